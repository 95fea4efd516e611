"""Response headers: type, size, disposition. Headers are ``array<struct<name,value>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .exprs import as_col, strip, text

_FILE_NAME = r"(?i)filename\*?\s*=\s*(?:[\w!#$%&+^`{}~-]*'[^']*')?\s*\"?([^\";]*)"


def header_value(headers: Column | str, name: str) -> Column:
    """Value of the first header of that name, in any case; NULL when absent."""
    return F.get(F.filter(as_col(headers), lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def mime_of(headers: Column | str) -> Column:
    return F.trim(F.substring_index(text(header_value(headers, "content-type")), ";", 1))


def content_length(headers: Column | str) -> Column:
    digits = F.regexp_extract(text(header_value(headers, "content-length")), r"^\s*([+-]?[0-9]+)", 1)
    return F.coalesce(F.try_to_number(F.nullif(F.replace(digits, F.lit("+"), F.lit("")), F.lit("")), F.lit("S999999999999999999")).cast("long"), F.lit(-1))


def content_disposition(headers: Column | str) -> Column:
    """``struct(kind, ext)``; kind is attachment, inline or NULL."""
    raw = text(header_value(headers, "content-disposition"))
    first = F.lower(strip(F.substring_index(raw, ";", 1)))
    ext = F.lower(F.regexp_extract(F.regexp_extract(raw, _FILE_NAME, 1), r"\.([A-Za-z0-9]{1,8})\s*\z", 1))
    return F.struct(
        F.when(first.isin("attachment", "inline"), first).alias("kind"), F.nullif(ext, F.lit("")).alias("ext")
    )


def without_file_names(headers: Column | str) -> Column:
    """The headers with every content-disposition rewritten without its file name."""

    def clean(h: Column) -> Column:
        raw = text(h["value"])
        first = F.lower(strip(F.substring_index(raw, ";", 1)))
        ext = F.lower(F.regexp_extract(raw, "\\.([A-Za-z0-9]{1,8})[\"'\\s]*\\z", 1))
        suffix = F.when(ext.isin(*P.KNOWN_EXTENSIONS), F.concat(F.lit("."), ext)).otherwise("")
        named = F.when(raw.rlike("(?i)filename"), F.concat(F.lit("; filename=<redacted>"), suffix)).otherwise("")
        kind = F.when(first.rlike(r"^[a-z-]+\z"), first).otherwise("unknown")
        return F.when(
            F.lower(h["name"]) == "content-disposition",
            F.struct(h["name"].alias("name"), F.concat(kind, named).alias("value")),
        ).otherwise(h)

    return F.transform(as_col(headers), clean)


def is_download(headers: Column | str) -> Column:
    """Served as an attachment, or as a document type browsers save."""
    return (F.coalesce(content_disposition(headers)["kind"], F.lit("")) == "attachment") | mime_of(headers).rlike(
        P.BINARY_DOCUMENT_MIME
    )
