"""URL projections. Everything here is a plain column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .exprs import as_col, decode_percent, first_of, literal_array, squeeze, strip, text, word_tokens
from .redaction import scrub_expr

ID = "{id}"
_AUTHORITY = r"(?i)^\s*(https?)://(?:[^/?#\\]*@)?(\[[^\]/?#]*\]|[^/?#\\:]*)(?::(\d*))?(?=[/?#\\]|\z)"


def origin_of(url: Column | str) -> Column:
    """``scheme://host[:port]`` in lower case, default ports dropped, NULL unless http(s)."""
    u = as_col(url)
    scheme = F.lower(F.regexp_extract(u, _AUTHORITY, 1))
    host = F.lower(F.regexp_extract(u, _AUTHORITY, 2))
    port = F.regexp_replace(F.regexp_extract(u, _AUTHORITY, 3), "^0+(?=.)", "")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    tail = F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, tail))


def host_of(url: Column | str) -> Column:
    """Host without port or user info, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(text(url), _AUTHORITY, 2))


def path_of(url: Column | str) -> Column:
    """Path of an absolute URL as written; empty when it cannot be read."""
    u = text(url)
    path = F.regexp_extract(u, P.URL, 3)
    return F.when(~u.rlike(P.URL), "").when(path == "", "/").otherwise(path)


def absolute_call_url(url: Column | str, base: Column | None = None) -> Column:
    """A recorded call address made absolute; NULL when there is nothing to resolve it on."""
    u = strip(text(url))
    b = F.coalesce(base, F.lit("")) if base is not None else F.lit("")
    scheme = F.regexp_extract(b, P.URL, 1)
    slash = F.when(u.startswith("/"), "").otherwise("/")
    return (
        F.when(u == "", None)
        .when(u.startswith("//"), F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), u))
        .when(u.rlike("(?i)^[a-z][a-z0-9+.-]*:"), u)
        .when(b != "", F.concat(F.regexp_replace(b, r"/+\z", ""), slash, u))
    )


def path_segments(path: Column) -> Column:
    """Decoded path segments without matrix parameters and without empty ones."""
    parts = F.transform(F.split(path, "/", -1), lambda s: decode_percent(F.substring_index(s, ";", 1)))
    return F.filter(parts, lambda s: s != "")


def parameter_names(query: Column) -> Column:
    """Distinct, sorted parameter names of a query string."""
    names = F.transform(
        F.split(query, "&", -1),
        lambda p: strip(decode_percent(F.replace(F.substring_index(p, "=", 1), F.lit("+"), F.lit(" ")))),
    )
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def parse_call_url(url: Column | str, base: Column | None = None) -> Column:
    """``struct(scheme, host, segments, query_keys, ext)``; NULL unless http(s).

    Works on the text itself, so a redaction placeholder inside an address
    survives.
    """
    u = F.coalesce(absolute_call_url(url, base), F.lit(""))
    scheme = F.lower(F.regexp_extract(u, P.URL, 1))
    host = F.lower(F.regexp_replace(F.regexp_extract(u, P.URL, 2), "^[^@]*@", ""))
    segments = path_segments(F.regexp_extract(u, P.URL, 3))
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    return F.when(
        scheme.isin("http", "https"),
        F.struct(
            scheme.alias("scheme"),
            host.alias("host"),
            segments.alias("segments"),
            parameter_names(F.regexp_extract(u, P.URL, 4)).alias("query_keys"),
            F.lower(F.regexp_extract(last, P.SEGMENT_EXTENSION, 1)).alias("ext"),
        ),
    )


def _fragment(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)(#.*)", 1)


def fragment_route(url: Column) -> Column:
    """The path part of a routing fragment (``#/…`` or ``#!/…``), else empty."""
    return F.regexp_extract(_fragment(url), r"^(#!?/[^?]*)", 1)


def route_of(url: Column | str, packs: Sequence[str] | None = ("generic",)) -> Column:
    """Which page an address is: path plus routing fragment, no query, scrubbed."""
    u = text(url)
    path = F.regexp_extract(u, P.URL, 3)
    raw = F.concat(F.when(path == "", "/").otherwise(path), fragment_route(u))
    return scrub_expr(raw, packs) if packs else raw


def route_or_path(route: Column | str, pathname: Column | str) -> Column:
    """Stored route, else the path, else ``/``."""
    return F.coalesce(F.nullif(as_col(route), F.lit("")), F.nullif(as_col(pathname), F.lit("")), F.lit("/"))


def query_keys(url: Column | str, packs: Sequence[str] | None = ("generic",), limit: int | None = None) -> Column:
    """Names from the query and from a fragment query, sorted, ``limit`` of them if asked."""
    u = text(url)
    frag = _fragment(u)
    frag_query = F.when(frag.contains("?"), F.substring(frag, F.instr(frag, "?") + 1, F.length(frag))).otherwise("")
    names = F.concat(parameter_names(F.regexp_extract(u, P.URL, 4)), parameter_names(frag_query))
    if packs:
        names = F.filter(F.transform(names, lambda n: scrub_expr(n, packs)), lambda n: n != "")
    return first_of(F.array_sort(F.array_distinct(names)), limit)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` the way a browser does."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(parts, -1)
    folded = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|\z)"), F.when(folded.startswith("/"), folded).otherwise(F.concat(F.lit("/"), folded))).otherwise(path)


def clean_href(href: Column | str, base: Column | str, packs: Sequence[str] | None = ("generic",)) -> Column:
    """A link target as a route; other origins keep their origin in front.

    NULL for scripts, mail, phone and data links and for bare fragments.
    """
    raw, b = strip(text(href)), text(base)
    base_origin, base_path = origin_of(b), path_of(b)
    base_scheme = F.lower(F.regexp_extract(b, P.URL, 1))
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    before_fragment = F.substring_index(raw, "#", 1)
    own = F.substring_index(before_fragment, "?", 1)
    absolute = raw.rlike("(?i)^[a-z][a-z0-9+.-]*:")
    full = F.when(raw.startswith("//"), F.concat(base_scheme, F.lit(":"), raw)).otherwise(raw)
    rooted = (
        F.when(absolute | raw.startswith("//"), path_of(full))
        .when(before_fragment == "", base_path)
        .when(own == "", base_path)
        .when(own.startswith("/"), own)
        .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    )
    target_origin = F.when(absolute | raw.startswith("//"), origin_of(full)).otherwise(base_origin)
    front = F.when(target_origin == base_origin, "").otherwise(F.coalesce(target_origin, F.lit("")))
    out = F.concat(front, _fold_dots(rooted), fragment_route(raw))
    usable = (
        (raw != "")
        & ~raw.rlike(P.SCRIPTED_HREF)
        & (~raw.startswith("#") | raw.rlike(P.ROUTED_FRAGMENT))
        & (~absolute | raw.rlike("(?i)^https?://"))
    )
    return F.when(usable, scrub_expr(out, packs) if packs else out)


# ------------------------------------------------------------ identifiers


def _class_changes(seg: Column) -> Column:
    return F.regexp_count(seg, F.lit("[a-z]+|[A-Z]+|[0-9]+|[_-]+")) - 1


def looks_like_id(seg: Column | str) -> Column:
    """Digits, UUIDs, long hex, redaction placeholders and opaque tokens.

    A token is told from a long name by how often the character class changes
    between neighbours: at four changes in ten or more it is opaque.
    """
    s = as_col(seg)
    token = (
        s.rlike(P.TOKEN)
        & s.rlike("[0-9]")
        & s.rlike("[A-Za-z]")
        & (_class_changes(s) * 10 >= (F.length(s) - 1) * 4)
    )
    return (s == ID) | s.rlike(P.PLACEHOLDER) | s.rlike(r"^[0-9]+\z") | s.rlike(P.UUID) | s.rlike(P.HEX_RUN) | token


def template_segment(seg: Column | str) -> Column:
    """``{id}``, ``{id}.ext`` or the segment unchanged."""
    s = as_col(seg)
    ext = F.regexp_extract(s, P.SEGMENT_EXTENSION, 1)
    stem = F.regexp_replace(s, P.SEGMENT_EXTENSION, "")
    return (
        F.when(looks_like_id(s), ID)
        .when((ext != "") & looks_like_id(stem), F.concat(F.lit(ID + "."), F.lower(ext)))
        .otherwise(s)
    )


def template_segments(segments: Column) -> Column:
    return F.transform(segments, template_segment)


def template_url(url: Column | str, base: Column | None = None) -> Column:
    """The address with identifier-like segments replaced; unchanged if unreadable."""
    u = parse_call_url(url, base)
    path = F.array_join(template_segments(u["segments"]), "/")
    return F.when(u.isNull(), text(url)).otherwise(F.concat(u["scheme"], F.lit("://"), u["host"], F.lit("/"), path))


def split_extension(name: Column | str) -> Column:
    """``struct(stem, ext)``: a known extension, else NULL and the whole name."""
    n = as_col(name)
    ext = F.lower(F.regexp_extract(n, P.FILE_EXTENSION, 1))
    known = ext.isin(*P.KNOWN_EXTENSIONS)
    return F.struct(
        F.when(known, F.regexp_replace(n, P.FILE_EXTENSION, "")).otherwise(n).alias("stem"),
        F.when(known, ext).alias("ext"),
    )


def _scrub_segment(seg: Column) -> Column:
    part = split_extension(decode_percent(seg))
    stem, ext = part["stem"], part["ext"]
    idlike = (
        stem.rlike("[0-9]{6,}")
        | stem.rlike(P.UUID)
        | stem.rlike(P.HEX_RUN)
        | (stem.rlike(P.TOKEN) & stem.rlike("[0-9]"))
    )
    return F.when(
        (seg != "") & idlike, F.concat(F.lit(ID), F.coalesce(F.concat(F.lit("."), ext), F.lit("")))
    ).otherwise(seg)


def scrub_url(url: Column | str, keep_route: bool = False) -> Column:
    """Origin and path with identifier-shaped segments replaced; NULL unless http(s).

    Looser than :func:`looks_like_id` on purpose: download addresses come
    straight from a browser and have seen no redaction.
    """
    u = text(url)

    def scrubbed(path: Column) -> Column:
        return F.array_join(F.transform(F.split(path, "/", -1), _scrub_segment), "/")

    path = F.regexp_extract(u, P.URL, 3)
    out = F.concat(origin_of(u), scrubbed(F.when(path == "", "/").otherwise(path)))
    if keep_route:
        out = F.concat(out, scrubbed(fragment_route(u)))
    return out


def without_query(url: Column | str) -> Column:
    return F.substring_index(F.substring_index(text(url), "#", 1), "?", 1)


def is_static_asset(ext: Column, mime: Column | str, is_download: Column | str | None = None) -> Column:
    """Scripts, styles, images, fonts and source maps; never a file the site hands over."""
    m = text(mime)
    by_ext = (ext == "map") | (ext.isin(*P.STATIC_EXTENSIONS) & ~m.rlike("(?i)json|xml"))
    kept = F.lit(False) if is_download is None else F.coalesce(as_col(is_download), F.lit(False))
    return ~kept & (m.rlike(P.STATIC_MIME) | by_ext)


# -------------------------------------------------------------- parameters


def is_paging_param(name: Column | str) -> Column:
    """Whether a parameter name means paging, judged by the name alone."""
    n = text(name)
    words = word_tokens_lower(n)
    return (
        F.regexp_replace(F.lower(n), "[^a-z0-9]+", "").isin(*P.PAGING_EXACT)
        | F.arrays_overlap(words, literal_array(P.PAGING_ANYWHERE))
        | (F.arrays_overlap(words, literal_array(P.PAGING_UNIT)) & F.arrays_overlap(words, literal_array(P.PAGING_NOUN)))
    )


def word_tokens_lower(n: Column) -> Column:
    spaced = F.lower(F.regexp_replace(n, "([a-z0-9])([A-Z])", "$1 $2"))
    return F.filter(F.split(spaced, "[^a-z0-9]+", -1), lambda w: w != "")


def is_position_param(name: Column | str) -> Column:
    """Parameters that choose where a page starts rather than how long it is."""
    words = F.regexp_replace(F.regexp_replace(text(name), "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return words.rlike(P.POSITION_WORD) & ~words.rlike(P.SIZE_WORD)


def id_tokens(name: Column | str) -> Column:
    return word_tokens(text(name), "[^A-Za-z]+")


def write_verb(name: Column | str) -> Column:
    """First word of an identifier that is a write verb, else NULL."""
    return F.get(F.filter(id_tokens(name), lambda w: w.rlike(P.WRITE_VERB)), F.lit(0))


# --------------------------------------------------------------- menu keys


def menu_id(path: Column) -> Column:
    """Comparison key of a menu path (an array of labels)."""
    return F.lower(F.array_join(F.transform(F.coalesce(path, F.array().cast("array<string>")), lambda p: squeeze(text(p))), " > "))


def trim_route(route: Column | str) -> Column:
    r = as_col(route)
    return F.when((F.length(r) > 1) & r.endswith("/"), F.substring(r, F.lit(1), F.length(r) - 1)).otherwise(r)


def href_matches_route(href: Column | str, route: Column | str) -> Column:
    """Equal but for a trailing slash, or a bare fragment the route ends in."""
    h, r = trim_route(text(href)), trim_route(text(route))
    return (h != "") & (r != "") & ((h == r) | (h.startswith("#") & (F.length(h) > 1) & r.endswith(h)))
