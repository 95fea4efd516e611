"""Identity of a page state: view key, signature, open menus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import text


def _key_safe(c: Column) -> Column:
    """Group and option names without the two signs the key is built from."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), "[=|]", " "), r"\s+", " "))


def view_key(view_groups: Column, pagination: Column) -> Column:
    """``group=option+option|…|page=n``: what is selected on a page, groups in order of name."""
    groups = F.filter(
        F.transform(
            F.coalesce(view_groups, F.array().cast(_GROUPS)),
            lambda g: F.struct(
                text(g["name"]).alias("name"),
                F.transform(F.filter(g["options"], lambda o: F.coalesce(o["active"], F.lit(False))), lambda o: _key_safe(o["text"])).alias("on"),
            ),
        ),
        lambda g: F.size(g["on"]) > 0,
    )
    parts = F.transform(F.array_sort(groups), lambda g: F.concat(g["name"], F.lit("="), F.array_join(g["on"], "+")))
    current = F.filter(
        F.transform(F.coalesce(pagination, F.array().cast(_PAGERS)), lambda p: _key_safe(p["current"])), lambda v: v != ""
    )
    pages = F.array_distinct(current)
    page = F.when(F.size(pages) > 0, F.array(F.concat(F.lit("page="), F.array_join(pages, ",")))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.concat(parts, page), "|")


_GROUPS = "array<struct<kind:string,label:string,name:string,container_selector:string,options:array<struct<text:string,selector:string,active:boolean,disabled:boolean>>>>"
_PAGERS = "array<struct<container_selector:string,style:string,next:string,prev:string,page_indicator:string,current:string>>"


def state_signature(route: Column, title: Column, control_keys: Column, view: Column, open_menus: Column | None = None) -> Column:
    """Text two states share when they look the same."""
    base = F.concat_ws("::", text(route), text(title), F.array_join(F.coalesce(control_keys, F.array().cast("array<string>")), "|"), text(view))
    if open_menus is None:
        return base
    return F.when(text(open_menus) == "", base).otherwise(F.concat(base, F.lit("::open="), text(open_menus)))


def errors_key(errors: Column) -> Column:
    return F.array_join(F.coalesce(errors, F.array().cast("array<string>")), " | ")
