"""Site map: one menu and one row per page, with views, lists, feeds and downloads.

Every function takes the whole capture and a ``by`` that names a site (the
origin by default). What belongs to a page but can grow without end is a child
table keyed by route.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import norm, squeeze, text
from ..functions.urls import menu_id, route_or_path
from .joins import href_to_route, menu_item_of_action
from .records import assign_ids

SITE = ("origin",)


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


# -------------------------------------------------------------------- pages


def states_by_page(states: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """The little of each state that page tables need."""
    return states.select(
        *dict.fromkeys([*by, "session"]), F.col("id").alias("state_id"), "seq", route_or_path("route", "pathname").alias("route"), text(F.col("view.key")).alias("view_key"),
        text("title").alias("title"), F.coalesce("headings", F.array().cast("array<string>")).alias("headings"),
        F.coalesce(F.col("auth.logged_in"), F.lit(False)).alias("logged_in"),
    )


def site_pages(slim: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """One row per route: id, first title, first headings, counts, logged-in flag."""
    seen = F.struct("seq", "session", "state_id")
    pages = slim.groupBy(*by, "route").agg(
        F.min("seq").alias("first_seq"),
        F.coalesce(F.min_by("title", F.when(F.col("title") != "", seen)), F.lit("")).alias("title"),
        F.coalesce(F.min_by("headings", F.when(F.size("headings") > 0, seen)), F.array().cast("array<string>")).alias("headings"),
        F.max("logged_in").alias("logged_in"),
        F.count(F.lit(1)).alias("n_states"),
        F.count_distinct("view_key").alias("n_views"),
    )
    ids = assign_ids(pages, keys=["route"], first="first_seq", prefix="pg_", by=by, out="page_id").drop("first_seen")
    return pages.join(ids, [*by, "route"])


def page_views(slim: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    return slim.groupBy(*by, "route", "view_key").agg(F.count(F.lit(1)).alias("n_states"), F.min("seq").alias("first_seq"))


# --------------------------------------------------------------------- menu


def menu_sightings(states: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """One row per menu item per state."""
    return states.select(*by, F.col("id").alias("state_id"), "seq", F.posexplode("nav.menus").alias("pos", "m")).select(
        *by, "state_id", "seq", "pos", text("m.text").alias("text"), F.col("m.path").alias("path"), "m.href", "m.selector", "m.has_children"
    )


def merge_menu(sightings: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """Menu items merged by path; later sightings fill what earlier ones lacked.

    ``preorder`` sorts parents before their children and siblings in the order
    they were first seen.
    """
    own = F.when(F.size("path") > 0, F.col("path")).otherwise(F.array("text"))
    named = sightings.withColumn("path", own).withColumn("text", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.element_at("path", -1)))
    named = named.filter(F.trim("text") != "").withColumn("menu_id", menu_id(F.col("path")))
    seen = F.struct("seq", "pos")
    nodes = named.groupBy(*by, "menu_id").agg(
        F.min(seen).alias("first"),
        F.min_by("text", seen).alias("text"),
        F.min_by("path", seen).alias("path"),
        F.min_by("href", F.when(text("href") != "", seen)).alias("href"),
        F.coalesce(F.min_by("selector", F.when(text("selector") != "", seen)), F.lit("")).alias("selector"),
        F.max(F.coalesce("has_children", F.lit(False))).alias("has_children"),
        F.count_distinct("state_id").alias("n_states"),
    ).withColumn("depth", F.size("path") - 1)
    return _with_preorder(nodes, by)


def _prefixes(nodes: DataFrame, by: Sequence[str], proper: bool) -> DataFrame:
    """One row per node and level of its path: a path is short, so this stays small."""
    top = F.size("path") - (1 if proper else 0)
    levels = F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))
    return nodes.select(*by, "menu_id", "path", F.explode(levels).alias("level")).withColumn(
        "above", menu_id(F.slice("path", F.lit(1), F.col("level")))
    ).select(*by, "menu_id", "level", "above")


def _with_preorder(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    known = nodes.select(*by, F.col("menu_id").alias("above"), F.col("first").alias("__rank"))
    chain = _prefixes(nodes, by, proper=False).join(known, [*by, "above"], "left")
    ranked = chain.groupBy(*by, "menu_id").agg(
        F.array_sort(F.collect_list(F.struct("level", "__rank"))).alias("__chain"),
        F.max(F.when(F.col("__rank").isNull(), F.col("level"))).alias("__gap"),
    )
    preorder = F.transform(F.filter("__chain", lambda x: x["level"] > F.coalesce("__gap", F.lit(0))), lambda x: x["__rank"])
    parent = nodes.filter(F.size("path") > 1).select(*by, menu_id(F.slice("path", F.lit(1), F.size("path") - 1)).alias("menu_id")).distinct().withColumn("__parent", F.lit(True))
    return (
        nodes.join(ranked.withColumn("preorder", preorder).select(*by, "menu_id", "preorder"), [*by, "menu_id"])
        .join(parent, [*by, "menu_id"], "left")
        .withColumn("has_children", F.col("has_children") | F.coalesce("__parent", F.lit(False)))
        .drop("__parent")
    )


def menu_visits(menu: DataFrame, actions: DataFrame, outcomes: DataFrame, states: DataFrame, pages: DataFrame, *, by: Sequence[str] = SITE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(menu with visited, clicks, leads_to)``.

    An item is visited when an action pressed it (by menu path, else by
    selector) or its link is a recorded route; it leads to the pages those
    opened.
    """
    clicks = menu_item_of_action(actions, menu, by=by).distinct()
    route_of = states.select("session", F.col("id").alias("to_id"), route_or_path("route", "pathname").alias("to_route"))
    from_of = states.select("session", F.col("id").alias("from_id"), route_or_path("route", "pathname").alias("from_route"))
    led = (
        clicks.join(actions.select(*by, "session", F.col("id").alias("action_id"), F.col("route").alias("__at")), [*by, "session", "action_id"])
        .join(outcomes, ["session", "action_id"])
        .join(route_of, ["session", "to_id"])
        .join(from_of, ["session", "from_id"], "left")
        .filter(F.col("via_new_tab") | (F.col("to_route") != F.coalesce("from_route", "__at", F.lit(""))))
        .select(*by, "menu_id", F.col("to_route").alias("route"))
    )
    linked = href_to_route(menu.select(*by, "menu_id", "href"), pages.select(*by, "route"), by=by).select(*by, "menu_id", "route")
    leads = led.unionByName(linked).distinct().join(pages.select(*by, "route", "page_id"), [*by, "route"])
    visited = clicks.select(*by, "menu_id").unionByName(linked.select(*by, "menu_id")).distinct().withColumn("__v", F.lit(True))
    out = menu.join(visited, [*by, "menu_id"], "left").withColumn("visited", F.coalesce("__v", F.lit(False))).drop("__v")
    return out, clicks, leads


# -------------------------------------------------------- views, lists, feeds


def actions_with_route(actions: DataFrame, states: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    at = states.select("session", F.col("id").alias("state_id_at_time"), route_or_path("route", "pathname").alias("__at"))
    return actions.join(at, ["session", "state_id_at_time"], "left").withColumn("page_route", F.coalesce(F.nullif(F.col("route"), F.lit("")), "__at", F.lit(""))).drop("__at")


def view_options(states: DataFrame, placed: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """Options of view groups per page: visited when ever active or clicked, enabled when ever pressable."""
    groups = states.select(*by, "seq", route_or_path("route", "pathname").alias("route"), F.posexplode("nav.view_groups").alias("gpos", "g"))
    name = F.coalesce(*[F.nullif(F.col(f"g.{c}"), F.lit("")) for c in ("name", "label", "container_selector")])
    spread = groups.withColumn("group", name).filter(F.col("group").isNotNull()).select(
        *by, "seq", "route", "gpos", "group", F.col("g.kind").alias("kind"), F.col("g.label").alias("label"), F.posexplode("g.options").alias("opos", "o")
    )
    keyed = spread.withColumn("option", F.coalesce(F.nullif(norm("o.text"), F.lit("")), F.nullif(F.col("o.selector"), F.lit("")))).filter(F.col("option").isNotNull())
    seen = F.struct("seq", "gpos", "opos")
    merged = keyed.groupBy(*by, "route", "group", "option").agg(
        F.min(seen).alias("first"), F.min_by(text("o.text"), seen).alias("text"), F.min_by("o.selector", F.when(text("o.selector") != "", seen)).alias("selector"),
        F.min_by(F.coalesce("kind", F.lit("tabs")), seen).alias("kind"), F.min_by(text("label"), seen).alias("label"),
        F.max(F.coalesce("o.active", F.lit(False))).alias("active"), F.max(~F.coalesce("o.disabled", F.lit(False))).alias("enabled"),
    )
    pressed = placed.filter(text("view_group") != "").select(
        *by, F.col("page_route").alias("route"), F.col("view_group").alias("group"),
        F.explode(F.array(F.concat(F.lit("t:"), norm("label")), F.concat(F.lit("t:"), norm("chosen")), F.concat(F.lit("s:"), text("selectors.primary")))).alias("__press"),
    ).filter(F.length("__press") > 2).distinct()
    how = merged.select(*by, "route", "group", "option", F.explode(F.array(F.concat(F.lit("t:"), norm("text")), F.concat(F.lit("s:"), text("selector")))).alias("__press")).filter(F.length("__press") > 2)
    hit = how.join(pressed, [*by, "route", "group", "__press"], "left_semi").select(*by, "route", "group", "option").distinct().withColumn("__hit", F.lit(True))
    return merged.join(hit, [*by, "route", "group", "option"], "left").withColumn("visited", F.col("active") | F.coalesce("__hit", F.lit(False))).drop("__hit", "active")


def list_status(states: DataFrame, placed: DataFrame, outcomes: DataFrame, downloads: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """Lists per page: has pagination, was paged, an item was opened, a download was seen."""
    at = route_or_path("route", "pathname").alias("route")
    one = lambda kind, col, size, head: states.select(*by, "seq", F.col("id").alias("state_id"), at, F.explode(f"lists.{col}").alias("p")).select(
        *by, "seq", "state_id", "route", F.lit(kind).alias("kind"), F.col("p.container_selector").alias("selector"), F.col(f"p.{size}").alias("n_rows"),
        (F.size("p.headers") if head else F.lit(0)).alias("n_headers"))
    seen = one("table", "tables", "row_count", True).unionByName(one("repeat", "repeats", "item_count", False)).filter(text("selector") != "")
    lists = seen.groupBy(*by, "route", "kind", "selector").agg(F.min("seq").alias("first_seq"), F.max("n_headers").alias("n_headers"))
    pager = states.select(*by, at, F.explode("lists.pagination").alias("p")).filter(
        (text("p.next") != "") | (text("p.prev") != "") | (text("p.page_indicator") != "")
    ).select(*by, "route").distinct().withColumn("has_pagination", F.lit(True))
    paged = placed.filter(_flag("pagination")).select(*by, F.col("page_route").alias("route")).distinct().withColumn("paged", F.lit(True))
    ends = states.select("session", F.col("id"), at, text(F.col("view.key")).alias("view"))
    to = ends.withColumnsRenamed({"id": "to_id", "route": "__tr", "view": "__tv"})
    frm = ends.withColumnsRenamed({"id": "from_id", "route": "__fr", "view": "__fv"})
    went = (
        placed.filter(text("list_selector") != "")
        .select(*by, "session", F.col("id").alias("action_id"), F.col("page_route").alias("route"), F.col("list_selector").alias("selector"),
                (_flag("pagination") | (text("view_group") != "")).alias("__paging"), F.col("route").alias("__ar"), text("view_key").alias("__av"))
        .join(outcomes, ["session", "action_id"], "left").join(to, ["session", "to_id"], "left").join(frm, ["session", "from_id"], "left")
        .join(downloads.filter(F.col("action_id").isNotNull()).select("session", "action_id").distinct().withColumn("__dl", F.lit(True)), ["session", "action_id"], "left")
    )
    moved = F.coalesce(F.col("via_new_tab"), F.lit(False)) | F.coalesce((F.col("__tr") != F.coalesce("__fr", "__ar", F.lit(""))) | (F.col("__tv") != F.coalesce("__fv", "__av")), F.lit(False))
    inside = went.groupBy(*by, "route", "selector").agg(
        F.max(~F.col("__paging") & F.col("to_id").isNotNull() & moved).alias("item_opened"), F.max(F.coalesce("__dl", F.lit(False))).alias("download_seen")
    )
    return lists.join(pager, [*by, "route"], "left").join(paged, [*by, "route"], "left").join(inside, [*by, "route", "selector"], "left").fillna(
        False, ["has_pagination", "paged", "item_opened", "download_seen"]
    )


def page_endpoints(slim: DataFrame, fed: DataFrame, call_map: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """``(by…, route, endpoint_id)``: endpoints called on a page's states."""
    ids = list(dict.fromkeys([*by, "session"]))
    placed = fed.filter(F.col("state_id").isNotNull()).join(slim.select(*ids, "state_id", "route"), [*ids, "state_id"])
    return placed.join(call_map.select(*ids, "net_id", "endpoint_id"), [*ids, "net_id"]).select(*by, "route", "endpoint_id").distinct()


def list_feeds(states: DataFrame, fed: DataFrame, call_map: DataFrame, row_lengths: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """``(by…, route, kind, selector, endpoint_id)``: what fills each list.

    The endpoint whose response array is as long as the list has rows (two or
    more) on the same state; else every list-like endpoint of the page.
    ``row_lengths`` holds ``(by…, session, net_id, len)``.
    """
    ids = list(dict.fromkeys([*by, "session"]))
    at = route_or_path("route", "pathname").alias("route")
    one = lambda kind, col, size: states.select(*ids, F.col("id").alias("state_id"), at, F.explode(f"lists.{col}").alias("p")).select(
        *ids, "state_id", "route", F.lit(kind).alias("kind"), F.col("p.container_selector").alias("selector"), F.col(f"p.{size}").alias("len"))
    lists = one("table", "tables", "row_count").unionByName(one("repeat", "repeats", "item_count")).filter(text("selector") != "").distinct()
    sized = (
        fed.filter(F.col("state_id").isNotNull()).join(row_lengths, [*ids, "net_id"]).join(call_map.select(*ids, "net_id", "endpoint_id"), [*ids, "net_id"])
        .select(*ids, "state_id", F.col("len").cast("bigint").alias("len"), "endpoint_id").distinct()
    )
    exact = lists.filter(F.col("len") >= 2).join(sized, [*ids, "state_id", "len"]).select(*by, "route", "kind", "selector", "endpoint_id").distinct()
    routes = states.select(*ids, F.col("id").alias("state_id"), at)
    listlike = sized.join(routes, [*ids, "state_id"]).select(*by, "route", "endpoint_id").distinct()
    rest = lists.select(*by, "route", "kind", "selector").distinct().join(exact, [*by, "route", "kind", "selector"], "left_anti")
    return exact.unionByName(rest.join(listlike, [*by, "route"]))


def page_downloads(downloads: DataFrame, states: DataFrame, actions: DataFrame, pages: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """``(by…, route, download_id)``: by recorded route, else by state, else by action."""
    known = pages.select(*by, "route", F.lit(True).alias("__known"))
    at = states.select("session", F.col("id").alias("state_id_at_time"), route_or_path("route", "pathname").alias("__state_route"))
    act = actions.select("session", F.col("id").alias("action_id"), F.nullif(F.col("route"), F.lit("")).alias("__action_route"))
    found = downloads.join(known, [*by, "route"], "left").join(at, ["session", "state_id_at_time"], "left").join(act, ["session", "action_id"], "left")
    route = F.coalesce(F.when(F.col("__known"), F.col("route")), "__state_route", "__action_route", "route")
    return found.select(*by, route.alias("route"), F.col("id").alias("download_id")).join(pages.select(*by, "route"), [*by, "route"], "left_semi")


# ------------------------------------------------------------------- labels


def page_labels(pages: DataFrame, leads: DataFrame | None = None, menu: DataFrame | None = None, *, by: Sequence[str] = SITE, limit: int = 60) -> DataFrame:
    """A name for each page that no other page has.

    The title when it is the page's alone, else a heading no other page has,
    else the menu item that leads there, else the route. Counts are aggregates
    joined back, not windows, so a title shared by most pages is no hot task.
    """
    titled = pages.withColumn("__t", norm("title"))
    titles = titled.filter(F.col("__t") != "").groupBy(*by, "__t").agg(F.count(F.lit(1)).alias("__tn"))
    spread = pages.select(*by, "page_id", F.posexplode("headings").alias("pos", "heading")).withColumn("__h", norm("heading")).filter(F.col("__h") != "")
    unique = spread.select(*by, "page_id", "__h").distinct().groupBy(*by, "__h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 1)
    own = spread.join(unique, [*by, "__h"], "left_semi").groupBy(*by, "page_id").agg(F.min_by("heading", "pos").alias("__heading"))
    base = titled.join(titles, [*by, "__t"], "left").join(own, [*by, "page_id"], "left")
    if leads is not None and menu is not None:
        first = leads.join(menu.select(*by, "menu_id", "preorder", "text"), [*by, "menu_id"]).groupBy(*by, "page_id").agg(F.min_by("text", "preorder").alias("__menu"))
        base = base.join(first, [*by, "page_id"], "left")
    else:
        base = base.withColumn("__menu", F.lit(None).cast("string"))

    def short(c: Column) -> Column:
        t = squeeze(c)
        return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)

    chosen = F.when(F.col("__tn") == 1, short(F.col("title"))).when(F.col("__heading").isNotNull(), short(F.col("__heading"))).when(F.col("__menu").isNotNull(), short(F.col("__menu")))
    named = base.withColumn("label", F.coalesce(F.nullif(chosen, F.lit("")), F.col("route"))).withColumn("__n", norm("label"))
    clash = named.groupBy(*by, "__n").agg(F.count(F.lit(1)).alias("__same"))
    final = F.when((F.col("__same") > 1) & (F.col("label") != F.col("route")), F.concat("label", F.lit(" ("), "route", F.lit(")"))).otherwise(F.col("label"))
    return named.join(clash, [*by, "__n"]).select(*by, "page_id", "route", final.alias("label"))


def pages_in_menu_order(pages: DataFrame, leads: DataFrame, menu: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """Pages with the menu item that leads there first; the rest follow by first visit."""
    rank = leads.join(menu.select(*by, "menu_id", "preorder"), [*by, "menu_id"]).groupBy(*by, "page_id").agg(F.min("preorder").alias("menu_rank"))
    return pages.join(rank, [*by, "page_id"], "left").orderBy(*by, F.col("menu_rank").asc_nulls_last(), "first_seq", "route")
