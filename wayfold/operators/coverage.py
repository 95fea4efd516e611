"""Coverage: what was seen and never opened, and the reports built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions.exprs import at_most, squeeze, text
from ..functions.names import cell, code, shorten, state_stem
from ..functions.urls import menu_id, route_or_path
from .sitemap import _prefixes

SITE = ("origin",)

# ---- fixed values: order of hint classes and how many are shown --------------
HINT_CLASSES = ("menu", "view", "paging", "open", "download")

# ---- fixed values: sentences of findings and titles of the attention list ----
SENTENCES = {
    "menu": 'Menu item "%s" was seen but never opened.',
    "view": 'On "%s", the %s "%s"%s was never %s.',
    "paging": 'The list on "%s" has more pages but "next page" was never clicked.',
    "open": 'No item was opened from the list on "%s".',
    "open_many": 'No item was opened from any of the %d lists on "%s".',
    "download": 'No download was recorded on "%s" although the page has download links.',
}
SECTIONS = {
    "fragile": "Fragile selectors", "weak_label": "Weak label sources", "not_unique": "Non-unique primary selectors", "same_id": "Duplicate ids on a page",
    "once": "Controls seen only once", "collides": "Key collisions across pages", "id_varies": "Ids that changed between captures",
    "widget": "Widget-backed controls (do not type into these)", "unknown": "Entry mode unknown", "secret": "Redacted controls — human-only, never automate",
    "danger": "Buttons the automation must never activate", "frames": "Embedded frames that were not recorded (blind spots)",
    "throttled": "States captured while DOM triggers were throttled",
}


def _plain(c: Column | str) -> Column:
    """Safe between double quotes in a sentence."""
    return F.trim(F.replace(squeeze(text(c)), F.lit('"'), F.lit("'")))


def is_logout(href: Column | str) -> Column:
    return text(href).rlike(P.LOGOUT_PATH)


def menu_covered(menu: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """Menu items that count, with ``covered``. Logout links are left out.

    A heading without an address is covered once everything under it is. Worked
    out from below in one pass: an item that fails on its own takes down the
    unbroken line of such headings above it.
    """
    counted = menu.filter(~is_logout("href"))
    parent = F.when(F.size("path") > 1, menu_id(F.slice("path", F.lit(1), F.size("path") - 1)))
    kids = counted.filter(F.size("path") > 1).select(*by, parent.alias("menu_id")).distinct().withColumn("__kids", F.lit(True))
    flagged = counted.join(kids, [*by, "menu_id"], "left").withColumns(
        {"__heading": ~F.col("visited") & F.col("has_children") & (text("href") == ""), "__kids": F.coalesce("__kids", F.lit(False))}
    )
    fails = flagged.filter(~F.col("visited") & ~(F.col("__heading") & F.col("__kids")))
    lines = _prefixes(fails, by, proper=True).join(
        flagged.select(*by, F.col("menu_id").alias("above"), F.col("__heading").alias("__h")), [*by, "above"], "left"
    )
    # The lowest level above a failing item that is not such a heading stops it.
    stop = lines.groupBy(*by, "menu_id").agg(F.max(F.when(~F.coalesce("__h", F.lit(False)), F.col("level"))).alias("__stop"))
    dragged = lines.join(stop, [*by, "menu_id"]).filter(F.col("level") > F.coalesce("__stop", F.lit(0))).select(*by, F.col("above").alias("menu_id"))
    missed = fails.select(*by, "menu_id").unionByName(dragged).distinct().withColumn("__missed", F.lit(True))
    return counted.join(missed, [*by, "menu_id"], "left").withColumn("covered", F.col("__missed").isNull()).drop("__missed")


def unvisited_menu(covered: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    return covered.filter(~F.col("covered")).select(*by, "menu_id", "text", "path", "selector", "preorder")


def page_gaps(pages: DataFrame, labels: DataFrame, options: DataFrame, lists: DataFrame, downloads: DataFrame, offers: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """``(by…, route, class, place, sentence)``: everything a page left undone.

    ``options``, ``lists`` and ``downloads`` come from the site map; ``offers``
    lists routes that show something to download.
    """
    named = pages.select(*by, "route", "page_id", "first_seq").join(labels.select(*by, "page_id", "label"), [*by, "page_id"], "left").withColumn("__name", _plain(F.coalesce("label", "route")))
    keep = [*by, "route", "first_seq", "__name"]
    what = F.when(F.col("kind") == "tabs", "tab").when(F.col("kind") == "chips", "filter option").otherwise("option")
    verb = F.when(F.col("kind") == "tabs", "opened").otherwise("selected")
    of = F.when(F.col("glabel") != "", F.concat(F.lit(' of "'), _plain("glabel"), F.lit('"'))).otherwise("")
    skipped = options.withColumnsRenamed({"label": "glabel"}).filter(~F.col("visited") & F.col("enabled")).join(named, [*by, "route"])
    views = skipped.select(*keep, F.lit("view").alias("class"), F.col("first").cast("string").alias("place"), F.format_string(
        SENTENCES["view"], F.col("__name"), what, F.coalesce(F.nullif(_plain("text"), F.lit("")), _plain("selector")), of, verb).alias("sentence"))
    per_page = lists.groupBy(*by, "route").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("has_pagination") & ~F.col("paged")).alias("unpaged"), F.max("item_opened").alias("opened")).join(named, [*by, "route"])
    paging = per_page.filter("unpaged").select(*keep, F.lit("paging").alias("class"), F.lit("").alias("place"), F.format_string(SENTENCES["paging"], F.col("__name")).alias("sentence"))
    unopened = per_page.filter(~F.col("opened")).select(*keep, F.lit("open").alias("class"), F.lit("").alias("place"), F.when(
        F.col("n") > 1, F.format_string(SENTENCES["open_many"], F.col("n"), F.col("__name"))).otherwise(F.format_string(SENTENCES["open"], F.col("__name"))).alias("sentence"))
    untaken = offers.select(*by, "route").distinct().join(downloads.select(*by, "route").distinct(), [*by, "route"], "left_anti").join(named, [*by, "route"]).select(
        *keep, F.lit("download").alias("class"), F.lit("").alias("place"), F.format_string(SENTENCES["download"], F.col("__name")).alias("sentence"))
    return views.unionByName(paging).unionByName(unopened).unionByName(untaken).drop("__name")


def offers_download(states: DataFrame, actions: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    shows = (F.size("lists.downloads") > 0) | F.exists("lists.repeats", lambda r: F.coalesce(r["has_download"], F.lit(False)))
    seen = states.filter(F.coalesce(shows, F.lit(False))).select(*by, route_or_path("route", "pathname").alias("route"))
    return seen.unionByName(actions.filter(F.coalesce("download", F.lit(False)) & (text("route") != "")).select(*by, "route")).distinct()


def page_coverage(pages: DataFrame, gaps: DataFrame, states: DataFrame, downloads: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """One row per page: calls seen, downloads taken, number of gaps, complete or not."""
    calls = states.select(*by, "session", route_or_path("route", "pathname").alias("route"), F.explode("net_refs").alias("n")).distinct().groupBy(*by, "route").agg(F.count(F.lit(1)).alias("api_calls"))
    taken = downloads.groupBy(*by, "route").agg(F.count(F.lit(1)).alias("downloads"))
    missing = gaps.groupBy(*by, "route").agg(F.count(F.lit(1)).alias("n_missing"))
    return (
        pages.select(*by, "page_id", "route", "title")
        .join(calls, [*by, "route"], "left").join(taken, [*by, "route"], "left").join(missing, [*by, "route"], "left")
        .fillna(0, ["api_calls", "downloads", "n_missing"])
        .withColumn("complete", F.col("n_missing") == 0)
    )


def coverage_totals(covered: DataFrame, pages: DataFrame, options: DataFrame, lists: DataFrame, downloads: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """The eight counters per site."""
    count = F.count(F.lit(1))
    some = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))
    menu = covered.groupBy(*by).agg(count.alias("menu_items"), some(F.col("covered")).alias("menu_visited"))
    page = pages.groupBy(*by).agg(count.alias("pages"))
    view = options.groupBy(*by).agg(count.alias("view_options"), some(F.col("visited")).alias("view_options_visited"))
    lst = lists.groupBy(*by).agg(count.alias("lists"), some(F.col("paged") & F.col("has_pagination")).alias("lists_paged"))
    down = downloads.groupBy(*by).agg(count.alias("downloads"))
    out = page
    for other in (menu, view, lst, down):
        out = out.join(other, list(by), "full_outer")
    names = ["menu_items", "menu_visited", "pages", "view_options", "view_options_visited", "lists", "lists_paged", "downloads"]
    return out.select(*by, *names).fillna(0, names)


def coverage_hints(covered: DataFrame, gaps: DataFrame, *, by: Sequence[str] = SITE, limit: int | None = None) -> DataFrame:
    """Findings per site, the most valuable first (``limit`` of them if asked): menu, views, paging, opening, downloads."""
    menu = covered.filter(~F.col("covered")).select(
        *by, F.lit("menu").alias("class"), F.lit(0).cast("bigint").alias("first_seq"), F.to_json("preorder").alias("place"),
        F.format_string(SENTENCES["menu"], _plain(F.array_join("path", " > "))).alias("sentence"),
    )
    every = menu.unionByName(gaps.select(*by, "class", "first_seq", "place", "sentence"))
    rank = F.array_position(F.array(*[F.lit(c) for c in HINT_CLASSES]), F.col("class"))
    # A row_number under a small limit is cut down on the map side before the shuffle.
    order = Window.partitionBy(*by).orderBy(rank, "first_seq", "place", "sentence")
    return every.withColumn("n", F.row_number().over(order)).filter(at_most(F.col("n"), limit)).select(*by, "n", "class", "sentence")


# ----------------------------------------------------------------- reports


def summary_counts(states: DataFrame, merged: DataFrame, lists: DataFrame, edges: DataFrame, endpoints: DataFrame | None = None, *, by: Sequence[str] = SITE) -> DataFrame:
    """Header numbers of a site."""
    s = states.groupBy(*by).agg(
        F.count(F.lit(1)).alias("states"), F.count_distinct(route_or_path("route", "pathname")).alias("routes"),
        F.sum(F.when(F.coalesce(F.col("auth.logged_in"), F.lit(False)), 1).otherwise(0)).alias("logged_in_states"))
    c = merged.groupBy(*by).agg(F.count(F.lit(1)).alias("controls"), F.sum(F.when(F.col("redacted_entirely"), 1).otherwise(0)).alias("human_only"))
    out = s.join(c, list(by), "left").join(lists.groupBy(*by).agg(F.count(F.lit(1)).alias("lists")), list(by), "left").join(
        edges.groupBy(*by).agg(F.count(F.lit(1)).alias("transitions")), list(by), "left")
    names = ["controls", "human_only", "lists", "transitions"]
    if endpoints is not None:
        e = endpoints.groupBy(*by).agg(F.count(F.lit(1)).alias("endpoints"), F.sum(F.when(F.col("write_hint").isNotNull(), 1).otherwise(0)).alias("writing_endpoints"))
        out, names = out.join(e, list(by), "left"), [*names, "endpoints", "writing_endpoints"]
    return out.fillna(0, names)


def page_inventory(states: DataFrame) -> DataFrame:
    """One row per state with counts and notes."""
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    n_lists = size("lists.tables") + size("lists.repeats") + size("lists.pagination") + size("lists.downloads")
    notes = F.array(
        F.when(F.col("in_iframe"), F.lit("iframe")),
        F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("manual duplicate of "), "duplicate_of")),
        F.when(F.col("capture_degraded"), F.lit("DOM triggers throttled")),
        F.when(F.size("blocked_frames") > 0, F.concat(F.size("blocked_frames").cast("string"), F.lit(" unrecorded frame(s)"))),
        F.when(F.col("auth.logged_in"), F.concat(F.lit("logged in ("), "auth.confidence", F.lit(")"))),
        F.when(F.col("opened_from").isNotNull(), F.concat(F.lit("opened in a new tab"), F.coalesce(F.concat(F.lit(" by "), "opened_from.action_id"), F.lit("")))),
    )
    return states.select(
        "session", "origin", "seq", F.col("id").alias("state_id"), cell(shorten(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")), 60)).alias("title"),
        route_or_path("route", "pathname").alias("route"), text(F.col("view.key")).alias("view_key"), size("controls").alias("controls"), n_lists.alias("lists"),
        size("errors").alias("errors"), cell(shorten("trigger", 40)).alias("reached_by"), state_stem("seq", "title", "pathname").alias("stem"), F.array_join(F.array_compact(notes), "; ").alias("notes"),
    )


def recent_states(states: DataFrame, edges: DataFrame, *, by: Sequence[str] = ("session",), keep: int | None = None) -> DataFrame:
    """States per session (the last ``keep`` if asked), flagged where new controls appeared."""
    from .records import retain_latest

    fresh = edges.filter(F.size("fields_added") > 0).select("session", F.col("to_id").alias("id")).distinct().withColumn("new_controls", F.lit(True))
    return (states if keep is None else retain_latest(states, keep, by=by)).join(fresh, ["session", "id"], "left").fillna(False, ["new_controls"])


def attention_list(states: DataFrame, merged: DataFrame, sightings: DataFrame | None = None, *, by: Sequence[str] = SITE) -> DataFrame:
    """``(by…, section, item)``: what a person should check before trusting the map."""
    key, primary = F.concat(F.lit("`"), cell("key"), F.lit("`")), F.concat(F.lit("`"), cell("selectors.primary"), F.lit("`"))
    sec = lambda df, kind, item: df.select(*by, F.lit(SECTIONS[kind]).alias("section"), item.alias("item"))
    spread = states.select(*by, "seq", route_or_path("route", "pathname").alias("route"), F.explode("controls").alias("c")).select(*by, "seq", "route", "c.*")
    buttons = states.select(*by, "seq", route_or_path("route", "pathname").alias("route"), F.explode("buttons").alias("b"))
    at = F.concat(F.lit("state "), F.col("seq").cast("string"), F.lit(": "))
    ids = spread.filter(text("id") != "").select(*by, "seq", "route", "id").unionByName(buttons.filter(text("b.id") != "").select(*by, "seq", "route", F.col("b.id").alias("id")))
    twice = ids.groupBy(*by, "seq", "route", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    many = states.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select(*by)
    parts = [
        sec(merged.filter(F.col("selectors.stability") == "fragile"), "fragile", F.concat(key, F.lit(" → "), primary)),
        sec(merged.filter(F.col("label_source").isin(*P.WEAK_LABEL_SOURCES)), "weak_label",
            F.concat(key, F.lit(" — labelSource `"), "label_source", F.lit("`"), F.when(text("label") != "", F.concat(F.lit(': "'), cell("label"), F.lit('"'))).otherwise(""))),
        sec(spread.filter(~F.coalesce("selectors.unique", F.lit(False))), "not_unique",
            F.concat(at, key, F.lit(" — "), primary, F.when(F.coalesce("selectors.unique_in_form", F.lit(False)), " (unique within its form)").otherwise(""))),
        sec(twice, "same_id", F.concat(F.lit("state "), F.col("seq").cast("string"), F.lit(" ("), code("route"), F.lit("): `#"), cell("id"), F.lit("` appears "), F.col("n").cast("string"), F.lit(" times"))),
        sec(merged.filter(F.col("n_states") == 1).join(many, list(by), "left_semi"), "once", F.concat(key, F.lit(" on "), "first_state_id")),
        sec(merged.filter("collides"), "collides", key),
        sec(merged.filter("id_varies"), "id_varies", key),
        sec(merged.filter(F.col("entry.mode") == "widget"), "widget", F.concat(key, F.lit(" — "), F.coalesce(F.nullif(F.col("entry.widget_kind"), F.lit("")), F.lit("widget")), F.lit(": "), cell("entry.evidence"))),
        sec(merged.filter(F.col("entry.mode") == "unknown"), "unknown", F.concat(key, F.lit(" — "), cell("entry.evidence"))),
        sec(spread.filter(F.coalesce("redacted_entirely", F.lit(False))), "secret", F.concat(at, key, F.lit(" — "), primary)),
        sec(buttons.filter(F.coalesce("b.danger", F.lit(False))), "danger", F.concat(F.lit('"'), cell("b.text"), F.lit('" — `'), cell("b.selector"), F.lit("`"))),
        sec(states.select(*by, F.explode("blocked_frames").alias("o")), "frames", F.concat(F.lit("`"), cell("o"), F.lit("`"))),
        sec(states.filter(F.coalesce("capture_degraded", F.lit(False))), "throttled", F.concat(F.lit("state "), F.col("seq").cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def recipe_rows(recipes: DataFrame, pages: DataFrame, labels: DataFrame, coverage: DataFrame, endpoints: DataFrame, lists: DataFrame, views: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """One row per page with what a reader of the site needs to get and read it."""
    n = lambda df, name: df.groupBy(*by, "route").agg(F.count(F.lit(1)).alias(name))
    r = recipes.select(*by, "route", "reachable", "steps", "direct_url", "note")
    out = (
        pages.select(*by, "page_id", "route", "first_seq").join(labels.select(*by, "page_id", "label"), [*by, "page_id"]).join(r, [*by, "route"], "left")
        .join(n(endpoints, "endpoints"), [*by, "route"], "left").join(n(lists, "lists"), [*by, "route"], "left").join(n(views, "views"), [*by, "route"], "left")
        .join(coverage.select(*by, "route", "downloads", F.col("n_missing").alias("missing")), [*by, "route"], "left")
        .fillna(0, ["endpoints", "lists", "views", "downloads", "missing"])
    )
    how = F.when(F.col("reachable"), F.concat(F.lit("reached in "), F.col("steps").cast("string"), F.lit(" step(s)"))).otherwise("not reachable by recorded clicks")
    return out.withColumn("summary", F.concat("label", F.lit(": "), how, F.lit("; "), F.col("lists").cast("string"), F.lit(" list(s), "), F.col("endpoints").cast("string"), F.lit(" endpoint(s), "), F.col("missing").cast("string"), F.lit(" gap(s)")))
