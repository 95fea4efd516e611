"""State graph: which states are kept, and the edges between them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import text
from ..functions.names import action_phrase, cell, code, human_duration, shorten
from ..functions.states import errors_key
from ..functions.urls import path_of, route_or_path
from .joins import asof_join, drop_across_pause, opener_of_tab
from .ordered import previous_row
from .records import first_of_key

DOCUMENT = ("session", "tab_id", "frame_id")


def keep_changes(df: DataFrame, *, by: Sequence[str], order: Sequence[str], look: Sequence[str], chunk=None) -> DataFrame:
    """Rows whose ``look`` differs from the row before them (A, A, B, A keeps A, B, A)."""
    seen = previous_row(df, by=by, order=order, payload=look, out="__before", chunk=chunk)
    same = F.col("__before").isNotNull()
    for c in look:
        same = same & F.col(c).eqNullSafe(F.col(f"__before.{c}"))
    return seen.filter(~same).drop("__before")


def dedupe_states(states: DataFrame, *, by: Sequence[str] = DOCUMENT, chunk=None) -> DataFrame:
    """Drops a state that looks like the one before it in its document.

    ``manual`` states always stay; one that repeats carries ``duplicate_of``.
    A dropped state looks exactly like its predecessor, so comparing with the
    neighbour is the same as comparing with the last state kept.
    """
    keyed = states.withColumn("__errors", errors_key(F.col("errors")))
    seen = previous_row(keyed, by=by, order=["captured_at", "seq"], payload=["signature", "__errors"], out="__prev", chunk=chunk)
    same = F.col("__prev").isNotNull() & F.col("signature").eqNullSafe(F.col("__prev.signature")) & (F.col("__errors") == F.col("__prev.__errors"))
    marked = seen.withColumn("__same", same)
    kept = marked.filter(~F.col("__same") | (F.col("trigger") == "manual"))
    last = previous_row(kept, by=by, order=["captured_at", "seq"], payload=["id"], out="__last", chunk=chunk)
    return last.withColumn("duplicate_of", F.when(F.col("__same"), F.col("__last.id")).otherwise(F.lit(None).cast("string"))).drop(
        "__errors", "__prev", "__same", "__last"
    )


# ------------------------------------------------------------------- edges


def _controls(col: Column) -> Column:
    """Controls by key; the first of a key wins."""
    return F.coalesce(col, F.array().cast("array<struct<key:string,redacted:boolean,options:array<struct<v:string,t:string>>>>"))


def _first_per_key(items: Column) -> Column:
    return F.filter(items, lambda c, i: F.array_position(F.transform(items, lambda x: x["key"]), c["key"]) == i + 1)


_SEEN = ["id", "url", "__route", "__view", "captured_at", "origin", "errors", "__controls", "__counts"]


def transitions(
    states: DataFrame,
    timeline: DataFrame | None = None,
    *,
    by: Sequence[str] = DOCUMENT,
    chunk=None,
) -> DataFrame:
    """One edge per pair of neighbouring states of a document.

    Both states are on one origin and no pause lies between them. The edge says
    which fields came and went, whose options changed, which list counts changed,
    which errors appeared and whether address, route or view changed.
    """
    slim = F.transform(
        F.col("controls"),
        lambda c: F.struct(c["key"].alias("key"), F.coalesce(c["redacted_entirely"], F.lit(False)).alias("redacted"), c["options"].alias("options")),
    )
    counts = F.concat(
        F.transform(F.col("lists.tables"), lambda t: F.struct(t["container_selector"].alias("selector"), t["row_count"].alias("n"))),
        F.transform(F.col("lists.repeats"), lambda r: F.struct(r["container_selector"].alias("selector"), r["item_count"].alias("n"))),
    )
    prepared = states.withColumns(
        {
            "__route": route_or_path("route", "pathname"),
            "__view": text(F.col("view.key")),
            "__controls": _first_per_key(_controls(slim)),
            "__counts": F.coalesce(counts, F.array().cast("array<struct<selector:string,n:bigint>>")),
            "errors": F.coalesce("errors", F.array().cast("array<string>")),
        }
    ).select(*by, "seq", "trigger", "trigger_at", *_SEEN)
    paired = previous_row(prepared, by=by, order=["captured_at", "seq"], payload=_SEEN, out="p", chunk=chunk).filter(
        F.col("p").isNotNull() & (F.col("p.origin") == F.col("origin"))
    )
    p = lambda c: F.col(f"p.{c}")
    edges = _diff(paired, p).select(
        *by,
        p("id").alias("from_id"), F.col("id").alias("to_id"), "trigger", "trigger_at", p("captured_at").alias("from_at"),
        F.col("captured_at").alias("to_at"), "origin", p("__route").alias("from_route"), F.col("__route").alias("to_route"),
        p("__view").alias("from_view"), F.col("__view").alias("to_view"),
        "fields_added", "fields_removed", "options_changed", "list_counts_changed", "errors_appeared",
        (p("url") != F.col("url")).alias("url_changed"),
        (p("__route") != F.col("__route")).alias("route_changed"),
        (p("__view") != F.col("__view")).alias("view_changed"),
        F.lit(False).alias("via_new_tab"),
    )
    if timeline is None:
        return edges
    return drop_across_pause(edges, timeline, by=["session"], chunk=chunk)


def _diff(paired: DataFrame, p) -> DataFrame:
    keys = lambda c: F.transform(c, lambda x: x["key"])
    before, after = p("__controls"), F.col("__controls")

    def changed(c: Column) -> Column:
        old = F.get(F.filter(before, lambda x: x["key"] == c["key"]), F.lit(0))
        return F.struct(c["key"].alias("key"), old["options"].alias("before"), c["options"].alias("after"), (old.isNotNull() & ~old["redacted"] & ~c["redacted"] & ~c["options"].eqNullSafe(old["options"])).alias("hit"))

    moved = F.filter(F.transform(after, changed), lambda x: x["hit"])

    def recount(c: Column) -> Column:
        # The last list of a selector is the one that counts.
        same = F.filter(p("__counts"), lambda x: x["selector"] == c["selector"])
        old = F.try_element_at(same, F.lit(-1))
        return F.struct(c["selector"].alias("selector"), old["n"].alias("before"), c["n"].alias("after"))

    recounted = F.filter(F.transform(F.col("__counts"), recount), lambda x: x["before"].isNotNull() & (x["before"] != x["after"]))
    return paired.withColumns(
        {
            "fields_added": F.array_except(keys(after), keys(before)),
            "fields_removed": F.array_except(keys(before), keys(after)),
            "options_changed": F.transform(moved, lambda x: F.struct(x["key"].alias("key"), x["before"].alias("before"), x["after"].alias("after"))),
            "list_counts_changed": F.array_distinct(recounted),
            "errors_appeared": F.filter(F.col("errors"), lambda e: ~F.array_contains(p("errors"), e)),
        }
    )


def claim_actions(actions: DataFrame, states: DataFrame, timeline: DataFrame | None = None, *, by: Sequence[str] = DOCUMENT, chunk=None) -> DataFrame:
    """``(session, action_id, state_id, is_primary)``: each action goes to the next state of its document.

    Not across a pause. The primary action of a state is the last one whose
    trigger is the state's own, else the last one.
    """
    ahead = asof_join(
        actions.select(*by, F.col("id").alias("action_id"), "seq", "at", "trigger"), states, by=by, left_ts="at", right_ts="captured_at",
        right_cols=["id", "trigger", "captured_at"], right_tie=["seq"], direction="forward", out="s", chunk=chunk,
    ).filter(F.col("s").isNotNull())
    flat = ahead.select(*by, "action_id", "seq", "at", F.col("s.id").alias("state_id"), F.col("s.captured_at").alias("to_at"),
                        (F.col("trigger") == F.col("s.trigger")).alias("__same"))
    if timeline is not None:
        flat = drop_across_pause(flat, timeline, by=["session"], from_ts="at", to_ts="to_at", chunk=chunk)
    main = flat.groupBy("session", "state_id").agg(F.max_by("action_id", F.struct("__same", "seq")).alias("__main"))
    return flat.join(main, ["session", "state_id"]).select("session", "action_id", "seq", "state_id", (F.col("action_id") == F.col("__main")).alias("is_primary"))


def edge_causes(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds ``action_id``, the primary action of the state an edge leads to."""
    main = claims.filter("is_primary").select("session", F.col("state_id").alias("to_id"), F.col("action_id"))
    return edges.join(main, ["session", "to_id"], "left")


def calls_between(edges: DataFrame, net: DataFrame) -> DataFrame:
    """``(session, from_id, to_id, net_id, seq, started_at, url)``: calls made while the first state was on screen.

    Uses the tab, not the frame. A call meets exactly one edge here, so this is
    as large as the log and no larger.
    """
    calls = net.filter(F.col("state_id_at_time").isNotNull()).select(
        "session", "tab_id", F.col("state_id_at_time").alias("from_id"), F.col("id").alias("net_id"), F.col("seq").alias("net_seq"), "started_at", "url"
    )
    return calls.join(edges.filter(~F.col("via_new_tab")).select("session", "tab_id", "from_id", "to_id", "trigger", "trigger_at"), ["session", "tab_id", "from_id"])


def new_tab_edges(states: DataFrame, opened: DataFrame, actions: DataFrame, timeline: DataFrame | None = None, *, chunk=None) -> DataFrame:
    """Edges from the state a tab was opened on to the first state of that tab.

    ``opened`` has one row per tab: ``session, tab_id, opener_tab_id, at,
    opener_state_id``. The click that opened it is found by time; its own state
    wins over the recorded one.
    """
    first = states.filter(F.col("frame_id") == 0).groupBy("session", "tab_id").agg(F.min_by("id", F.struct("captured_at", "seq")).alias("to_id"))
    asked = opened.select("session", F.col("opener_tab_id").alias("tab_id"), F.col("tab_id").alias("__new_tab"), "at", "opener_state_id")
    found = opener_of_tab(asked, actions, chunk=chunk)
    links = found.select(
        "session", F.col("__new_tab").alias("tab_id"), F.col("opener.id").alias("action_id"),
        F.coalesce(F.col("opener.state_id_at_time"), "opener_state_id").alias("from_id"),
    ).join(first, ["session", "tab_id"])
    end = lambda side: states.select(
        "session", F.col("id").alias(f"{side}_id"), F.col("captured_at").alias(f"{side}_at"),
        route_or_path("route", "pathname").alias(f"{side}_route"), text(F.col("view.key")).alias(f"{side}_view"), F.col("url").alias(f"{side}_url"),
        *([F.col("trigger"), F.col("origin")] if side == "to" else []),
    )
    edges = links.join(end("from"), ["session", "from_id"]).join(end("to"), ["session", "to_id"]).select(
        "session", "tab_id", F.lit(0).cast("long").alias("frame_id"), "from_id", "to_id", "trigger", "from_at", "to_at", "origin",
        "from_route", "to_route", "from_view", "to_view", "action_id",
        (F.col("from_url") != F.col("to_url")).alias("url_changed"), (F.col("from_route") != F.col("to_route")).alias("route_changed"),
        (F.col("from_view") != F.col("to_view")).alias("view_changed"), F.lit(True).alias("via_new_tab"),
    )
    return edges if timeline is None else drop_across_pause(edges, timeline, by=["session"], chunk=chunk)


# ------------------------------------------------------------ dependencies


def dependencies(edges: DataFrame, net: DataFrame, *, before: timedelta = timedelta(milliseconds=50), after: timedelta = timedelta(milliseconds=2500)) -> DataFrame:
    """Which control drives which: a ``change:<key>`` followed by a call or by other options changing.

    A call in the window makes it certain (high), options alone likely (medium).
    Without a trigger time every call between the states counts.
    """
    changes = edges.filter(F.col("trigger").startswith("change:") & (F.length("trigger") > 7) & ~F.col("via_new_tab"))
    calls = calls_between(changes, net)
    t, at = F.unix_micros("started_at"), F.unix_micros("trigger_at")
    us = lambda d: int(d.total_seconds() * 1_000_000)
    inside = F.col("trigger_at").isNull() | F.coalesce(t.between(at - F.lit(us(before)), at + F.lit(us(after))), F.lit(False))
    first = calls.filter(inside).groupBy("session", "from_id", "to_id").agg(
        F.count(F.lit(1)).alias("n_calls"), F.min_by(F.coalesce(F.nullif(path_of("url"), F.lit("")), F.col("url")), F.struct("net_seq", "net_id")).alias("endpoint")
    )
    source = F.substring(F.col("trigger"), F.lit(8), F.length("trigger"))
    targets = F.filter(F.transform("options_changed", lambda o: o["key"]), lambda k: k != source)
    joined = changes.join(first, ["session", "from_id", "to_id"], "left")
    return (
        joined.withColumns({"source_key": source, "target_keys": targets, "via_network": F.col("n_calls").isNotNull()})
        .filter(F.col("via_network") | (F.size("target_keys") > 0))
        .select("session", "source_key", "target_keys", "via_network", F.when(F.col("via_network"), "high").otherwise("medium").alias("confidence"),
                "endpoint", F.col("to_id").alias("state_id"), F.col("to_at").alias("at"))
    )


def distinct_dependencies(deps: DataFrame, *, by: Sequence[str] = ("session",)) -> DataFrame:
    """First finding per source, sorted targets and endpoint."""
    keyed = deps.withColumns({"__targets": F.array_join(F.array_sort("target_keys"), ","), "__endpoint": text("endpoint")})
    return first_of_key(keyed, [*by, "source_key", "__targets", "__endpoint"], ["at", "state_id"]).drop("__targets", "__endpoint")


# ---------------------------------------------------------------- outcomes


def outcomes(actions: DataFrame, edges: DataFrame, claims: DataFrame, states: DataFrame) -> DataFrame:
    """``(session, action_id, from_id, to_id, via_new_tab)``: what each action led to.

    The edge that names an action as its cause decides, then the tab it opened;
    the next state counts only for actions no edge mentions.
    """
    cause = edges.filter(F.col("action_id").isNotNull()).select(
        "session", "action_id", F.lit(0).alias("rank"), F.col("to_at").alias("at"), "from_id", "to_id", "via_new_tab"
    )
    tab = states.filter(F.col("opened_from.action_id").isNotNull()).select(
        "session", F.col("opened_from.action_id").alias("action_id"), F.lit(1).alias("rank"), F.col("captured_at").alias("at"),
        F.col("opened_from.state_id").alias("from_id"), F.col("id").alias("to_id"), F.lit(True).alias("via_new_tab"),
    )
    mentioned = edges.select("session", F.col("to_id").alias("state_id")).distinct()
    said = claims.join(mentioned, ["session", "state_id"], "left_semi").select("session", "action_id").unionByName(cause.select("session", "action_id")).distinct()
    rest = (
        actions.filter(F.col("result_state_id").isNotNull())
        .select("session", F.col("id").alias("action_id"), F.lit(2).alias("rank"), "at", F.col("state_id_at_time").alias("from_id"),
                F.col("result_state_id").alias("to_id"), F.lit(False).alias("via_new_tab"))
        .join(said, ["session", "action_id"], "left_anti")
    )
    return first_of_key(cause.unionByName(tab).unionByName(rest), ["session", "action_id"], ["rank", "at", "to_id"]).drop("rank", "at")


def entry_state(states: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """First logged-in state of a site, else its first state."""
    out = ~F.coalesce(F.col("auth.logged_in"), F.lit(False))
    return states.groupBy(*by).agg(F.min_by("id", F.struct(out, F.col("seq"), F.col("id"))).alias("entry_state_id"))


def reached_by(states: DataFrame, edges: DataFrame) -> DataFrame:
    """Per state how it was reached: the last edge into it, else its own trigger."""
    last = edges.groupBy("session", F.col("to_id").alias("id")).agg(F.max_by(F.struct("trigger", "from_id"), F.struct("to_at", "from_id")).alias("__e"))
    return states.join(last, ["session", "id"], "left").select(
        "session", F.col("id").alias("state_id"), "seq", route_or_path("route", "pathname").alias("route"), text(F.col("view.key")).alias("view_key"),
        F.coalesce(F.concat(F.col("__e.trigger"), F.lit(" from "), F.col("__e.from_id")), F.col("trigger")).alias("reached_by"),
    )


def flow_narrative(states: DataFrame, edges: DataFrame, actions: DataFrame, timeline: DataFrame) -> DataFrame:
    """``(session, at, line)``: edges, chain starts and pauses as sentences in order of time."""
    name = F.concat(F.lit("**"), F.col("seq").cast("string"), F.lit(" "), cell(shorten(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("__route")), 48)), F.lit("**"),
                    F.when(text("title") != "", F.concat(F.lit(" "), code("__route"))).otherwise(""))
    named = states.withColumn("__route", route_or_path("route", "pathname")).withColumn("__name", name)
    ends = lambda side: named.select("session", F.col("id").alias(f"{side}_id"), F.col("__name").alias(f"{side}_name"))
    cause = actions.select("session", F.col("id").alias("action_id"), action_phrase(F.struct(*actions.columns)).alias("__did"))
    plural = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    added, errors = F.size("fields_added"), F.size("errors_appeared")
    parts = F.array_compact(F.array(
        F.when(F.col("route_changed"), F.concat(F.lit("navigated to "), code("to_route"), F.when(F.col("via_new_tab"), " in a new tab").otherwise("")))
        .when(F.col("url_changed"), F.lit("the URL changed within the same route")),
        F.when(F.col("view_changed") & (~F.col("route_changed") | (F.col("to_view") != "")), F.concat(F.lit("the view became "), code(F.coalesce(F.nullif(F.col("to_view"), F.lit("")), F.lit("(default)"))))),
        F.when(added > 0, F.concat(F.lit("added "), plural(added, "control"))),
        F.when(F.size("fields_removed") > 0, F.concat(F.lit("removed "), F.size("fields_removed").cast("string"))),
        F.when(errors > 0, F.concat(F.lit("surfaced "), plural(errors, "error"))),
    ))
    told = (
        edges.join(ends("from"), ["session", "from_id"]).join(ends("to"), ["session", "to_id"]).join(cause, ["session", "action_id"], "left")
        .select("session", F.unix_millis("to_at").alias("at_ms"),
                F.concat(F.lit("From "), "from_name", F.lit(", "),
                         F.coalesce(F.concat("__did", F.lit(" (`"), "action_id", F.lit("`)")), F.concat(F.lit("`"), cell("trigger"), F.lit("`"))),
                         F.lit(" led to "), "to_name", F.lit(" — "),
                         F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("no structural change"), F.lit(".")).alias("line"))
    )
    why = F.when(F.col("seq") == 1, "session start").when(F.col("trigger") == "load", "fresh load (new tab, reload, or after a pause)").otherwise("chain start")
    starts = named.join(edges.select("session", F.col("to_id").alias("id")).distinct(), ["session", "id"], "left_anti").select(
        "session", (F.unix_millis("captured_at") - 1).alias("at_ms"), F.concat("__name", F.lit(" begins a chain — "), why, F.lit(".")).alias("line")
    )
    events = previous_row(timeline.filter(F.col("type").isin("paused", "resumed", "cleared")), by=["session"], order=["at", "type"], payload=["type", "at"], out="p")
    gaps = events.filter(((F.col("type") == "resumed") & (F.col("p.type") == "paused")) | (F.col("type") == "cleared")).select(
        "session", F.unix_millis("at").alias("at_ms"),
        F.when(F.col("type") == "cleared", "— session cleared —").otherwise(
            F.concat(F.lit("— capture paused for "), human_duration(F.unix_millis("at") - F.unix_millis("p.at")), F.lit(" —"))).alias("line"),
    )
    return told.unionByName(starts).unionByName(gaps).orderBy("session", "at_ms", "line")
