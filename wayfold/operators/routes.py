"""Click routes: the shortest safe way from the entry to every page and view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import text
from ..functions.redaction import has_placeholder
from ..functions.urls import menu_id, route_or_path
from ..session import cut_lineage
from .joins import asof_join

SITE = ("origin",)
STATE_SEP = "\u0000"


def instability(selectors: Column) -> Column:
    """Lower is sturdier; four for a target without a selector."""
    base = F.when(selectors["stability"] == "stable", 0).when(selectors["stability"] == "likely", 1).otherwise(2)
    shared = F.when(~F.coalesce(selectors["unique"], F.lit(True)), 1).otherwise(0)
    return F.when(text(selectors["primary"]) == "", 4).otherwise(base + shared)


def node_of(route: Column | str, view: Column | str) -> Column:
    """The search node of a state: page and view, not the visit."""
    return F.concat(text(route), F.lit(STATE_SEP), text(view))


def click_graph(edges: DataFrame, actions: DataFrame, claims: DataFrame, *, by: Sequence[str] = SITE) -> tuple[DataFrame, DataFrame]:
    """``(hops, refused)``.

    A hop is one control that leads from one page and view to another, with the
    sturdiest recorded instance (the latest among equals) and how often it was
    seen. Edges without a cause, and edges on which anything flagged danger was
    pressed, are refused.
    """
    acts = actions.select(
        "session", F.col("id").alias("action_id"), F.col("seq").alias("action_seq"), "kind", "label", "selectors", "menu_path", "href", "chosen",
        "list_selector", "pagination", "view_group", F.coalesce("danger", F.lit(False)).alias("danger"),
    )
    risky = (
        claims.select("session", F.col("state_id").alias("to_id"), "action_id")
        .join(acts.filter("danger").select("session", "action_id", "label"), ["session", "action_id"])
        .groupBy("session", "to_id").agg(F.min(F.struct("action_id", "label")).alias("__risk"))
    )
    known = edges.join(acts, ["session", "action_id"], "left").join(risky, ["session", "to_id"], "left").withColumns(
        {"from_node": node_of("from_route", "from_view"), "to_node": node_of("to_route", "to_view"), "cost": instability(F.col("selectors"))}
    )
    bad = F.col("kind").isNull() | F.coalesce("danger", F.lit(False)) | F.col("__risk").isNotNull()
    refused = known.filter(bad).select(
        *by, F.col("to_node").alias("node"), "to_at", "trigger", "from_id",
        F.coalesce(F.col("__risk.action_id"), F.when(F.coalesce("danger", F.lit(False)), F.col("action_id"))).alias("danger_id"),
        F.coalesce(F.col("__risk.label"), F.when(F.coalesce("danger", F.lit(False)), F.col("label"))).alias("danger_label"),
    )
    pressed = F.coalesce(F.nullif(F.col("selectors.primary"), F.lit("")), F.concat(F.lit("label:"), text("label"), F.lit("|"), F.array_join(F.coalesce("menu_path", F.array().cast("array<string>")), ">")))
    usable = known.filter(~bad & (F.col("from_node") != F.col("to_node"))).withColumn("pressed", pressed)
    step = F.struct("session", "action_id", "action_seq", "kind", "label", "selectors", "menu_path", "href", "chosen", "list_selector", "pagination", "view_group",
                    "from_id", "to_id", "from_route", "to_route", "to_view", "via_new_tab", "cost")
    hops = usable.groupBy(*by, "from_node", "to_node", "pressed").agg(
        F.min_by(step, F.struct("cost", -F.col("action_seq"), "action_id")).alias("step"), F.count(F.lit(1)).alias("seen")
    )
    return hops, refused


def shortest_paths(hops: DataFrame, entry: DataFrame, *, by: Sequence[str] = SITE, payload: bool = True, max_depth: int | None = None) -> DataFrame:
    """``(by…, node, steps, cost, seen, path)``: breadth-first, level by level.

    ``hops`` has ``from_node, to_node, seen`` and ``step`` (with ``cost``);
    ``entry`` one ``node`` per site. Within a level the lower total cost wins,
    then the more often seen. Each level is one join, one anti join and one
    aggregation; its rows are written once, with the node they came from and the last step alone.
    Paths are put together from these pointers at the end.
    """
    kind = hops.schema["step"].dataType if payload else hops.schema["to_node"].dataType
    frontier = cut_lineage(entry.select(
        *by, "node", F.lit(0).alias("steps"), F.lit(0).cast("bigint").alias("cost"), F.lit(0).cast("bigint").alias("seen"),
        F.lit(None).cast(entry.schema["node"].dataType).alias("via"), F.lit(None).cast(kind).alias("step"),
    ))
    out_edges = cut_lineage(hops.withColumnRenamed("seen", "__seen").withColumn("__step", F.col("step") if payload else F.col("to_node")).withColumnRenamed("from_node", "node"))
    hop_cost = F.col("__step.cost") if payload else F.col("hop_cost")
    reached, levels = frontier, 0
    while max_depth is None or levels < max_depth:
        found = frontier.drop("step", "via").join(out_edges, [*by, "node"]).select(
            *by, F.col("to_node").alias("node"), (F.col("steps") + 1).alias("steps"), (F.col("cost") + hop_cost).cast("bigint").alias("cost"),
            (F.col("seen") + F.col("__seen")).cast("bigint").alias("seen"), F.col("node").alias("via"), F.col("__step").alias("step"),
        )
        fresh = found.join(reached.select(*by, "node"), [*by, "node"], "left_anti")
        level = fresh.groupBy(*by, "node").agg(F.min_by(F.struct("steps", "cost", "seen", "via", "step"), F.struct("cost", -F.col("seen"), "via")).alias("b")).select(*by, "node", "b.*")
        frontier = cut_lineage(level)
        if frontier.limit(1).count() == 0:
            break
        reached, levels = reached.unionByName(frontier), levels + 1
    return unrolled(reached, levels, by=by)


def unrolled(reached: DataFrame, depth: int, *, by: Sequence[str]) -> DataFrame:
    """``reached`` (by…, node, via, step, others) with the ``path`` of steps from the entry in place of the pointer.

    Pointers jump: each round joins a node's stretch of path to that of the node it points
    at, so stretches double and log2 of ``depth`` rounds do.
    """
    path = F.when(F.col("via").isNull(), F.array().cast(f"array<{reached.schema['step'].dataType.simpleString()}>")).otherwise(F.array("step"))
    rows = reached.withColumn("path", path).drop("step")
    done, open_ = rows.filter("via is null"), rows.filter("via is not null")
    for _ in range(depth.bit_length()):
        ahead = done.unionByName(open_).select(*by, F.col("node").alias("via"), F.col("via").alias("__via"), F.col("path").alias("__path"))
        jumped = cut_lineage(open_.join(ahead, [*by, "via"]).withColumn("path", F.concat("__path", "path")).withColumn("via", F.col("__via")).select(*rows.columns))
        done, open_ = done.unionByName(jumped.filter("via is null")), jumped.filter("via is not null")
    return done.drop("via")


def branch_openers(reached: DataFrame, actions: DataFrame, claims: DataFrame, edges: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """``(by…, node, hop, level, opener)``: menu branches to open before a step.

    A branch is opened again when it was reopened on that very edge; otherwise
    only if no earlier step since the last change of page has it open. The
    sturdiest opener wins: on the same edge, else earlier in the log, else any.
    """
    went = edges.filter(F.col("route_changed") & F.col("action_id").isNotNull()).select("session", "action_id").distinct()
    presses = actions.filter((F.col("kind") == "click") & ~F.coalesce("danger", F.lit(False)) & (F.size("menu_path") > 0)).select(
        *by, "session", F.col("id").alias("action_id"), "seq", menu_id(F.col("menu_path")).alias("branch"), instability(F.col("selectors")).alias("rank"), "label", "selectors", "menu_path", "href", "chosen", "kind"
    ).join(went, ["session", "action_id"], "left_anti")
    opener = F.struct("action_id", "seq", "kind", "label", "selectors", "menu_path", "href", "chosen")
    best = F.struct("rank", -F.col("seq"), "action_id")
    hops = reached.select(*by, "node", F.posexplode("path").alias("hop", "step"))
    moved = F.transform(F.col("path"), lambda s: F.when(s["from_route"] != s["to_route"], 1).otherwise(0))
    stretch = reached.select(*by, "node", F.posexplode(moved).alias("hop", "m"), moved.alias("__all")).select(
        *by, "node", "hop", F.aggregate(F.slice("__all", F.lit(1), F.col("hop")), F.lit(0), lambda a, x: a + x).alias("stretch")
    )
    n = F.size("step.menu_path")
    need = hops.filter(n > 1).select(*by, "node", "hop", F.col("step.session").alias("session"), F.col("step.to_id").alias("to_id"), F.col("step.action_seq").alias("action_seq"),
                                     F.col("step.menu_path").alias("mp"), F.explode(F.sequence(F.lit(1), n - 1)).alias("level")).withColumn("branch", menu_id(F.slice("mp", F.lit(1), F.col("level"))))
    any_open = presses.groupBy(*by, "branch").agg(F.min_by(opener, best).alias("__any"))
    on_edge = claims.select("session", F.col("state_id").alias("to_id"), "action_id").join(presses, ["session", "action_id"]).groupBy(*by, "session", "to_id", "branch").agg(F.min_by(opener, best).alias("__edge"))
    wanted = need.join(any_open, [*by, "branch"]).join(on_edge, [*by, "session", "to_id", "branch"], "left").join(stretch, [*by, "node", "hop"])
    own = hops.filter(n > 0).select(*by, "node", "hop", menu_id(F.col("step.menu_path")).alias("branch")).join(stretch, [*by, "node", "hop"])
    opened_at = wanted.select(*by, "node", "stretch", "branch", "hop").unionByName(own.select(*by, "node", "stretch", "branch", "hop")).groupBy(*by, "node", "stretch", "branch").agg(F.min("hop").alias("__first"))
    due = wanted.join(opened_at, [*by, "node", "stretch", "branch"]).filter(F.col("__edge").isNotNull() | (F.col("hop") <= F.col("__first")))
    # The sturdiest earlier press: the latest one before the step, per rank, then the lowest rank.
    ranks = due.select(*by, "node", "hop", "level", "branch", "action_seq").withColumn("rank", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    earlier = asof_join(
        ranks, presses.withColumn("opener", opener), by=[*by, "branch", "rank"], left_ts="action_seq", right_ts="seq", right_cols=["opener"], strict=True, out="m", chunk=100_000,
    ).filter(F.col("m").isNotNull()).groupBy(*by, "node", "hop", "level").agg(F.min_by("m.opener", "rank").alias("__earlier"))
    return due.join(earlier, [*by, "node", "hop", "level"], "left").select(*by, "node", "hop", "level", F.coalesce("__edge", "__earlier", "__any").alias("opener"))


def route_steps(reached: DataFrame, openers: DataFrame, states: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """Numbered steps of every recipe, branch openers in front of the step that needs them."""
    shown = states.select("session", F.col("id").alias("to_id"), F.get(F.filter("headings", lambda h: F.trim(h) != ""), F.lit(0)).alias("expect_heading"))
    hops = reached.select(*by, "node", F.posexplode("path").alias("hop", "s"))
    main = hops.select(
        *by, "node", "hop", F.lit(1_000_000).alias("level"), "s.session", "s.action_id", F.when(F.col("s.kind") == "change", "change").otherwise("click").alias("kind"),
        text("s.label").alias("label"), text("s.selectors.primary").alias("selector"), F.array_join(F.coalesce("s.menu_path", F.array().cast("array<string>")), " > ").alias("menu"),
        "s.from_id", "s.to_id", F.col("s.to_route").alias("expect_route"), F.col("s.to_view").alias("expect_view_key"), F.col("s.via_new_tab").alias("opens_new_tab"),
        ((text("s.list_selector") != "") & ~F.coalesce("s.pagination", F.lit(False)) & (text("s.view_group") == "")).alias("opens_item"),
    ).join(shown, ["session", "to_id"], "left")
    before = openers.join(hops, [*by, "node", "hop"]).select(
        *by, "node", "hop", "level", "s.session", "opener.action_id", F.lit("click").alias("kind"), text("opener.label").alias("label"), text("opener.selectors.primary").alias("selector"),
        F.array_join("opener.menu_path", " > ").alias("menu"), F.col("s.from_id").alias("from_id"), F.col("s.from_id").alias("to_id"), F.col("s.from_route").alias("expect_route"),
        F.element_at(F.split("node", STATE_SEP), 2).alias("expect_view_key"), F.lit(False).alias("opens_new_tab"), F.lit(False).alias("opens_item"), F.lit(None).cast("string").alias("expect_heading"),
    )
    every = before.unionByName(main)
    # A recipe is as long as its path; numbering it is a sort of a handful of rows.
    packed = every.groupBy(*by, "node").agg(F.array_sort(F.collect_list(F.struct("hop", "level", *[c for c in main.columns if c not in (*by, "node", "hop", "level")]))).alias("steps"))
    return packed.select(*by, "node", F.posexplode("steps").alias("n", "s")).select(*by, "node", (F.col("n") + 1).alias("n"), "s.*").drop("hop", "level")


def route_recipes(states: DataFrame, reached: DataFrame, refused: DataFrame, entry: DataFrame, steps: DataFrame | None = None, *, by: Sequence[str] = SITE) -> DataFrame:
    """One row per page and view: reachable or why not, number of steps, direct URL, notes."""
    s = states.withColumns({"__route": route_or_path("route", "pathname"), "__view": text(F.col("view.key"))}).withColumn("node", node_of("__route", "__view"))
    seen = F.struct("seq", "id")
    targets = s.groupBy(*by, "node").agg(
        F.min_by("__route", seen).alias("route"), F.min_by("__view", seen).alias("view_key"), F.min_by("id", seen).alias("first_state_id"), F.min_by("trigger", seen).alias("first_trigger"),
        F.min_by(F.col("opened_from").isNotNull(), seen).alias("in_new_tab"), F.min("seq").alias("first_seq"),
    )
    loads = s.filter(F.col("trigger") == "load").groupBy(*by, F.col("__route").alias("route")).agg(F.count(F.lit(1)).alias("n_loads"))
    keys = s.filter(F.col("trigger") == "load").select(*by, F.col("__route").alias("route"), F.explode("query_keys").alias("k")).distinct().groupBy(*by, "route").agg(F.array_join(F.array_sort(F.collect_set("k")), ", ").alias("load_keys"))
    load_views = s.filter(F.col("trigger") == "load").select(*by, "node").distinct().withColumn("view_loaded", F.lit(True))
    no = refused.groupBy(*by, "node").agg(F.min_by(F.struct("trigger", "from_id"), F.struct("to_at", "from_id")).alias("first"), F.min(F.struct("danger_id", "danger_label")).alias("danger"), F.max(F.col("danger_id").isNotNull()).alias("risky"))
    no = no.withColumn("danger", F.when(F.col("risky"), F.col("danger")))
    start = entry.select(*by, F.col("node").alias("entry_node"), "entry_state_id", "entry_route")
    landed = F.element_at("path", -1)["to_id"]
    r = (
        targets.join(reached.select(*by, "node", "steps", "cost", F.when(F.size("path") > 0, landed).alias("landed")), [*by, "node"], "left")
        .join(no, [*by, "node"], "left").join(loads, [*by, "route"], "left").join(keys, [*by, "route"], "left").join(load_views, [*by, "node"], "left").join(start, list(by), "left")
    )
    is_entry, ok = F.col("node") == F.col("entry_node"), F.col("steps").isNotNull()
    loaded = F.col("n_loads").isNotNull()
    openable = loaded & ~has_placeholder("route")
    code = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    why = (
        F.when(F.col("danger").isNotNull(), F.concat(F.lit('Reached in the recording only through "'), F.coalesce(F.nullif(F.col("danger.danger_label"), F.lit("")), F.col("danger.danger_id")), F.lit('" ('), F.col("danger.danger_id"),
                                                     F.lit("), which is flagged danger and is never replayed. A human has to take that step.")))
        .when(F.col("first").isNotNull(), F.concat(F.lit("Reached in the recording by "), code("first.trigger"), F.lit(" from "), F.col("first.from_id"), F.lit(", with no recorded click behind it, so there is nothing to replay.")))
        .when(F.col("in_new_tab"), F.lit("Opened in a new tab whose opener was not recorded."))
        .when(F.col("first_trigger") == "load", F.concat(F.lit("Seen only as a page load; no recorded click leads here from the entry page ("), F.col("entry_route"), F.lit(").")))
        .otherwise(F.concat(F.lit("No recorded click path leads here from the entry page ("), F.col("entry_route"), F.lit(").")))
    )
    notes = F.array(
        F.when(is_entry, F.lit("This is the entry state.")),
        F.when(~ok, why),
        F.when(loaded & ~openable, F.lit("The route holds a redacted segment, so no direct URL is given; take the value from the page that links here.")),
        F.when(openable & (text("load_keys") != ""), F.concat(F.lit("When it was loaded the URL carried query parameters ("), F.col("load_keys"), F.lit("); their values were not recorded."))),
        F.when(openable & F.col("view_loaded").isNull(), F.lit("The direct URL opens the page, not this view of it; the view still has to be selected.")),
    )
    origin = F.regexp_replace(F.col(by[0]), r"/+\z", "") if by else F.lit("")
    direct = F.when(openable, F.concat(origin, F.when(F.col("route").startswith("/"), "").otherwise("/"), F.col("route")))
    return r.select(
        *by, "node", "route", "view_key", F.when(is_entry, F.col("entry_state_id")).otherwise(F.coalesce("landed", "first_state_id")).alias("target_state_id"),
        ok.alias("reachable"), "steps", "cost", direct.alias("direct_url"), "first_seq", F.array_join(F.array_compact(notes), " ").alias("note"),
    )


def entry_nodes(states: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """Per site the entry state and its search node."""
    later = ~F.coalesce(F.col("auth.logged_in"), F.lit(False))
    pick = F.struct(F.col("id").alias("entry_state_id"), route_or_path("route", "pathname").alias("entry_route"), text(F.col("view.key")).alias("__v"))
    best = states.groupBy(*by).agg(F.min_by(pick, F.struct(later, F.col("seq"), F.col("id"))).alias("e")).select(*by, "e.*")
    return best.withColumn("node", node_of("entry_route", "__v")).drop("__v")


def best_recipes(recipes: DataFrame, *, by: Sequence[str] = SITE) -> DataFrame:
    """One recipe per page: reachable first, then fewest steps, then the default view."""
    order = F.struct(~F.col("reachable"), F.coalesce("steps", F.lit(1 << 30)), F.col("view_key") != "", F.col("first_seq"))
    rest = [c for c in recipes.columns if c not in (*by, "route")]
    best = recipes.groupBy(*by, "route").agg(F.min_by(F.struct(*rest), order).alias("b"))
    return best.select(*by, "route", "b.*")
