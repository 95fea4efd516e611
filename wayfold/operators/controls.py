"""Controls rolled up over states: labels, selectors, collisions, widgets, lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.exprs import first_of, norm, rank_of, text
from ..functions.urls import route_or_path
from .records import first_of_key

# ---- fixed values: selectors that stay good when an id does not -------------
_STABLE_ATTRIBUTE = r"^\[(data-testid|data-test|data-cy|data-qa|data-test-id|data-automation-id)="
_LIKELY_ATTRIBUTE = r"^\[(formcontrolname|name)=|aria-label="


#: Characters of a label that a recorded click is named by (fixed value of the log format).
CLICK_LABEL = 40


def _ids(df: DataFrame, by: Sequence[str]) -> list[str]:
    """What makes an id unique: the keys, and the session where there is one."""
    return list(dict.fromkeys([*by, *(c for c in ("session",) if c in df.columns)]))


def controls_of(states: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """One row per control per state, with the route it was seen on."""
    ids = _ids(states, by)
    return states.select(
        *ids, F.col("id").alias("state_id"), F.col("seq").alias("state_seq"), route_or_path("route", "pathname").alias("route"),
        F.posexplode("controls").alias("pos", "c"),
    ).select(*ids, "state_id", "state_seq", "route", "pos", "c.*")


def varying_ids(controls: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """``(by…, id, n_ids, id_low, id_high)``: ids that alternate for one logical control.

    The control is named by route, binding, name, label and type.
    """
    named = controls.filter((text("id") != "") & ((text("binding") != "") | (text("name") != "") | (text("label") != "")))
    kinds = named.select(*by, "route", text("binding").alias("binding"), text("name").alias("name"), norm("label").alias("__label"), text("type").alias("type"), "id").distinct()
    keys = [*by, "route", "binding", "name", "__label", "type"]
    several = kinds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("__lo"), F.max("id").alias("__hi")).filter(F.col("n_ids") > 1)
    met = kinds.join(several, keys).select(*by, "id", "n_ids", "__lo", "__hi")
    return met.groupBy(*by, "id").agg(F.max("n_ids").alias("n_ids"), F.min("__lo").alias("id_low"), F.max("__hi").alias("id_high"))


def effective_controls(controls: DataFrame, varying: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Adds ``eff_key`` and the selector to use, with id selectors demoted where the id varies."""
    v = varying.select(*by, "id", F.lit(True).alias("__varies"), "n_ids")
    joined = controls.join(v, [*by, "id"], "left")
    varies = F.coalesce("__varies", F.lit(False))
    first_of = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    key = F.when(varies & (F.col("key") == F.col("id")), first_of("binding", "name", "label", "key")).otherwise(F.col("key"))
    demote = varies & F.col("selectors.primary").startswith("#")
    others = F.filter(F.col("selectors.fallbacks"), lambda s: ~s.startswith("#"))
    primary = F.when(demote, F.coalesce(F.get(others, F.lit(0)), F.col("selectors.primary"))).otherwise(F.col("selectors.primary"))
    judged = F.when(primary.rlike(_STABLE_ATTRIBUTE), "stable").when(primary.rlike(_LIKELY_ATTRIBUTE), "likely").otherwise("fragile")
    return joined.withColumns(
        {
            "eff_key": key,
            "sel": F.struct(
                primary.alias("primary"),
                F.when(demote, F.slice(others, F.lit(2), F.size(others))).otherwise(F.col("selectors.fallbacks")).alias("fallbacks"),
                F.col("selectors.shadow_path").alias("shadow_path"),
                F.when(demote, judged).otherwise(F.col("selectors.stability")).alias("stability"),
            ),
            "id_varies": demote,
        }
    ).drop("__varies")


def merge_controls(controls: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """One row per control of a site, from :func:`effective_controls`.

    Controls of one key stay apart when label or type differ. The best label is
    that of the best label source, the best selector the most stable one, the
    longest option list wins, and a credential stays one. Ties go to the
    control seen first.
    """
    seen = F.struct("state_seq", "pos")
    when = lambda cond, value: F.when(cond, value)
    n_options = F.coalesce(F.size("options"), F.lit(-1))
    credential = F.coalesce("redacted_entirely", F.lit(False))
    known = F.coalesce(F.col("entry.mode"), F.lit("unknown")) != "unknown"
    state = [c for c in ("session", "state_id") if c in controls.columns]
    rolled = controls.groupBy(*by, F.col("eff_key"), norm("label").alias("variant"), "type").agg(
        F.min(seen).alias("first_seen"),
        F.min_by("route", seen).alias("first_route"),
        F.min_by("state_id", seen).alias("first_state_id"),
        F.min_by(F.struct("label", "label_source"), F.struct(rank_of(F.col("label_source"), P.LABEL_SOURCE_RANK), seen)).alias("__label"),
        F.max(F.coalesce("required", F.lit(False))).alias("required"),
        F.min_by("max_length", when(F.col("max_length").isNotNull(), seen)).alias("max_length"),
        F.min_by("pattern", when(text("pattern") != "", seen)).alias("pattern"),
        F.min_by("sel", F.struct(rank_of(F.col("sel.stability"), P.STABILITY_RANK), seen)).alias("selectors"),
        F.min_by("options", F.struct(-n_options, seen)).alias("options"),
        F.min_by("entry", when(F.col("entry").isNotNull(), F.struct(~known, seen))).alias("entry"),
        F.max(credential).alias("redacted_entirely"),
        F.max("id_varies").alias("id_varies"),
        F.count_distinct(*state).alias("n_states"),
    )
    variants = rolled.groupBy(*by, "eff_key").agg(F.count(F.lit(1)).alias("n_variants"))
    whole = rolled.join(variants, [*by, "eff_key"])
    return whole.select(
        *by,
        F.when(F.col("n_variants") > 1, F.concat_ws("::", "first_route", "eff_key")).otherwise(F.col("eff_key")).alias("key"),
        "eff_key", "variant", "type", F.col("__label.label").alias("label"), F.col("__label.label_source").alias("label_source"),
        "required", "max_length", "pattern", "selectors", F.when(~F.col("redacted_entirely"), F.col("options")).alias("options"), "entry",
        "redacted_entirely", "id_varies", "n_states", "first_state_id", F.col("first_seen").alias("__first_seen"),
        (F.col("n_variants") > 1).alias("collides"),
    )


def control_sightings(controls: DataFrame, merged: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """``(by…, key, state_id)`` pairs, and through which state-level key each was found."""
    ids = _ids(controls, by)
    slim = controls.select(*ids, "state_id", "eff_key", F.col("key").alias("state_key"), norm("label").alias("variant"), "type")
    keys = merged.select(*by, "eff_key", "variant", F.col("type").alias("__type"), "key")
    return slim.join(keys, [*by, "eff_key", "variant"]).filter(F.col("type").eqNullSafe(F.col("__type"))).select(*ids, "key", "state_id", "state_key").distinct()


def alternate_keys(controls: DataFrame, merged: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """``(by…, key, alt_key)``: other names a control answers to."""
    names = controls.select(*by, "eff_key", norm("label").alias("variant"), "type", F.explode(F.array("key", "id", "name", "binding", "label")).alias("alt_key"))
    keys = merged.select(*by, "eff_key", "variant", F.col("type").alias("__type"), F.col("key").alias("merged_key"))
    met = names.filter(text("alt_key") != "").join(keys, [*by, "eff_key", "variant"]).filter(F.col("type").eqNullSafe(F.col("__type")) & (F.col("alt_key") != F.col("eff_key")))
    return met.select(*by, F.col("merged_key").alias("key"), "alt_key").distinct()


def collisions(merged: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """``(by…, key, n_colliding)``: merged keys that share one key with another control."""
    several = merged.filter("collides")
    sizes = several.groupBy(*by, "eff_key").agg((F.count(F.lit(1)) - 1).alias("n_colliding"))
    return several.join(sizes, [*by, "eff_key"]).select(*by, "key", "eff_key", "n_colliding")


def promote_widgets(merged: DataFrame, edges: DataFrame, sightings: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Marks a control as a widget when clicking it made new controls appear.

    A trigger names what was clicked whole, or by its first ``CLICK_LABEL`` characters where the log cut it there.
    """
    ids = _ids(sightings, by)
    clicks = edges.filter(F.col("trigger").startswith("click:") & (F.size("fields_added") > 0)).select(
        *ids, F.col("from_id").alias("state_id"), norm(F.substring(F.col("trigger"), F.lit(7), F.length("trigger"))).alias("__clicked"),
        F.size("fields_added").alias("__n"), F.col("to_id").alias("__to"),
    )
    spoken = merged.select(*by, "key", F.explode(F.array_distinct(F.array(*(x for c in ("label", "key") for x in (norm(c), F.substring(norm(c), 1, CLICK_LABEL)))))).alias("__clicked"))
    hits = (
        sightings.select(*ids, "key", "state_id").distinct().join(spoken, [*by, "key"]).join(clicks, [*ids, "state_id", "__clicked"])
        .groupBy(*by, "key").agg(F.min_by(F.concat(F.lit("click opened "), F.col("__n").cast("string"), F.lit(" new control(s) in "), "__to"), F.col("__to")).alias("__why"))
    )
    unknown = F.col("entry.mode") == "unknown"
    entry = F.when(unknown & F.col("__why").isNotNull(),
                   F.struct(F.lit("widget").alias("mode"), F.col("__why").alias("evidence"), F.col("entry.widget_kind").alias("widget_kind"), F.col("entry.mask").alias("mask"))).otherwise(F.col("entry"))
    return merged.join(hits, [*by, "key"], "left").withColumn("entry", entry).withColumnRenamed("__why", "widget_note")


def link_dependencies(deps: DataFrame, sightings: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """``(by…, source, target, endpoint)``: which merged control drives which."""
    ids = _ids(sightings, by)
    look = sightings.select(*ids, "state_id", F.col("state_key"), "key").distinct()
    spread = deps.select(*ids, "state_id", "source_key", "endpoint", F.explode_outer("target_keys").alias("target_key"))
    src = look.withColumnsRenamed({"state_key": "source_key", "key": "__src"})
    dst = look.withColumnsRenamed({"state_key": "target_key", "key": "__dst"})
    joined = spread.join(src, [*ids, "state_id", "source_key"], "left").join(dst, [*ids, "state_id", "target_key"], "left")
    return joined.select(*by, F.coalesce("__src", "source_key").alias("source"), F.coalesce("__dst", "target_key").alias("target"), "endpoint").distinct()


def merge_lists(states: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """Distinct list patterns by kind and selector: first state, number of states, longest header row."""
    ids = _ids(states, by)
    part = lambda kind, col, sel, headers, size: states.select(
        *ids, F.col("id").alias("state_id"), F.col("seq").alias("state_seq"), F.explode(f"lists.{col}").alias("p")
    ).select(*ids, "state_id", "state_seq", F.lit(kind).alias("kind"), F.col(f"p.{sel}").alias("selector"),
             (F.col("p.headers") if headers else F.lit(None).cast("array<string>")).alias("headers"),
             (F.col(f"p.{size}") if size else F.lit(None).cast("bigint")).alias("n_rows"))
    every = (
        part("table", "tables", "container_selector", True, "row_count")
        .unionByName(part("repeat", "repeats", "container_selector", False, "item_count"))
        .unionByName(part("pagination", "pagination", "container_selector", False, None))
        .unionByName(part("download", "downloads", "selector", False, None))
    )
    return every.filter(text("selector") != "").groupBy(*by, "kind", "selector").agg(
        F.min_by("state_id", "state_seq").alias("first_state_id"), F.count_distinct(*ids, "state_id").alias("n_states"),
        F.max_by("headers", F.struct(F.size("headers"), -F.col("state_seq"))).alias("headers"), F.max("n_rows").alias("n_rows"),
    )


def selectors_file(merged: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    return merged.select(*by, "key", F.col("selectors.primary").alias("primary"), F.col("selectors.fallbacks").alias("fallbacks"), F.col("selectors.shadow_path").alias("shadow_path"))


def reference_data(merged: DataFrame, *, by: Sequence[str] = ("origin",), limit: int | None = None) -> DataFrame:
    """Option lists of controls with their size; ``limit`` options are shown if asked."""
    return merged.filter(F.size("options") > 0).select(
        *by, "key", "label", F.size("options").alias("n_options"),
        F.array_join(F.transform(first_of(F.col("options"), limit), lambda o: F.concat_ws("=", o["v"], o["t"])), ", ").alias("options"),
    )


def locator_candidates(selectors: Column, role: Column | None = None, name: Column | None = None) -> Column:
    """Ranked locators: role and name first where they are known, then selectors; redacted ones are left out."""
    js = lambda c: F.to_json(F.array(c))
    quoted = lambda c: F.substring(js(c), F.lit(2), F.length(js(c)) - 2)
    name, role = (F.trim(text(F.lit("") if c is None else c)) for c in (name, role))
    by_role = F.when((role != "") & (name != "") & ~name.rlike(P.PLACEHOLDER),
                     F.concat(F.lit("page.getByRole("), quoted(role), F.lit(", { name: "), quoted(name), F.lit(", exact: true })")))
    hosts = F.array_join(F.transform(F.coalesce(selectors["shadow_path"], F.array().cast("array<string>")), lambda h: F.concat(F.lit(".locator("), quoted(h), F.lit(")"))), "")
    css = F.concat(F.array(selectors["primary"]), F.coalesce(selectors["fallbacks"], F.array().cast("array<string>")))
    usable = F.filter(css, lambda s: (text(s) != "") & ~s.rlike(P.PLACEHOLDER))
    located = F.transform(usable, lambda s: F.concat(F.lit("page"), hosts, F.lit(".locator("), quoted(s), F.lit(")")))
    return F.array_distinct(F.array_compact(F.concat(F.array(by_role), located)))
