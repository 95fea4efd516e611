"""API catalog: calls folded into endpoint templates, and what is known of each.

``net`` follows :mod:`wayfold.schemas`. All grouping is by method, host and
templated path; lists that can grow with the data (calls, states, routes) come
back as child tables of pairs, never as arrays on the endpoint row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.exprs import text
from ..functions.urls import (
    ID, id_tokens, is_paging_param, is_static_asset, parse_call_url, path_of, route_or_path, template_segments, write_verb,
)
from ..session import cut_lineage
from .joins import next_state
from .ordered import dense_number
from .records import assign_ids

# ---- fixed values: when two templates are one endpoint ----------------------
SHAPE_MATCH = 0.7
#: Distinct kinds of evidence that a task settles at once.
KINDS_PER_TASK = 4096


def parsed_calls(net: DataFrame, *, by: Sequence[str] = (), base: Column | None = None, url: str = "url", seq: str = "seq",
                 call_id: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Calls that can be endpoints: readable http(s) addresses that are not static assets."""
    have = set(net.columns)
    col = lambda name, default: F.col(name) if name in have else default
    u = net.withColumn("__u", parse_call_url(url, base))
    mime, saved = col("mime_type", F.lit("")), col("is_download", F.lit(False))
    kept = u.filter(F.col("__u").isNotNull() & ~is_static_asset(F.col("__u.ext"), mime, saved))
    return kept.select(
        *by,
        F.col(call_id).alias("net_id"),
        F.col(seq).alias("seq"),
        F.upper(F.coalesce(F.nullif(col("method", F.lit("GET")), F.lit("")), F.lit("GET"))).alias("method"),
        F.col("__u.scheme").alias("scheme"),
        F.col("__u.host").alias("host"),
        template_segments(F.col("__u.segments")).alias("segs"),
        F.col("__u.query_keys").alias("query_keys"),
        *[F.col(c) for c in keep if c in have],
    )


def _path(segs: Column | str) -> Column:
    return F.concat(F.lit("/"), F.array_join(segs, "/"))


def _is_templated(s: Column) -> Column:
    return (s == ID) | s.startswith(ID + ".")


def _extension(v: Column) -> Column:
    return F.when(_is_templated(v), F.substring(v, len(ID) + 2, 20)).otherwise(F.lower(F.regexp_extract(v, P.SEGMENT_EXTENSION, 1)))


def _candidates(templates: DataFrame, keys: Sequence[str], start: int, with_evidence: bool) -> list[int]:
    """Positions at or after ``start`` where calls alike elsewhere differ. At most one per path depth.

    Without evidence only values that carry a digit can fold, so only those count.
    """
    spread = templates.select(*keys, "segs", F.posexplode("segs").alias("pos", "value")).filter(F.col("pos") >= start)
    if not with_evidence:
        spread = spread.filter(_is_templated(F.col("value")) | F.col("value").rlike("[0-9]"))
    masked = spread.withColumn("rest", _masked(F.col("segs"), F.col("pos")))
    found = masked.groupBy(*keys, "pos", F.size("segs"), "rest").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = found.filter(F.col("lo") != F.col("hi")).select("pos").distinct().collect()
    return sorted(r.pos for r in rows)


def _masked(segs: Column, pos: Column) -> Column:
    return F.array_join(F.transform(segs, lambda s, i: F.when(i == pos, "\u0000").otherwise(s)), "/")


class _Kinds:
    """Kinds of evidence by the paths they hold, to say which of them are like a given one."""

    def __init__(self, kinds: pd.DataFrame):
        self.size = np.array([-1 if e is None else len(e) for e in kinds["evidence"]], np.int64)
        self.like = kinds["like"].to_numpy(bool)
        owner = pd.Series(np.repeat(np.arange(len(kinds)), np.maximum(self.size, 0)))
        paths = np.array([p for e in kinds["evidence"] if e is not None for p in e], object)
        self.holders = {p: o.to_numpy() for p, o in owner.groupby(paths)} if len(paths) else {}

    def alike(self, evidence, like: bool) -> np.ndarray:
        if evidence is None:
            return self.like & like
        met = [self.holders[p] for p in evidence if p in self.holders]
        common = np.bincount(np.concatenate(met), minlength=len(self.size)) if met else np.zeros(len(self.size), np.int64)
        union = self.size + len(evidence) - common
        overlap = np.divide(common, union, out=np.ones(len(common)), where=union > 0)
        return np.where(self.size >= 0, overlap >= SHAPE_MATCH, self.like & like)


def _found_clusters(batch: pd.DataFrame) -> pd.DataFrame:
    """The next kinds of a bucket in order: each joins the first founder it is like, or founds a cluster."""
    batch = batch.sort_values("rank").reset_index(drop=True)
    kinds, founder = _Kinds(batch), np.zeros(len(batch), bool)
    home = np.arange(len(batch))
    for i, (evidence, like) in enumerate(zip(batch["evidence"], batch["like"])):
        hits = np.flatnonzero(kinds.alike(evidence, like) & founder)
        founder[i] = not len(hits)
        home[i] = hits[0] if len(hits) else i
    return batch.assign(cluster=batch["kind"].to_numpy()[home])[["bucket", "kind", "cluster", "evidence", "like", "rank"]]


def _join_clusters(later: pd.DataFrame, founders: pd.DataFrame) -> pd.DataFrame:
    """Later kinds that are like one of the new founders, each with the first of them."""
    founders = founders.sort_values("rank").reset_index(drop=True)
    kinds, names = _Kinds(founders), founders["kind"].to_numpy()
    hits = [np.flatnonzero(kinds.alike(e, like))[:1] for e, like in zip(later["evidence"], later["like"])]
    home = [names[h[0]] if len(h) else None for h in hits]
    return later.assign(cluster=home)[["bucket", "kind", "cluster"]].dropna()


def first_come_clusters(kinds: DataFrame, *, batch: int = KINDS_PER_TASK) -> DataFrame:
    """``(bucket, kind, cluster)``: every kind with the kind that founded its cluster.

    ``kinds``: bucket, kind (once a bucket), evidence (distinct paths or NULL), like, seen. In
    order of (seen, kind) a kind joins the first founder it is like, else it founds a cluster.
    Kinds are like each other when their evidence overlaps by ``SHAPE_MATCH``, two empty ones
    too; where one has none, both must be marked ``like``.

    A round settles the next ``batch`` kinds of all buckets, a task a bucket, and then meets
    the founders among them with all later kinds, ``batch`` of these a task. So a task holds two
    batches whatever a bucket holds, and the fullest bucket needs a round per batch at
    most; kinds that joined a founder are no longer counted. Empty table: no rows.
    """
    ranked = dense_number(kinds.select("bucket", "kind", "evidence", "like", "seen"), by=["bucket"], order=["seen", "kind"], out="rank", chunk=100_000)
    left, done = cut_lineage(ranked.select("bucket", "kind", "evidence", "like", "rank")), None
    while True:
        low = left.groupBy("bucket").agg(F.min("rank").alias("__low"))
        marked = left.join(low, "bucket").withColumn("__now", F.col("rank") < F.col("__low") + batch).drop("__low")
        schema = "bucket string, kind string, cluster string, evidence array<string>, like boolean, rank long"
        settled = cut_lineage(marked.filter("__now").drop("__now").groupBy("bucket").applyInPandas(_found_clusters, schema))
        done = settled.select("bucket", "kind", "cluster") if done is None else done.unionByName(settled.select("bucket", "kind", "cluster"))
        later = marked.filter("NOT __now").drop("__now").withColumn("__part", F.floor(F.col("rank") / batch))
        if later.limit(1).count() == 0:
            return done
        founders = settled.filter("kind = cluster").drop("cluster").join(later.select("bucket", F.col("__part").alias("part")).distinct(), "bucket")
        joined = cut_lineage(
            later.groupBy("bucket", "__part").cogroup(founders.groupBy("bucket", "part")).applyInPandas(_join_clusters, "bucket string, kind string, cluster string")
        )
        done = done.unionByName(joined)
        left = cut_lineage(later.drop("__part").join(joined.select("bucket", "kind"), ["bucket", "kind"], "left_anti"))
        if left.limit(1).count() == 0:
            return done


def _fold_position(templates: DataFrame, keys: Sequence[str], pos: int, with_evidence: bool) -> DataFrame:
    """One position folded: values of one kind become ``{id}`` or ``{id}.ext``."""
    here = F.get(F.col("segs"), F.lit(pos))
    marked = templates.withColumns(
        {
            "bucket": F.when(F.size("segs") > pos, F.concat_ws("\u0001", *keys, F.size("segs").cast("string"), _masked(F.col("segs"), F.lit(pos)))),
            "value": here,
        }
    ).withColumn("like", _is_templated(F.col("value")) | F.col("value").rlike("[0-9]"))
    if with_evidence:
        values = marked.filter(F.col("bucket").isNotNull()).groupBy("bucket", "value", "like").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("ok_paths")))).alias("__ok"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("sent_paths")))).alias("__sent"),
            F.max(F.col("ok_paths").isNotNull()).alias("__has_ok"),
            F.max(F.col("sent_paths").isNotNull()).alias("__has_sent"),
            F.min("first_seq").alias("seen"),
        )
        values = values.withColumn("evidence", F.when(F.col("__has_ok"), F.col("__ok")).when(F.col("__has_sent"), F.col("__sent")))
        values = values.filter(F.col("evidence").isNotNull() | F.col("like"))
        kind = F.concat_ws(":", F.col("like").cast("string"), F.coalesce(F.sha2(F.array_join("evidence", "\n"), 256), F.lit("-")))
        values = cut_lineage(values.withColumn("kind", kind).select("bucket", "value", "like", "kind", "evidence", "seen"))
        kinds = values.groupBy("bucket", "kind").agg(F.first("evidence").alias("evidence"), F.first("like").alias("like"), F.min("seen").alias("seen"))
        member = values.join(first_come_clusters(kinds), ["bucket", "kind"]).select("bucket", "value", "cluster")
    else:
        member = marked.filter(F.col("bucket").isNotNull() & F.col("like")).select("bucket", "value").distinct().withColumn("cluster", F.lit("0"))
    shared = member.groupBy("bucket", "cluster").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min(_extension(F.col("value"))).alias("e_lo"), F.max(_extension(F.col("value"))).alias("e_hi"),
    ).filter(F.col("lo") != F.col("hi"))
    template = F.when((F.col("e_lo") == F.col("e_hi")) & (F.col("e_lo") != ""), F.concat(F.lit(ID + "."), F.col("e_lo"))).otherwise(ID)
    renamed = member.join(shared.select("bucket", "cluster", template.alias("__to")), ["bucket", "cluster"]).select("bucket", "value", "__to")
    folded = marked.join(renamed, ["bucket", "value"], "left").withColumn("moved", F.coalesce(F.col("__to") != F.col("value"), F.lit(False)))
    return folded.withColumn(
        "segs",
        F.when(F.col("__to").isNull(), F.col("segs")).otherwise(F.transform("segs", lambda s, i: F.when(i == pos, F.col("__to")).otherwise(s))),
    ).select(*templates.columns)


def template_by_variance(calls: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, method, host, raw_path, path)``: segments that vary between calls folded.

    Works on distinct templates, not calls. Optional array columns
    ``response_paths`` / ``request_paths`` (leaf paths of each body) with
    ``status`` are the evidence that values belong together; without evidence
    values have to carry a digit. Passes stop when nothing changes: each folds at
    least one template, so they end.
    """
    keys = [*by, "method", "host"]
    have = set(calls.columns)
    with_evidence = bool({"response_paths", "request_paths"} & have)
    templates = calls.groupBy(*keys, "segs").agg(F.min("seq").alias("first_seq"))
    if with_evidence:
        ok = F.col("status").isNull() | F.col("status").between(200, 299) if "status" in have else F.lit(True)
        for name, source, cond in (("ok_paths", "response_paths", ok), ("sent_paths", "request_paths", F.lit(True))):
            if source not in have:
                templates = templates.withColumn(name, F.lit(None).cast("array<string>"))
                continue
            shaped = calls.filter(cond & F.col(source).isNotNull())
            pairs = shaped.select(*keys, "segs", F.explode_outer(source).alias("__p")).distinct()
            sets = pairs.groupBy(*keys, "segs").agg(F.array_sort(F.collect_set("__p")).alias(name))
            templates = templates.join(sets, [*keys, "segs"], "left")
    templates = cut_lineage(templates.withColumn("raw", F.col("segs")).withColumn("moved", F.lit(False)))
    while True:
        changed, pos = False, 0
        while True:
            ahead = _candidates(templates, keys, pos, with_evidence)
            if not ahead:
                break
            pos = ahead[0]
            templates = cut_lineage(_fold_position(templates, keys, pos, with_evidence))
            changed = changed or templates.filter("moved").limit(1).count() > 0
            pos += 1
        if not changed:
            break
    return templates.select(*keys, _path("raw").alias("raw_path"), _path("segs").alias("path"), "first_seq")


def group_endpoints(calls: DataFrame, *, by: Sequence[str] = (), fold_variance: bool = True, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(endpoints, call_map)`` from :func:`parsed_calls`.

    Endpoints are numbered in order of first call; the scheme is that of the
    first call. ``keep`` names columns that identify a call beside its id, as the
    session does where ids begin anew in each.
    """
    keys = [*by, "method", "host"]
    routed = calls.withColumn("raw_path", _path("segs"))
    if fold_variance:
        folded = template_by_variance(calls, by=by).select(*keys, "raw_path", "path")
        routed = routed.join(folded, [*keys, "raw_path"])
    else:
        routed = routed.withColumn("path", F.col("raw_path"))
    groups = routed.groupBy(*keys, "path").agg(
        F.min("seq").alias("first_seq"), F.min_by("scheme", F.struct("seq", "net_id")).alias("scheme"), F.count(F.lit(1)).alias("n_calls")
    )
    named = assign_ids(groups, keys=["method", "host", "path"], first="first_seq", prefix="api_", by=by, out="endpoint_id").drop("first_seen")
    endpoints = groups.join(named, [*keys, "path"]).withColumn("url_template", F.concat("scheme", F.lit("://"), "host", "path"))
    call_map = routed.join(named, [*keys, "path"]).select(*dict.fromkeys([*by, *keep]), "net_id", "endpoint_id", "seq", "method", "path", "query_keys")
    return endpoints, call_map


# ------------------------------------------------------------- attribution


def attribute_calls(net: DataFrame, states: DataFrame, *, by: Sequence[str] = ("session",), chunk=None) -> DataFrame:
    """``(by…, net_id, state_id)``: which state each call fed.

    The next state in the call's frame when the call began at or after that
    state's trigger, or was made from its path and not from the current one's;
    else the state on screen.
    """
    shown = states.select(*by, F.col("id").alias("state_id_at_time"), F.col("url").alias("__at_url"))
    calls = (
        net.select(
            *by, F.col("id").alias("net_id"), "seq", "tab_id",
            F.when(F.col("state_id_inferred"), F.lit(0).cast("long")).otherwise(F.coalesce("frame_id", F.lit(0).cast("long"))).alias("frame_id"),
            "started_at", "page_url", "state_id_at_time",
        )
        .join(shown, [*by, "state_id_at_time"], "left")
        .withColumn("__at", F.when(F.col("__at_url").isNotNull() | F.col("state_id_at_time").isNotNull(), F.col("state_id_at_time")))
    )
    ahead = next_state(calls, states, by=[*by, "tab_id", "frame_id"], state_cols=["id", "trigger_at", "url"], chunk=chunk)
    nxt, at = F.col("next_state"), F.col("__at")
    came_from = path_of("page_url")
    after_trigger = F.coalesce(F.col("started_at") >= nxt["trigger_at"], F.lit(False))
    from_next = (came_from != "") & (came_from == path_of(nxt["url"])) & (came_from != path_of("__at_url"))
    fed = (
        F.when(nxt.isNull() | nxt["id"].eqNullSafe(at), at)
        .when(at.isNull(), nxt["id"])
        .when(after_trigger | from_next, nxt["id"])
        .otherwise(at)
    )
    return ahead.select(*by, "net_id", fed.alias("state_id"))


# ----------------------------------------------------------------- catalog


def write_hints(endpoints: DataFrame, call_map: DataFrame, net: DataFrame, *, by: Sequence[str] = (), session: Sequence[str] = ()) -> DataFrame:
    """``(by…, endpoint_id, write_hint)``: why an endpoint may change data, NULL when it only reads."""
    word = F.get(F.filter(F.transform(F.split("path", "/"), write_verb), lambda w: w.isNotNull()), F.lit(0))
    by_name = F.when(F.col("method").isin(*P.WRITE_METHODS), F.concat(F.lit("method "), F.col("method"))).when(
        ~F.col("method").isin(*P.READ_METHODS) & word.isNotNull(), F.concat(F.lit('path word "'), word, F.lit('"'))
    )
    ids = list(dict.fromkeys([*by, *session]))
    bodies = net.select(*ids, F.col("id").alias("net_id"), "request_body").filter(text("request_body").rlike(r"^\s*\{"))
    fields = F.map_entries(F.from_json("request_body", "map<string,variant>"))
    value = lambda e: F.try_variant_get(e["value"], "$", "string")
    hit = F.filter(
        fields,
        lambda e: e["key"].rlike(P.OPERATION_KEY) & (F.schema_of_variant(e["value"]) == "STRING") & write_verb(value(e)).isNotNull(),
    )
    named = F.get(F.transform(hit, lambda e: F.concat(F.lit('operation "'), F.substring(value(e), 1, 60), F.lit('"'))), F.lit(0))
    spoken = (
        bodies.withColumn("__hint", named)
        .filter(F.col("__hint").isNotNull())
        .join(call_map.filter(~F.col("method").isin(*P.READ_METHODS)).select(*ids, "net_id", "endpoint_id", "seq"), [*ids, "net_id"])
        .groupBy(*by, "endpoint_id")
        .agg(F.min_by("__hint", F.struct("seq", "net_id")).alias("__spoken"))
    )
    return (
        endpoints.select(*by, "endpoint_id", "method", "path")
        .join(spoken, [*by, "endpoint_id"], "left")
        .select(*by, "endpoint_id", F.coalesce(by_name, "__spoken").alias("write_hint"))
    )


def common_mime(calls: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Most frequent media type; the one seen first wins a tie."""
    mime = F.lower(F.trim(F.substring_index(text("mime_type"), ";", 1)))
    counted = calls.withColumn("__m", mime).filter(F.col("__m") != "").groupBy(*by, "__m").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return counted.groupBy(*by).agg(F.max_by("__m", F.struct("n", -F.col("first"))).alias("mime_type"))


def response_split(status: Column | str = "status") -> Column:
    """Which shape a response belongs to: ``error`` from status 400 on, else ``response``."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s >= 400, "error").otherwise("response")


def api_catalog(net: DataFrame, states: DataFrame, actions: DataFrame, *, by: Sequence[str] = ("session",), base: Column | None = None,
                fold_variance: bool = True, chunk=None, session: Sequence[str] = ("session",)) -> dict[str, DataFrame]:
    """The catalog as a parent table and child tables.

    Endpoints are those of ``by``; ids are joined within ``session``, where they are
    unique, and child tables of ids carry it.

    ``endpoints`` has one row per endpoint; ``endpoint_params`` its query keys,
    ``endpoint_calls``, ``endpoint_states``, ``endpoint_actions`` and
    ``endpoint_routes`` the pairs; ``endpoint_statuses`` the status counts.
    """
    have = set(net.columns)
    ids = list(dict.fromkeys([*by, *session]))
    calls = parsed_calls(net, by=ids, base=base, keep=["status", "response_paths", "request_paths"])
    endpoints, call_map = group_endpoints(calls, by=by, fold_variance=fold_variance, keep=session)
    ek = [*by, "endpoint_id"]
    ik = list(dict.fromkeys([*ek, *session]))
    facts = call_map.join(
        net.select(*ids, F.col("id").alias("net_id"), "status", "mime_type", "is_download", "page_url", F.col("action_id_at_time").alias("action_id"),
                   *(["has_full_body"] if "has_full_body" in have else [])),
        [*ids, "net_id"],
    )
    fed = attribute_calls(net, states, by=ids, chunk=chunk)
    flags = facts.groupBy(*ek).agg(
        F.max(F.coalesce("is_download", F.lit(False))).alias("is_download"),
        (F.max(F.coalesce("has_full_body", F.lit(False))) if "has_full_body" in have else F.lit(False)).alias("has_full_body"),
    )
    params = (
        call_map.select(*ek, F.explode("query_keys").alias("query_key"))
        .groupBy(*ek, "query_key").agg(F.count(F.lit(1)).alias("n_calls"))
        .withColumn("is_paging", is_paging_param("query_key"))
    )
    state_route = states.select(*ids, F.col("id").alias("state_id"), route_or_path("route", "pathname").alias("__state_route"))
    action_route = actions.select(*ids, F.col("id").alias("action_id"), F.nullif(F.col("route"), F.lit("")).alias("__action_route"))
    placed = (
        facts.join(fed, [*ids, "net_id"], "left")
        .join(state_route, [*ids, "state_id"], "left")
        .join(action_route, [*ids, "action_id"], "left")
        .withColumn("route", F.coalesce("__state_route", "__action_route", path_of("page_url")))
    )

    def pairs(column: str, keys: Sequence[str]) -> DataFrame:
        return placed.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy(*keys, column).agg(F.min("seq").alias("first_seq"))

    parent = (
        endpoints.join(common_mime(facts, by=ek), ek, "left")
        .join(flags, ek, "left")
        .join(write_hints(endpoints, call_map, net, by=by, session=session), ek, "left")
        .withColumn("mime_type", F.coalesce("mime_type", F.lit("")))
    )
    return {
        "endpoints": parent,
        "endpoint_params": params,
        "endpoint_statuses": facts.filter(F.col("status").isNotNull()).groupBy(*ek, "status").agg(F.count(F.lit(1)).alias("n_calls")),
        "endpoint_calls": call_map.select(*ik, "net_id", "seq"),
        "endpoint_states": pairs("state_id", ik),
        "endpoint_actions": pairs("action_id", ik),
        "endpoint_routes": pairs("route", ek),
    }


def body_paging_params(request_nodes: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Top-level request body keys that mean paging."""
    return request_nodes.filter((F.col("parent") == "$") & F.col("key").isNotNull() & is_paging_param("key")).select(*by, F.col("key").alias("query_key")).distinct()


def structured_endpoint_counts(net: DataFrame, *, by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Method and path of calls that returned JSON or XML with a body; the ``limit`` most frequent of each site if asked."""
    kept = net.filter(text("mime_type").rlike("(?i)json|xml") & (text("response_body") != ""))
    path = F.coalesce(F.nullif(path_of("url"), F.lit("")), F.col("url"))
    counted = kept.groupBy(*by, F.concat_ws(" ", F.col("method"), path).alias("endpoint")).agg(F.count(F.lit(1)).alias("n_calls"))
    if limit is None:
        return counted
    order = Window.partitionBy(*by).orderBy(F.col("n_calls").desc(), "endpoint")
    return counted.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= limit).drop("__n")
