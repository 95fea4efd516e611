"""Record upkeep: ids, retention, origins, consent, manifests, integrity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import padded
from ..functions.urls import origin_of
from .ordered import dense_number, order_number

# ---- fixed values: how many records a session keeps -------------------------
RETAINED = {"states": 500, "net": 2500, "actions": 3000, "downloads": 500, "timeline": 200}
DEGRADED_NET_DIVISOR = 4
ID_PREFIX = {"states": ("st_", 4), "net": ("net_", 4), "actions": ("act_", 4), "downloads": ("dl_", 4),
             "pages": ("pg_", 3), "endpoints": ("api_", 3)}


def assign_ids(
    df: DataFrame,
    *,
    keys: Sequence[str],
    first: str,
    prefix: str,
    width: int = 3,
    by: Sequence[str] = (),
    out: str = "id",
    chunk: int = 100_000,
) -> DataFrame:
    """One row per key with ``first`` (first sighting) and a dense id in that order.

    Rows are brought down to keys before anything is numbered, and numbering
    goes chunk by chunk, so neither step needs all rows of a site in one place.
    """
    kinds = df.groupBy(*by, *keys).agg(F.min(first).alias("first_seen"))
    numbered = dense_number(kinds, by=by, order=["first_seen", *keys], out="__n", chunk=chunk)
    return numbered.withColumn(out, F.concat(F.lit(prefix), padded("__n", width))).drop("__n")


def retain_latest(df: DataFrame, keep: int, *, by: Sequence[str] = ("session",), seq: str = "seq",
                  degraded: Column | None = None, chunk: int = 100_000) -> DataFrame:
    """The newest ``keep`` rows per session; a quarter of that where ``degraded``.

    The count from the end comes from a chunked running sum, so a session with
    most of the rows is still read in parallel.
    """
    turned = df.withColumn("__back", -order_number(df, seq))
    ranked = dense_number(turned, by=by, order=["__back"], out="__rank", chunk=chunk)
    limit = F.lit(keep) if degraded is None else F.when(degraded, keep // DEGRADED_NET_DIVISOR).otherwise(keep)
    return ranked.filter(F.col("__rank") <= limit).drop("__back", "__rank")


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; an aggregate, so nothing is sorted per key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def consent_filter(df: DataFrame, allowed: DataFrame | Sequence[str], *, origin: str = "origin") -> DataFrame:
    """Rows whose exact origin is on the allow list; subdomains are separate.

    A list in code is a literal test that reaches the scan; a table is a
    semi join, which turns into a broadcast by itself when it is small.
    """
    if isinstance(allowed, DataFrame):
        return df.join(allowed.select(F.col(allowed.columns[0]).alias(origin)).distinct(), origin, "left_semi")
    return df.filter(F.col(origin).isin(*list(allowed)))


def split_by_origin(tables: Mapping[str, DataFrame], consented: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a capture with the origin each row belongs to.

    States, actions and downloads carry theirs; a call belongs to the origin of
    the page it was made from, an edge to the origin both its ends are on, a
    dependency to that of its state. ``origins`` lists every origin that was
    allowed or seen.
    """
    states = tables["states"]
    home = states.select("session", F.col("id").alias("__sid"), F.col("origin").alias("__origin"))
    out = dict(tables)
    seen = states.select("origin")
    out["origins"] = (seen if consented is None else seen.unionByName(consented.select("origin"))).distinct()
    if "net" in tables:
        out["net"] = tables["net"].withColumn("origin", origin_of("page_url"))
    if "transitions" in tables:
        ends = (
            tables["transitions"]
            .join(home.withColumnsRenamed({"__sid": "from_id", "__origin": "origin"}), ["session", "from_id"])
            .join(home.withColumnsRenamed({"__sid": "to_id"}), ["session", "to_id"])
        )
        out["transitions"] = ends.filter(F.col("origin") == F.col("__origin")).drop("__origin")
    if "dependencies" in tables:
        out["dependencies"] = tables["dependencies"].join(
            home.withColumnsRenamed({"__sid": "state_id", "__origin": "origin"}), ["session", "state_id"]
        )
    return out


def manifest(origins: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per origin of every table; origins without rows read zero."""
    counts = None
    for name, df in tables.items():
        part = df.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).select("origin", F.lit(name).alias("kind"), "n")
        counts = part if counts is None else counts.unionByName(part)
    wide = counts.groupBy("origin").agg(
        *[F.sum(F.when(F.col("kind") == name, F.col("n"))).alias(f"n_{name}") for name in tables]
    )
    return origins.select("origin").distinct().join(wide, "origin", "full_outer").fillna(0, [f"n_{n}" for n in tables])


def site_framework(states: DataFrame, by: Sequence[str] = ("origin",)) -> DataFrame:
    """The framework of a site: the first state that shows one, else the first state's."""
    plain = F.coalesce(F.col("framework.framework"), F.lit("plain")) == "plain"
    return states.groupBy(*by).agg(
        F.coalesce(F.min_by("framework.framework", F.struct(plain, F.col("seq"), F.col("id"))), F.lit("plain")).alias("framework"),
        F.min_by("framework.version", F.struct(plain, F.col("seq"), F.col("id"))).alias("framework_version"),
    )


def reference_integrity(references: Mapping[str, tuple[DataFrame, str]], known: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(source, kind, ref)`` for every id that is mentioned but does not exist.

    ``references`` maps ``"table:kind"`` to a frame and the column that names
    ids of that kind (a string or an array); ``known`` maps a kind to a frame
    and its id column.
    """
    mentions = ids = None
    for label, (df, column) in references.items():
        source, kind = label.rsplit(":", 1)
        value = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
        part = df.select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), value.alias("ref")).filter(F.col("ref").isNotNull())
        mentions = part if mentions is None else mentions.unionByName(part)
    for kind, (df, column) in known.items():
        part = df.select(F.lit(kind).alias("kind"), F.col(column).alias("ref"))
        ids = part if ids is None else ids.unionByName(part)
    return mentions.distinct().join(ids, ["kind", "ref"], "left_anti").select("source", "kind", "ref")


def unique_names(df: DataFrame, *, base: str, order: Sequence[str], by: Sequence[str] = (), out: str = "name",
                 chunk: int = 100_000) -> DataFrame:
    """``base``, ``base_2``, ``base_3`` … in order of appearance."""
    ranked = dense_number(df, by=[*by, base], order=order, out="__n", chunk=chunk)
    return ranked.withColumn(
        out, F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), F.col("__n").cast("string")))
    ).drop("__n")
