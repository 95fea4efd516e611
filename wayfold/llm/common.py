"""Helpers of several operators: written stages, connected components, exact quantiles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table on shared disk; later reads take the columns they need."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal ``keys`` that follow each other, one table per run.

    For partitions sorted by ``keys``; holds one run and one batch at a time.
    """
    kept: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(c[0].as_py() for c in columns)
        if last is not None and first != last:
            yield pa.Table.from_batches(kept)
            kept = []
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(starts, starts[1:])):
            if i:
                yield pa.Table.from_batches(kept)
                kept = []
            if b > a:
                kept.append(batch.slice(a, b - a))
        last = tuple(c[batch.num_rows - 1].as_py() for c in columns)
    if kept:
        yield pa.Table.from_batches(kept)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of ``range(n)`` to the least node that the pairs link it to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == was).all():
            break
    kids = np.flatnonzero(root != np.arange(n))
    return kids, root[kids]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of ``edges`` with the least node it can reach.

    Large-star and small-star rounds; each is joins and grouped minima, so a node
    with very many neighbours is combined before the shuffle and its join is
    split by AQE. The number of rounds grows with the logarithm of the longest
    path. Self links and repeated links change nothing; nulls are left out.
    """
    e = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    )
    loops = e.filter("u = v")
    e = e.filter("u > v")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).union(e.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.filter("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).union(loops.select(F.col("u").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def kth_largest(df: DataFrame, value: Column, k: int) -> float | None:
    """The exact k-th largest of a double column, by narrowing a histogram.

    A pass counts 4096 bins between two bounds; the bin with the k-th value gives
    the next bounds. At most 4096 counts come to the driver in a pass. Nulls and
    NaN do not count; None when there are fewer than ``k`` values.
    """
    bins = 4096
    v = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(width))).alias("bin")
        found = (
            v.filter((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high))).groupBy(at)
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        )
        above = v.filter(F.col("v") > F.lit(high)).count()
        for r in sorted(found, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return high


def least_key(*columns: str) -> Column:
    """64 bits that spread rows evenly whatever the columns hold."""
    return F.xxhash64(*columns)
