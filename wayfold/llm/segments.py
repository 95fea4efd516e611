"""Exact top-k by inner product, with bounds from segment statistics, coarse to fine.

Components become whole numbers. A vector cut into segments has a mean and a deviation per
segment; |x - y|^2 is at least the segments' length times the squared differences
of these, which bounds the inner product from above by
sum of length x (mean x mean + deviation x deviation). Candidates are bounded with
few segments, then with more; a candidate below the k-th best score so far goes. Those that pass
all levels are scored exactly.

Queries and candidates meet in blocks: a block of queries is sent to each
block of candidates, with the k-th best scores over one block as a first bar, and
each meeting sends k rows per query at most.

Vectors that are null, empty, or hold null or non-finite components take no part,
nor do null ids. A query's candidates are all rows but its own with as many components. Rows
that repeat an id are queries and candidates each, so such an id has one ranking per row; they are
told apart by a number given when the vectors are written. Ties go to the smaller id, then to
either row of the id. Scores are exact up to 2^53; larger ones follow double precision.
Empty table: no rows. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cover_tree import _matrix

K = 10
SCALE = 1024
#: Queries and candidates in a block.
QUERIES, CANDIDATES = 512, 4096
#: Segments of each level.
LEVELS = (4, 8, 16, 32)
#: Candidates bounded at a time.
CHUNK = 512


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations per segment, each times the root of the segment's length."""
    cuts = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    sizes = np.diff(cuts).astype(float)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / sizes
    square = np.add.reduceat(v * v, cuts[:-1], axis=1) / sizes
    spread = np.sqrt(np.maximum(0, square - mean**2))
    return np.concatenate([mean, spread], axis=1) * np.sqrt(np.concatenate([sizes, sizes]))


def best(queries: np.ndarray, query_keys: np.ndarray, bar: np.ndarray, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): the k best rows of each query, but for the row of its own key, that reach its bar; ties to the smaller id."""
    stats_q = [statistics(queries, n) for n in LEVELS]
    order = np.argsort(-np.sqrt((rows**2).sum(axis=1)), kind="stable")  # long vectors raise the bar soonest
    rows, ids, keys = rows[order], ids[order], keys[order]
    stats_x = [statistics(rows, n) for n in LEVELS]
    bar = bar.copy()
    found: list[tuple[np.ndarray, ...]] = []
    top = np.empty((len(queries), 0))
    for at in range(0, len(rows), CHUNK):
        part = slice(at, at + CHUNK)
        alive = keys[None, part] != query_keys[:, None]
        for q, x in zip(stats_q, stats_x):
            bound = q @ x[part].T
            alive &= bound + 1e-9 * np.abs(bound) + 1e-3 >= bar[:, None]
            if not alive.any():
                break
        i, j = np.nonzero(alive)
        if not len(i):
            continue
        if len(i) > alive.size // 4:
            score = (queries @ rows[part].T)[i, j]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", queries[i[s : s + 65536]], rows[at + j[s : s + 65536]]) for s in range(0, len(i), 65536)])
        ok = score >= bar[i]
        i, j, score = i[ok], j[ok], score[ok]
        found.append((i, ids[at + j], score))
        dense = np.full((len(queries), min(CHUNK, len(rows) - at)), -np.inf)
        dense[i, j] = score
        top = np.concatenate([top, dense], axis=1)
        if top.shape[1] > k:
            top = -np.partition(-top, k - 1, axis=1)[:, :k]
        if top.shape[1] == k:
            bar = np.maximum(bar, top.min(axis=1))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    i, v, s = (np.concatenate(x) for x in zip(*found))
    keep = s >= bar[i]
    i, v, s = i[keep], v[keep], s[keep]
    by = np.lexsort((v, -s, i))
    i, v, s = i[by], v[by], s[by]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], v[place < k], s[place < k]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, dim, v (whole numbers as doubles) of the rows that take part, written once."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(e, lambda x: F.floor(x * SCALE).cast("double"))
    used = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine & (F.size(e) > 0), F.lit(False)))
    return cut_lineage(used.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.size(e).alias("dim"), v.alias("v")))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for queries and candidates of (row, vec_id, dim, v), both out of one table of ``whole_vectors``."""
    sizes = {r["dim"]: r["count"] for r in queries.groupBy("dim").count().collect()}  # a row per vector length
    rows = {r["dim"]: r["count"] for r in candidates.groupBy("dim").count().collect()}
    spark = queries.sparkSession
    parts = [(d, -(-n // QUERIES), -(-rows.get(d, 0) // CANDIDATES)) for d, n in sizes.items()]
    small = F.broadcast(spark.createDataFrame(parts, "dim int, qs int, cs int"))
    q = queries.join(small, "dim").filter("cs > 0").withColumn("q", F.pmod(F.xxhash64("row"), "qs").cast("int"))
    c = candidates.join(small, "dim").withColumn("c", F.pmod(F.xxhash64("row", F.lit(5)), "cs").cast("int"))

    def met(q: DataFrame, c: DataFrame) -> DataFrame:
        """Rows of both sides, keyed by (dim, q, c)."""
        left = q.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)) if "c" not in q.columns else F.col("c")).select("dim", "q", "c", F.lit(True).alias("asks"), "row", "vec_id", "v", "bar")
        right = c.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select("dim", "q", "c", F.lit(False).alias("asks"), "row", "vec_id", "v", F.lit(0.0).alias("bar"))
        return left.unionByName(right)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import runs

        for cell in runs(batches, ["dim", "q", "c"]):
            asks, row, ids, bar = (cell.column(x).to_numpy(zero_copy_only=False) for x in ("asks", "row", "vec_id", "bar"))
            v = _matrix(cell.column("v"))
            asks = asks.astype(bool)
            i, found, score = best(v[asks], row[asks], bar[asks], v[~asks], ids[~asks], row[~asks], k) if asks.any() and not asks.all() else (np.empty(0, int), np.empty(0, int), np.empty(0))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(row[asks][i]), pa.array(ids[asks][i]), pa.array(found.astype(np.int64)), pa.array(score)], names=["row", "query_id", "vec_id", "score"])

    def run(q: DataFrame, c: DataFrame) -> DataFrame:
        keys = ["dim", "q", "c"]
        return met(q, c).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "row long, query_id long, vec_id long, score double")

    # a first bar: the k-th best score in the queries' first block of candidates
    first = run(q.withColumn("c", F.lit(0)).withColumn("bar", F.lit(float("-inf"))), c.filter("c = 0"))
    bars = first.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("row", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    q = q.join(bars, "row", "left").withColumn("bar", F.coalesce("least", F.lit(float("-inf"))))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return run(q, c).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


#: The query in DuckDB.
ORACLE_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row AND len(q.e) = len(c.e))
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
