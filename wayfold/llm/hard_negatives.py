"""Hard-negative mining: threshold joins over inverted lists, with thresholds that fall until windows fill.

An anchor's positives are its best rows of its own label; the hard negatives of a positive
are the best rows of other labels that score no more than the positive and no less
than a share of it. Both are threshold joins of anchors with rows by inner product, done
in rounds: a first, high threshold fills the windows of most anchors, and only those that
are still open are asked again with a lower one. The last threshold is the
foot of the window (for positives: none), so every window is complete in the end.

Anchors and rows meet in blocks of bounded size. A block of rows keeps its components in
inverted lists, a list a stretch of dimensions. A row's first dimensions are left out while their norm
times the anchors' norm stays below the threshold, for what they add alone cannot reach it.
Partial scores are summed from the last list to the first; a pair goes once its sum plus the
product of both remaining norms is below its threshold. Pairs that stay are scored whole.
Anchors are sent to every block that can hold partners: blocks of their own label
for positives, all blocks for negatives.

Rows with a null label, or a vector that is null, empty or holds null or non-finite
components, take no part; nor do rows with another number of components than the anchor.
Rows that repeat an id are rows each. Rows with a null id are never anchors, and come after all
ids in ties. Scores are exact up to 2^53. Empty table, no anchors: no rows. Extra columns
are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, written

#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's least share of its positive's score, in hundredths.
LEAST = 80
#: Components are these times as large, rounded down.
SCALE = 256
#: Anchors and rows of a block, about.
ANCHORS, ROWS = 256, 4096
#: Dimensions of an inverted list.
STRETCH = 8
#: Thresholds of the rounds: shares of the anchor's own score; hundredths of the positive's.
FIRST_SHARES = (0.8, 0.5, 0.25, None)
LATER_SHARES = (94, 87, LEAST)

_NO_ID = 2**63 - 1
_FOUND = "anchor long, slot int, key long, vec_id long, score double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Lists:
    """Rows of one block as inverted lists over stretches of dimensions."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(rows.var(axis=0), kind="stable")  # what tells rows apart is summed first
        self.rows = rows[:, self.order]
        self.starts = np.arange(0, rows.shape[1], STRETCH)
        #: norm of the dimensions before each stretch, then of all
        self.norms = self.norms_before(self.rows)

    def norms_before(self, v: np.ndarray) -> np.ndarray:
        squares = np.add.reduceat(v * v, self.starts, axis=1)
        return np.sqrt(np.concatenate([np.zeros((len(v), 1)), np.cumsum(squares, axis=1)], axis=1))

    def reach(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs that reach the anchor's threshold."""
        a = anchors[:, self.order]
        norms, slack = self.norms_before(a), 1e-6
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(norms[:, -1] > 0, (least - slack) / norms[:, -1], np.where(least > slack, np.inf, -np.inf)).min(initial=np.inf)
        # stretches before a row's first list are covered by their norm
        first = (self.norms[:, 1:] < ratio).sum(axis=1)
        by_first = np.argsort(first, kind="stable")
        lists = np.searchsorted(first[by_first], np.arange(len(self.starts)), side="right")
        alive = np.ones(len(self.rows), bool)
        total = np.zeros((len(a), len(self.rows)))
        near = np.zeros(total.shape, bool)
        for g in reversed(range(len(self.starts))):
            mine = by_first[: lists[g]]
            mine = mine[alive[mine]]
            if not len(mine):
                continue
            part = slice(self.starts[g], self.starts[g] + STRETCH)
            total[:, mine] += a[:, part] @ self.rows[mine, part].T
            near[:, mine] = total[:, mine] + norms[:, g, None] * self.norms[None, mine, g] * (1 + 1e-12) >= least[:, None] - slack
            alive[mine] = near[:, mine].any(axis=0)
        near[:, ~alive] = False
        i, j = np.nonzero(near)
        score = np.concatenate([np.einsum("ij,ij->i", anchors_, rows_) for anchors_, rows_ in ((a[i[s : s + 65536]], self.rows[j[s : s + 65536]]) for s in range(0, len(i), 65536))] or [np.empty(0)])
        ok = score >= least[i] - slack
        return i[ok], j[ok], score[ok]


def members(embeddings: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """key, vec_id, cls, dim, v of the rows that take part, written once so that keys stay."""
    fine = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter("label is not null").filter(F.coalesce(fine, F.lit(False)))
    rows = written(rows.select(F.monotonically_increasing_id().alias("key"), F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), "label", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("v")), "members")
    classes = written(rows.select("label").distinct().select("label", F.monotonically_increasing_id().alias("cls")), "classes")
    return rows.join(classes, "label").select("key", "vec_id", "cls", "dim", "v")


def _parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row a group of ``keys``: its number of blocks."""
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(ROWS)).cast("int").alias("parts"))


def threshold_join(asks: DataFrame, rows: DataFrame, same_label: bool, k: int, least_share: int) -> DataFrame:
    """(anchor, slot, key, vec_id, score): for each anchor and window its best ``k`` rows per block.

    ``asks``: key, cls, dim, v, least (threshold), tops (greatest score of each window; the slot is its place).
    Without ``same_label``, rows must have another label and ``least_share`` hundredths of the top.
    """
    keys = ["dim", "cls"] if same_label else ["dim"]
    parts = _parts(rows, keys)
    rows, asks = rows.withColumn("own", F.col("cls")), asks.withColumn("own", F.col("cls"))
    dealt = rows.join(parts, keys).withColumn("c", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    n_asks = asks.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(ANCHORS)).cast("int").alias("ask_parts"))
    sent = asks.join(n_asks, keys).join(parts, keys).withColumn("b", F.pmod(F.xxhash64("key", F.lit(7)), "ask_parts").cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = dealt.select(*keys, "c", F.lit(-1).alias("b"), "key", "own", "vec_id", "v", F.lit(0.0).alias("least"), F.array().cast("array<double>").alias("tops")).unionByName(
        sent.select(*keys, "c", "b", "key", "own", F.lit(0).cast("long").alias("vec_id"), "v", "least", "tops")
    )
    order = [*keys, "c", "b"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        for run in runs(batches, order):
            mine = tuple(run.column(c)[0].as_py() for c in order[:-1])
            key, own, ids = (run.column(c).to_numpy() for c in ("key", "own", "vec_id"))
            if run.column("b")[0].as_py() < 0:
                cell, lists, row_key, row_own, row_id = mine, Lists(_matrix(run.column("v"))), key, own, ids
                continue
            if mine != cell:
                continue
            width = max(len(t) for t in run.column("tops").to_pylist())
            tops = np.full((len(key), width), np.nan)
            for n, t in enumerate(run.column("tops").to_pylist()):
                tops[n, : len(t)] = [np.nan if x is None else x for x in t]
            i, j, score = lists.reach(_matrix(run.column("v")), run.column("least").to_numpy())
            ok = ((row_own[j] == own[i]) == same_label) & (row_key[j] != key[i])
            i, j, score = i[ok], j[ok], score[ok]
            by = np.lexsort((row_key[j], row_id[j], -score, i))
            i, j, score = i[by], j[by], score[by]
            for slot in range(width):
                top = tops[i, slot]
                inside = score <= top
                if not same_label:
                    inside &= 100 * score >= least_share * top
                at = np.flatnonzero(inside)
                place = np.arange(len(at)) - np.searchsorted(i[at], i[at])
                at = at[place < k]
                if len(at):
                    columns = [pa.array(key[i[at]]), pa.array(np.full(len(at), slot, np.int32)), pa.array(row_key[j[at]]), pa.array(row_id[j[at]]), pa.array(score[at])]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "key", "vec_id", "score"])

    found = both.repartition(*order[:-1]).sortWithinPartitions(*order).mapInArrow(search, _FOUND)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def positives(anchors: DataFrame, rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor, slot, vec_id, score): the best ``k`` other rows of each anchor's label, by falling thresholds."""
    open_, out = anchors, None
    own = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    for share in FIRST_SHARES:
        least = F.lit(float("-inf")) if share is None else own * share
        asks = open_.select("key", "cls", "dim", "v", least.alias("least"), F.array(F.lit(float("inf"))).alias("tops"))
        found = written(threshold_join(asks, rows, True, k, 0), "positives")
        full = found.groupBy("anchor").agg(F.count("*").alias("n"))
        if share is not None:
            full = full.filter(F.col("n") >= k)
        done = found.join(full.select("anchor"), "anchor", "left_semi").select("anchor", (F.col("rank") - 1).alias("slot"), "vec_id", "score")
        out = done if out is None else out.unionByName(done)
        open_ = written(open_.join(full, open_["key"] == full["anchor"], "left_anti"), "open")
        if share is None or not open_.limit(1).count():
            break
    return out


def negatives(anchors: DataFrame, rows: DataFrame, tops: DataFrame, k: int = NEGATIVES, least: int = LEAST) -> DataFrame:
    """(anchor, slot, rank, vec_id, score): the best ``k`` rows of other labels in the window of each positive, by falling thresholds.

    ``tops``: anchor, slot, score of each positive. No window of a negative top holds anything.
    """
    open_, out = written(tops.filter("score >= 0").select("anchor", "slot", "score"), "windows"), None
    width = (open_.agg(F.max("slot")).first()[0] or 0) + 1
    shares = [s for s in LATER_SHARES if s > least] + [least]
    for share in shares:
        slots = [F.max(F.when(F.col("slot") == s, F.col("score"))) for s in range(width)]
        wanted = open_.groupBy("anchor").agg((F.min("score") * share / 100).alias("least"), F.array(*slots).alias("tops"))
        asks = wanted.join(anchors, wanted["anchor"] == anchors["key"]).select("key", "cls", "dim", "v", "least", "tops")
        found = written(threshold_join(asks, rows, False, k, least), "negatives")
        if share == least:
            done = found
        else:
            full = found.groupBy("anchor", "slot").count().filter(F.col("count") >= k).drop("count")
            done = found.join(full, ["anchor", "slot"], "left_semi")
        done = done.select("anchor", "slot", "rank", "vec_id", "score")
        out = done if out is None else out.unionByName(done)
        if share == least:
            break
        open_ = written(open_.join(full, ["anchor", "slot"], "left_anti"), "windows")
        if not open_.limit(1).count():
            break
    return out


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for rows and anchors of ``members``."""
    anchors = written(anchors, "anchors")
    best = written(positives(anchors, rows, n_positives), "best")
    hard = negatives(anchors, rows, best, n_negatives, least)

    def name(c: str) -> Column:
        return F.when(F.col(c) != _NO_ID, F.col(c))

    kept = best.select("anchor", "slot", name("vec_id").alias("positive_id"), F.col("score").cast("long").alias("positive_score"))
    hard = hard.select("anchor", "slot", "rank", name("vec_id").alias("negative_id"), F.col("score").cast("long").alias("negative_score"))
    ids = anchors.select(F.col("key").alias("anchor"), name("vec_id").alias("anchor_id"))
    return hard.join(kept, ["anchor", "slot"]).join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mined_embeddings(embeddings: DataFrame) -> DataFrame:
    """The rows of the query: labels of every seventh id are wrong by one, anchors are every hundredth id."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = written(members(embeddings, label), "rows")
    return mine(rows, rows.filter(f"vec_id % 100 = 0 and vec_id <> {_NO_ID}"))


#: The query in DuckDB: every anchor with every row.
ORACLE_SQL = f"""WITH v AS (SELECT row_number() OVER () AS nr, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.nr AS a, a.vec_id AS anchor_id, c.nr AS c, c.vec_id, a.label = c.label AS same, cast(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.nr <> c.nr AND len(a.e) = len(c.e)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, c) AS place FROM s WHERE same) WHERE place <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.c) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, cast(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
