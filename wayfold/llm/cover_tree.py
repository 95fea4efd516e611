"""Near-duplicate vectors: exact pairs by cosine, found by walking two cover trees at once.

Vectors of one label are scaled to length one, where cosine >= c means distance
<= sqrt(2 - 2c). Equal vectors are one class. Classes are dealt to the nearest of a
bounded number of centres and in blocks; each block becomes a cover tree: nested
levels whose radii halve, every node with the greatest distance to what lies below
it. Two blocks are walked together from their roots: node pairs farther apart than
both radii and the threshold are dropped, others open, and leaves are compared in
double precision by their cosine. Block pairs whose roots are too far apart are
never sent.

A block pair sends one row per class and link of a spanning forest, not its pairs,
unless pairs are asked for.

Vectors that are null, zero, or hold null or non-finite components link with
nothing, nor do those without a label; each is a component of its own. Vectors of
different lengths do not link. Labels of any type that can be written as text are compared as
they are. Repeated rows are vectors of their own and link with
each other. Rows with a null id: n_links as any other, and the component's id if a
linked row has one. Empty table: no rows. Extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import connected_components, forest, runs

COSINE = 0.93
#: Classes in a block, about; centres a label has at most, and all labels have.
BLOCK = 1024
CENTRES, ALL_CENTRES = 64, 4096


class Tree:
    """A cover tree over unit vectors: nodes level by level, children of a node next to each other."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        point, radius, child = [0], [0.0], [(0, 0)]
        todo = [(0, np.arange(1, len(unit)), None)]  # node, points below it, radius of its level
        for node, below, level in todo:
            if not len(below):
                continue
            distance = self._distance(point[node], below)
            radius[node] = float(distance.max())
            level = radius[node] if level is None else level
            level = min(level, radius[node]) / 2
            start, parts = len(point), [(point[node], below[distance <= level])]
            rest, distance = below[distance > level], None
            while len(rest):
                centre, rest = int(rest[0]), rest[1:]
                near = self._distance(centre, rest) <= level
                parts.append((centre, rest[near]))
                rest = rest[~near]
            if len(parts) == 1 and level < 1e-9:  # as good as equal: all are leaves
                parts = [(point[node], below[:0])] + [(int(p), below[:0]) for p in below]
            for centre, own in parts:
                todo.append((len(point), own, level))
                point.append(centre)
                radius.append(0.0)
                child.append((0, 0))
            child[node] = (start, len(point))
        self.point, self.radius, self.child = np.array(point), np.array(radius), child
        self.leaf = np.array([a == b for a, b in child])

    def _distance(self, one: int, many: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, ((self.unit[many] - self.unit[one]) ** 2).sum(axis=1)))


def dual_pairs(left: Tree, right: Tree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs within ``reach`` (and a hair more), by walking both trees."""
    same = left is right
    out_a, out_b, todo = [], [], [(0, 0)]
    while todo:
        a, b = todo.pop()
        kids_a = np.arange(*left.child[a]) if not left.leaf[a] else np.array([a])
        kids_b = np.arange(*right.child[b]) if not right.leaf[b] else np.array([b])
        x, y = left.unit[left.point[kids_a]], right.unit[right.point[kids_b]]
        gap = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T))
        near = gap <= left.radius[kids_a][:, None] + right.radius[kids_b][None, :] + reach + 1e-6
        if same and a == b:
            near = np.triu(near)
        i, j = np.nonzero(near)
        i, j = kids_a[i], kids_b[j]
        ends = left.leaf[i] & right.leaf[j]
        p, q = left.point[i[ends]], right.point[j[ends]]
        keep = p != q if same else np.ones(len(p), bool)
        out_a.append(p[keep])
        out_b.append(q[keep])
        todo.extend(zip(i[~ends].tolist(), j[~ends].tolist()))
    return np.concatenate(out_a), np.concatenate(out_b)


def _usable(vector: str = "embedding"):
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v**2).sum(axis=1, keepdims=True))


def blocks(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``classes`` (cls, label, dim, copies, embedding) with ``blk``, the block of each."""
    spark = classes.sparkSession
    sizes = classes.groupBy("label", "dim").count()
    wanted = sizes.select("label", "dim", "count", F.least(F.lit(CENTRES), F.ceil(F.col("count") / block)).cast("int").alias("centres"))
    # at most ALL_CENTRES vectors: the share of each label is drawn by hash
    drawn = classes.join(F.broadcast(wanted.filter("centres > 1").orderBy(F.desc("count")).limit(ALL_CENTRES // 2)), ["label", "dim"]).filter(
        F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < F.col("centres") / F.col("count") * (1 << 20))
    centres: dict[tuple, np.ndarray] = {}
    for r in drawn.select("label", "dim", "embedding").limit(ALL_CENTRES).collect():
        centres.setdefault((r["label"], r["dim"]), []).append(r["embedding"])
    centres = {k: _unit(np.array(v, np.float64)) for k, v in centres.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = np.zeros(batch.num_rows, np.int32)
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            for k in set(keys) & set(centres):
                mine = np.array([x == k for x in keys])
                v = _unit(_matrix(batch.column(4).filter(pa.array(mine))))
                nearest[mine] = (v @ centres[k].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=["cls", "label", "dim", "copies", "embedding", "centre"])

    near = cut_lineage(classes.select("cls", "label", "dim", "copies", "embedding").mapInArrow(assign, "cls long, label string, dim int, copies long, embedding array<double>, centre int"))
    parts = near.groupBy("label", "dim", "centre").agg(F.ceil(F.count("*") / block).alias("parts"))
    return near.join(parts, ["label", "dim", "centre"]).withColumn("blk", F.xxhash64("label", "dim", "centre", F.pmod(F.xxhash64("cls", F.lit(3)), "parts"))).drop("parts", "centre")


def linked(classes: DataFrame, cosine: float = COSINE, pairs: bool = False) -> DataFrame:
    """Rows (a, b, links): ``b`` null and the links of class ``a`` by copies, or a link of a spanning forest; with ``pairs``, all links."""
    dealt = cut_lineage(blocks(classes))
    reach = float(np.sqrt(2 - 2 * cosine))

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["blk"]):
            at = np.argsort(rows.column("cls").to_numpy())
            unit = _unit(_matrix(rows.column("embedding")))[at]
            far = float(np.sqrt(np.maximum(0, 2 - 2 * (unit @ unit[0])).max()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("blk")[:1].combine_chunks(), rows.column("label")[:1].combine_chunks(), rows.column("dim")[:1].combine_chunks(), pa.array([unit[0].tolist()]), pa.array([far])],
                names=["blk", "label", "dim", "root", "radius"])

    roots = cut_lineage(dealt.repartition("blk").sortWithinPartitions("blk").mapInArrow(root, "blk long, label string, dim int, root array<double>, radius double"))
    one, two = roots.toDF("i", "label", "dim", "r1", "d1"), roots.toDF("j", "label", "dim", "r2", "d2")
    dot = F.aggregate(F.zip_with("r1", "r2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cells = one.join(two, ["label", "dim"]).filter("i <= j").filter(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("d1") + F.col("d2") + reach + 1e-6).select("i", "j")
    cells = cut_lineage(cells)
    sides = cells.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"))
    rows = sides.join(dealt, "blk").select("i", "j", (F.col("blk") != F.col("i")).alias("side"), "cls", "copies", "embedding")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["i", "j"]):
            cls, copies, side = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "copies", "side"))
            at = np.lexsort((cls, side))
            cls, copies, side, v = cls[at], copies[at], side[at], _matrix(cell.column("embedding"))[at]
            unit, cut = _unit(v), int((~side).sum())
            left = Tree(unit[:cut])
            right = left if cell.column("i")[0].as_py() == cell.column("j")[0].as_py() else Tree(unit[cut:])
            a, b = dual_pairs(left, right, reach)
            b = b if right is left else b + cut
            v = v / np.abs(v).max(axis=1, keepdims=True)
            exact = np.concatenate([
                (v[a[k : k + 65536]] * v[b[k : k + 65536]]).sum(axis=1) / np.sqrt((v[a[k : k + 65536]] ** 2).sum(axis=1) * (v[b[k : k + 65536]] ** 2).sum(axis=1))
                for k in range(0, max(len(a), 1), 65536)])
            a, b = a[exact >= cosine], b[exact >= cosine]
            if not len(a):
                continue
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(cls[np.minimum(a, b)]), pa.array(cls[np.maximum(a, b)]), pa.array(np.zeros(len(a), np.int64))], names=["a", "b", "links"])
                continue
            n = (np.bincount(a, copies[b], minlength=len(cls)) + np.bincount(b, copies[a], minlength=len(cls))).astype(np.int64)
            has = np.flatnonzero(n)
            kid, top = forest(len(cls), a, b)
            first = np.concatenate([cls[has], cls[kid]])
            second = pa.array(np.concatenate([np.zeros(len(has), np.int64), cls[top]]), mask=np.arange(len(first)) < len(has))
            yield pa.RecordBatch.from_arrays([pa.array(first), second, pa.array(np.concatenate([n[has], np.zeros(len(kid), np.int64)]))], names=["a", "b", "links"])

    return rows.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(walk, "a long, b long, links long")


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows with the two halves of their key, null where they take no part, and the written classes of equal vectors of a label.

    The key is two hashes of 64 bits of the label and the vector, read forwards and backwards; among
    10^10 vectors two unlike ones share both with chance 1e-19. ``cls`` numbers the classes.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))  # one zero
    used = F.col("label").isNotNull() & _usable()
    rows = rows.withColumn("h1", F.when(used, F.xxhash64("label", F.size("embedding"), "embedding"))).withColumn("h2", F.when(used, F.xxhash64(F.lit(1), F.reverse("embedding"), "label")))
    classes = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first(F.size("embedding")).alias("dim"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    return rows, cut_lineage(classes.withColumn("cls", F.monotonically_increasing_id()))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, classes = vector_classes(vectors)
    found = cut_lineage(linked(classes, cosine))
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("b IS NOT NULL"), "a", "b").select(F.col("node").alias("cls"), "component")
    own = classes.select("cls", "h1", "h2", "copies", "least").join(links, "cls", "left").join(roots, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    of = own.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(of, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The query in DuckDB.
ORACLE_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = comp.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp"""
