"""Near-duplicate texts by word n-gram Jaccard, candidates pruned the Bayesian way.

1. Every text becomes its set of hashed shingles (``WORDS`` words, split at white
   space; a shorter text is one shingle) and ``BANDS x ROWS`` MinHash values. Texts
   with one set are a class and go on as one.
2. Classes that share a band meet in buckets; buckets with the same members are
   kept once. In a bucket, MinHash values are compared a few at a time, and a pair
   is dropped as soon as the posterior chance of ``threshold`` falls below ``MISS``.
   What stays links classes to groups; no pair at or above the threshold lies
   across two groups.
3. In a group, all pairs are verified on whole shingle sets. Links are
   counted, and joined to components.

Buckets and groups of any size are dealt in blocks, and a block pair sends one row
per class and link of a spanning forest, never its pairs. A pair at the threshold
exactly is missed by all bands with chance (1 - t^ROWS)^BANDS, 3e-6 at 0.8.

Null or empty text and text of white space has no shingle and links with nothing.
A document is an id, null or not, with one shingle set: rows of one id with different
sets are documents of their own, and their texts are never joined. Inside, documents go
by a row number. Empty table: no rows. Extra columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import connected_components, forest, runs, text_bytes

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 32
#: MinHash values looked at before each decision, and the chance below which a pair is dropped.
LOOKS = (20, 40, 80, 160)
MISS = 1e-6
#: Classes in a block; a task holds two blocks.
BUCKET_BLOCK, GROUP_BLOCK = 512, 256

_SEEDS = np.random.default_rng(20_011).integers(1, 1 << 32, (2, ROWS * BANDS), dtype=np.uint64).astype(np.uint32)


class Shingler:
    """Shingle sets of texts; hashes of words are kept."""

    def __init__(self, words: int = WORDS):
        self.words, self.known, self.letters = words, {}, 0

    def _hashes(self, parts: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[p] for p in parts], np.uint64)
        except KeyError:
            if len(known) > 500_000 or self.letters > 20_000_000:
                known.clear()
                self.letters = 0
            import xxhash

            for p in parts:
                if p not in known:
                    known[p] = xxhash.xxh3_64_intdigest(p)
                    self.letters += len(p)
            return np.array([known[p] for p in parts], np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct shingles."""
        parts = text.split()
        if not parts:
            return np.empty(0, np.uint64)
        h, n = self._hashes(parts), min(self.words, len(parts))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(h) - n + 1 + i]
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least of each hash over a set; 32 bits each."""
    a, b = _SEEDS
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    low = shingles.astype(np.uint32) ^ (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 4096):
        x = low[at : at + 4096, None] * (a | np.uint32(1))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x += b
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def least_matches(looks: tuple[int, ...] = LOOKS, threshold: float = THRESHOLD, miss: float = MISS) -> list[int]:
    """Per look, the fewest matches at which the posterior (even prior) still gives the threshold a chance of ``miss``.

    The posterior of m matches in n is Beta(m + 1, n - m + 1); its mass above t is the
    chance of at most m successes in n + 1 draws at t.
    """
    out = []
    for n in looks:
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return out


def text_marks(text: str = "text") -> list[Column]:
    """128 bits of a text as two columns; null counts as empty."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("text_1"), F.xxhash64(F.lit(1), whole).alias("text_2")]


def same_text(a: DataFrame, b: DataFrame) -> Column:
    """Rows with one id, null or not, and one text."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_1"] == b["text_1"]) & (a["text_2"] == b["text_2"])


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_1, text_2, n (shingles), set_1, set_2 (128 bits of the set), minhash (binary) from doc_id, text, text_1, text_2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.shingles(t) for t in text_bytes(batch.column(1))]
            marks = [_set_mark(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *batch.columns[2:], pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                    pa.array([minhash(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_1", "text_2", "n", "set_1", "set_2", "minhash"],
            )

    return docs.mapInArrow(run, "doc_id long, text_1 long, text_2 long, n long, set_1 long, set_2 long, minhash binary")


def _set_mark(s: np.ndarray) -> tuple[int, int]:
    one = np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15)) if len(s) else np.uint64(0)
    y = (s ^ (s >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    two = (y ^ (y >> np.uint64(32))).sum(dtype=np.uint64)
    return int(np.uint64(one).astype(np.int64)), int(np.uint64(two).astype(np.int64))


def _blocks(df: DataFrame, size: str, key: str, block: int) -> DataFrame:
    """Rows copied to each pair of blocks (i <= j) of their bucket that holds their own block."""
    parts = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(key, F.lit(7)), parts).cast("int")
    return (
        df.withColumn("_n", parts).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).withColumn("side", F.col("_own") > F.col("i"))
        .drop("_n", "_own", "_other")
    )


def candidate_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): links whose components hold every pair of classes at or above the threshold.

    ``classes``: rep, minhash. A written stage: read twice.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, BANDS + 1, dtype=np.uint64)
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.repeat(salt[None, :], len(v), axis=0)
            for r in range(ROWS):
                key = (key ^ v[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(key.reshape(-1).astype(np.int64))], names=["rep", "bucket"])

    dealt = classes.select("rep", "minhash").mapInArrow(bands, "rep long, bucket long")
    # one bucket of those that hold the same classes
    full = (
        dealt.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("who_2"))
        .filter("size > 1").groupBy("size", "who", "who_2").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    )
    members = cut_lineage(dealt.join(full, "bucket"))
    cells = _blocks(members, "size", "rep", BUCKET_BLOCK).join(classes.select("rep", "minhash"), "rep").select("bucket", "i", "j", "rep", "side", "minhash")
    need = least_matches(threshold=threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["bucket", "i", "j"]):
            v = np.frombuffer(b"".join(rows.column("minhash").to_pylist()), "<u4").reshape(-1, ROWS * BANDS)
            rep, side = rows.column("rep").to_numpy(), rows.column("side").to_numpy(zero_copy_only=False)
            order = np.argsort(rep, kind="stable")
            v, rep, side = v[order], rep[order], side[order]
            mixed = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
            left, right = [], []
            for at in range(0, len(rep), 64):
                a, b = np.meshgrid(np.arange(at, min(at + 64, len(rep))), np.arange(len(rep)), indexing="ij")
                ok = a < b if not mixed else (~side[a]) & side[b]
                a, b = a[ok], b[ok]
                same, done = np.zeros(len(a), np.int64), 0
                for look, least in zip(LOOKS, need):
                    same += (v[a, done:look] == v[b, done:look]).sum(axis=1)
                    keep = same >= least
                    a, b, same, done = a[keep], b[keep], same[keep], look
                left.append(a)
                right.append(b)
            kid, root = forest(len(rep), np.concatenate(left), np.concatenate(right))
            if len(kid):
                yield pa.RecordBatch.from_arrays([pa.array(rep[kid]), pa.array(rep[root])], names=["a", "b"])

    keys = ["bucket", "i", "j"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def verified(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (a, b, links): ``b`` null and the links of class ``a`` counted by copies, or a link of a spanning forest.

    ``sets``: grp, size (classes of the group), rep, copies, shingles (binary).
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["grp", "i", "j"]):
            rep, side, copies = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "side", "copies"))
            order = np.argsort(rep, kind="stable")
            rep, side, copies = rep[order], side[order], copies[order]
            data = [np.frombuffer(x.as_buffer(), "<u8") for x in rows.column("shingles").take(pa.array(order))]
            n = np.array([len(d) for d in data])
            mixed = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
            # columns: shingles that two or more of the sets hold
            values, where, seen = np.unique(np.concatenate(data), return_inverse=True, return_counts=True)
            column = np.cumsum(seen > 1) - 1
            of = np.repeat(np.arange(len(rep)), n)
            shared = seen[where] > 1
            of, col = of[shared], column[where[shared]]
            by = np.argsort(col, kind="stable")
            of, col = of[by], col[by]
            same = np.zeros((len(rep), len(rep)), np.float32)
            width = max(256, (1 << 22) // max(len(rep), 1))
            for low in range(0, int(col[-1]) + 1 if len(col) else 0, width):
                a, b = np.searchsorted(col, (low, low + width))
                part = np.zeros((len(rep), int(min(width, col[b - 1] - low + 1)) if b > a else 1), np.float32)
                part[of[a:b], col[a:b] - low] = 1
                same += part @ part.T
            union = n[:, None] + n[None, :] - same
            linked = same >= threshold * union - 1e-6
            linked &= (side[:, None] != side[None, :]) if mixed else ~np.eye(len(rep), dtype=bool)
            links = linked @ copies
            has = np.flatnonzero(links)
            kid, root = forest(len(rep), *np.nonzero(np.triu(linked)))
            a = np.concatenate([rep[has], rep[kid]])
            b = pa.array(np.concatenate([np.zeros(len(has), np.int64), rep[root]]), mask=np.arange(len(a)) < len(has))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[has], np.zeros(len(kid), np.int64)]).astype(np.int64))], names=["a", "b", "links"])

    keys = ["grp", "i", "j"]
    cells = _blocks(sets, "size", "rep", GROUP_BLOCK).select(*keys, "rep", "side", "copies", "shingles")
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long, links long")


def grouped(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows with their signatures and a row number, and one row per document: doc_id, row (its first), keeper (row of the group's document with the least id), class_id, n_links."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *text_marks())
    # the numbers are fixed by being written
    signed = cut_lineage(signatures(texts, words).withColumn("row", F.monotonically_increasing_id()))
    known = signed.filter("n > 0").groupBy("doc_id", "set_1", "set_2", "n").agg(F.min("row").alias("row"), F.count("*").alias("rows"))
    # a class goes by its document with the least id; a null id comes last
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    classes = known.groupBy("set_1", "set_2", "n").agg(F.min_by("row", order).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    member = cut_lineage(known.join(classes, ["set_1", "set_2", "n"]).select("doc_id", "row", "rows", "rep", "least", "copies"))
    reps = member.filter("row = rep").select("rep", "rows", "least", "copies")
    groups = connected_components(candidate_links(reps.join(signed.select(F.col("row").alias("rep"), "minhash"), "rep"), threshold), "a", "b")
    groups = cut_lineage(groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
    wanted = groups.join(sizes, "grp").join(reps, "rep").join(signed.select(F.col("row").alias("rep"), "doc_id", "text_1", "text_2"), "rep")
    of_text = texts.join(wanted, same_text(texts, wanted)).select("text", "rep", "grp", "size", "copies")
    if wanted.filter("rows > 1").limit(1).count():
        of_text = of_text.groupBy("rep", "grp", "size", "copies").agg(F.min("text").alias("text")).select(*of_text.columns)

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.shingles(t).astype("<u8").tobytes() for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], names=["rep", "grp", "size", "copies", "shingles"])

    found = cut_lineage(verified(of_text.mapInArrow(shingle, "rep long, grp long, size long, copies long, shingles binary"), threshold))
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = cut_lineage(connected_components(found.filter("b IS NOT NULL"), "a", "b").select(F.col("node").alias("rep"), "component"))
    first = F.min(F.struct(F.col("least").isNull(), "least", F.col("rep").alias("keeper"))).alias("first")
    named = roots.join(reps, "rep").groupBy("component").agg(first).select("component", F.col("first.least").alias("class_id"), F.col("first.keeper").alias("keeper"))
    of_rep = links.join(roots.join(named, "component"), "rep", "full")
    of_doc = member.join(of_rep, "rep", "left").select(
        "doc_id", "row", F.coalesce("keeper", "rep").alias("keeper"), F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    bare = signed.filter("n = 0").groupBy("doc_id").agg(F.min("row").alias("row"))
    return signed, of_doc.unionByName(bare.select("doc_id", "row", F.col("row").alias("keeper"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, null_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id (least id that links reach, null if all are null), n_links (other documents linked directly).

    Documents without an id are judged and counted like all others; their own rows are returned with ``null_ids``.
    """
    found = grouped(docs, words, threshold)[1].select("doc_id", "class_id", "n_links")
    return found if null_ids else found.filter("doc_id IS NOT NULL")


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group, that of the least id; rows without a shingle stay, once per id, and all of those without an id."""
    signed, found = grouped(docs.select("doc_id", "text"), words, threshold)
    kept = signed.join(cut_lineage(found.filter("row = keeper").select("row")), "row", "left_semi").select("doc_id", "text_1", "text_2")
    free = signed.filter("n = 0 AND doc_id IS NULL").select("doc_id", "text_1", "text_2")
    stay = cut_lineage(kept.unionByName(free).distinct())
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), *text_marks())
    left = marked.join(stay, same_text(marked, stay), "left_semi")
    twice = cut_lineage(signed.filter("n > 0 OR doc_id IS NOT NULL").groupBy("doc_id", "text_1", "text_2").count().filter("count > 1").drop("count"))
    if twice.limit(1).count():
        once = left.join(twice, same_text(left, twice), "left_semi").dropDuplicates(["doc_id", "text_1", "text_2"])
        left = left.join(twice, same_text(left, twice), "left_anti").unionByName(once)
    return left.select("whole.*")
