"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Texts become words. Of the hashes of all runs of k words, the least of every window of
w such runs is kept as a fingerprint (with all its ties). Two texts that share k + w - 1
words in a row share all the runs of one window, hence its least one: with k + w - 1 = the
window's size, no shared window is missed. An item's window has one fingerprint, the least of
its own runs, at a known place in it. A document's fingerprints are joined with those; a hit is
extended to the words of the whole window around it and joined with the windows of that
fingerprint and place by these words, so what remains is exact.

Items of fewer words than a window are one window each; every size that occurs has its own
k and w (k is the size itself where it is below ``RUN``).

Fingerprints of the benchmark are broadcast in blocks of ``BLOCK`` windows. A benchmark of
one block takes one pass over the documents; with more, the documents are written with
a row number first, and each block takes a pass. All words of a document travel beside its
fingerprints by reference only; what is shuffled is a row a document and a row a
window found in it. Equal sets of windows are looked up once, however many documents hold them.

Null texts, and texts without words, have no words and no hits. Rows that repeat an id are
documents each. Items without words never occur; rows of one item_id are one item, and
rows whose item_id is null are one item that is written as an empty string. An empty
benchmark hits nothing; an empty table gives no rows. Texts of any length are read whole. Extra
columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import written

#: Words of a window.
WINDOW = 10
#: Words of a run whose hash is a fingerprint.
RUN = 5
#: Windows of the benchmark that are broadcast at once; about 200 bytes each.
BLOCK = 200_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none of a null text."""
    low = F.translate(text.cast("string"), _UPPER, _LOWER)
    return F.coalesce(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def places(n: Column) -> Column:
    """0 … n-1, empty when n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))


def run_hashes(hashed: Column, k: int) -> Column:
    """The hash of every run of k words, from the words' hashes."""
    return F.transform(places(F.size(hashed) - (k - 1)), lambda i: F.xxhash64(*(F.get(hashed, i + j) for j in range(k))))


def least_of_windows(runs: Column, w: int) -> Column:
    """The least of every w neighbours."""
    if w == 1:
        return runs
    return F.transform(places(F.size(runs) - (w - 1)), lambda i: F.least(*(F.get(runs, i + j) for j in range(w))))


def fingerprints(runs: Column, least: Column, size: int) -> Column:
    """(size, at, print) of the runs that are the least of a window they lie in."""
    w = shape(size)[1]
    # a run's hash is never below the least of a window around it, so it is one of these if it is no greater than the greatest
    near = (lambda i: F.get(least, i)) if w == 1 else (lambda i: F.greatest(*(F.get(least, i - j) for j in range(w))))
    kept = F.filter(F.transform(runs, lambda r, i: F.struct(i.alias("at"), r.alias("print"), (r <= near(i)).alias("least"))), lambda s: s["least"])
    return F.transform(kept, lambda s: F.struct(F.lit(size).alias("size"), s["at"].alias("at"), s["print"].alias("print")))


def shape(size: int) -> tuple[int, int]:
    """k and w that find every shared window of ``size`` words."""
    k = min(RUN, size)
    return k, size - k + 1


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item, size, words (joined by blanks): the distinct windows of each item."""
    w = F.col("w")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).filter(F.size(w) > 0)
    every = F.transform(places(F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i + 1, F.least(F.lit(size), F.size(w)))))
    return items.select("item", F.least(F.lit(size), F.size(w)).alias("size"), F.explode(every).alias("words")).distinct()


def placed_windows(windows: DataFrame) -> DataFrame:
    """``windows`` (size, words) with the fingerprint of each and its place in it."""
    hashed = windows.withColumn("h", F.transform(F.split("words", " ", -1), lambda x: F.xxhash64(x)))
    runs = F.lit(None).cast("array<bigint>")
    for size in range(1, WINDOW + 1):
        runs = F.when(F.col("size") == size, run_hashes(F.col("h"), shape(size)[0])).otherwise(runs)
    least = hashed.withColumn("runs", runs).withColumn("print", F.array_min("runs"))
    return least.select(*windows.columns, "print", (F.array_position("runs", F.col("print")) - 1).cast("int").alias("place"))


def hits(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Of ``rows`` (row, w, others): every row once with null in start, and a row for each window found.

    Columns: row, others, n_words, start, size, window. ``windows`` (window, size, words, print, place) is broadcast.
    """
    own = [c for c in rows.columns if c != "w"]
    hashed = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("w"))
    found: Column = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("print")))
    for size in sizes:
        k, w = shape(size)
        hashed = hashed.withColumn(f"r{size}", run_hashes(F.col("h"), k)).withColumn(f"l{size}", least_of_windows(F.col(f"r{size}"), w))
        found = F.concat(found, fingerprints(F.col(f"r{size}"), F.col(f"l{size}"), size))
    each = hashed.select(*own, "w", "n_words", F.explode(found).alias("f")).select(*own, "w", "n_words", "f.*")
    known = F.broadcast(windows.select("size", "print", "place").distinct())
    near = each.join(known, ["size", "print"], "left").filter(F.col("place").isNotNull() | (F.col("size") == 0))
    start = F.col("at") - F.col("place")
    inside = near.withColumn("start", start).filter((F.col("size") == 0) | ((start >= 0) & (start + F.col("size") <= F.col("n_words"))))
    # the hit extended to the whole window; rows of size 0 stand for the document
    spread = inside.select(*own, "n_words", "start", "size", "print", "place", F.when(F.col("size") > 0, F.concat_ws(" ", F.slice("w", F.greatest(F.col("start") + 1, F.lit(1)), F.col("size")))).alias("words"))
    exact = spread.join(F.broadcast(windows), ["size", "print", "place", "words"], "left").filter(F.col("window").isNotNull() | (F.col("size") == 0))
    return exact.select(*own, "n_words", "start", "size", "window")


def covered(spans: Column) -> Column:
    """Words inside any of the spans (start, size)."""
    empty = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(got: Column, s: Column) -> Column:
        end = s["start"] + s["size"]
        return F.struct(F.greatest(got["end"], end).alias("end"), (got["n"] + F.greatest(F.lit(0), end - F.greatest(got["end"], s["start"]))).alias("n"))

    return F.aggregate(F.array_sort(spans), empty, add, lambda got: got["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (start and end word of each window found)."""
    if not 1 <= size <= WINDOW:
        raise ValueError(f"windows of 1 to {WINDOW} words")
    items = written(item_windows(benchmark, size).withColumn("window", F.sha2(F.concat("size", F.lit(":"), "words"), 256)), "item-windows")
    distinct = written(placed_windows(items.select("window", "size", "words").distinct()), "windows")
    found = distinct.groupBy("size").count().collect()  # ``size`` rows at most
    sizes, n = sorted(r["size"] for r in found), sum(r["count"] for r in found)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text"))
    as_words = [F.col("row"), F.col("doc_id"), words(F.col("text")).alias("w")]
    if n <= block:
        every = hits(rows.select(*as_words), distinct, sizes)
    else:
        rows = written(rows, "numbered-texts").select(*as_words)
        blocks = -(-n // block) * 2  # by hash, so a block is half full on average
        parts = [hits(rows, distinct.filter(F.pmod(F.xxhash64("window", F.lit(11)), F.lit(blocks)) == b), sizes) for b in range(blocks)]
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
    span = F.when(F.col("window").isNotNull(), F.struct("start", "size"))
    judged = every.groupBy("row", "doc_id").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("window")).alias("windows"))
    judged = judged.withColumn("windows", F.when(F.size("windows") > 0, F.col("windows"))).withColumn("set", F.sha2(F.array_join("windows", ""), 256))
    judged = written(judged, "judged")
    # each set of windows is looked up once
    sets = judged.filter("set is not null").groupBy("set").agg(F.first("windows").alias("windows"))
    of = sets.select("set", F.explode("windows").alias("window")).join(items.select("window", "item"), "window")
    named = of.select("set", "item").distinct().groupBy("set").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("all"))
    named = named.select("set", F.col("n").alias("n_items"), F.sha2("all", 256).alias("items_sha256"))
    out = judged.join(named, "set", "left")
    n_hit = covered(F.col("spans"))
    ends = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["size"]).alias("end"))).alias("spans")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), ends,
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.0) -> DataFrame:
    """Documents of which at most ``share`` of the words are hit; null ids and repeated ids are judged as the worst of their rows."""
    judged = decontaminate(docs, benchmark).groupBy("doc_id").agg(F.max(F.col("n_hit") / F.greatest(F.col("n_words"), F.lit(1))).alias("_hit"))
    bad = cut_lineage(judged.filter(F.col("_hit") > share).select(F.col("doc_id").alias("_bad")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")


#: The query in DuckDB: every window of every text, met as it stands.
ORACLE_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS size, list_slice(w, i, i + least({WINDOW}, len(w)) - 1) AS words
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT nr, size, i, list_slice(w, i, i + size - 1) AS words FROM (SELECT nr, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
met AS (SELECT p.nr, p.size, p.i, x.item FROM places p JOIN windows x ON p.size = x.size AND p.words = x.words),
hit AS (SELECT nr, count(DISTINCT k) AS n_hit FROM (SELECT nr, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT nr, i, size FROM met)) GROUP BY nr),
named AS (SELECT nr, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT nr, item FROM met) GROUP BY nr)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (nr) LEFT JOIN named USING (nr)"""
