"""Quality by importance resampling: two hashed n-gram models and a Gumbel top-k.

Words, runs of signs and their pairs are hashed into ``BUCKETS``. Counts over
labelled good texts make the target model, counts over all texts the raw one; a
text's log weight is the log ratio of the two, summed over its n-grams. A word equal
to the one before it, and every word of a line equal to the one before it, is hashed
as such, not as the word. Gumbel noise, fixed by the id, is added, and the
``k`` greatest sums are the sample: a draw without replacement in proportion to the
weights.

The target model is fitted to a bounded sample of labelled rows (``SAMPLE``); raw
counts, weights and the k-th greatest sum cover every row.

Null or empty text: no n-gram, log weight 0. Null ids share one noise. Repeated
rows and ties at the k-th sum stay together, so the sample may be larger than k.
Without target rows all weights are 0. Empty table: no rows. Extra columns stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kth_largest, text_bytes

#: Hashed n-grams of each model.
BUCKETS = 20_000
#: Labelled target rows that the target model is fitted to, about.
SAMPLE = 20_000
#: Words whose hashes a worker keeps at a time, and their letters.
WORDS_KEPT, LETTERS_KEPT = 500_000, 20_000_000

_PARTS = re.compile(r"\w+|[^\w\s]+")
_AGAIN, _LINE = 1, 2  # hashes of a repeated word and of a word in a repeated line


class Hasher:
    """N-gram buckets of texts, with the hashes of words kept."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0

    def _words(self, parts: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[p] for p in parts], np.int64)
        except KeyError:
            if len(known) > WORDS_KEPT or self.letters > LETTERS_KEPT:
                known.clear()
                self.letters = 0
            for p in parts:
                if p not in known:
                    known[p] = 3 + zlib.crc32(p.encode())
                    self.letters += len(p)
            return np.array([known[p] for p in parts], np.int64)

    def buckets(self, text: str) -> np.ndarray:
        """Buckets of all words and pairs of a text."""
        lines = text.lower().split("\n")
        if len(set(lines)) < len(lines) and any(a == b for a, b in zip(lines, lines[1:])):
            parts = [_PARTS.findall(line) for line in lines]
            marks = [a == b for a, b in zip([None, *lines], lines)]
            h = self._words([p for part in parts for p in part])
            h[np.repeat(marks, [len(p) for p in parts])] = _LINE
        else:
            h = self._words(_PARTS.findall(text.lower()))
        if not len(h):
            return h
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (h[1:] != _LINE)])
        h = np.where(again, _AGAIN, h)
        pairs = (h[:-1] * 1_000_003 + h[1:] * 31 + 7) & 0x7FFFFFFFFFFFFFFF
        pairs ^= pairs >> 29
        return np.concatenate([h, pairs]) % BUCKETS


def ngram_counts(docs: DataFrame, target: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket over the texts whose id is in ``target`` (small), and over all texts."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(target.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, good in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                got = np.bincount(hasher.buckets(text), minlength=BUCKETS)
                total[1] += got
                if good:
                    total[0] += got
        seen = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])], names=["bucket", "target", "raw"])

    found = marked.select("text", "good").mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    both = np.zeros((2, BUCKETS), np.int64)
    for r in found.collect():  # at most BUCKETS rows
        both[:, r["bucket"]] = r["target"], r["raw"]
    return both[0], both[1]


def target_rows(labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """A bounded sample of the ids labelled good, and the good share among labelled rows, raised by two standard errors."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    good, n = known.agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(0)), F.count("*")).first()
    good = good or 0
    share = good / n if n else 1.0
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = known.filter("y > 0").filter(draw < min(1.0, sample / max(good, 1))).select("doc_id")
    return rows, min(1.0, share + 2 * (share * (1 - share) / max(n, 1)) ** 0.5)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the smoothed target chance over the smoothed raw chance, per bucket."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def log_weight(text: Column, ratio: np.ndarray) -> Column:
    """A text's log weight, as a column."""
    made: list[Hasher] = []

    @F.pandas_udf("double")
    def weigh(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Hasher())
        return pd.Series([float(ratio[made[0].buckets(t or "")].sum()) for t in texts], dtype="float64")

    return weigh(text.cast("string"))


def gumbel(doc_id: Column, seed: int = 0) -> Column:
    """Standard Gumbel noise fixed by the id."""
    u = (F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def weighted(docs: DataFrame, target: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with ``log_weight`` and ``key``, the weight with noise."""
    ratio = log_ratio(*ngram_counts(docs, target))
    return docs.withColumn("log_weight", log_weight(F.col("text"), ratio)).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))


def threshold(scored: DataFrame, share: float) -> float:
    """The k-th greatest key for a share of all rows. ``scored`` is read several times: a written stage."""
    n = scored.count()
    found = kth_largest(scored, F.col("key"), max(1, min(n, -int(-share * n // 1))))
    return float("-inf") if found is None else found
