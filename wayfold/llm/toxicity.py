"""Toxicity by multiple-instance learning: sentences are judged, documents are labelled.

A sentence's chance is a logistic function of the weights of its words and of their
first letters; a document's chance is the noisy-or of its sentences. The
weights are fitted to document labels by gradient steps on that likelihood, so the
sentences that made a document toxic carry the weight, and ``locate`` names them. A step
is a job over the written sample: tasks sum the slopes, the driver holds only weights.

Labels are learned from a bounded sample of the training rows, ``SAMPLE`` a class;
every text is scored whole. A word's weight is looked up once per worker.

Null or empty text has no sentence and scores 0, also where no model could be
fitted (no labelled text of one of the two classes): then every text scores the
toxic share of the labelled rows. Null ids are scored, held out from nothing and
never learned from; repeated labels of a document count as their greatest, and of its
repeated texts the least is learned from. Repeated rows are scored each. Texts of any
length are scored whole. Empty table: no rows. Extra columns stay.
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

from .common import text_bytes, written

#: Training documents of each class, about.
SAMPLE = 2000
#: Hashed features; a feature counts when this many training documents have it.
BUCKETS = 1 << 20
SEEN_IN = 4
#: Gradient steps, their size, and the pull of weights to zero.
STEPS, RATE, DECAY = 80, 0.2, 0.05
#: Lengths of the word beginnings that are features beside the word.
HEADS = (4, 5, 6)
#: Words whose weights a worker keeps at a time, and their letters.
WORDS_KEPT, LETTERS_KEPT = 500_000, 20_000_000
#: Features of the sample worked on together, about.
TOGETHER = 1 << 19
#: Tasks of a gradient step, for the sample is bounded, whatever number of files it lies in. Each sends a number a weight to the driver.
STEP_TASKS = 4

_PARTS = re.compile(r"[^\W\d_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")


def features(word: str) -> list[int]:
    """Hashed features of a word in lower case."""
    names = [word] + [f"{word[:n]}-" for n in HEADS if len(word) >= n]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def sentence_parts(text: str) -> tuple[list[str], np.ndarray]:
    """Words of a text in lower case and the sentence of each."""
    parts = _PARTS.findall(text.lower())
    stop = np.fromiter((p in _STOPS for p in parts), bool, len(parts))
    number = np.cumsum(stop)[~stop]
    return [p for p in parts if p not in _STOPS], np.unique(number, return_inverse=True)[1]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class Model:
    """Fitted weights; scores texts."""

    def __init__(self, weights: dict[int, float], bias: float, share: float | None = None):
        self.weights, self.bias, self.share = weights, bias, share
        self.known: dict[str, float] = {}
        self.letters = 0

    def __getstate__(self):
        return self.weights, self.bias, self.share

    def __setstate__(self, state):
        self.__init__(*state)

    def _look_up(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words])
        except KeyError:
            if len(known) > WORDS_KEPT or self.letters > LETTERS_KEPT:
                known.clear()
                self.letters = 0
            get = self.weights.get
            for w in words:
                if w not in known:
                    known[w] = sum(get(f, 0.0) for f in features(w))
                    self.letters += len(w)
            return np.array([known[w] for w in words])

    def sentences(self, text: str) -> np.ndarray:
        """Log odds of each sentence that has words."""
        words, number = sentence_parts(text)
        if not words:
            return np.zeros(0)
        w = self._look_up(words)
        w[1:] *= (w[1:] != w[:-1]) | (number[1:] != number[:-1])  # a word said again and again counts once
        return np.bincount(number, w) + self.bias

    def score(self, text: str) -> float:
        if self.share is not None:
            return self.share
        return float(-np.expm1(-np.logaddexp(0, self.sentences(text)).sum()))


def sample_rows(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """Blocks of sampled documents: labels, and for each feature of a sentence the document, the sentence and the feature.

    ``taken``: doc_id, y, weight. One text counts for an id, the least of those that share it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    texts = texts.groupBy("doc_id", "y", "weight").agg(F.min("text").alias("text")).select("text", "y", "weight")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y: list[int] = []
        weight: list[float] = []
        held: list[np.ndarray] = []
        sentences = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sentences, size
            triples = np.concatenate(held)
            row = [np.array(y, "<i4"), np.array(weight, "<f8"), *(triples[:, c] for c in range(3))]
            for kept in (y, weight, held):
                kept.clear()
            sentences = size = 0
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in row], names=["y", "weight", "doc", "sentence", "feature"])

        for batch in batches:
            for text, label, w in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, number = sentence_parts(text)
                if not words:
                    continue
                fresh = [i for i, t in enumerate(words) if not i or t != words[i - 1] or number[i] != number[i - 1]]
                found = [features(words[i]) for i in fresh]
                triples = np.empty((sum(map(len, found)), 3), "<i4")
                triples[:, 0] = len(y)
                triples[:, 1] = sentences + np.repeat(number[fresh], [len(f) for f in found])
                triples[:, 2] = [f for each in found for f in each]
                y.append(label)
                weight.append(w)
                held.append(triples)
                sentences, size = sentences + int(number[-1]) + 1, size + len(triples)
                if size >= TOGETHER:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(parts, "y binary, weight binary, doc binary, sentence binary, feature binary")


def _numbers(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], "<f8" if name == "weight" else "<i4")


def _block_rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one at a time, as views of its bytes."""
    for i in range(batch.num_rows):
        yield {name: batch.column(c)[i].as_buffer() for c, name in enumerate(batch.schema.names)}


def kept_features(blocks: DataFrame) -> np.ndarray:
    """Features that enough documents have, ascending; at most ``BUCKETS``."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _block_rows(batch):
                pairs = np.unique(_numbers(row, "feature").astype(np.int64) << 32 | _numbers(row, "doc"))
                feature, n = np.unique(pairs >> 32, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(feature.astype(np.int32)), pa.array(n)], names=["feature", "n"])

    counts = blocks.select("doc", "feature").mapInArrow(seen, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return np.sort(counts.filter(F.col("n") >= SEEN_IN).select("feature").toArrow().column(0).to_numpy())


def placed(blocks: DataFrame, kept: np.ndarray) -> DataFrame:
    """Blocks with the document of each sentence, and sentence and place in ``kept`` of each kept feature."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _block_rows(batch):
                doc, sentence, feature = (_numbers(row, c) for c in ("doc", "sentence", "feature"))
                of = np.zeros(int(sentence.max()) + 1, "<i4")
                of[sentence] = doc
                place = np.searchsorted(kept, feature)
                ok = place < len(kept)
                ok[ok] = kept[place[ok]] == feature[ok]
                found = [row["y"].to_pybytes(), row["weight"].to_pybytes(), of.tobytes(), sentence[ok].tobytes(), place[ok].astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in found], names=["y", "weight", "of", "sentence", "place"])

    return blocks.mapInArrow(places, "y binary, weight binary, of binary, sentence binary, place binary")


def block_gradient(row: dict, w: np.ndarray, b: float) -> np.ndarray:
    """The slope of one block's loss by every kept weight and, last, by the bias."""
    label, weight, of, where, at = (_numbers(row, c) for c in ("y", "weight", "of", "sentence", "place"))
    z = np.bincount(where, w[at], minlength=len(of)) + b
    clear = np.exp(-np.bincount(of, np.logaddexp(0, z), minlength=len(label)))
    pull = np.where(label > 0, -clear / np.maximum(1 - clear, 1e-12), 1.0) * weight
    g = pull[of] / (1 + np.exp(-np.clip(z, -60, 60)))
    return np.append(np.bincount(at, g[where], minlength=len(w)), g.sum())


def fit(blocks: DataFrame, documents: int, weight: float) -> Model:
    """Weights from blocks of sampled documents. A step's slopes are summed in tasks; the driver holds weights alone."""
    kept = kept_features(blocks)
    blocks = written(placed(blocks, kept), "toxicity-places").coalesce(STEP_TASKS)
    w, b = np.zeros(len(kept)), -5.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):

        def slopes(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, b: float = b) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w) + 1)
            for batch in batches:
                for row in _block_rows(batch):
                    total += block_gradient(row, w, b)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["slopes"])

        # a row a task
        grad = np.zeros(len(w) + 1)
        for r in blocks.mapInArrow(slopes, "slopes binary").collect():
            grad += np.frombuffer(r["slopes"])
        grad = grad / weight
        grad[:-1] += DECAY * w / documents
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(dict(zip(kept.tolist(), w.tolist())), float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of the labelled rows that are not held out."""
    own = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    )
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if not counts:
        return Model({}, 0.0, 0.0)
    shares = {y: min(1.0, sample / n) for y, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("y") == 1, shares.get(1, 0.0)).otherwise(shares.get(0, 0.0))
    # about 2 x sample rows of 20 bytes, whatever the size of the tables
    taken = own.filter(draw < share).withColumn("weight", 1 / share)
    blocks = written(sample_rows(docs, taken), "toxicity-sample")
    found = blocks.select("y", "weight").toArrow().to_pylist()  # 12 bytes a sampled document
    y, weight = (np.concatenate([_numbers(r, c) for r in found] or [np.empty(0)]) for c in ("y", "weight"))
    if len(set(y.tolist())) < 2:
        return Model({}, 0.0, counts.get(1, 0) / sum(counts.values()))
    return fit(blocks, len(y), float(weight.sum()))


def score(text: Column, model: Model) -> Column:
    """The document's chance of being toxic, as a column."""

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in texts], dtype="float64")

    return judge(text.cast("string"))


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence, chance: the sentences that reach ``least`` alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                at = 0
                for piece in re.split(r"(?<=[.!?\n])", text):
                    z = model.sentences(piece)
                    chance = float(1 / (1 + np.exp(-z[0]))) if len(z) else 0.0
                    if chance >= least:
                        out.append((doc_id, at, at + len(piece), piece, chance))
                    at += len(piece)
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "sentence", "chance"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, end long, sentence string, chance double")
