"""Packing by cutting-stock column generation.

Texts become pieces of at most ``capacity`` tokens: full ones and a rest. The
histogram of piece lengths, grouped into classes of nearly equal counts, is the
demand of a cutting-stock linear program: a pattern says how many pieces of each
class one sequence takes. New patterns are priced by a knapsack dynamic program
over the duals until Farley's bound says that the optimum is near. Patterns are
used a whole number of times; what that leaves over is packed greedily. Then the
pieces of a class, ranked, take the places that the patterns have for it.

Only the histogram (``capacity`` counts at most) reaches the driver. The ranks
come from counts of bounded groups, so a class may hold any share of the rows.

Null or empty text: a document of the end id alone. Null ids, repeated rows and
ties: every row is a document of its own and is packed. Empty table: no rows.
Other columns, also ones named like results, are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import written
from .tokens import encoder, utf8

CAPACITY = 2048
#: Length classes of the linear program, at most.
CLASSES = 320
#: The program stops within this share of the optimum, or within one sequence of it.
GAP = 0.001
#: Pieces ranked by one task at most, about.
RANKED_TOGETHER = 50_000


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of every text: doc_id, start, length, ids_crc32, doc_tokens and, if asked, ids as 32-bit numbers."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, True)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for doc_id, found in zip(batch.column(0).to_pylist(), encode.ids_of(utf8(batch.column(1)))):
                ids = np.append(found.astype("<u4"), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity].tobytes()
                    row = (doc_id, at, len(piece) // 4, zlib.crc32(piece), len(ids)) + (piece,) * with_ids
                    for n, v in zip(names, row):
                        out[n].append(v)
            kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in zip(names, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, fields)


def classes_of(histogram: dict[int, int], most: int = CLASSES) -> list[tuple[int, int]]:
    """(longest length, count) per class; a class takes whole lengths and about the same number of pieces as any other."""
    lengths = sorted(histogram)
    if len(lengths) <= most:
        return [(length, histogram[length]) for length in lengths]
    share, out, held, done = sum(histogram.values()) / most, [], 0, 0
    for i, length in enumerate(lengths):
        held += histogram[length]
        if done + held >= share * (len(out) + 1) or i == len(lengths) - 1:
            out.append((length, held))
            done, held = done + held, 0
    return out


def best_fills(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the greatest worth for every room up to ``capacity`` and the class taken last (-1: none)."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(int(sizes[0]), capacity + 1):
        k = fits[room]
        with_one = value[room - sizes[:k]] + worth[:k]
        best = int(with_one.argmax())
        value[room], last[room] = with_one[best], best
    return value, last


def fill(last: np.ndarray, sizes: np.ndarray, room: int, n: int) -> np.ndarray:
    """The pattern behind a room's value."""
    pattern = np.zeros(n)
    while room > 0 and last[room] >= 0:
        pattern[last[room]] += 1
        room -= sizes[last[room]]
    return pattern


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """As many patterns as classes and their use: the longest class left and the fullest room beside it, until a class runs out."""
    n, left = len(sizes), demand.astype(float)
    open_, patterns, used = np.arange(n), [], []
    while len(open_):
        _, last = best_fills(sizes[open_], sizes[open_] + 1e-3 * sizes[open_] / sizes[-1], capacity)
        pattern = np.zeros(n)
        pattern[open_] = fill(last, sizes[open_], capacity - int(sizes[open_[-1]]), len(open_))
        pattern[open_[-1]] += 1
        takes = np.flatnonzero(pattern)
        ratio = left[takes] / pattern[takes]
        times = ratio.min()
        patterns.append(pattern)
        used.append(times)
        left = left - times * pattern
        open_ = open_[open_ != takes[ratio.argmin()]]
    return np.array(patterns), np.maximum(np.array(used), 0)


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (one per row), how often each is used, and a lower bound of the linear program."""
    n = len(sizes)
    patterns, used = first_basis(sizes, demand, capacity)
    inverse, stalled = np.linalg.inv(patterns.T), 0
    bound = float(sizes @ demand) / capacity  # no sequence holds more
    while stalled < 5:
        duals = inverse.sum(axis=0)
        value, last = best_fills(sizes, np.maximum(duals, 0), capacity)
        bound = max(bound, float(duals @ demand) / max(value[capacity], 1.0))
        if used.sum() <= max(bound * (1 + gap), np.ceil(bound - 1e-6)):
            break
        worth = np.maximum(duals, 0) + value[capacity - sizes]  # the best pattern that holds a class
        before = used.sum()
        for c in np.argsort(-worth, kind="stable"):
            if worth[c] <= 1 + 1e-9:
                break
            column = fill(last, sizes, capacity - sizes[c], n)
            column[c] += 1
            if inverse.sum(axis=0) @ column <= 1 + 1e-9:
                continue
            step = inverse @ column
            able = step > 1e-9
            ratio = np.where(able, used / np.where(able, step, 1), np.inf)
            out = int(ratio.argmin())
            used = used - ratio[out] * step
            used[out] = ratio[out]
            patterns[out] = column
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            used = np.maximum(used, 0)
        stalled = stalled + 1 if before - used.sum() <= gap / 20 * before else 0
    return patterns, used, bound


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that take each piece of the demand once: the program's, rounded down, and a greedy rest."""
    patterns, used, _ = cutting_stock(sizes, demand.astype(float), capacity)
    left, out = demand.copy(), []
    for pattern, times in zip(patterns.round().astype(int), np.floor(used + 1e-6).astype(int)):
        takes = pattern > 0
        if takes.any() and (times := int(min(times, (left[takes] // pattern[takes]).min()))):
            out.append((pattern, times))
            left = left - times * pattern
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), int)
        for c in range(len(sizes) - 1, -1, -1):
            if take := int(min(left[c], room // sizes[c])):
                pattern[c], room = take, room - take * int(sizes[c])
        takes = pattern > 0
        times = int((left[takes] // pattern[takes]).min())
        out.append((pattern, times))
        left = left - times * pattern
    return out


def places(patterns: list[tuple[np.ndarray, int]], n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: the first rank, first sequence and pieces a sequence of each pattern that takes it."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    ranks, sequence = [0] * n, 0
    for pattern, times in patterns:
        for c in np.flatnonzero(pattern):
            out[c].append((ranks[c], sequence, int(pattern[c])))
            ranks[c] += int(pattern[c]) * times
        sequence += times
    return [tuple(np.array(x, np.int64).reshape(-1, 3).T) for x in out]


def pack(pieces: DataFrame, key: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` is read several times: a written stage.

    ``key`` orders pieces of one class and one sequence; pieces equal in it are alike.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {int(r[0]): r[1] for r in pieces.groupBy(length).count().collect()}
    groups = classes_of(histogram)
    sizes, demand = np.array([g[0] for g in groups], np.int64), np.array([g[1] for g in groups], np.int64)
    slots = places(whole_patterns(sizes, demand, capacity), len(sizes)) if groups else []
    of = [(n, int(np.searchsorted(sizes, n))) for n in sorted(histogram)]
    shares = [(n, c, -(-int(demand[c]) // RANKED_TOGETHER)) for n, c in of]
    small = spark.createDataFrame(shares, "_length long, _class int, _parts int")  # one row per length: at most ``capacity``
    dealt = (
        pieces.join(F.broadcast(small), F.col(length) == F.col("_length")).drop("_length")
        .withColumn("_part", F.pmod(F.xxhash64(*key), F.col("_parts"))).drop("_parts")
    )
    counts = dealt.groupBy("_class", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("_class", "_part", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_class", "_part").orderBy(*key)) - 1
    ranked = dealt.withColumn("_rank", rank).join(before, ["_class", "_part"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_part", "_before")
    fields = [*ranked.schema.fields]
    names = [f.name for f in fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, at = (batch.column(names.index(x)).to_numpy() for x in ("_class", "_rank"))
            sequence = np.zeros(batch.num_rows, np.int64)
            for c in np.unique(group):
                mine = group == c
                ranks, first, each = slots[c]
                row = np.searchsorted(ranks, at[mine], side="right") - 1
                sequence[mine] = first[row] + (at[mine] - ranks[row]) // each[row]
            keep = [i for i, x in enumerate(names) if x not in ("_class", "_rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence)], names=[*(names[i] for i in keep), "sequence_id"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name not in ("_class", "_rank"))
    placed = ranked.mapInArrow(place, f"{ddl}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc(length), *key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("offset", (F.sum(length).over(inside) - F.col(length)).cast("long"))


def packed_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    pieces = token_pieces(docs, path, end_id, capacity, with_ids)
    pieces = written(pieces, "pieces") if with_ids else cut_lineage(pieces)
    return pack(pieces, ["doc_id", "start", "doc_tokens", "ids_crc32"], capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences: sequence_id and its ids, pieces in order of their offset; a sequence is bounded by the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (all, x) -> concat(all, x.ids))").alias("ids"))
