"""Token ids as length-limited canonical Huffman code, in blocks that decode alone.

Ids are counted over all documents; package-merge gives each id a code of at most
``LIMIT`` bits, and the code itself follows from the lengths alone. Documents in
ascending ``doc_id`` order form blocks. A block holds its documents' ids and
lengths, the packed bits, and the bit offset of every ``STRIDE``-th symbol, so
decoding starts at all of these at once and looks codes up in one table.

The format is a folder of two Parquet tables, written and read by Spark, hence in
any store Spark knows: ``codebook`` (id, bits) and ``blocks`` (file, block,
first token in its file, doc ids, token counts, symbols, offsets, payload).

Null or empty text: the end id alone. Null ids come first; rows with equal ids are
ordered by length and check sum, and equal ones are alike. Empty table: an empty
folder, no rows. Other columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, written
from .tokens import encoder, utf8

#: Longest code in bits; the table of the decoder has two to this power entries.
LIMIT = 18
#: Symbols between two noted bit offsets.
STRIDE = 128
#: Symbols a block holds before the next document starts a new one, about.
BLOCK = 1 << 18
#: Symbols of a file, about.
FILE = 1 << 22

_BLOCKS = "file int, block int, first_token long, doc_ids array<long>, n_tokens array<long>, n_symbols long, offsets binary, payload binary"


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, ids (32-bit numbers when the vocabulary needs them, else 16-bit), counts.

    The last row of a task holds nothing but ``counts``: how often each id occurred in it, as 64-bit numbers.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, False)
        counts = np.zeros(1 << 16, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        names = ["doc_id", "n_tokens", "ids_crc32", "ids", "width", "counts"]
        for batch in batches:
            rows = [np.append(ids, coder.dtype(end_id)) for ids in coder.ids_of(utf8(batch.column(1)))]
            if rows:
                got = np.bincount(np.concatenate(rows), minlength=len(counts))
                got[: len(counts)] += counts
                counts = got
            columns = [batch.column(0), [len(r) for r in rows], [zlib.crc32(r.astype("<u4").tobytes()) for r in rows], [r.tobytes() for r in rows], [r.itemsize for r in rows], [None] * len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([None] * 5 + [counts.astype("<i8").tobytes()], kinds)], names=names)

    fields = "doc_id long, n_tokens long, ids_crc32 long, ids binary, width int, counts binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, fields)


def _numbers(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the counts that the encoding tasks left."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0):
                total = np.frombuffer(counts.as_buffer(), "<i8")
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["id", "n"])

    return tokens.filter("counts is not null").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per symbol by package-merge: the least total under the limit."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(float)
    levels, weights = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        weights, is_leaf = both[rank], rank < n
    levels.append(is_leaf)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        got = int(is_leaf[:take].sum())
        bits[:got] += 1
        take = 2 * (take - got)
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id: each begins where the code space of those before ends."""
    order = np.lexsort((ids, bits))
    limit = int(bits.max(initial=1))
    spans = np.int64(1) << (limit - bits[order])
    codes = np.empty(len(ids), np.int64)
    codes[order] = (np.cumsum(spans) - spans) >> (limit - bits[order])
    return codes


class Code:
    """Tables of one codebook."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        self.limit = int(bits.max(initial=1))
        codes, top = canonical(ids, bits), int(ids.max(initial=0)) + 1
        #: code and bits of a symbol, and symbol and bits of what a code begins with; bits in the lowest five places
        self.of_symbol, self.at_window = np.zeros(top, np.uint32), np.zeros(1 << self.limit, np.uint32)
        self.of_symbol[ids] = codes << 5 | bits
        order = np.lexsort((ids, bits))
        spans = 1 << (self.limit - bits[order])
        self.at_window[: spans.sum()] = np.repeat((ids << 5 | bits)[order], spans)

    def pack(self, symbols: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the symbols, first one highest, and the bit offset of every ``STRIDE``-th."""
        both = self.of_symbol[symbols]
        bits = (both & 31).astype(np.int64)
        ends = np.cumsum(bits)
        at = ends - bits
        words = np.zeros(int(ends[-1] if len(ends) else 0) // 64 + 2, np.uint64)
        word, room = at >> 6, 64 - (at & 63) - bits
        code = (both >> 5).astype(np.uint64)
        inside = room >= 0
        head = np.where(inside, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        # codes that share a word do not overlap, so their sum is their union
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(first):
            words[word[first]] = np.add.reduceat(head, first)
        over = np.flatnonzero(~inside)
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes(), at[::STRIDE]

    def unpack(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """All symbols; every noted offset is a lane, and all lanes take one step at a time."""
        words = np.frombuffer(payload, ">u8").astype(np.uint64)
        out = np.zeros((STRIDE, len(offsets)), np.uint32)
        at, shift = offsets.astype(np.int64), np.uint64(64 - self.limit)
        last = n - (len(offsets) - 1) * STRIDE
        for step in range(STRIDE if len(offsets) > 1 else last):
            if step == last and len(at) == len(offsets):
                at = at[:-1]
            word, skip = at >> 6, (at & 63).astype(np.uint64)
            window = (words[word] << skip) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - skip))
            got = self.at_window[window >> shift]
            out[step, : len(at)] = got >> 5
            at = at + (got & 31)
        return out.T.reshape(-1)[:n]


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, files: int | None = None) -> None:
    """Encode ``docs`` and write the two tables. Files follow ``doc_id``; so do blocks in a file."""
    spark = docs.sparkSession
    tokens = written(token_rows(docs, path, end_id), "tokens")
    found = id_counts(tokens).collect()  # at most the vocabulary
    ids = np.array(sorted(r["id"] for r in found), np.int64)
    count = {r["id"]: r["n"] for r in found}
    bits = code_lengths(np.array([count[i] for i in ids.tolist()], np.int64)) if len(ids) else np.zeros(0, np.int64)
    spark.createDataFrame(list(zip(ids.tolist(), bits.tolist())), "id long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, file = Code(ids, bits), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[int | None] = []
        done = block = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, done, size
            symbols = np.concatenate(held)
            payload, offsets = code.pack(symbols)
            row = [file, block, done, names.copy(), [len(h) for h in held], len(symbols), offsets.astype("<i8").tobytes(), payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            block, done, size = block + 1, done + len(symbols), 0
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, data, width in zip(*(batch.column(i) for i in range(3))):
                held.append(_numbers(data.as_buffer(), width.as_py()).astype(np.int32))
                names.append(doc_id.as_py())
                size += len(held[-1])
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    order = ["doc_id", "n_tokens", "ids_crc32"]
    parts = files or max(1, -(-sum(count.values()) // FILE))
    sorted_ = tokens.filter("counts is null").repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids", "width")
    sorted_.mapInArrow(blocks, _BLOCKS).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents from a folder: doc_id, start, n_tokens, ids_crc32 and, if asked, ids as 32-bit numbers."""
    book = spark.read.parquet(f"{folder}/codebook").collect()  # at most the vocabulary
    ids, bits = np.array([r["id"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64)
    stored = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    totals = stored.groupBy("file").agg(F.sum("n_symbols").alias("n"))  # a row per file
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(ids, bits)
        for batch in batches:
            for r in batch.to_pylist():
                symbols = code.unpack(r["payload"], np.frombuffer(r["offsets"], "<i8"), r["n_symbols"]).astype("<u4")
                sizes = np.array(r["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                parts = [symbols[e - s : e].tobytes() for s, e in zip(sizes.tolist(), ends.tolist())]
                columns = [
                    pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + r["first_token"] + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ] + [pa.array(parts, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    return stored.join(before, "file").select("doc_ids", "n_tokens", "n_symbols", "first_token", "before", "offsets", "payload").mapInArrow(decode, fields)


def round_trip(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``docs`` in the format and read them back."""
    folder = folder or new_folder(docs.sparkSession, "huffman")
    write(docs, path, folder, end_id)
    return read(docs.sparkSession, folder, with_ids=False)
