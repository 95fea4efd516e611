"""Encoding and decoding by a SentencePiece BPE model, in vectorised merge rounds.

Texts are cut into words (a run of spaces and what follows; no piece reaches over
that place), and words where no piece holds the two neighbouring characters. The
words a worker has not seen become one flat array of symbols. In a round, every
word finds the least rank among its pairs by a segmented minimum and merges the
pairs of that rank from the left, all at once, up to the first that gives a pair to be merged
before the rest. Symbols are compacted and words without pairs are set aside, until
none is left. Characters outside the vocabulary fall back to bytes.

In a long word the minimum is that of the pairs near by: a merge and all that follows
from it before a pair of higher rank stay within one piece's length, so pairs farther apart than
twice that cannot meet, in whatever order they go. Stretches without pairs leave
the array as they settle. Where each merge in a run of one symbol sets off another at once, as
with spaces in models that give all runs of them one rank, the run is put down block by block.
So a very long text without spaces, or one long run, takes a number of rounds that hardly grows.

Null or empty text: the begin and end ids, decoded to the empty text. Null ids,
ties and repeated rows: every row is encoded for itself. Empty table: no rows.
Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ChunkStore, utf8

SPACE = "▁"
_NONE = np.iinfo(np.int32).max


class PieceModel(ChunkStore):
    """Tables of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.n, self.begin, self.end = n, sp.bos_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        kinds = [(sp.is_control(i), sp.is_unknown(i), sp.is_byte(i), sp.is_unused(i)) for i in range(n)]
        normal = [i for i in range(n) if not any(kinds[i])]
        if any(k[3] for k in kinds) or sum(k[2] for k in kinds) != 256:
            raise ValueError("the model must fall back to bytes and have no unused pieces")
        if sp.normalize(" a  B² ") != SPACE * 2 + "a" + SPACE * 2 + "B²" + SPACE:
            raise ValueError("the model must keep texts as they are and put a space before them")
        if any(SPACE in pieces[i].lstrip(SPACE) or "\n" in pieces[i] for i in normal):
            raise ValueError("a piece of the model reaches over words")
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if kinds[i][2]:
                self.byte[int(pieces[i][3:5], 16)] = i
        of = {pieces[i]: i for i in normal}
        # characters: a piece of their own, or n + code point
        self.char = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in of.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.full(n + 1, _NONE, np.int32)
        self.rank[normal] = np.unique(-scores[normal], return_inverse=True)[1]
        symbol = lambda s: of.get(s, int(self.char[ord(s)]) if len(s) == 1 else None)
        wide = n + 0x110000
        found = {(a, b): i for p, i in of.items() if len(p) > 1 for at in range(1, len(p)) if (a := symbol(p[:at])) is not None and (b := symbol(p[at:])) is not None}
        keys = np.array([a * wide + b for a, b in found], np.int64)
        order = np.argsort(keys)
        self.wide, self.keys, self.merged = wide, keys[order], np.array(list(found.values()), np.int32)[order]
        near = {ord(a) * 0x110000 + ord(b) for p in of for a, b in zip(p, p[1:])}
        self.near = np.array(sorted(near), np.int64)
        # a piece is safe when every pair it takes part in ranks after it
        soonest = np.full(n + 1, _NONE, np.int64)
        for (a, b), i in found.items():
            for x in (a, b):
                if x < n:
                    soonest[x] = min(soonest[x], self.rank[i])
        self.safe = soonest > self.rank
        # what happens at one place changes nothing more than a piece away; two such places never meet
        self.reach = 2 * max(map(len, of)) + 4
        self.long = 4 * self.reach
        self.blocks = {c: b for c in set(self.char[[ord(p) for p in of if len(p) == 1]].tolist()) if (b := self._block(c, found))}
        # bytes of the pieces, for decoding
        text = [b"" if k[0] else " ⁇ ".encode() if k[1] else bytes([int(p[3:5], 16)]) if k[2] else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds)]
        self.text_size = np.array([len(t) for t in text], np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.text_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.leads = np.array([not any(k) and p.startswith(SPACE) for p, k in zip(pieces, kinds)])
        super().__init__(np.uint16 if n <= 1 << 16 else np.uint32)

    def cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """At every line break and before every run of spaces; the space that the model puts before a text is its start."""
        data[begins] = 0x20
        space = data == 0x20
        at = (data == 0x0A) | (space & ~np.concatenate([[False], space[:-1]]))
        at[begins] = True
        return np.flatnonzero(at)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair merges to; n where there is none."""
        key = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.n).astype(np.int32)

    def _block(self, c: int, found: dict[tuple[int, int], int]) -> tuple[int, int] | None:
        """(piece, length): what a long run of the symbol ``c`` becomes, one block after another, where its merges set off others at once."""
        rank = lambda a, b: self.rank[found.get((a, b), self.n)]
        first, limit = found.get((c, c)), rank(c, c)
        if first is None or min(rank(first, c), rank(first, first)) > limit:
            return None
        size, row, seen = 4 * self.reach, [c] * (4 * self.reach), {}
        while min(ranks := [rank(a, b) for a, b in zip(row, row[1:])], default=_NONE) <= limit:
            at = ranks.index(min(ranks))
            row[at : at + 2] = [found[row[at], row[at + 1]]]
            # equal pieces and an untouched rest
            made = next((i for i, x in enumerate(row) if x == c), len(row))
            if len(set(row[:made])) == 1 and set(row[made:]) == {c}:
                seen[row[0], made] = size - len(row) + made
        # the second and third block begin and end as the first did, so all do
        piece = row[0]
        lengths = [seen.get((piece, i), 0) for i in (1, 2, 3)]
        return (piece, lengths[0]) if lengths[0] and lengths == [lengths[0] * i for i in (1, 2, 3)] else None

    def _until_earlier(self, hit: np.ndarray, sym: np.ndarray, to: np.ndarray, group: np.ndarray, blocked: np.ndarray) -> np.ndarray:
        """The merges of ``hit`` that one after another, from the left, would make, until one gives a pair that goes before the rest."""
        made, held = to[hit], blocked[hit]
        ask = np.flatnonzero(~self.safe[made])
        at, piece = hit[ask], made[ask]
        rank = self.rank[piece]
        before, after, two = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1), np.maximum(at - 2, 0)
        # what stands on the left then: the piece of the merge before, or the symbol as it is
        joined = np.zeros(len(sym), bool)
        joined[hit] = True
        left = np.where((at > 1) & joined[two] & (group[two] == group[at]), to[two], sym[before])
        early = (at > 0) & (group[before] == group[at]) & (self.rank[self._pairs(left, piece)] <= rank)
        early |= (at + 2 < len(sym)) & (group[after] == group[at]) & (self.rank[self._pairs(piece, sym[after])] <= rank)
        if not early.any() and not held.any():
            return hit
        # merges out of each other's reach do not wait for each other
        chain = np.cumsum(np.concatenate([[True], (group[hit[1:]] != group[hit[:-1]]) | (np.diff(hit) > self.reach)])) - 1
        last = np.full(chain[-1] + 1, len(sym))
        np.minimum.at(last, chain[ask[early]], at[early])
        np.minimum.at(last, chain[held], hit[held] - 1)
        return hit[hit <= last[chain]]

    def encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [w.replace(" ", SPACE) for w in new]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        points = np.frombuffer("".join(whole).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(whole)), sizes)
        place = np.arange(len(points))
        sym = self.char[points]
        # cut where the word ends or no piece holds both characters
        key = points[:-1] * 0x110000 + points[1:]
        at = np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)
        cut = np.concatenate([[True], (word[1:] != word[:-1]) | (self.near[at] != key)])
        for c, (piece, length) in self.blocks.items():
            begin = np.flatnonzero(cut & (sym == c))
            stop = np.append(np.flatnonzero(cut | (sym != c)), len(sym))
            size = stop[np.searchsorted(stop, begin, side="right")] - begin
            count = (size - 2 * self.reach) // length
            begin, count = begin[count > 0], count[count > 0]
            if len(begin):
                inside = np.zeros(len(sym) + 1, np.int64)
                inside[begin], inside[begin + count * length] = 1, -1
                inside = np.cumsum(inside[:-1]) > 0
                head = np.repeat(begin - length * (np.cumsum(count) - count), count) + length * np.arange(count.sum())
                sym = sym.copy()
                sym[head], inside[head] = piece, False
                sym, cut, place = sym[~inside], cut[~inside], place[~inside]
        group = np.cumsum(cut)
        to = np.full(len(sym), self.n, np.int32)
        joined = np.flatnonzero(~cut[1:])
        to[joined] = self._pairs(sym[joined], sym[joined + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            rank = self.rank[to]
            lengths = np.diff(np.append(starts, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            far = np.flatnonzero(np.repeat(lengths > self.long, lengths))
            if len(far):
                least[far] = _least_near(rank[far], self.reach)
            open_ = least < _NONE
            done.append((place[~open_], sym[~open_]))
            if not open_.any():
                break
            best = open_ & (rank == least)
            blocked = np.zeros(len(sym), bool)
            if len(far):  # a pair of the same rank on the left that has to wait holds up those after it
                blocked[far] = _least_near(np.where(best[far], _NONE, rank[far]), self.reach, left=True) <= rank[far]
            # each second pair of a run of overlapping ones, counted from its left end
            index = np.arange(len(sym))
            run = best & np.concatenate([[False], best[:-1]])
            run[starts] = False
            if run.any():
                begin = np.maximum.accumulate(np.where(run, 0, index))
                best &= (index - begin) % 2 == 0
            hit = self._until_earlier(np.flatnonzero(best), sym, to, group, blocked)
            sym = sym.copy()
            sym[hit] = to[hit]
            # what is settled goes; its neighbours are apart from then on
            apart = np.concatenate([[True], (group[1:] != group[:-1]) | ~open_[:-1]])
            group = np.cumsum(apart)
            stay = open_.copy()
            stay[hit + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[hit] = True
            sym, group, place, to, changed = sym[stay], group[stay], place[stay], to[stay], changed[stay]
            again = changed.copy()
            again[:-1] |= changed[1:]
            look = np.flatnonzero(again)
            to[look] = self.n
            look = look[look < len(sym) - 1]
            look = look[group[look] == group[look + 1]]
            to[look] = self._pairs(sym[look], sym[look + 1])
        place = np.concatenate([d[0] for d in done])
        order = np.argsort(place, kind="stable")
        place, sym = place[order], np.concatenate([d[1] for d in done])[order]
        word = word[place]
        odd = np.flatnonzero(sym >= self.n)
        ids = sym.astype(np.int64)
        if len(odd):
            count = np.ones(len(sym), np.int64)
            code = sym[odd] - self.n
            count[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            raw = np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)
            ids, word = np.repeat(ids, count), np.repeat(word, count)
            ids[np.repeat(sym >= self.n, count)] = self.byte[raw]
        return ids.astype(self.dtype), np.bincount(word, minlength=len(new))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text, with the begin and end ids."""
        mark = SPACE.encode()
        texts = [t.replace(mark, b" ") if mark in t else t for t in texts]
        return [np.concatenate([[self.begin], ids, [self.end]]).astype("<u4") for ids in self.ids_of(texts)]

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.text_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.text_bytes[np.repeat(self.text_at[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()
        shown = np.flatnonzero(sizes > 0)
        if len(shown) and self.leads[ids[shown[0]]]:
            raw = raw[1:]
        return raw.decode(errors="replace")


def _least_near(rank: np.ndarray, reach: int, left: bool = False) -> np.ndarray:
    """The least of the values within ``reach`` places of each, or of those up to it."""
    width, power = (1 if left else 2) * reach + 1, 1
    edge = np.full(reach, _NONE, rank.dtype)
    least = np.concatenate([edge, rank] if left else [edge, rank, edge])
    while 2 * power <= width:
        least, power = np.minimum(least[:-power], least[power:]), 2 * power
    rest = width - power
    return np.minimum(least[: len(rank)], least[rest : rest + len(rank)])


_made: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """The model of this worker."""
    if path not in _made:
        _made[path] = PieceModel(path)
    return _made[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian 32-bit numbers) of every whole text, with begin and end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            rows = model.encode(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to rows of doc_id, n_tokens and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            texts = [model.decode(np.frombuffer(b.as_buffer(), "<u4")) for b in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
