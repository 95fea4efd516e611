"""Whole texts to token ids in Arrow batches, each distinct chunk encoded once.

A text is cut before runs of white space and, for byte-level vocabularies, before what
is no letter after a Latin one. No vocabulary here has a token that
reaches over such a place from the left, so the ids of the chunks, one after
another, are the ids of the text. Chunks repeat far more than texts: a worker keeps
the ids of those it has seen and gives only new ones to the tokenizer.

Chunks are found and looked up for a whole batch at once: up to 15 bytes and the
length make an exact key of 128 bits, and a four-way table of such keys leads to the
ids. Longer chunks take a dictionary. Chunks that lost their place are encoded
again, and the store is emptied when it is full, which changes no result.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

#: Chunks whose ids a worker keeps at a time, and their bytes.
STORE, LETTERS = 1_000_000, 24_000_000
#: Slots of the table.
SLOT_BITS = 21
#: Bytes of texts worked on together, about.
TOGETHER = 1 << 20

_START, _SPACE, _LINE = 0xFF, 0x20, 0x0A
_KEY = 16
#: What keeps the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: White space of more than one byte.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_IS_LETTER, _IS_MARK = np.zeros((2, 256), bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_IS_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: A word of Latin letters that no normal form changes, with the white space before and a stop after it: most chunks.
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _byte_letters() -> dict[int, str]:
    """Byte -> the printable character that byte-level vocabularies write for it.

    Printable Latin-1 stands for itself; the others follow from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class ChunkStore:
    """Ids of chunks, learned when first seen. A subclass says where texts are cut and encodes chunks."""

    def __init__(self, dtype: type):
        self.dtype = dtype
        self.empty()

    def empty(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, self.dtype)
        self.used = self.letters = self.count = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.slot_keys = np.zeros((1 << SLOT_BITS, 2), np.uint64)
        self.slot_places = np.full(1 << SLOT_BITS, -1, np.int32)

    # ---- what a subclass says

    def cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where chunks begin in ``data``, in which every text begins with a start byte at ``begins``."""
        raise NotImplementedError

    def encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks and how many each has."""
        raise NotImplementedError

    def whole(self, text: bytes) -> np.ndarray | None:
        """Ids of a text that cannot be cut; None for all others."""
        return None

    # ---- the store

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Places of chunks that the table did not have."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.at]
        placed = dict(zip(new, range(self.count, self.count + len(new))))
        if new:
            ids, sizes = self.encode_new([c.lstrip(b"\xff").decode(errors="replace") for c in new])
            total, end = len(ids), self.count + len(new)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while end > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.flat[self.used : self.used + total] = ids
            self.starts[self.count : end] = self.used + np.cumsum(sizes) - sizes
            self.sizes[self.count : end] = sizes
            self.used, self.count = self.used + total, end
            long = {c: i for c, i in placed.items() if len(c) >= _KEY}
            self.at.update(long)
            self.letters += sum(map(len, long))
        return np.array([placed[c] if c in placed else self.at[c] for c in chunks], np.int32)

    def _places(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each chunk in the store."""
        sizes = ends - begins
        # the eight bytes from each place on, as one number; a key is two of them without what lies behind the chunk
        from_here = np.ndarray(len(data) + 8, "<u8", np.concatenate([data, np.zeros(_KEY, np.uint8)]), strides=(1,))
        key = np.empty((len(begins), 2), np.uint64)
        key[:, 0] = from_here[begins] & _FIRST[np.minimum(sizes, 8)]
        key[:, 1] = from_here[np.minimum(begins + 8, len(data))] & _FIRST[np.clip(sizes - 8, 0, 7)]
        key[:, 1] |= np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)
        mixed = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        first = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        short = sizes < _KEY
        place = np.full(len(begins), -1, np.int32)
        for slot in (first, first ^ 1, first ^ 2, first ^ 3):
            open_ = np.flatnonzero((place < 0) & short)
            s = slot[open_]
            hit = (self.slot_keys[s] == key[open_]).all(axis=1)
            place[open_[hit]] = self.slot_places[s[hit]]
        miss = np.flatnonzero(place < 0)
        if len(miss):
            buffer = data.tobytes()
            place[miss] = self._learn([buffer[a:b] for a, b in zip(begins[miss].tolist(), ends[miss].tolist())])
            kept = miss[short[miss]]
            s = first[kept]
            for step in (1, 3, 1):  # the next of the four while this one is taken; the last, full or not
                s = np.where(self.slot_places[s] < 0, s, s ^ step)
            s, one = np.unique(s, return_index=True)  # two new chunks may want one slot: one has it
            self.slot_keys[s], self.slot_places[s] = key[kept[one]], place[kept[one]]
        return place

    def _some(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in ``data`` and how many each text has."""
        at = self.cuts(data, begins)
        place = self._places(data, at, np.append(at[1:], len(data)))
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[place] - ends + sizes, sizes) + np.arange(total)]
        counts = np.add.reduceat(sizes, np.searchsorted(at, begins)) if len(begins) else np.zeros(0, np.int64)
        if self.count > STORE or self.letters > LETTERS:
            self.empty()
        return ids, counts

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of every text, none added."""
        out: list[np.ndarray | None] = [self.whole(t) if t else np.empty(0, self.dtype) for t in texts]
        todo = [i for i, x in enumerate(out) if x is None]
        while todo:
            size, n = 0, 0
            while n < len(todo) and (n == 0 or size < TOGETHER):
                size, n = size + len(texts[todo[n]]) + 1, n + 1
            now, todo = todo[:n], todo[n:]
            data = np.frombuffer(b"\xff" + b"\xff".join(texts[i] for i in now), np.uint8).copy()
            sizes = np.array([len(texts[i]) + 1 for i in now])
            ids, counts = self._some(data, np.cumsum(sizes) - sizes)
            for i, part in zip(now, np.split(ids, np.cumsum(counts)[:-1])):
                out[i] = part
        return out


class ChunkEncoder(ChunkStore):
    """Ids of texts by a tokenizer file, the same as encoding each text whole."""

    def __init__(self, path: str, word_ends: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.word_ends = self.tokenizer.model.tokenize, word_ends
        self.small = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,\n"}
        #: strings that the tokenizer takes out of a text before all else
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        super().__init__(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def whole(self, text: bytes) -> np.ndarray | None:
        if not any(s in text for s in self.special):
            return None
        return np.asarray(self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids, self.dtype)

    def cuts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if self.word_ends:  # white space is dropped: any place will do, and what stood there does not matter
            at = (data == _SPACE) | (data == _LINE) | (data == _START)
            data[at] = _SPACE
            return np.flatnonzero(at)
        at = ((data == _SPACE) | (data == _LINE)) & ~np.concatenate([[True], _IS_SPACE[data[:-1]]])
        at[1:] |= _IS_MARK[data[1:]] & _IS_LETTER[data[:-1]]
        if (data >= 0x80).any():
            for wide in _WIDE_SPACE.finditer(data.tobytes()):
                at[wide.end() : wide.end() + 1] = False
        at[begins] = True
        return np.flatnonzero(at)

    def _word(self, text: str) -> list[int]:
        return [t.id for t in self.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(_LETTERS))]

    def _plain(self, space: str, word: str, stop: str) -> list[int]:
        """A plain chunk by the vocabulary's merges alone: its parts are known without the splitting rules."""
        if self.word_ends:
            ids = self._word(word.lower())
        elif space == "\n":
            ids = self.small["\n"] + self._word(word)
        elif word.isascii():
            ids = [t.id for t in self.tokenize(_LETTERS[32] + word if space else word)]
        else:
            ids = [t.id for t in self.tokenize((space + word).encode().decode("latin-1").translate(_LETTERS))]
        return ids + self.small[stop] if stop else ids

    def _short(self, chunk: str) -> list[int] | None:
        """A plain chunk by the vocabulary's merges alone; None for any other."""
        if not self.word_ends and chunk.isascii():  # most of them: nothing has to be looked for
            first = chunk[:1]
            if first == " " and chunk[1:].isalpha():
                return [t.id for t in self.tokenize(_LETTERS[32] + chunk[1:])]
            if chunk.isalpha():
                return [t.id for t in self.tokenize(chunk)]
        plain = _PLAIN.fullmatch(chunk)
        return plain and self._plain(*plain.groups())

    def encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got: list[int] = []  # one list: a list a chunk would be looked through as garbage again and again
        ends, odd = [], []
        for i, chunk in enumerate(new):
            ids = self._short(chunk)
            if ids is None:
                odd.append(i)
            else:
                got += ids
            ends.append(len(got))
        sizes = np.diff(np.array(ends, np.int64), prepend=0)
        if not odd:
            return np.array(got, self.dtype), sizes
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in odd], add_special_tokens=False)]
        sizes[odd] = [len(ids) for ids in rest]
        is_odd = np.zeros(len(new), bool)
        is_odd[odd] = True
        of_odd = np.repeat(is_odd, sizes)
        ids = np.empty(len(of_odd), self.dtype)
        ids[~of_odd], ids[of_odd] = got, [i for r in rest for i in r]
        return ids, sizes


_made: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, word_ends: bool) -> ChunkEncoder:
    """The encoder of this worker."""
    if (path, word_ends) not in _made:
        _made[path, word_ends] = ChunkEncoder(path, word_ends)
    return _made[path, word_ends]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
