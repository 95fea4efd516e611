"""Chains of spans: the time a span began in, for every row, without walking a key in one task.

A span opens at a row and holds for a fixed time; the first row after it opens the next.
Which rows open spans depends on where the chain began, so a plain scan has to walk the
whole key. Here each chunk of a key becomes a function: from the opening time that enters it to
the one that leaves it. Its table is short, as only rows within one span of the chunk's first row
can be reached from outside, and chains that meet stay together. The tables of a key are
composed in order, a row a chunk, which gives every chunk its entry; then all chunks
are walked apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import chunk_width

_FOREVER = 2**63 - 1
#: Span of a chunk in the unit of the time column when the caller names none: 15 minutes of milliseconds.
DEFAULT_CHUNK = 900_000


def following(t: np.ndarray, forced: np.ndarray, span: int, inclusive: bool) -> np.ndarray:
    """For a span opened at each row, the row that opens the next one; ``len(t)`` for none."""
    n = len(t)
    by_time = np.searchsorted(t, t + span, side="left" if inclusive else "right")
    marks = np.flatnonzero(forced)
    nearest = np.append(marks, n)[np.searchsorted(marks, np.arange(n), side="right")]
    return np.minimum(np.maximum(by_time, np.arange(n) + 1), nearest)


def entered(t: np.ndarray, forced: np.ndarray, span: int, inclusive: bool, since: int | None) -> int:
    """The first row that opens a span after one that began at ``since`` outside."""
    first = int(forced.argmax()) if forced.any() else len(t)
    return 0 if since is None else min(first, int(np.searchsorted(t, since + span, side="left" if inclusive else "right")))


def chunk_function(t: np.ndarray, forced: np.ndarray, span: int, inclusive: bool) -> tuple[list[int], list[int]]:
    """``at`` and ``to``: an entry is met by the first row whose time it reaches, and leaves with the time beside it.

    Entries that reach no row leave as they came.
    """
    n = len(t)
    after = following(t, forced, span, inclusive)
    last = np.where(after < n, after, np.arange(n))
    while True:  # pointers double until every row knows the last opening that follows from it
        further = last[last]
        if (further == last).all():
            break
        last = further
    leaves = t[last]
    first = int(forced.argmax()) if forced.any() else n
    reach = min(first, int(np.searchsorted(t, t[0] + span, side="left" if inclusive else "right")), n - 1)
    at, to = t[: reach + 1].copy(), leaves[: reach + 1]
    if reach == first:
        at[-1] = _FOREVER
    kept = np.append(to[1:] != to[:-1], True)
    return at[kept].tolist(), to[kept].tolist()


def leave(at: Sequence[int], to: Sequence[int], span: int, inclusive: bool, since: int | None) -> int:
    """The function of a chunk applied to an entry."""
    if since is None:
        return int(to[0])
    k = int(np.searchsorted(np.asarray(at), since + span, side="left" if inclusive else "right"))
    return int(to[k]) if k < len(to) else since


def openings(t: np.ndarray, forced: np.ndarray, span: int, inclusive: bool, since: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each row the time the span before it began in, and whether there is one."""
    after = following(t, forced, span, inclusive)
    out, known = np.zeros(len(t), np.int64), np.ones(len(t), bool)
    k = entered(t, forced, span, inclusive, since)
    out[: k + 1], known[: k + 1] = since or 0, since is not None
    while k < len(t):
        nxt = int(after[k])
        out[k + 1 : nxt + 1] = t[k]
        k = nxt
    return out, known


class Compose:
    """Chunk functions of one key, in order: the entry of every chunk but the first."""

    inputs = ("__chunk", "at", "to")
    schema = "__chunk bigint, __entry bigint"

    def __init__(self, span: int, inclusive: bool):
        self.span, self.inclusive, self.since = span, inclusive, None

    def close(self):
        return ()

    def feed(self, e):
        if self.since is not None:
            yield int(e["__chunk"]), self.since
        self.since = leave(e["at"], e["to"], self.span, self.inclusive, self.since)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one chunk at a time, from partitions sorted by ``__run``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = batch.column(batch.schema.get_field_index("__run")).to_numpy(zero_copy_only=False)
        if not len(names):
            continue
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if held and names[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = names[a]
    if held:
        yield pa.Table.from_batches(held)


#: Rows of short chunks that leave a task at once.
TOGETHER = 10_000


def _some(runs: Iterator[pa.Table]) -> Iterator[list[pa.Table]]:
    """Chunks in order, short ones together: a chunk of few rows is not worth a batch of its own."""
    held, size = [], 0
    for run in runs:
        held.append(run)
        size += run.num_rows
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def span_before(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], span: int, inclusive: bool = True, forced: Column | None = None, out: str = "since", chunk=None
) -> DataFrame:
    """Adds ``out``: when the span before the row began, NULL for a key's first row.

    A row opens a span when ``out`` is NULL, when its time is ``out`` + ``span`` or later (later, if
    not ``inclusive``), or where ``forced`` is true. ``order[0]`` is the time, a whole
    number without nulls; the others break ties.
    """
    from ..streaming.keyed import scan

    if span < 1:
        raise ValueError("a span lasts one unit of time or more")
    width = chunk_width(DEFAULT_CHUNK if chunk is None else chunk)
    by_chunk = F.floor(F.col(order[0]).cast("long") / F.lit(width)).cast("long")
    base = df.withColumn("__t", F.col(order[0]).cast("long")).withColumn("__force", F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))).withColumn("__chunk", by_chunk)
    base = base.withColumn("__run", F.to_json(F.struct(*by, "__chunk")))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _some(_runs(batches)):
            found = [chunk_function(r.column("__t").to_numpy(), r.column("__force").to_numpy(zero_copy_only=False), span, inclusive) for r in runs]
            heads = pa.concat_tables([r.select([*by, "__chunk"]).slice(0, 1) for r in runs])
            for c, lists in zip(("at", "to"), zip(*found, strict=True), strict=True):
                heads = heads.append_column(c, pa.array(lists, pa.list_(pa.int64())))
            yield from heads.combine_chunks().to_batches()

    slim = base.select(*by, "__chunk", "__t", "__force", "__run", *order[1:])
    keys = [base.schema[c].simpleString().replace(":", " ", 1) for c in by]
    functions = slim.repartition("__run").sortWithinPartitions("__run", "__t", *order[1:]).mapInArrow(tables, ", ".join([*keys, "__chunk bigint", "at array<bigint>", "to array<bigint>"]))
    entries = scan(functions, lambda: Compose(span, inclusive), by=by, order=["__chunk"])
    same = [base[c].eqNullSafe(entries[c]) for c in by] + [base["__chunk"] == entries["__chunk"]]
    joined = base.join(entries, same, "left").select(*(base[c] for c in base.columns), "__entry")
    fields = joined.schema.add(out, "long")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _some(_runs(batches)):
            made = []
            for run in runs:
                entry = run.column("__entry")[0].as_py()
                since, known = openings(run.column("__t").to_numpy(), run.column("__force").to_numpy(zero_copy_only=False), span, inclusive, entry)
                made.append(run.append_column(out, pa.array(since, mask=~known)))
            yield from pa.concat_tables(made).combine_chunks().to_batches()

    dealt = joined.repartition("__run").sortWithinPartitions("__run", "__t", *order[1:])
    return dealt.mapInArrow(walk, fields).select(*df.columns, out)
