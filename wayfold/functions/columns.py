"""Table functions that read and write columns: what one value of a row becomes, beside the row's other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and characters read that leave a task at once; what one value becomes is never split.
BATCH_ROWS, BATCH_CHARS = 10_000, 16_000_000

ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string()),
}


def unfold(df: DataFrame, column: str, rows_of: Callable[[str | None], Iterator[tuple]], ddl: str, *, count: str | None = None) -> DataFrame:
    """The rows that ``rows_of`` makes of ``column``, beside the other columns of ``df``.

    ``count`` writes equal rows that a task holds at one time once, with their number in a column of that name.
    """
    others = [c for c in df.columns if c != column]
    shape = StructType.fromDDL(ddl + (f", {count} bigint" if count else ""))
    types = [(f.name, ARROW[f.dataType.simpleString()]) for f in shape]

    def made_of(values: tuple, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_map(kind) or None in values:
            return pa.array([v and list(v.items()) for v in values] if pa.types.is_map(kind) else values, kind)
        keys = [k for v in values if v for k in v]
        return pa.MapArray.from_arrays(pa.array(list(accumulate(map(len, values), initial=0)), pa.int32()), pa.array(keys, kind.key_type), pa.array([x for v in values if v for x in v.values()], kind.item_type))

    def batch(rows: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        fixed = [rows.column(c).take(pa.array(at, pa.int64())) for c in others]
        made = [made_of(values, t) for values, (_, t) in zip(zip(*found, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(fixed + made, others + [n for n, _ in types])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at, found, size = [], [], 0
            for i, value in enumerate(rows.column(column)):
                text, before = value.as_py(), len(found)
                found.extend(rows_of(text))
                at.extend([i] * (len(found) - before))
                size += len(text or "")
                if found and (len(found) >= BATCH_ROWS or size >= BATCH_CHARS):
                    yield batch(rows, at, found)
                    at, found, size = [], [], 0
            if found:
                yield batch(rows, at, found)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            owners = list(zip(*[rows.column(c).to_pylist() for c in others], strict=True)) if others else [()] * rows.num_rows
            first: dict[tuple, int] = {}
            seen: dict[tuple, int] = {}
            same: dict[tuple[int, int], list] = {}  # a value's rows that are the very object of another value's are counted as a whole
            size = held = 0

            def flush() -> pa.RecordBatch:
                for at, made, n in same.values():
                    for row in made:
                        seen[at, row] = seen.get((at, row), 0) + n
                return batch(rows, [k[0] for k in seen], [(*k[1], n) for k, n in seen.items()])

            for i, value in enumerate(rows.column(column)):
                text = value.as_py()
                try:
                    at = first.setdefault(owners[i], i)
                except TypeError:  # lists and the like are not compared here; Spark does it later
                    at = i
                made = rows_of(text)
                if isinstance(made, tuple):
                    known = same.get((at, id(made)))
                    if known:
                        known[2] += 1
                    elif made:
                        same[at, id(made)] = [at, made, 1]  # holds it, so that the number stays its own
                        held += len(made)
                else:
                    for row in made:
                        key = (at, row)
                        seen[key] = seen.get(key, 0) + 1
                size += len(text or "")
                if (seen or same) and (len(seen) + held >= BATCH_ROWS or size >= BATCH_CHARS):
                    yield flush()
                    seen, same, size, held = {}, {}, 0, 0
            if seen or same:
                yield flush()

    return df.mapInArrow(counted if count else plain, StructType([df.schema[c] for c in others] + shape.fields))
