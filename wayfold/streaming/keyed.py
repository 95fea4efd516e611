"""Runs the machines: over sorted partitions in batch, on keyed state in streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import previous_row, running_sum


def _out_schema(df: DataFrame, by: Sequence[str], machine) -> T.StructType:
    return T.StructType([df.schema[k] for k in by] + list(T._parse_datatype_string(machine.schema)))


def split_at_gaps(df: DataFrame, *, by: Sequence[str], ts_ms: str, gap: int, tie: Sequence[str] = (), chunk=None) -> DataFrame:
    """Adds ``part``, a number that grows at every gap of ``gap`` ms or more.

    Nothing a machine does reaches over such a gap, so a document with most of
    the rows falls into many independent pieces.
    """
    order = [ts_ms, *tie]
    chunk = 900_000 if chunk is None else chunk
    seen = previous_row(df, by=by, order=order, payload=[ts_ms], out="__p", chunk=chunk)
    new = F.when(F.col("__p").isNull() | (F.col(ts_ms) - F.col(f"__p.{ts_ms}") >= gap), 1).otherwise(0)
    return running_sum(seen.withColumn("__new", new), by=by, order=order, value=F.col("__new"), out="part", chunk=chunk).drop("__p", "__new")


def scan(df: DataFrame, make: Callable, *, by: Sequence[str], order: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """Every key of ``df`` through its own machine, in order.

    Partitions are streamed batch by batch with one machine open at a time, so
    memory does not grow with a key.
    """
    sample = make()
    schema, keys, inputs = _out_schema(df, by, sample), list(by), list(sample.inputs)
    slim = df.select(*keys, *dict.fromkeys([*inputs, *order])).repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, at, rows = None, None, []
        for pdf in batches:
            for values in pdf[keys + inputs].itertuples(index=False, name=None):
                key = values[: len(keys)]
                if key != at:
                    if machine is not None:
                        rows += [(*at, *r) for r in machine.close()]
                    machine, at = make(), key
                rows += [(*at, *r) for r in machine.feed(dict(zip(inputs, values[len(keys) :], strict=True)))]
            if rows:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if machine is not None:
            rows += [(*at, *r) for r in machine.close()]
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return slim.mapInPandas(run, schema)


#: A document silent for so long in event time is forgotten with its state.
IDLE = timedelta(days=1)


def _ms(span: timedelta) -> int:
    return max(0, int(span.total_seconds() * 1000))


def stream(df: DataFrame, make: Callable, *, by: Sequence[str], event_time: str, delay: timedelta, idle: timedelta = IDLE) -> DataFrame:
    """The same machines on a stream: state per key, open rows closed by the watermark.

    Rows wait in the key's state until the watermark has passed them and are then
    fed in order of time, marks before rows of the same moment, so rows that come
    late but within ``delay`` change nothing. The state of a key goes when nothing
    waits, nothing is open and ``idle`` has passed.
    """
    sample = make()
    schema, keys, inputs = _out_schema(df, by, sample), list(by), list(sample.inputs)
    names = [f.name for f in schema]
    timed = df.withWatermark(event_time, f"{_ms(delay)} milliseconds")
    kind = inputs.index("kind") if "kind" in inputs else None
    at = inputs.index("ts_ms")

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, kept = make(), {"held": [], "last": 0}
        if state.exists:
            kept = json.loads(state.get[0])
            machine.state = kept["machine"]
        edge, held, rows = state.getCurrentWatermarkMs(), kept["held"], []
        for batch in batches:
            held += [[v.item() if hasattr(v, "item") else v for v in r] for r in batch[inputs].itertuples(index=False, name=None)]
        held.sort(key=lambda r: (r[at], kind is not None and r[kind] == "row"))
        n = sum(r[at] < edge for r in held)
        for values in held[:n]:
            rows += list(machine.feed(dict(zip(inputs, values, strict=True))))
        last, held = max([kept["last"], *(r[at] for r in held)]), held[n:]
        if (due := machine.due()) is not None and due < edge:
            rows += list(machine.close())
            due = machine.due()
        if not held and due is None and last + _ms(idle) < edge:
            state.remove()
        else:
            wake = min([last + _ms(idle), *(r[at] for r in held[:1]), *([int(due)] if due is not None else [])])
            state.update((json.dumps({"machine": machine.state, "held": held, "last": last}),))
            state.setTimeoutTimestamp(max(wake, edge) + 1)
        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=names)

    return timed.groupBy(*keys).applyInPandasWithState(step, schema, "blob string", "append", GroupStateTimeout.EventTimeTimeout)
