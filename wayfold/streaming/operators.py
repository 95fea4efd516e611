"""Streaming operators and their batch twins, keyed by document."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.chains import span_before
from ..operators.joins import asof_join
from ..operators.ordered import carry_last, previous_row, running_sum
from ..session import cut_lineage
from . import machines as M
from .keyed import scan, split_at_gaps, stream

DOCUMENT = ("session", "tab_id", "frame_id")
LATENESS = {"tabs": timedelta(milliseconds=250), "downloads": timedelta(milliseconds=1000), "hints": timedelta(milliseconds=1000), "dependencies": timedelta(milliseconds=50)}
#: States and items that meet in one task of ``overlay_memory``, about.
RUNS, ITEMS = 256, 1000


def millis(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("ts_ms", F.unix_millis(F.col(ts).cast("timestamp")))


def bursts(df: DataFrame, *, by: Sequence[str] = DOCUMENT, gap: int = M.DEBOUNCE, ceiling: int = M.CEILING, state_gap: int = 0, tie: Sequence[str] = (), chunk=None) -> DataFrame:
    """Batch bursts over ``ts_ms, trigger, route``; every burst runs apart, so a document need not be quiet to be split.

    Where bursts begin follows from where the ceiling was last counted from: a chain of
    spans that quiet gaps and changes of route begin anew. With ``state_gap`` a burst also waits for the one before,
    and only pieces between long gaps run apart. Rows without a time are left out.
    """
    df, order = df.filter("ts_ms is not null"), ["ts_ms", *tie]
    if state_gap:
        parts = split_at_gaps(df, by=by, ts_ms="ts_ms", gap=gap + 2 * state_gap, tie=tie, chunk=chunk)
    else:
        width = 900_000 if chunk is None else chunk
        seen = previous_row(df, by=by, order=order, payload=["ts_ms", "route"], out="__p", chunk=width)
        quiet = F.col("__p").isNull() | (F.col("ts_ms") - F.col("__p.ts_ms") >= gap)
        moved = ~F.col("__p.route").eqNullSafe(F.col("route"))
        held = span_before(seen.withColumn("__quiet", quiet), by=by, order=order, span=ceiling, forced=quiet | moved, out="__since", chunk=width)
        new = F.col("__quiet") | F.col("__since").isNull() | (F.col("ts_ms") >= F.col("__since") + ceiling)
        parts = running_sum(held, by=by, order=order, value=F.when(new, 1).otherwise(0), out="part", chunk=width)
    return scan(parts, lambda: M.Bursts(gap, ceiling, state_gap), by=[*by, "part"], order=order).drop("part")


def stream_bursts(df: DataFrame, *, by: Sequence[str] = DOCUMENT, event_time: str = "ts", gap: int = M.DEBOUNCE, ceiling: int = M.CEILING, state_gap: int = 0, delay: timedelta = LATENESS["tabs"]) -> DataFrame:
    return stream(df, lambda: M.Bursts(gap, ceiling, state_gap), by=by, event_time=event_time, delay=delay)


def gap_sessions(df: DataFrame, *, by: Sequence[str], ts: str, gap: str, n: str = "n_events") -> DataFrame:
    """Sessions by gap alone, with Spark's own session window; works on streams too."""
    return df.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias(n)).select(*by, F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"), n)


def volume_breaker(df: DataFrame, *, by: Sequence[str] = DOCUMENT, limit: int = M.BREAKER_RECORDS, window: int = M.BREAKER_WINDOW, cooldown: int = M.BREAKER_COOLDOWN, tie: Sequence[str] = (), chunk=None) -> DataFrame:
    """Records of ``ts_ms, trigger, records`` with ``kept`` and ``degraded``, chunks of a document apart.

    Counting windows are a chain of spans; so are the cool-downs, over the rows where a window holds too
    much. Nothing here walks a whole document. Rows without a time are left out.
    """
    width, order = 900_000 if chunk is None else chunk, ["ts_ms", *tie]
    rows = span_before(df.filter("ts_ms is not null"), by=by, order=order, span=window, inclusive=False, out="__since", chunk=width)
    new = F.col("__since").isNull() | (F.col("ts_ms") > F.col("__since") + window)
    counted = running_sum(rows, by=by, order=order, value=F.when(new, 1).otherwise(0), out="__window", chunk=width)
    counted = running_sum(counted, by=[*by, "__window"], order=order, value=F.col("records").cast("long"), out="__n", chunk=width)
    counted = cut_lineage(counted.drop("__since", "__window"))  # read by the trips and by what they cut
    over = counted.filter(F.col("__n") > limit).select(*by, *order)
    trips = span_before(over, by=by, order=order, span=cooldown, out="__since", chunk=width)
    trips = trips.filter(F.col("__since").isNull() | (F.col("ts_ms") >= F.col("__since") + cooldown)).drop("__since").withColumn("__trip", F.col("ts_ms"))
    # a trip row sorts before the record that it stands for, so that record is cut too
    both = counted.select(*by, *order, "trigger").withColumns({"__trip": F.lit(None).cast("long"), "__side": F.lit(1)}).unionByName(trips.withColumns({"trigger": F.lit(None).cast("string"), "__side": F.lit(0)}))
    last = carry_last(both, by=by, order=[*order, "__side"], value=F.col("__trip"), out="__last", chunk=width).filter("__side = 1")
    cut = F.coalesce(F.col("ts_ms") < F.col("__last") + cooldown, F.lit(False))
    return last.select(*by, F.col("ts_ms").cast("long").alias("ts_ms"), "trigger", (~(cut & F.coalesce(F.col("trigger") == "dom-change", F.lit(False)))).alias("kept"), cut.alias("degraded"))


def stream_volume_breaker(df: DataFrame, *, by: Sequence[str] = DOCUMENT, event_time: str = "ts", delay: timedelta = LATENESS["tabs"]) -> DataFrame:
    return stream(df, M.VolumeBreaker, by=by, event_time=event_time, delay=delay)


def stream_transitions(df: DataFrame, *, by: Sequence[str] = DOCUMENT, event_time: str = "ts", delay: timedelta = LATENESS["tabs"]) -> DataFrame:
    """Deduped states with the state before them: A, A, B, A keeps three rows and two edges.

    The batch twins are ``dedupe_states`` and ``transitions``.
    """
    return stream(df, M.Neighbours, by=by, event_time=event_time, delay=delay)


def pause_gate(rows: DataFrame, timeline: DataFrame, *, by: Sequence[str] = ("session",), ts: str = "at", chunk=None) -> DataFrame:
    """Rows recorded while nothing was paused: the last pause or resume before them decides."""
    marks = timeline.filter(F.col("type").isin("paused", "resumed")).withColumn("__mark", F.col("at"))
    seen = asof_join(rows, marks, by=by, left_ts=ts, right_ts="__mark", right_cols=["type"], right_tie=["type"], out="__m", chunk=chunk)
    return seen.filter(~F.coalesce(F.col("__m.type") == "paused", F.lit(False))).drop("__m")


def stream_pause_gate(df: DataFrame, *, by: Sequence[str] = ("session",), event_time: str = "ts", delay: timedelta = LATENESS["tabs"]) -> DataFrame:
    """Records and pause events on one stream (``kind`` tells them apart)."""
    return stream(df, M.PauseGate, by=by, event_time=event_time, delay=delay)


def stream_attribution(df: DataFrame, *, by: Sequence[str] = ("session", "tab_id"), event_time: str = "ts", window: int = M.ACTION_WINDOW, delay: timedelta = LATENESS["tabs"]) -> DataFrame:
    """Calls with the last action before them; actions arrive as ``kind = 'mark'``. Batch twin: ``action_before_call``."""
    return stream(df, lambda: M.LastSeen(window, False), by=by, event_time=event_time, delay=delay)


def stream_hints(df: DataFrame, *, by: Sequence[str] = ("session", "tab_id"), event_time: str = "ts", window: int = M.HINT_TTL, delay: timedelta = LATENESS["hints"]) -> DataFrame:
    """Downloads with the hint before them, each hint used once. Batch twin: ``consume_hints``."""
    return stream(df, lambda: M.LastSeen(window, True), by=by, event_time=event_time, delay=delay)


def overlay_memory(
    sightings: DataFrame, *, by: Sequence[str] = DOCUMENT, memory: int | None = None, shown: int | None = None, order: Sequence[str] = ("ts_ms", "state_id", "pos"), chunk=None
) -> DataFrame:
    """Menu items per state, with the ones seen earlier in the document as not visible.

    States are numbered; between two sightings of an item, and after its last one, it is out of
    sight: an interval of state numbers. Intervals are met with the states they cover, stretch of
    states by stretch and part of the items by part, so neither a long document nor a large menu is
    held anywhere. With ``memory`` or ``shown`` no more than so many items are remembered or shown, and a
    document is walked in order. Sightings without an item, or a time, show no item; their states count.
    """
    if memory is not None or shown is not None:
        return scan(sightings, lambda: M.MenuMemory(memory, shown), by=by, order=order)
    width = 900_000 if chunk is None else chunk
    rows = sightings.select(F.to_json(F.struct(*by)).alias("__doc"), *by, *dict.fromkeys([*order, "state_id", "item"])).filter(F.col(order[0]).isNotNull())
    before = previous_row(rows, by=["__doc"], order=order, payload=["state_id"], out="__p", chunk=width)
    new = F.col("__p").isNull() | ~F.col("__p.state_id").eqNullSafe(F.col("state_id"))
    numbered = running_sum(before, by=["__doc"], order=order, value=F.when(new, 1).otherwise(0), out="__run", chunk=width)
    states = numbered.groupBy("__doc", *by, "__run").agg(F.first("state_id").alias("state_id"))
    seen = numbered.filter("item is not null").groupBy("__doc", *by, "__run", "item").agg(F.first("state_id").alias("state_id"))
    visible = seen.select(*by, "state_id", "item", F.lit(True).alias("visible"))
    # the sighting before each one; then the stretch after the last of all
    earlier = previous_row(seen.select("__doc", "item", "__run"), by=["__doc", "item"], order=["__run"], payload=["__run"], out="__p", chunk=1000)
    between = earlier.filter(F.col("__p").isNotNull()).select("__doc", "item", (F.col("__p.__run") + 1).alias("__from"), (F.col("__run") - 1).alias("__to"))
    ends = states.groupBy("__doc").agg(F.max("__run").alias("__to"))
    after = seen.groupBy("__doc", "item").agg((F.max("__run") + 1).alias("__from")).join(ends, "__doc").select("__doc", "item", "__from", "__to")
    gone = between.unionByName(after).filter("__from <= __to")
    parts = seen.groupBy("__doc", "item").agg(F.lit(1).alias("n")).groupBy("__doc").agg(F.ceil(F.sum("n") / F.lit(ITEMS)).cast("int").alias("__parts"))
    stretch = lambda c: F.floor(F.col(c) / F.lit(RUNS))
    cells = gone.join(parts, "__doc").select("*", F.pmod(F.xxhash64("item"), "__parts").cast("int").alias("__part"), F.explode(F.sequence(stretch("__from"), stretch("__to"))).alias("__cell")).drop("__parts")
    held = states.join(parts, "__doc").select(*states.columns, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), stretch("__run").alias("__cell"))
    met = held.join(cells, ["__doc", "__part", "__cell"]).filter("__run between __from and __to")
    return visible.unionByName(met.select(*by, "state_id", "item", F.lit(False).alias("visible")))


def download_lifecycle(events: DataFrame, *, by: Sequence[str] = ("id",), ts: str = "at", stale: timedelta = timedelta(seconds=60)) -> DataFrame:
    """Current row of each download from its patches, in any order.

    Unknown values never blank known ones; once complete or interrupted it stays
    so; downloads announced long after they started are left out. Plain
    aggregation, so the same code runs on a stream in update mode.
    """
    latest = lambda c, known: F.max_by(c, F.when(known, F.col(ts))).alias(c)
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    settled = F.col("state").isin("complete", "interrupted")
    out = events.groupBy(*by).agg(
        F.min(F.when(F.col("kind") == "created", F.unix_millis(ts) - F.unix_millis("started_at"))).alias("__late"),
        F.coalesce(F.max_by("state", F.when(settled, F.col(ts))), F.lit("in_progress")).alias("state"),
        latest("mime", said("mime")), latest("name_shape", said("name_shape")), latest("extension", said("extension")),
        F.coalesce(F.max_by("size_bytes", F.when(F.col("size_bytes") > 0, F.col(ts))), F.lit(-1)).alias("size_bytes"),
        F.max(ts).alias("updated_at"),
    )
    return out.filter(F.col("__late").isNull() | (F.col("__late") <= int(stale.total_seconds() * 1000))).drop("__late")


def session_stats(events: DataFrame, *, by: Sequence[str] = ("session",)) -> DataFrame:
    """Live counters per session (complete or update mode on a stream)."""
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(f"n_{kind}")
    return events.groupBy(*by).agg(*[count(k) for k in ("state", "net", "action", "download")], F.max(F.coalesce("throttled", F.lit(False))).alias("throttled"))


def blocked_frames(attempts: DataFrame, allowed: DataFrame) -> DataFrame:
    """Distinct frame origins without consent, per tab."""
    return attempts.join(allowed.select(F.col("origin").alias("frame_origin")), "frame_origin", "left_anti").select("session", "tab_id", "frame_origin").dropDuplicates()


def late_rows(stream_df: DataFrame, *, ts: str, delay: timedelta, by: Sequence[str]) -> DataFrame:
    """Every row with ``late``: older than the newest seen of its key minus ``delay``.

    The newest time is kept in the stream's own state, so it survives a restart. Rows
    of one batch are held against what earlier batches brought.
    """
    columns, schema = list(stream_df.columns), T.StructType([*stream_df.schema.fields, T.StructField("late", T.BooleanType())])
    ms = int(delay.total_seconds() * 1000)

    def step(key, batches, state):
        import pandas as pd

        newest = state.get[0] if state.exists else None
        top = newest
        for batch in batches:
            at = pd.to_datetime(batch[ts], utc=True).astype("datetime64[ms, UTC]").astype("int64")
            yield batch[columns].assign(late=False if newest is None else at < newest - ms)
            top = int(at.max()) if top is None else max(top, int(at.max()))
        if top is not None:
            state.update((top,))

    return stream_df.groupBy(*by).applyInPandasWithState(step, schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def route_late(stream_df: DataFrame, *, ts: str, delay: timedelta, on_time: Callable, late: Callable, by: Sequence[str] = ("session",)):
    """``foreachBatch`` body: late rows (see :func:`late_rows`) go to ``late``, all others to ``on_time``."""

    def each(batch: DataFrame, epoch: int) -> None:
        late(batch.filter("late").drop("late"), epoch)
        on_time(batch.filter("NOT late").drop("late"), epoch)

    return late_rows(stream_df, ts=ts, delay=delay, by=by).writeStream.foreachBatch(each)


def live_coverage(changes: DataFrame, report: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], *, every: str = "5 seconds"):
    """Re-runs a coverage report at every trigger in which something arrived."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            sink(report(), epoch)

    return changes.writeStream.foreachBatch(each).trigger(processingTime=every)
