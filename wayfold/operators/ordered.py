"""Ordered scans that stay parallel when one key holds much of the data.

A plain window over ``(key ORDER BY time)`` puts a whole key into one task. The
functions here cut every key into chunks of the order column (a fixed span of
time, or of a sequence number), scan each chunk on its own, and hand the little
that has to cross a chunk edge (a last row, a sum) along a summary with one row
per chunk. A hot key is then spread over as many tasks as it has chunks, the
data itself is shuffled once, and the summary is small because it is built with
map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Span of one chunk when the caller names none.
DEFAULT_CHUNK = timedelta(minutes=15)

_CHUNK = "__chunk"


def order_number(df: DataFrame, column: str) -> Column:
    """The order column as a whole number: microseconds for times."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("long")


def chunk_width(chunk: timedelta | int | None) -> int:
    if chunk is None:
        chunk = DEFAULT_CHUNK
    if isinstance(chunk, timedelta):
        return max(1, int(chunk.total_seconds() * 1_000_000))
    return max(1, int(chunk))


def _with_chunk(df: DataFrame, order: Sequence[str], chunk, descending: bool) -> DataFrame:
    number = F.coalesce(F.floor(order_number(df, order[0]) / F.lit(chunk_width(chunk))), F.lit(-(2**62)))
    return df.withColumn(_CHUNK, -number if descending else number)


def _sort(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _carried(summary: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    before = Window.partitionBy(*by).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*by, _CHUNK, value.over(before).alias(name))


def previous_row(
    df: DataFrame,
    *,
    by: Sequence[str],
    order: Sequence[str],
    payload: Sequence[str],
    out: str = "prev",
    chunk: timedelta | int | None = None,
) -> DataFrame:
    """``lag`` over ``by``: adds the struct of the row before, NULL for the first."""
    base = _with_chunk(df, order, chunk, False)
    row = F.struct(*payload)
    local = Window.partitionBy(*by, _CHUNK).orderBy(*_sort(order, False))
    scanned = base.withColumn("__local", F.lag(row).over(local))
    summary = base.groupBy(*by, _CHUNK).agg(F.max_by(row, F.struct(*order)).alias("__last"))
    carry = _carried(summary, by, F.last("__last"), "__carry")
    return (
        scanned.join(carry, [*by, _CHUNK], "left")
        .withColumn(out, F.coalesce("__local", "__carry"))
        .drop("__local", "__carry", _CHUNK)
    )


def carry_last(
    df: DataFrame,
    *,
    by: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    chunk: timedelta | int | None = None,
    descending: bool = False,
) -> DataFrame:
    """Running last non-NULL ``value`` up to and including the row itself.

    ``descending`` walks the order columns from the end, which turns "last
    before" into "first after".
    """
    base = _with_chunk(df, order, chunk, descending).withColumn("__value", value)
    local = (
        Window.partitionBy(*by, _CHUNK)
        .orderBy(*_sort(order, descending))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = base.withColumn("__local", F.last("__value", ignorenulls=True).over(local))
    pick = F.min_by if descending else F.max_by
    # Rows without a value rank NULL, which max_by and min_by pass over, so a
    # chunk that holds none still gets its summary row.
    place = F.when(F.col("__value").isNotNull(), F.struct(*order))
    summary = base.groupBy(*by, _CHUNK).agg(pick("__value", place).alias("__last"))
    carry = _carried(summary, by, F.last("__last", ignorenulls=True), "__carry")
    return (
        scanned.join(carry, [*by, _CHUNK], "left")
        .withColumn(out, F.coalesce("__local", "__carry"))
        .drop("__value", "__local", "__carry", _CHUNK)
    )


def running_sum(
    df: DataFrame,
    *,
    by: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    chunk: timedelta | int | None = None,
) -> DataFrame:
    """Sum of ``value`` from the first row of the key to the row itself."""
    base = _with_chunk(df, order, chunk, False).withColumn("__value", value)
    local = (
        Window.partitionBy(*by, _CHUNK)
        .orderBy(*_sort(order, False))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = base.withColumn("__local", F.sum("__value").over(local))
    summary = base.groupBy(*by, _CHUNK).agg(F.sum("__value").alias("__part"))
    carry = _carried(summary, by, F.sum("__part"), "__carry")
    return (
        scanned.join(carry, [*by, _CHUNK], "left")
        .withColumn(out, F.col("__local") + F.coalesce("__carry", F.lit(0)))
        .drop("__value", "__local", "__carry", _CHUNK)
    )


def dense_number(
    df: DataFrame,
    *,
    by: Sequence[str] = (),
    order: Sequence[str],
    out: str,
    chunk: timedelta | int | None = None,
) -> DataFrame:
    """``row_number`` over ``by`` that no single task has to sort alone."""
    keyed = df if by else df.withColumn("__all", F.lit(0))
    numbered = running_sum(keyed, by=list(by) or ["__all"], order=order, value=F.lit(1), out=out, chunk=chunk)
    return numbered if by else numbered.drop("__all")
