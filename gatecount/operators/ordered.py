"""Previous-value and running-value columns that survive a hot key.

A plain ``lag() over (partition by key order by seq)`` puts every row of one key
into one task. Here the arrival number cuts each key into segments of at most
``segment_rows`` rows: a window looks back inside a segment, and the one value
each segment inherits comes from a table with one row per (key, segment), built
by a map-side combined aggregate. Only that small table is windowed per key.

The raw rows are shuffled once, on (key, segment); the join that brings in the
inherited value reuses that partitioning and order. The aggregate reads the input a
second time, only the columns it needs, and combines before its own small shuffle.

The bound holds where arrival numbers are dense. For sparse ones, such as
microseconds, pass ``segment_rows=arrival_width(...)``, which measures the density.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Arrival numbers per segment; a segment never holds more rows of one key.
SEGMENT_ROWS = 1 << 20
_SEGMENT = "_segment"


def _segmented(df: DataFrame, order: str, segment_rows: int) -> DataFrame:
    return df.withColumn(_SEGMENT, F.floor(F.col(order) / F.lit(segment_rows)).cast("bigint"))


def arrival_width(df: DataFrame, order: str, rows: int = SEGMENT_ROWS) -> int:
    """How far arrival numbers may spread in a segment so that it holds about ``rows`` rows (one small job)."""
    seen = df.agg(F.count(order).alias("n"), (F.max(order) - F.min(order) + 1).alias("spread")).first()
    return max(1, rows * int(seen["spread"] or 1) // max(1, seen["n"]))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    prefix: str = "prev_",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add ``prev_<value>``: the value of the row before, per key, in arrival order.

    ``order`` is an arrival number, unique within a key. The values must not be
    null where the row exists; a null result means there was no row before.
    """
    keys, values = list(keys), list(values)
    rows = _segmented(df, order, segment_rows)
    inside = Window.partitionBy(*keys, _SEGMENT).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(_SEGMENT)

    last = rows.groupBy(*keys, _SEGMENT).agg(
        *[F.max_by(F.col(v), F.col(order)).alias(f"_last_{v}") for v in values]
    )
    inherited = last.select(
        *keys, _SEGMENT, *[F.lag(f"_last_{v}").over(across).alias(f"_in_{v}") for v in values]
    )
    looked = rows.select("*", *[F.lag(v).over(inside).alias(f"_lag_{v}") for v in values])
    joined = looked.join(inherited, [*keys, _SEGMENT], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_lag_{v}", f"_in_{v}").alias(f"{prefix}{v}") for v in values],
    )


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    how: str = "max",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add ``name``: running max / min / sum of ``value`` up to and including each row."""
    keys = list(keys)
    combine = {
        "max": (F.max, F.greatest),
        "min": (F.min, F.least),
        "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    }
    aggregate, merge = combine[how]
    rows = _segmented(df.withColumn("_value", value), order, segment_rows)
    inside = Window.partitionBy(*keys, _SEGMENT).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)

    total = rows.groupBy(*keys, _SEGMENT).agg(aggregate("_value").alias("_total"))
    inherited = total.select(*keys, _SEGMENT, aggregate("_total").over(before).alias("_in"))
    looked = rows.withColumn("_run", aggregate("_value").over(inside))
    joined = looked.join(inherited, [*keys, _SEGMENT], "left")
    return joined.select(*df.columns, merge(F.col("_run"), F.col("_in")).alias(name))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    The filter on row_number becomes a window group limit, so each map task sends
    at most one row per key.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key; map tasks send at most ``k`` rows of a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def dense_number(
    df: DataFrame, position: str, name: str, start: Column, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Number the rows start, start+1, ... by a unique position, without one global sort.

    Rows are ranked inside position segments; the offsets come from the running
    count over segments, a table of one row per ``segment_rows`` positions.
    """
    rows = _segmented(df, position, segment_rows)
    inside = Window.partitionBy(_SEGMENT).orderBy(position)
    before = Window.orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(_SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(_SEGMENT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    return ranked.join(offsets, _SEGMENT).select(
        *df.columns, (start + F.col("_offset") + F.col("_inside")).cast("bigint").alias(name)
    )
