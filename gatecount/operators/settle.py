"""Settling final values, folding them into history, and what share was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecount import rules
from gatecount.functions import times as T

GRADES = ("final", "partial", "missed")


def settle(
    screenings: DataFrame, now: Column, grace_minutes: int = rules.SETTLE_GRACE_MINUTES
) -> DataFrame:
    """Fill ``settled`` for rows whose start lies more than the grace time back.

    Rows settled before keep their value. ``newly_settled`` marks this run's.
    """
    if "settled" not in screenings.columns:
        kind = "struct<sold:bigint,total:bigint,confidence:string,captured_at:timestamp_ntz>"
        screenings = screenings.withColumn("settled", F.lit(None).cast(kind))
    due = F.col("settled").isNull() & (F.col("starts_at") < now - T.minutes(grace_minutes))
    value = F.struct(
        F.coalesce("sold", F.lit(0)).cast("bigint").alias("sold"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        T.settle_confidence(F.col("starts_at"), F.col("captured_at")).alias("confidence"),
        F.col("captured_at").alias("captured_at"),
    )
    out = screenings.withColumn("newly_settled", due).withColumn(
        "settled", F.when(due, value).otherwise(F.col("settled"))
    )
    if "next_look_at" in screenings.columns:
        out = out.withColumn("next_look_at", F.when(~due, F.col("next_look_at")))
    return out


def settle_counts(settled: DataFrame) -> DataFrame:
    return (
        settled.where("newly_settled")
        .groupBy(F.col("settled.confidence").alias("confidence"))
        .agg(F.count(F.lit(1)).alias("screenings"))
    )


def is_foldable(now: Column, after_days: int = rules.FOLD_AFTER_DAYS) -> Column:
    old = F.col("starts_at") < now - T.days(after_days)
    return F.coalesce(F.col("settled").isNotNull() & old, F.lit(False))


def fold_daily(
    settled: DataFrame, now: Column, stored: DataFrame | None = None, group: str = "film_id"
) -> DataFrame:
    """Daily totals of the rows old enough to fold, added to the stored ones."""
    price = F.coalesce("price_min", F.lit(rules.DEFAULT_PRICE))
    fresh = (
        settled.where(is_foldable(now))
        .groupBy("day", group)
        .agg(
            F.sum("settled.sold").alias("sold"),
            F.sum("settled.total").alias("capacity"),
            F.count(F.lit(1)).alias("screenings"),
            F.sum(F.col("settled.sold") * price).alias("gross"),
        )
    )
    if stored is None:
        return fresh
    measures = ("sold", "capacity", "screenings", "gross")
    return (
        stored.select("day", group, *measures)
        .unionByName(fresh)
        .groupBy("day", group)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def _grade_counts(confidence: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("total")] + [
        F.count(F.when(confidence == g, 1)).alias(g) for g in GRADES
    ]


def fold_coverage(settled: DataFrame, now: Column, stored: DataFrame | None = None) -> DataFrame:
    """Per day, how many folded rows were measured how well."""
    fresh = (
        settled.where(is_foldable(now)).groupBy("day").agg(*_grade_counts(F.col("settled.confidence")))
    )
    if stored is None:
        return fresh
    measures = ("total", *GRADES)
    return (
        stored.select("day", *measures)
        .unionByName(fresh)
        .groupBy("day")
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def working_set(settled: DataFrame, now: Column) -> DataFrame:
    """What stays after folding."""
    return settled.where(~is_foldable(now))


def recent_coverage(
    working: DataFrame, stored: DataFrame, now: Column, days: int = rules.COVERAGE_DAYS
) -> DataFrame:
    """One row (total, missed, partial) over the working set and the folded days."""
    since = now - T.days(days)
    live = working.where(F.col("settled").isNotNull() & (F.col("starts_at") >= since)).agg(
        *_grade_counts(F.col("settled.confidence"))
    )
    folded = stored.where(F.col("day") >= since.cast("date")).agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("total", *GRADES)]
    )
    both = live.unionByName(folded)
    return both.agg(*[F.sum(m).cast("bigint").alias(m) for m in ("total", "missed", "partial")])


def due_list(screenings: DataFrame, now: Column, limit: int = 400) -> DataFrame:
    """What to read next: unsettled, not started, look time reached; soonest start first."""
    waiting = (F.col("starts_at") > now) & (
        F.col("next_look_at").isNull() | (F.col("next_look_at") <= now)
    )
    if "settled" in screenings.columns:
        waiting = waiting & F.col("settled").isNull()
    return screenings.where(waiting).orderBy("starts_at", "screening_key").limit(limit)
