"""What a stream no longer needs in detail goes into sums, on Spark's own windowed aggregates.

Both take their rows from the files another stream has written, keep one state row per open window and film, and write a
window once, when the watermark says that nothing is added to it any more: a day of settled shows when it is folded, an
hour of the ramp when it leaves the time for which hours are kept. State therefore never holds more than that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecount import rules
from gatecount.operators.settle import GRADES


def daily_stream(
    settled: DataFrame, keep_days: int = rules.FOLD_AFTER_DAYS, cutoff_hours: int = rules.BUSINESS_DAY_CUTOFF_HOURS, group: str = "film_id"
) -> DataFrame:
    """Daily totals and coverage per film: day, film, sold, capacity, screenings, gross and the grades.

    ``settled``: rows of `gatecount.streaming.settle.settle_stream` with the film and price_min (null: the default
    price). A day is written once the newest settled show started ``keep_days`` after its end; a show that is settled
    later than that is too late for its day.
    """
    rows = settled.withColumn("_start", F.col("starts_at").cast("timestamp")).withWatermark("_start", f"{keep_days} days")
    day = F.window("_start", "1 day", "1 day", f"{cutoff_hours} hours")
    price = F.coalesce(F.col("price_min"), F.lit(rules.DEFAULT_PRICE))
    sums = rows.groupBy(day.alias("_day"), group).agg(
        F.sum("sold").alias("sold"),
        F.sum("total").alias("capacity"),
        F.count(F.lit(1)).alias("screenings"),
        F.sum(F.col("sold") * price).alias("gross"),
        *[F.count(F.when(F.col("confidence") == g, 1)).alias(g) for g in GRADES],
    )
    return sums.withColumn("day", F.col("_day.start").cast("date")).drop("_day")


def ramp_stream(sales: DataFrame, keep_days: int = rules.RAMP_RETENTION_DAYS, group: str = "film_id") -> DataFrame:
    """Hourly sums (hour, film, sold) of the hours that are more than ``keep_days`` back, one row each."""
    rows = sales.withColumn("_hour", F.col("hour").cast("timestamp")).withWatermark("_hour", f"{keep_days} days")
    sums = rows.groupBy(F.window("_hour", "1 hour").alias("_in"), group).agg(F.sum("sold").alias("sold"))
    return sums.withColumn("hour", F.col("_in.start").cast("timestamp_ntz")).drop("_in")
