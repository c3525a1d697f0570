"""Day, week, title, chain, format and place roll-ups of the working set.

Each roll-up is one filter that reaches the scan, one partially aggregated
groupBy and, for rankings, a bounded sort. ``base`` computes the effective
measures once so that several answers can share a persisted input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecount import rules
from gatecount.functions import numbers as N
from gatecount.functions import text as X
from gatecount.functions import times as T
from gatecount.operators.ordered import top_per_key


def describe(screenings: DataFrame, halls: DataFrame, cinemas: DataFrame) -> DataFrame:
    """Add hall and cinema names; a missing hall or cinema gives an empty name.

    No join hint: Spark broadcasts a dimension only while its size is under the
    session's threshold and sorts and merges beyond it.
    """
    named = halls.select("hall_key", F.col("name").alias("hall"), "cinema_key").join(
        cinemas.select("cinema_key", F.col("name").alias("cinema")), "cinema_key", "left"
    )
    joined = screenings.join(named.drop("cinema_key"), "hall_key", "left")
    return joined.fillna("", ["hall", "cinema"])


def metadata_fallback(ids: DataFrame, catalogue: DataFrame, history: DataFrame, id_col: str = "film_id") -> DataFrame:
    """Title from the catalogue, else from history, else ``#id``."""
    live = catalogue.select(F.col(id_col), F.col("title").alias("_t1"), F.col("original_title").alias("_o1"))
    past = history.select(F.col(id_col), F.col("title").alias("_t2"), F.col("original_title").alias("_o2"))
    return (
        ids.join(live, id_col, "left")
        .join(past, id_col, "left")
        .select(
            *ids.columns,
            F.coalesce("_t1", "_t2", F.concat(F.lit("#"), F.col(id_col).cast("string"))).alias("title"),
            F.when(F.col("_t1").isNotNull(), F.col("_o1")).otherwise(F.col("_o2")).alias("original_title"),
        )
    )


def base(
    screenings: DataFrame,
    now: Column,
    today: Column,
    default_price: float = rules.DEFAULT_PRICE,
) -> DataFrame:
    """Films only, this week's or today's rows, with the effective measures."""
    settled = "settled" in screenings.columns
    none = F.lit(None).cast("bigint")
    sold = N.admissions(F.col("settled.sold") if settled else none, F.col("sold"))
    seats = N.admissions(F.col("settled.total") if settled else none, F.col("total"))
    monday = T.week_start(today)
    in_week = F.col("day").between(monday, F.date_add(monday, 6))
    rows = screenings.where(~F.coalesce(F.col("kind") == "event", F.lit(False))).where(
        in_week | (F.col("day") == today)
    )
    return rows.withColumns(
        {
            "admissions": sold,
            "seats": seats,
            "gross": sold * N.price(F.col("price_min"), default_price),
            "started": F.col("starts_at") <= now,
            "is_today": F.col("day") == today,
        }
    )


def _standing() -> list[Column]:
    return [
        F.coalesce(F.sum("admissions"), F.lit(0)).alias("admissions"),
        F.coalesce(F.sum("seats"), F.lit(0)).alias("seats_offered"),
        F.count(F.lit(1)).alias("screenings"),
    ]


def with_occupancy(df: DataFrame) -> DataFrame:
    return df.withColumn("occupancy", N.safe_ratio(F.col("admissions"), F.col("seats_offered")))


def day_totals(rows: DataFrame) -> DataFrame:
    return with_occupancy(
        rows.where("is_today").agg(
            *_standing(),
            F.count(F.when(F.col("started"), 1)).alias("screenings_done"),
            F.count(F.when(F.col("sold_out"), 1)).alias("sellouts"),
            F.coalesce(F.sum("gross"), F.lit(0.0)).alias("gross"),
        )
    )


def week_totals(rows: DataFrame) -> DataFrame:
    return with_occupancy(
        rows.agg(
            *_standing(),
            F.coalesce(F.sum("gross"), F.lit(0.0)).alias("gross"),
            F.coalesce(F.sum(F.when(~F.col("started"), F.col("admissions"))), F.lit(0)).alias("presale"),
        )
    )


def film_period(rows: DataFrame, group: str = "film_id") -> DataFrame:
    """Standing of each title: today, this week, sell-outs and presale, in one pass."""
    today = F.col("is_today")
    out = rows.groupBy(group).agg(
        F.coalesce(F.sum(F.when(today, F.col("admissions"))), F.lit(0)).alias("today_admissions"),
        F.coalesce(F.sum(F.when(today, F.col("seats"))), F.lit(0)).alias("today_seats"),
        F.count(F.when(today, 1)).alias("today_screenings"),
        F.sum("admissions").alias("week_admissions"),
        F.sum("seats").alias("week_seats"),
        F.count(F.lit(1)).alias("week_screenings"),
        F.count(F.when(F.col("sold_out"), 1)).alias("sellouts"),
        F.coalesce(F.sum(F.when(~F.col("started"), F.col("admissions"))), F.lit(0)).alias("presale"),
    )
    return out.withColumns(
        {
            "today_occupancy": N.safe_ratio(F.col("today_admissions"), F.col("today_seats")),
            "week_occupancy": N.safe_ratio(F.col("week_admissions"), F.col("week_seats")),
        }
    )


def film_ranking(period: DataFrame, measure: str, group: str = "film_id") -> DataFrame:
    """Titles with anything sold, best first (a total order: the key breaks ties)."""
    return period.where(F.col(measure) > 0).orderBy(F.desc(measure), F.col(group))


def week_spine(rows: DataFrame, today: Column) -> DataFrame:
    """Monday to Sunday, days without data as zero rows, ``past`` before today."""
    spark = rows.sparkSession
    monday = T.week_start(today)
    spine = spark.range(1).select(
        F.explode(F.sequence(monday, F.date_add(monday, 6))).alias("day")
    )
    sums = rows.groupBy("day").agg(*_standing())
    return spine.join(sums, "day", "left").select(
        "day",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("admissions", "seats_offered", "screenings")],
        (F.col("day") < today).alias("past"),
    )


def film_by_day(rows: DataFrame, group: str = "film_id") -> DataFrame:
    return rows.groupBy(group, "day").agg(F.sum("admissions").alias("admissions"))


def breakdowns(rows: DataFrame, group: str = "film_id") -> DataFrame:
    """Per title by chain, by format combination and by cinema.

    The raw rows are reduced once to the finest combination; the grouping sets
    then expand that small table, not the input. Unnamed cinemas are left out.
    """
    fine = rows.groupBy(group, "chain", X.format_label(F.col("formats")).alias("format"), "cinema").agg(
        F.sum("admissions").alias("admissions"), F.sum("seats").alias("seats_offered")
    )
    long = fine.select(
        group,
        "admissions",
        "seats_offered",
        F.explode(
            F.create_map(
                F.lit("chain"), F.col("chain"), F.lit("format"), F.col("format"), F.lit("cinema"), F.col("cinema")
            )
        ).alias("breakdown", "value"),
    ).where(F.col("value") != "")
    return long.groupBy(group, "breakdown", "value").agg(
        F.sum("admissions").alias("admissions"), F.sum("seats_offered").alias("seats_offered")
    )


def cinemas_per_film(rows: DataFrame, group: str = "film_id") -> DataFrame:
    return rows.where(F.col("cinema") != "").groupBy(group).agg(F.countDistinct("cinema").alias("cinemas"))


def top_cinemas(rows: DataFrame, k: int = 10, group: str = "film_id") -> DataFrame:
    """Best k cinemas per title: reduced to (title, cinema) before the window."""
    per = rows.where(F.col("cinema") != "").groupBy(group, "cinema").agg(
        F.sum("admissions").alias("admissions"), F.sum("seats").alias("seats_offered")
    )
    return top_per_key(per, [group], [F.desc("admissions"), F.col("cinema")], k)


def planned_ratio(
    screenings: DataFrame,
    now: Column,
    min_past: int = rules.MIN_PAST_SCREENINGS,
    group: str = "film_id",
) -> DataFrame:
    """Screenings of the next seven days over the last seven; null under ``min_past``."""
    week = T.days(7)
    start = F.col("starts_at")
    counts = (
        screenings.where((start >= now - week) & (start < now + week))
        .groupBy(group)
        .agg(
            F.count(F.when(start < now, 1)).alias("past"),
            F.count(F.when(start >= now, 1)).alias("next"),
        )
    )
    ratio = F.when(F.col("past") >= min_past, F.col("next").cast("double") / F.col("past"))
    return counts.withColumn("planned_ratio", ratio)


def fullest(rows: DataFrame, k: int = 10, min_capacity: int = rules.FULLEST_MIN_CAPACITY) -> DataFrame:
    ratio = F.col("admissions").cast("double") / F.col("seats")
    big = rows.where(F.col("is_today") & (F.col("seats") >= min_capacity)).withColumn("ratio", ratio)
    return big.orderBy(F.desc("ratio"), "screening_key").limit(k)


def upcoming(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.where(F.col("is_today") & ~F.col("started")).orderBy("starts_at", "screening_key").limit(k)


def todays_list(rows: DataFrame, group: str = "film_id") -> DataFrame:
    """Today's screenings per title in start order, as rows (no array per title)."""
    return rows.where("is_today").orderBy(group, "starts_at", "screening_key")


def share_of_top(period: DataFrame, measure: str = "week_admissions") -> DataFrame:
    """Each title against the leader, average per screening and free seats."""
    top = period.agg(F.max(measure).alias("m")).select("m")
    return period.withColumns(
        {
            "share": N.safe_ratio(F.col(measure), top.scalar()),
            "per_screening": N.safe_ratio(F.col(measure), F.col("week_screenings")),
            "free_seats": F.greatest(F.col("week_seats") - F.col(measure), F.lit(0)),
        }
    )


def refresh_candidates(
    screenings: DataFrame,
    films: DataFrame,
    now: Column,
    limit: int = rules.CONTEXT_LIMIT,
    min_admissions: int = rules.CONTEXT_MIN_ADMISSIONS,
    stale_hours: int = rules.CONTEXT_STALE_HOURS,
) -> DataFrame:
    """Titles worth new context: enough sold, and no rating or a stale one; biggest first."""
    settled = F.col("settled.sold") if "settled" in screenings.columns else F.lit(None).cast("bigint")
    sums = screenings.groupBy("film_id").agg(
        F.sum(N.admissions(settled, F.col("sold"))).alias("admissions")
    )
    stale = (
        F.col("rating").isNull()
        | F.col("context_at").isNull()
        | (F.col("context_at") < now - T.hours(stale_hours))
    )
    return (
        films.where(stale)
        .join(sums.where(F.col("admissions") >= min_admissions), "film_id")
        .orderBy(F.desc("admissions"), "film_id")
        .limit(limit)
    )


def official_plus_measured(
    official: DataFrame, daily: DataFrame, handover_days: int = rules.HANDOVER_DAYS
) -> DataFrame:
    """Official total plus what was measured from ``as_of`` + handover on.

    ``official``: film_id, admissions, gross, as_of. ``daily``: film_id, day, admissions.
    """
    measured = daily.select("film_id", "day", F.col("admissions").alias("_sold"))
    since = F.when(F.col("day") >= F.date_add("as_of", handover_days), F.col("_sold"))
    return (
        official.join(measured, "film_id", "left")
        .groupBy("film_id", "admissions", "gross", "as_of")
        .agg(F.coalesce(F.sum(since), F.lit(0)).alias("since_admissions"))
        .withColumn("total", F.col("admissions") + F.col("since_admissions"))
    )
