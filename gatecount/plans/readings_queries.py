"""Queries over counter readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecount.functions import times as T
from gatecount.operators import alerts as A
from gatecount.operators import readings as R
from gatecount.operators.resolve import restrict_to
from gatecount.plans import views as V
from gatecount.plans.views import with_views

def sales_ramp(spark, sf_dir):
    return R.sales_ramp(V.readings(spark, sf_dir))


def hold_confirm(spark, sf_dir):
    rows = V.readings(spark, sf_dir).select("seq", "screening_key", "sold", "total")
    return R.hold_confirm(rows).drop("total")


def closed_guard(spark, sf_dir):
    rows = V.readings(spark, sf_dir).select("seq", "screening_key", "sold", "total")
    return R.closed_guard(rows).drop("total")


def confirmed_ramp(spark, sf_dir):
    """Increments over recorded readings only: the held ones never enter the ramp."""
    return R.confirmed_ramp(V.readings(spark, sf_dir))


def ramp_totals(spark, sf_dir):
    return R.ramp_totals(sales_ramp(spark, sf_dir))


def ramp_summary(spark, sf_dir):
    now = T.instant(V.EVENTS_NOW)
    return R.ramp_summary(sales_ramp(spark, sf_dir), now.cast("date"), T.week_start(now.cast("date")))


def ramp_cumulative(spark, sf_dir):
    return R.ramp_cumulative(sales_ramp(spark, sf_dir), last_hours=48)


def ramp_retention(spark, sf_dir):
    return R.ramp_retention(sales_ramp(spark, sf_dir), T.instant("2024-01-28 09:40:00"))


def restrict_series(spark, sf_dir):
    """The ramp of the films that have a large purchase."""
    listed = (
        V.table(spark, sf_dir, "events")
        .where((F.col("event_type") == "purchase") & (F.col("value") >= 300))
        .select((F.col("user_id") % 5).alias("film_id"))
        .distinct()
    )
    return restrict_to(sales_ramp(spark, sf_dir), listed)


def threshold_alert(spark, sf_dir):
    return R.threshold_alert(V.readings(spark, sf_dir))


def linked_alert(spark, sf_dir):
    """The same rings found by pointers from tick to tick, no series gathered."""
    return A.linked_alert(V.readings(spark, sf_dir))


def seat_occupancy(spark, sf_dir):
    """Seat plans built from orders: each line is a seat, its part decides the state."""
    states = F.array(*[F.lit(s) for s in ("FREE", "occupied", "RESERVED", "BROKEN", "Free", "BLOCKED", "odd")])
    seats = V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.get(states, (F.col("l_partkey") % 7).cast("int")).alias("state"),
        F.round(F.col("l_discount") * 100 - 3, 0).alias("price"),
    )
    return R.seat_totals(seats, "l_orderkey")


def deferred_capacity(spark, sf_dir):
    line = V.table(spark, sf_dir, "lineitem")
    size = F.lit(30) + F.lit(10) * (F.col("l_suppkey") % 4)
    drift = F.when(F.col("l_partkey") % 17 == 0, F.lit(0.0043)).otherwise(F.lit(0.0))
    facts = line.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_suppkey").alias("hall_key"),
        F.round((size - F.least(F.col("l_quantity"), size)) / size + drift, 4).alias("free_ratio"),
    )
    known = (
        V.table(spark, sf_dir, "supplier")
        .where("s_acctbal > 0")
        .select(F.col("s_suppkey").alias("hall_key"), (F.lit(30) + F.lit(10) * (F.col("s_suppkey") % 4)).alias("capacity"))
    )
    return R.deferred_capacity(facts, known)


QUERIES = {
    f.__name__: f
    for f in (
        sales_ramp,
        hold_confirm,
        closed_guard,
        confirmed_ramp,
        ramp_totals,
        ramp_summary,
        ramp_cumulative,
        ramp_retention,
        restrict_series,
        threshold_alert,
        linked_alert,
        seat_occupancy,
        deferred_capacity,
    )
}

ORACLES = {
    "sales_ramp": with_views("ramp", body=" SELECT hour, film_id, sold FROM ramp"),
    "hold_confirm": with_views(
        "vr",
        body="""
        SELECT seq, screening_key, sold,
               CASE WHEN sold >= total AND NOT coalesce(lag(sold >= total) OVER (PARTITION BY screening_key ORDER BY seq), false)
                    THEN 'held' ELSE 'recorded' END AS outcome
        FROM vr""",
    ),
    "closed_guard": with_views(
        "vr",
        body=""", g AS (
          SELECT *, sold >= total AND coalesce(lag(sold) OVER (PARTITION BY screening_key ORDER BY seq), 0) < 0.8 * total AS stop
          FROM vr),
        f AS (SELECT screening_key, min(seq) AS first_stop FROM g WHERE stop GROUP BY 1)
        SELECT seq, g.screening_key, sold,
               CASE WHEN first_stop IS NULL OR seq < first_stop THEN 'recorded'
                    WHEN seq = first_stop THEN 'rejected' ELSE 'closed' END AS outcome
        FROM g LEFT JOIN f ON g.screening_key = f.screening_key""",
    ),
    "confirmed_ramp": with_views(
        "vr",
        body=""", h AS (
          SELECT *, sold >= total AND NOT coalesce(lag(sold >= total) OVER (PARTITION BY screening_key ORDER BY seq), false) AS held
          FROM vr),
        d AS (
          SELECT film_id, at_ts, sold - lag(sold) OVER (PARTITION BY screening_key ORDER BY seq) AS delta FROM h WHERE NOT held)
        SELECT date_trunc('hour', at_ts) AS hour, film_id, CAST(sum(delta) AS BIGINT) AS sold
        FROM d WHERE delta > 0 GROUP BY 1, 2""",
    ),
    "ramp_totals": with_views(
        "ramp", body=" SELECT hour, CAST(sum(sold) AS BIGINT) AS sold FROM ramp GROUP BY 1 HAVING sum(sold) > 0"
    ),
    "ramp_summary": with_views(
        "ramp",
        body=f""", t AS (SELECT hour, CAST(sum(sold) AS BIGINT) AS sold FROM ramp GROUP BY 1),
        d AS (SELECT *, row_number() OVER (ORDER BY hour DESC) AS back FROM t
              WHERE CAST(hour AS DATE) = CAST(TIMESTAMP '{V.EVENTS_NOW}' AS DATE))
        SELECT CAST((SELECT coalesce(sum(sold), 0) FROM d) AS BIGINT) AS sold_today,
               CAST(coalesce((SELECT sold FROM d WHERE back = 2), 0) AS BIGINT) AS sold_last_hour,
               CAST((SELECT count(*) FROM d) AS BIGINT) AS hours_today,
               CAST(coalesce(sum(sold) FILTER (hour >= date_trunc('week', TIMESTAMP '{V.EVENTS_NOW}')), 0) AS BIGINT) AS sold_week
        FROM t""",
    ),
    "ramp_cumulative": with_views(
        "ramp",
        body=""", t AS (SELECT hour, CAST(sum(sold) AS BIGINT) AS sold FROM ramp GROUP BY 1)
        SELECT hour, sold, CAST((SELECT sum(sold) FROM t u WHERE u.hour <= t.hour) AS BIGINT) AS cumulative,
               sold = (SELECT max(sold) FROM t) AS is_peak
        FROM t ORDER BY hour DESC LIMIT 48""",
    ),
    "ramp_retention": with_views(
        "ramp", body=" SELECT hour, film_id, sold FROM ramp WHERE hour >= TIMESTAMP '2024-01-07 09:00:00'"
    ),
    "restrict_series": with_views(
        "ramp",
        body=""" SELECT hour, film_id, sold FROM ramp
        WHERE film_id IN (SELECT user_id % 5 FROM events WHERE event_type = 'purchase' AND value >= 300)""",
    ),
    "threshold_alert": with_views(
        "vr",
        recursive=True,
        body=""", ticks AS (
          SELECT screening_key, time_bucket(INTERVAL 5 MINUTE, at_ts) AS tick, arg_max(sold, seq) AS v FROM vr GROUP BY 1, 2),
        s AS (SELECT *, row_number() OVER (PARTITION BY screening_key ORDER BY tick) AS n FROM ticks),
        walk AS (
          SELECT screening_key, n, tick, v, tick AS ring_at, v AS ring_value, true AS ring FROM s WHERE n = 1
          UNION ALL
          SELECT s.screening_key, s.n, s.tick, s.v,
                 CASE WHEN s.v - w.ring_value >= 100 AND s.tick - w.ring_at >= INTERVAL 10 MINUTE THEN s.tick ELSE w.ring_at END,
                 CASE WHEN s.v - w.ring_value >= 100 AND s.tick - w.ring_at >= INTERVAL 10 MINUTE THEN s.v ELSE w.ring_value END,
                 s.v - w.ring_value >= 100 AND s.tick - w.ring_at >= INTERVAL 10 MINUTE
          FROM walk w JOIN s ON s.screening_key = w.screening_key AND s.n = w.n + 1)
        SELECT screening_key, ring_at, ring_value FROM walk WHERE ring""",
    ),
    "seat_occupancy": """
        WITH seats AS (
          SELECT l_orderkey, CASE l_partkey % 7 WHEN 0 THEN 'FREE' WHEN 1 THEN 'OCCUPIED' WHEN 2 THEN 'RESERVED' WHEN 3 THEN 'BROKEN'
                   WHEN 4 THEN 'FREE' WHEN 5 THEN 'BLOCKED' ELSE 'ODD' END AS state, round(l_discount * 100 - 3, 0) AS price
          FROM lineitem)
        SELECT l_orderkey, count(*) FILTER (state NOT IN ('BROKEN', 'BLOCKED', 'DISABLED', 'FREE')) AS sold,
               count(*) FILTER (state NOT IN ('BROKEN', 'BLOCKED', 'DISABLED')) AS total,
               min(price) FILTER (price > 0) AS price_min, max(price) FILTER (price > 0) AS price_max
        FROM seats GROUP BY 1""",
    "deferred_capacity": """
        WITH f AS (
          SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS hall_key, 30 + 10 * (l_suppkey % 4) AS size,
                 round((30 + 10 * (l_suppkey % 4) - least(l_quantity, 30 + 10 * (l_suppkey % 4))) / (30 + 10 * (l_suppkey % 4))
                       + CASE WHEN l_partkey % 17 = 0 THEN CAST(0.0043 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END, 4) AS free_ratio
          FROM lineitem),
        r AS (
          SELECT f.*, CASE WHEN s_suppkey IS NULL THEN 'missing'
                           WHEN abs(size * free_ratio - floor(size * free_ratio + 0.5)) > 0.05 THEN 'stale' ELSE 'readable' END AS capacity_state
          FROM f LEFT JOIN supplier ON hall_key = s_suppkey AND s_acctbal > 0)
        SELECT l_orderkey, l_linenumber, l_partkey, hall_key, free_ratio, capacity_state,
               CASE WHEN capacity_state = 'readable' THEN CAST(greatest(0, least(size, size - floor(size * free_ratio + 0.5))) AS BIGINT) END AS sold,
               CASE WHEN capacity_state = 'readable' THEN CAST(size AS BIGINT) END AS total
        FROM r""",
}
ORACLES["linked_alert"] = ORACLES["threshold_alert"]
