"""Queries over the screenings: roll-ups, rankings, settlement, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecount.functions import times as T
from gatecount.operators import readings as R
from gatecount.operators import rollup as U
from gatecount.operators import settle as S
from gatecount.plans import views as V
from gatecount.plans.views import with_views

DAY = f"DATE '{V.TODAY}'"
TS = f"TIMESTAMP '{V.NOW}'"


def _now():
    return T.instant(V.NOW)


def _today():
    return F.lit(V.TODAY).cast("date")


def _base(spark, sf_dir):
    return U.base(V.screenings(spark, sf_dir), _now(), _today())


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def screening_described(spark, sf_dir):
    """Halls and cinemas as dimensions; some halls and some cinemas are missing."""
    supplier = V.table(spark, sf_dir, "supplier")
    halls = supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("hall_key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("cinema_key")
    )
    cinemas = (
        V.table(spark, sf_dir, "nation")
        .where("n_regionkey <> 0")
        .select(F.col("n_nationkey").alias("cinema_key"), F.col("n_name").alias("name"))
    )
    shows = V.screenings(spark, sf_dir).select("screening_key", "hall_key", "starts_at", "sold", "total")
    return U.describe(shows, halls, cinemas)


def metadata_fallback(spark, sf_dir):
    part = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("film_id"), "p_name", "p_type", "p_size")
    ids = part.select("film_id")
    live = part.where("p_size <= 20").select(
        "film_id", F.col("p_name").alias("title"), F.when(F.col("film_id") % 2 == 0, F.col("p_type")).alias("original_title")
    )
    past = part.where("p_size BETWEEN 11 AND 35").select(
        "film_id", F.concat(F.lit("old "), "p_name").alias("title"), F.col("p_type").alias("original_title")
    )
    return U.metadata_fallback(ids, live, past)


def day_totals(spark, sf_dir):
    return _rounded(_rounded(U.day_totals(_base(spark, sf_dir)), "occupancy"), "gross", digits=2)


def week_totals(spark, sf_dir):
    return _rounded(_rounded(U.week_totals(_base(spark, sf_dir)), "occupancy"), "gross", digits=2)


def film_period(spark, sf_dir):
    return _rounded(U.film_period(_base(spark, sf_dir)), "today_occupancy", "week_occupancy")


def film_ranking(spark, sf_dir):
    period = U.film_period(_base(spark, sf_dir)).select("film_id", "week_admissions")
    return U.film_ranking(period, "week_admissions")


def week_spine(spark, sf_dir):
    return U.week_spine(_base(spark, sf_dir), _today())


def film_by_day(spark, sf_dir):
    return U.film_by_day(_base(spark, sf_dir))


def breakdown_sets(spark, sf_dir):
    return U.breakdowns(_base(spark, sf_dir))


def cinemas_per_film(spark, sf_dir):
    return U.cinemas_per_film(_base(spark, sf_dir))


def top_cinemas(spark, sf_dir):
    return U.top_cinemas(_base(spark, sf_dir))


def planned_ratio(spark, sf_dir):
    return _rounded(U.planned_ratio(V.screenings(spark, sf_dir), _now()), "planned_ratio")


def fullest(spark, sf_dir):
    return _rounded(U.fullest(_base(spark, sf_dir)), "ratio").select(
        "screening_key", "film_id", "cinema", "admissions", "seats", "ratio"
    )


def upcoming(spark, sf_dir):
    return U.upcoming(_base(spark, sf_dir)).select("screening_key", "film_id", "hall", "starts_at", "admissions")


def todays_list(spark, sf_dir):
    return U.todays_list(_base(spark, sf_dir)).select("film_id", "starts_at", "screening_key", "hall", "admissions", "seats")


def share_of_top(spark, sf_dir):
    out = U.share_of_top(U.film_period(_base(spark, sf_dir)))
    return _rounded(out, "share", "per_screening").select(
        "film_id", "week_admissions", "share", "per_screening", "free_seats"
    )


def refresh_candidates(spark, sf_dir):
    films = (
        V.table(spark, sf_dir, "part")
        .groupBy(V.brand_number().alias("film_id"))
        .agg(F.max("p_size").alias("m"))
        .select(
            "film_id",
            F.when(F.col("film_id") % 3 != 0, F.col("m").cast("double")).alias("rating"),
            F.when(F.col("film_id") % 4 != 0, T.instant("1998-06-17 04:00:00") + F.expr("make_dt_interval(0, CAST(film_id % 5 AS INT))")).alias("context_at"),
        )
    )
    return U.refresh_candidates(V.screenings(spark, sf_dir), films, _now()).select("film_id", "admissions", "rating")


def official_plus_measured(spark, sf_dir):
    from gatecount.operators import official as O

    official = O.latest_totals(V.weekly(spark, sf_dir), T.instant("1998-06-13 12:00:00"), 40).drop("title")
    daily = U.film_by_day(V.screenings(spark, sf_dir).withColumn("admissions", F.col("sold")))
    return U.official_plus_measured(official, daily).select("film_id", "admissions", "as_of", "since_admissions", "total")


def settle(spark, sf_dir):
    return S.settle_counts(S.settle(V.screenings(spark, sf_dir), _now()))


def settle_rows(spark, sf_dir):
    out = S.settle(V.screenings(spark, sf_dir), _now()).where("newly_settled")
    return out.select("screening_key", "settled.sold", "settled.total", "settled.confidence", "settled.captured_at")


def fold_history(spark, sf_dir):
    settled = S.settle(V.screenings(spark, sf_dir), _now())
    stored = V.weekly(spark, sf_dir).select(
        F.col("weekend_from").alias("day"),
        "film_id",
        F.col("weekend_admissions").alias("sold"),
        (F.col("weekend_admissions") * 2).alias("capacity"),
        F.col("cinemas").alias("screenings"),
        F.col("weekend_gross").alias("gross"),
    )
    return _rounded(S.fold_daily(settled, _now(), stored), "gross", digits=2)


def fold_coverage(spark, sf_dir):
    return S.fold_coverage(S.settle(V.screenings(spark, sf_dir), _now()), _now())


def working_set(spark, sf_dir):
    kept = S.working_set(S.settle(V.screenings(spark, sf_dir), _now()), _now())
    return kept.select("screening_key", "starts_at", F.col("settled").isNotNull().alias("is_settled"))


def coverage(spark, sf_dir):
    settled = S.settle(V.screenings(spark, sf_dir), _now())
    return S.recent_coverage(S.working_set(settled, _now()), S.fold_coverage(settled, _now()), _now(), 20)


def repair_closed(spark, sf_dir):
    rows = S.settle(V.screenings(spark, sf_dir), _now())
    out = R.repair_closed(rows, _now(), F.col("chain") == "R")
    return out.select(
        "screening_key", "repaired", "sold", "total", "captured_at", F.col("settled.confidence").alias("confidence")
    )


def due_list(spark, sf_dir):
    rows = S.settle(V.screenings(spark, sf_dir), _now())
    return S.due_list(rows.where("chain = 'A'"), _now(), 400).select("screening_key", "starts_at")


def settle_confidence(spark, sf_dir):
    rows = V.screenings(spark, sf_dir)
    return rows.select("screening_key", T.settle_confidence(F.col("starts_at"), F.col("captured_at")).alias("confidence"))


def next_look_at(spark, sf_dir):
    """Each show seen from its own moment, up to five days ahead and some after the start."""
    rows = V.screenings(spark, sf_dir).withColumn(
        "now", F.col("starts_at") - F.expr("make_dt_interval(0, 0, CAST(film_id * 311 + total * 7 + sold * 3 - 500 AS INT))")
    )
    return rows.select(
        "screening_key",
        T.next_look(F.col("starts_at"), F.col("now")).alias("look"),
        T.recheck_look(F.col("starts_at"), F.col("now")).alias("recheck"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        screening_described,
        metadata_fallback,
        day_totals,
        week_totals,
        film_period,
        film_ranking,
        week_spine,
        film_by_day,
        breakdown_sets,
        cinemas_per_film,
        top_cinemas,
        planned_ratio,
        fullest,
        upcoming,
        todays_list,
        share_of_top,
        refresh_candidates,
        official_plus_measured,
        settle,
        settle_rows,
        fold_history,
        fold_coverage,
        working_set,
        coverage,
        repair_closed,
        due_list,
        settle_confidence,
        next_look_at,
    )
}

_OCC = "round(CASE WHEN sum(total) > 0 THEN CAST(sum(sold) AS DOUBLE) / sum(total) ELSE 0 END, 6)"
_BIG = "CAST(coalesce(sum({0}), 0) AS BIGINT)"
_FOLD = f"starts_at < {TS} - INTERVAL 10 DAY"

ORACLES = {
    "screening_described": with_views(
        "vs",
        body=""" SELECT screening_key, hall_key, starts_at, sold, total, coalesce(s.s_name, '') AS hall, coalesce(n.n_name, '') AS cinema
        FROM vs LEFT JOIN supplier s ON hall_key = s.s_suppkey AND s.s_acctbal > 0
                LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey AND n.n_regionkey <> 0""",
    ),
    "metadata_fallback": """
        SELECT p_partkey AS film_id,
               CASE WHEN p_size <= 20 THEN p_name WHEN p_size <= 35 THEN 'old ' || p_name ELSE '#' || p_partkey END AS title,
               CASE WHEN p_size <= 20 THEN CASE WHEN p_partkey % 2 = 0 THEN p_type END
                    WHEN p_size <= 35 THEN p_type END AS original_title
        FROM part""",
    "day_totals": with_views(
        "vs",
        body=f""" SELECT {_BIG.format('sold')} AS admissions, {_BIG.format('total')} AS seats_offered, count(*) AS screenings,
          count(*) FILTER (started) AS screenings_done, count(*) FILTER (sold_out) AS sellouts,
          round(coalesce(sum(gross), 0), 2) AS gross, {_OCC} AS occupancy
        FROM vsb WHERE is_today""",
    ),
    "week_totals": with_views(
        "vs",
        body=f""" SELECT {_BIG.format('sold')} AS admissions, {_BIG.format('total')} AS seats_offered, count(*) AS screenings,
          round(coalesce(sum(gross), 0), 2) AS gross, CAST(coalesce(sum(sold) FILTER (NOT started), 0) AS BIGINT) AS presale,
          {_OCC} AS occupancy
        FROM vsb""",
    ),
    "film_period": with_views(
        "vs",
        body=""" SELECT film_id, CAST(coalesce(sum(sold) FILTER (is_today), 0) AS BIGINT) AS today_admissions,
          CAST(coalesce(sum(total) FILTER (is_today), 0) AS BIGINT) AS today_seats, count(*) FILTER (is_today) AS today_screenings,
          CAST(sum(sold) AS BIGINT) AS week_admissions, CAST(sum(total) AS BIGINT) AS week_seats, count(*) AS week_screenings,
          count(*) FILTER (sold_out) AS sellouts, CAST(coalesce(sum(sold) FILTER (NOT started), 0) AS BIGINT) AS presale,
          round(coalesce(CAST(sum(sold) FILTER (is_today) AS DOUBLE) / sum(total) FILTER (is_today), 0), 6) AS today_occupancy,
          round(CAST(sum(sold) AS DOUBLE) / sum(total), 6) AS week_occupancy
        FROM vsb GROUP BY 1""",
    ),
    "film_ranking": with_views(
        "vs",
        body=" SELECT film_id, CAST(sum(sold) AS BIGINT) AS week_admissions FROM vsb GROUP BY 1 HAVING sum(sold) > 0",
    ),
    "week_spine": with_views(
        "vs",
        body=f""", d AS (SELECT CAST(DATE '1998-06-15' + CAST(i AS INTEGER) AS DATE) AS day FROM range(7) r(i))
        SELECT d.day, CAST(coalesce(sum(sold), 0) AS BIGINT) AS admissions, CAST(coalesce(sum(total), 0) AS BIGINT) AS seats_offered,
               count(screening_key) AS screenings, d.day < {DAY} AS past
        FROM d LEFT JOIN vsb ON vsb.day = d.day GROUP BY d.day""",
    ),
    "film_by_day": with_views("vs", body=" SELECT film_id, day, CAST(sum(sold) AS BIGINT) AS admissions FROM vsb GROUP BY 1, 2"),
    "breakdown_sets": with_views(
        "vs",
        body=""" SELECT film_id, 'chain' AS breakdown, chain AS value, CAST(sum(sold) AS BIGINT) AS admissions, CAST(sum(total) AS BIGINT) AS seats_offered FROM vsb GROUP BY 1, 2, 3
        UNION ALL SELECT film_id, 'format', format, CAST(sum(sold) AS BIGINT), CAST(sum(total) AS BIGINT) FROM vsb GROUP BY 1, 2, 3
        UNION ALL SELECT film_id, 'cinema', cinema, CAST(sum(sold) AS BIGINT), CAST(sum(total) AS BIGINT) FROM vsb GROUP BY 1, 2, 3""",
    ),
    "cinemas_per_film": with_views("vs", body=" SELECT film_id, count(DISTINCT cinema) AS cinemas FROM vsb GROUP BY 1"),
    "top_cinemas": with_views(
        "vs",
        body=""", c AS (SELECT film_id, cinema, CAST(sum(sold) AS BIGINT) AS admissions, CAST(sum(total) AS BIGINT) AS seats_offered FROM vsb GROUP BY 1, 2)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY admissions DESC, cinema) <= 10""",
    ),
    "planned_ratio": with_views(
        "vs",
        body=f""", c AS (
          SELECT film_id, count(*) FILTER (starts_at < {TS}) AS past, count(*) FILTER (starts_at >= {TS}) AS next
          FROM vs WHERE starts_at >= {TS} - INTERVAL 7 DAY AND starts_at < {TS} + INTERVAL 7 DAY GROUP BY 1)
        SELECT film_id, past, next, CASE WHEN past >= 8 THEN round(CAST(next AS DOUBLE) / past, 6) END AS planned_ratio FROM c""",
    ),
    "fullest": with_views(
        "vs",
        body=""" SELECT screening_key, film_id, cinema, sold AS admissions, total AS seats, round(CAST(sold AS DOUBLE) / total, 6) AS ratio
        FROM vsb WHERE is_today AND total >= 40 ORDER BY CAST(sold AS DOUBLE) / total DESC, screening_key LIMIT 10""",
    ),
    "upcoming": with_views(
        "vs",
        body=""" SELECT screening_key, film_id, hall, starts_at, sold AS admissions FROM vsb
        WHERE is_today AND NOT started ORDER BY starts_at, screening_key LIMIT 10""",
    ),
    "todays_list": with_views(
        "vs", body=" SELECT film_id, starts_at, screening_key, hall, sold AS admissions, total AS seats FROM vsb WHERE is_today"
    ),
    "share_of_top": with_views(
        "vs",
        body=""", p AS (SELECT film_id, CAST(sum(sold) AS BIGINT) AS a, CAST(sum(total) AS BIGINT) AS t, count(*) AS n FROM vsb GROUP BY 1)
        SELECT film_id, a AS week_admissions, round(CASE WHEN max(a) OVER () > 0 THEN CAST(a AS DOUBLE) / max(a) OVER () ELSE 0 END, 6) AS share,
               round(CAST(a AS DOUBLE) / n, 6) AS per_screening, greatest(t - a, 0) AS free_seats FROM p""",
    ),
    "refresh_candidates": with_views(
        "vs",
        body=f""", f AS (
          SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS film_id, CAST(max(p_size) AS DOUBLE) AS m FROM part GROUP BY 1),
        g AS (SELECT film_id, CASE WHEN film_id % 3 <> 0 THEN m END AS rating,
                     CASE WHEN film_id % 4 <> 0 THEN TIMESTAMP '1998-06-17 04:00:00' + to_hours(film_id % 5) END AS context_at FROM f),
        s AS (SELECT film_id, CAST(sum(sold) AS BIGINT) AS admissions FROM vs GROUP BY 1 HAVING sum(sold) >= 50)
        SELECT film_id, admissions, rating FROM g JOIN s USING (film_id)
        WHERE rating IS NULL OR context_at IS NULL OR context_at < {TS} - INTERVAL 6 HOUR
        ORDER BY admissions DESC, film_id LIMIT 12""",
    ),
    "official_plus_measured": (
        with_views("vs", "vw", body="")
        + """, o AS (
          SELECT film_id, total_admissions AS admissions, weekend_from AS as_of FROM vw
          WHERE weekend_from >= CAST(TIMESTAMP '1998-06-13 12:00:00' - INTERVAL 40 DAY AS DATE)
          QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY total_admissions DESC, weekend_from, title) = 1)
        SELECT o.film_id, admissions, as_of, CAST(coalesce(sum(sold) FILTER (day >= as_of + 4), 0) AS BIGINT) AS since_admissions,
               CAST(admissions + coalesce(sum(sold) FILTER (day >= as_of + 4), 0) AS BIGINT) AS total
        FROM o LEFT JOIN vs ON vs.film_id = o.film_id GROUP BY 1, 2, 3"""
    ),
    "settle": with_views("vs", body=" SELECT confidence, count(*) AS screenings FROM vset WHERE confidence IS NOT NULL GROUP BY 1"),
    "settle_rows": with_views(
        "vs", body=" SELECT screening_key, sold, total, confidence, captured_at FROM vset WHERE confidence IS NOT NULL"
    ),
    "fold_history": with_views(
        "vs",
        "vw",
        body=f""", u AS (
          SELECT day, film_id, sold, total AS capacity, 1 AS screenings, sold * coalesce(price_min, 205.0) AS gross FROM vset WHERE {_FOLD}
          UNION ALL
          SELECT weekend_from, film_id, weekend_admissions, weekend_admissions * 2, cinemas, weekend_gross FROM vw)
        SELECT day, film_id, CAST(sum(sold) AS BIGINT) AS sold, CAST(sum(capacity) AS BIGINT) AS capacity,
               CAST(sum(screenings) AS BIGINT) AS screenings, round(sum(gross), 2) AS gross FROM u GROUP BY 1, 2""",
    ),
    "fold_coverage": with_views(
        "vs",
        body=f""" SELECT day, count(*) AS total, count(*) FILTER (confidence = 'final') AS final,
          count(*) FILTER (confidence = 'partial') AS partial, count(*) FILTER (confidence = 'missed') AS missed
        FROM vset WHERE {_FOLD} GROUP BY 1""",
    ),
    "working_set": with_views(
        "vs", body=f" SELECT screening_key, starts_at, confidence IS NOT NULL AS is_settled FROM vset WHERE NOT ({_FOLD})"
    ),
    "coverage": with_views(
        "vs",
        body=f""", u AS (
          SELECT confidence FROM vset WHERE confidence IS NOT NULL AND NOT ({_FOLD}) AND starts_at >= {TS} - INTERVAL 20 DAY
          UNION ALL
          SELECT confidence FROM vset WHERE {_FOLD} AND day >= CAST({TS} - INTERVAL 20 DAY AS DATE))
        SELECT count(*) AS total, count(*) FILTER (confidence = 'missed') AS missed, count(*) FILTER (confidence = 'partial') AS partial FROM u""",
    ),
    "repair_closed": with_views(
        "vs",
        body=f""", b AS (
          SELECT *, coalesce(chain = 'R' AND sold >= total AND starts_at - INTERVAL 60 MINUTE <= {TS}
                    AND (captured_at IS NULL OR captured_at >= starts_at - INTERVAL 60 MINUTE), false) AS repaired FROM vset)
        SELECT screening_key, repaired, CASE WHEN NOT repaired THEN sold END AS sold, CASE WHEN NOT repaired THEN total END AS total,
               CASE WHEN NOT repaired THEN captured_at END AS captured_at,
               CASE WHEN repaired AND confidence IS NOT NULL THEN 'missed' ELSE confidence END AS confidence
        FROM b""",
    ),
    "due_list": with_views(
        "vs",
        body=f""" SELECT screening_key, starts_at FROM vset
        WHERE chain = 'A' AND confidence IS NULL AND starts_at > {TS} AND (next_look_at IS NULL OR next_look_at <= {TS})
        ORDER BY starts_at, screening_key LIMIT 400""",
    ),
    "settle_confidence": with_views(
        "vs",
        body=""" SELECT screening_key, CASE WHEN captured_at IS NULL THEN 'missed' WHEN epoch(starts_at) - epoch(captured_at) <= 900 THEN 'final'
          ELSE 'partial' END AS confidence FROM vs""",
    ),
    "next_look_at": with_views(
        "vs",
        body=""", n AS (SELECT screening_key, starts_at, starts_at - to_minutes(film_id * 311 + total * 7 + sold * 3 - 500) AS now FROM vs),
        m AS (SELECT *, date_diff('minute', now, starts_at) AS ahead FROM n),
        c AS (SELECT *, now + CASE WHEN ahead <= 120 THEN INTERVAL 10 MINUTE WHEN ahead <= 720 THEN INTERVAL 30 MINUTE
                              WHEN ahead <= 2880 THEN INTERVAL 2 HOUR ELSE INTERVAL 12 HOUR END AS candidate,
                     starts_at - INTERVAL 5 MINUTE AS last_chance FROM m),
        l AS (SELECT *, CASE WHEN ahead > 0 THEN CASE WHEN candidate > last_chance THEN greatest(now, last_chance) ELSE candidate END END AS look FROM c)
        SELECT screening_key, look, CASE WHEN look IS NOT NULL THEN least(look, now + INTERVAL 5 MINUTE) END AS recheck FROM l""",
    ),
}
