"""Queries over the weekly and annual tables: totals, ranking, run model."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecount.functions import times as T
from gatecount.operators import forecast as M
from gatecount.operators import official as O
from gatecount.operators import resolve as E
from gatecount.plans import views as V
from gatecount.plans.views import with_views

RUN = ("film_id", "run")


def _now():
    return T.instant(V.NOW)


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _runs(spark, sf_dir):
    return M.collect_runs(V.weekly(spark, sf_dir), RUN, keep=("origin",))


def _runs_with_plan(spark, sf_dir):
    """Runs with a planned screen ratio for most films."""
    ratio = F.when(F.col("film_id") % 4 != 0, (F.col("film_id") % 11 + 1) / F.lit(8.0))
    return _runs(spark, sf_dir).withColumn("planned_ratio", ratio)


def latest_totals(spark, sf_dir):
    return O.latest_totals(V.weekly(spark, sf_dir), _now())


def run_series(spark, sf_dir):
    return O.run_series(V.weekly(spark, sf_dir), _now(), 120)


def all_time_ranking(spark, sf_dir):
    return O.all_time_ranking(V.weekly(spark, sf_dir), V.annual(spark, sf_dir))


def archive_summary(spark, sf_dir):
    return O.archive_summary(V.weekly(spark, sf_dir))


def newest_weekend(spark, sf_dir):
    return O.newest_weekend(V.weekly(spark, sf_dir)).select("film_id", "run", "rank", "weekend_admissions", "total_admissions")


def freshness_check(spark, sf_dir):
    """Seen from every order date: which report was due, and was it there."""
    have = V.weekly(spark, sf_dir).agg(F.max("weekend_from")).scalar()
    days = V.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("today")).distinct()
    expected = T.expected_weekend(F.col("today"))
    return days.select("today", expected.alias("expected"), (have < expected).alias("awaiting"))


def report_state(spark, sf_dir):
    return O.freshness(V.weekly(spark, sf_dir), F.lit(V.TODAY).cast("date"))


def week_key(spark, sf_dir):
    """File names of every order's week, newest report first by number."""
    day = F.col("o_orderdate")
    name = F.concat(
        F.lit("/files/top20-"), F.year(day).cast("string"), F.lit("-"), F.weekofyear(day).cast("string"),
        F.when(F.col("o_orderkey") % 5 == 0, "sk.xls").otherwise("cz.xls"),
    )
    files = V.table(spark, sf_dir, "orders").select(name.alias("file")).distinct()
    parsed = files.withColumn("_w", O.parse_week_file(F.col("file")))
    return (
        parsed.where(F.col("_w.year").isNotNull())
        .select("file", "_w.year", "_w.week", O.week_key(F.col("_w.year"), F.col("_w.week")).alias("week_key"))
        .orderBy(F.desc("year"), F.desc("week"))
    )


def only_new(spark, sf_dir):
    """Weeks the orders name that the weekly table does not hold."""
    day = F.col("o_orderdate")
    seen = V.table(spark, sf_dir, "orders").select(
        F.year(F.date_add(F.date_trunc("week", day).cast("date"), 3)).cast("bigint").alias("year"),
        F.weekofyear(day).cast("bigint").alias("week"),
    ).distinct()
    stored = V.weekly(spark, sf_dir).where("weekend_from < DATE '1999-01-01'").select("year", "week")
    return E.only_new(seen, stored, ["year", "week"])


def normalize_run(spark, sf_dir):
    rows = _runs(spark, sf_dir).select(*RUN, F.explode(M.normalize_run(F.col("points"))).alias("p"))
    return rows.select(*RUN, "p.week", "p.admissions", "p.total", "p.cinemas")


def hold_strength(spark, sf_dir):
    rows = _runs(spark, sf_dir).withColumn("p", M.normalize_run(F.col("points")))
    own = M.measured_strength(F.col("p"), F.col("origin"))
    return rows.select(
        *RUN, F.round(own, 6).alias("measured"), F.round(M.opening_strength(F.col("p")), 6).alias("opening")
    )


def forecast_run(spark, sf_dir):
    out = M.forecast(_runs_with_plan(spark, sf_dir), planned_ratio="planned_ratio")
    return _rounded(out, "hold", "strength", "multiplier", "screen_trend").select(
        *RUN, "so_far", "total", "low", "high", "hold", "strength", "measured", "weeks", "multiplier", "screen_trend"
    )


def forecast_opening(spark, sf_dir):
    """Forecasts after a single weekend: only the opening's intensity is known."""
    first = _runs(spark, sf_dir).withColumn("points", F.slice(M.normalize_run(F.col("points")), 1, 1))
    out = M.forecast(first, normalized=True)
    return _rounded(out, "strength", "multiplier").select(*RUN, "so_far", "total", "low", "high", "strength", "measured", "multiplier")


def forecast_curve(spark, sf_dir):
    out = M.forecast(_runs(spark, sf_dir)).select(*RUN, F.explode("curve").alias("c"))
    return out.select(*RUN, "c.week", "c.total", "c.projected")


def forecast_trend(spark, sf_dir):
    return M.forecast_trend(_runs_with_plan(spark, sf_dir), RUN, planned_ratio="planned_ratio")


def trend_direction(spark, sf_dir):
    return M.trend_direction(forecast_trend(spark, sf_dir), RUN)


def forecast_log(spark, sf_dir):
    """A log with repeated vintages and more than the kept number per film."""
    rows = V.weekly(spark, sf_dir).select(
        "film_id",
        F.col("weekend_from").alias("as_of"),
        F.col("week_of_run").alias("weeks"),
        F.col("total_admissions").alias("predicted"),
        F.col("weekend_admissions").alias("low"),
        (F.col("total_admissions") * 2).alias("high"),
        F.lit(None).cast("double").alias("screen_trend"),
        (F.col("weekend_from").cast("timestamp_ntz") + F.expr("make_dt_interval(CAST(substr(run, length(run), 1) AS INT))")).alias("at_ts"),
    )
    again = rows.where("film_id % 2 = 0").withColumns(
        {"predicted": F.col("predicted") + 1, "at_ts": F.col("at_ts") + F.expr("INTERVAL '12' HOUR")}
    )
    return M.forecast_log(rows, again).drop("screen_trend")


def calibrate_hold(spark, sf_dir):
    out = M.calibrate_hold(_runs(spark, sf_dir), RUN)
    return out.select("origin", "week", "n", F.round("quantile", 6).alias("median_hold"))


def calibrate_decline(spark, sf_dir):
    out = M.calibrate_decline(_runs(spark, sf_dir), RUN)
    return out.select("week", "n", F.round("quantile", 6).alias("median_decline"))


def calibrate_spread(spark, sf_dir):
    out = M.calibrate_spread(_runs(spark, sf_dir), RUN)
    return out.select("stage", F.round("probability", 1).alias("probability"), "n", F.round("quantile", 6).alias("ratio"))


def held_out_accuracy(spark, sf_dir):
    """Bands from the runs that began before 1996, judged on the runs since."""
    begun = F.to_date(F.split("run", "/")[1], "yyyy-MM")
    runs = _runs(spark, sf_dir).withColumn("started", begun)
    out = M.held_out_accuracy(runs, F.lit("1996-01-01").cast("date"), RUN)
    return _rounded(out, "within", "covered", "covered_fixed", "low", "high")


QUERIES = {
    f.__name__: f
    for f in (
        latest_totals,
        run_series,
        all_time_ranking,
        archive_summary,
        newest_weekend,
        freshness_check,
        report_state,
        week_key,
        only_new,
        normalize_run,
        hold_strength,
        forecast_run,
        forecast_opening,
        forecast_curve,
        forecast_trend,
        trend_direction,
        forecast_log,
        calibrate_hold,
        calibrate_decline,
        calibrate_spread,
        held_out_accuracy,
    )
}

# The clean run by window functions: leading previews off, the opening numbered 1.
_CLEAN = """, r0 AS (
  SELECT film_id, run, origin, week_of_run AS week, weekend_admissions AS adm, total_admissions AS total, cinemas,
         row_number() OVER w AS n, count(*) OVER (PARTITION BY run) AS len, lead(weekend_admissions) OVER w AS next_adm
  FROM vw WINDOW w AS (PARTITION BY run ORDER BY week_of_run)),
r1 AS (
  SELECT *, CASE WHEN n < len AND (week < 0 OR (week < 1 AND adm < 0.35 * next_adm)) THEN 0 ELSE 1 END AS opens FROM r0),
r2 AS (SELECT *, max(opens) OVER (PARTITION BY run ORDER BY n) AS kept FROM r1),
clean AS (
  SELECT film_id, run, origin, week + CASE WHEN first_value(week) OVER w = 0 THEN 1 ELSE 0 END AS week, adm, total, cinemas,
         row_number() OVER w AS n
  FROM r2 WHERE kept = 1 WINDOW w AS (PARTITION BY run ORDER BY n))"""


def _hold(origin: str, week: str) -> str:
    return (
        f"(CASE WHEN {origin} = 'cz' THEN CASE {week} WHEN 1 THEN 0.51 WHEN 2 THEN 0.583 WHEN 3 THEN 0.623 WHEN 4 THEN 0.656 WHEN 5 THEN 0.751 ELSE 0.5 END "
        f"ELSE CASE {week} WHEN 1 THEN 0.516 WHEN 2 THEN 0.618 WHEN 3 THEN 0.642 WHEN 4 THEN 0.686 WHEN 5 THEN 0.701 ELSE 0.5 END END)::DOUBLE"
    )


def _model(cuts: str, planned: str) -> str:
    """Every (run, cut) forecast from ``clean``: strength by joins, projection by recursion."""
    return f"""{_CLEAN}, cuts AS ({cuts}),
    pts AS (
      SELECT k.run AS run, k.cut, c.film_id, c.origin, c.week, c.adm, c.total, c.cinemas, c.n
      FROM cuts k JOIN clean c ON c.run = k.run AND c.n <= k.cut),
    pairs AS (
      SELECT a.run, a.cut, least(a.adm::DOUBLE / b.adm, 0.95) / {_hold('b.origin', 'b.week')} AS ratio, pow(0.6::DOUBLE, a.cut - a.n) AS w
      FROM pts a JOIN pts b ON a.run = b.run AND a.cut = b.cut AND b.n = a.n - 1
      WHERE a.week = b.week + 1 AND b.adm > 0 AND a.adm::DOUBLE / b.adm > 0.05),
    own AS (SELECT run, cut, exp(sum(ln(ratio) * w) / sum(w)) AS measured FROM pairs GROUP BY 1, 2),
    opening AS (
      SELECT run, cut, week AS first_week, adm AS first_adm,
             CASE WHEN cinemas > 0 THEN greatest(0.6, least(1.3, pow(adm::DOUBLE / cinemas / 160.0, 0.5))) END AS intensity
      FROM pts WHERE n = 1),
    lst AS (
      SELECT p.film_id, p.run, p.cut, p.origin, p.week, p.adm, greatest(p.total, p.adm) AS so_far, measured, intensity, first_week, first_adm,
             coalesce(measured, intensity, 1.0) AS strength, {planned} AS planned,
             CASE WHEN p.origin = 'cz' THEN 1.634 ELSE 1.513 END::DOUBLE AS uplift
      FROM pts p JOIN opening o ON o.run = p.run AND o.cut = p.cut LEFT JOIN own ON own.run = p.run AND own.cut = p.cut
      WHERE p.n = p.cut AND p.adm > 0 AND p.week >= 1),
    tr AS (
      SELECT *, CASE WHEN planned IS NOT NULL THEN greatest(0.5, least(1.6, planned /
               (CASE week WHEN 1 THEN 0.602 WHEN 2 THEN 0.711 WHEN 3 THEN 0.796 WHEN 4 THEN 0.809 WHEN 5 THEN 0.81 ELSE 0.826 END)::DOUBLE)) END AS trend
      FROM lst),
    walk AS (
      SELECT run, cut, 0 AS k, adm::DOUBLE AS weekend, 0.0::DOUBLE AS ahead FROM tr
      UNION ALL
      SELECT w.run, w.cut, w.k + 1, w.weekend * least({_hold('t.origin', 't.week + w.k')} * pow(t.strength, 0.4) * CASE WHEN w.k = 0 THEN coalesce(pow(t.trend, 0.75), 1.0) ELSE 1.0 END, 0.95),
             w.ahead + w.weekend * least({_hold('t.origin', 't.week + w.k')} * pow(t.strength, 0.4) * CASE WHEN w.k = 0 THEN coalesce(pow(t.trend, 0.75), 1.0) ELSE 1.0 END, 0.95) * t.uplift
      FROM walk w JOIN tr t ON t.run = w.run AND t.cut = w.cut
      WHERE w.k < 10 AND w.weekend * least({_hold('t.origin', 't.week + w.k')} * pow(t.strength, 0.4) * CASE WHEN w.k = 0 THEN coalesce(pow(t.trend, 0.75), 1.0) ELSE 1.0 END, 0.95) >= 300),
    sums AS (SELECT run, cut, max(ahead) AS ahead FROM walk GROUP BY 1, 2),
    fc AS (
      SELECT t.*, CAST(floor(so_far + ahead + 0.5) AS BIGINT) AS total,
             [0.57, 0.66, 0.83, 0.89, 0.94][least(t.cut, 5)]::DOUBLE AS lo, [2.09, 1.35, 1.3, 1.29, 1.27][least(t.cut, 5)]::DOUBLE AS hi
      FROM tr t JOIN sums s ON s.run = t.run AND s.cut = t.cut)"""


_FULL = "SELECT run, max(n) AS cut FROM clean GROUP BY 1"
_EVERY = "SELECT run, n AS cut FROM clean"
_PLAN = "CASE WHEN p.film_id % 4 <> 0 THEN (p.film_id % 11 + 1) / 8.0::DOUBLE END"
_LIVE = "CASE WHEN p.film_id % 4 <> 0 AND p.cut = (SELECT max(n) FROM clean c WHERE c.run = p.run) THEN (p.film_id % 11 + 1) / 8.0::DOUBLE END"
_NONE = "CAST(NULL AS DOUBLE)"
_TREND = " SELECT film_id, run, CAST(cut AS BIGINT) AS cut, week, total AS predicted FROM fc"

ORACLES = {
    "latest_totals": with_views(
        "vw",
        body=f""" SELECT film_id, total_admissions AS admissions, total_gross AS gross, weekend_from AS as_of, title FROM vw
        WHERE weekend_from >= CAST(TIMESTAMP '{V.NOW}' - INTERVAL 200 DAY AS DATE)
        QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY total_admissions DESC, weekend_from, title) = 1""",
    ),
    "run_series": with_views(
        "vw",
        body=f""", cur AS (SELECT * FROM vw WHERE weekend_from >= CAST(TIMESTAMP '{V.NOW}' - INTERVAL 120 DAY AS DATE))
        SELECT film_id, week_of_run, weekend_admissions, total_admissions, cinemas, country FROM cur
        QUALIFY row_number() OVER (PARTITION BY film_id, week_of_run ORDER BY weekend_from, rank) = 1""",
    ),
    "all_time_ranking": with_views(
        "vw",
        "va",
        body=""", w AS (
          SELECT lower(trim(title)) AS k, arg_min(title, weekend_from) AS title, max(total_admissions) AS adm, max(total_gross) AS gross,
                 max(weekend_from) AS last_seen, year(min(weekend_from)) AS y FROM vw GROUP BY 1),
        a AS (
          SELECT lower(trim(title)) AS k, arg_min(title, year * 1000 + rank) AS title, max(admissions) AS adm, max(gross) AS gross,
                 arg_min(coalesce(premiere, make_date(year, 12, 31)), year * 1000 + rank) AS last_seen,
                 arg_max(year(premiere), year * 1000 + rank) FILTER (premiere IS NOT NULL) AS py,
                 arg_min(coalesce(year(premiere), year), year * 1000 + rank) AS fy FROM va GROUP BY 1)
        SELECT coalesce(w.k, a.k) AS title_key, coalesce(w.title, a.title) AS title, greatest(w.adm, a.adm) AS admissions,
               greatest(w.gross, a.gross) AS gross, coalesce(w.last_seen, a.last_seen) AS last_seen,
               CAST(coalesce(a.py, w.y, a.fy) AS BIGINT) AS year
        FROM w FULL JOIN a ON w.k = a.k ORDER BY admissions DESC, title_key LIMIT 100""",
    ),
    "archive_summary": with_views(
        "vw",
        body=""" SELECT max(weekend_from) AS weekend_from, CAST(sum(weekend_admissions) FILTER (weekend_from = (SELECT max(weekend_from) FROM vw)) AS BIGINT) AS weekend_total,
          min(weekend_from) AS archive_from, count(DISTINCT weekend_from) AS weeks_stored FROM vw""",
    ),
    "newest_weekend": with_views(
        "vw",
        body=""" SELECT film_id, run, rank, weekend_admissions, total_admissions FROM vw
        WHERE weekend_from = (SELECT max(weekend_from) FROM vw)""",
    ),
    "freshness_check": with_views(
        "vw",
        body=""", d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS today FROM orders),
        e AS (SELECT today, CAST(today - CAST(CASE WHEN dayofweek(today) = 0 THEN 7 ELSE dayofweek(today) END AS INTEGER) - 3 AS DATE) AS expected FROM d)
        SELECT today, expected, (SELECT max(weekend_from) FROM vw) < expected AS awaiting FROM e""",
    ),
    "report_state": with_views(
        "vw",
        body=f""" SELECT CAST(DATE '{V.TODAY}' - CAST(dayofweek(DATE '{V.TODAY}') AS INTEGER) - 3 AS DATE) AS expected, max(weekend_from) AS have,
          max(weekend_from) < DATE '{V.TODAY}' - CAST(dayofweek(DATE '{V.TODAY}') AS INTEGER) - 3 AS awaiting FROM vw""",
    ),
    "week_key": """
        SELECT DISTINCT '/files/top20-' || year(o_orderdate) || '-' || weekofyear(o_orderdate) || 'cz.xls' AS file,
               CAST(year(o_orderdate) AS BIGINT) AS year, CAST(weekofyear(o_orderdate) AS BIGINT) AS week,
               year(o_orderdate) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS week_key
        FROM orders WHERE o_orderkey % 5 <> 0""",
    "only_new": with_views(
        "vw",
        body=""" SELECT DISTINCT CAST(isoyear(o_orderdate) AS BIGINT) AS year, CAST(weekofyear(o_orderdate) AS BIGINT) AS week FROM orders
        EXCEPT SELECT year, week FROM vw WHERE weekend_from < DATE '1999-01-01'""",
    ),
    "normalize_run": with_views("vw", body=_CLEAN + " SELECT film_id, run, week, adm AS admissions, total, cinemas FROM clean"),
    "hold_strength": with_views(
        "vw",
        recursive=True,
        body=_model(_FULL, _NONE)
        + """ SELECT c.film_id, c.run, round(own.measured, 6) AS measured, round(o.intensity, 6) AS opening
        FROM clean c JOIN opening o ON o.run = c.run LEFT JOIN own ON own.run = c.run WHERE c.n = 1""",
    ),
    "forecast_run": with_views(
        "vw",
        recursive=True,
        body=_model(_FULL, _PLAN)
        + f""" SELECT film_id, run, so_far, total, greatest(so_far, CAST(floor(total * lo + 0.5) AS BIGINT)) AS low,
          CAST(floor(total * hi + 0.5) AS BIGINT) AS high, round(least({_hold('origin', 'week')} * strength, 0.95), 6) AS hold,
          CASE WHEN strength <> 1.0 THEN round(strength, 6) END AS strength, measured IS NOT NULL AS measured, week AS weeks,
          CASE WHEN first_week <= 1 AND first_adm > 0 THEN round(total::DOUBLE / first_adm, 6) END AS multiplier, round(trend, 6) AS screen_trend
        FROM fc""",
    ),
    "forecast_opening": with_views(
        "vw",
        recursive=True,
        body=_model("SELECT run, CAST(1 AS BIGINT) AS cut FROM clean GROUP BY 1", _NONE)
        + """ SELECT film_id, run, so_far, total, greatest(so_far, CAST(floor(total * lo + 0.5) AS BIGINT)) AS low,
          CAST(floor(total * hi + 0.5) AS BIGINT) AS high, CASE WHEN strength <> 1.0 THEN round(strength, 6) END AS strength,
          measured IS NOT NULL AS measured, CASE WHEN first_week <= 1 AND first_adm > 0 THEN round(total::DOUBLE / first_adm, 6) END AS multiplier
        FROM fc""",
    ),
    "forecast_curve": with_views(
        "vw",
        recursive=True,
        body=_model(_FULL, _NONE)
        + """ SELECT c.film_id, c.run, c.week, greatest(c.total, c.adm) AS total, false AS projected FROM clean c JOIN fc ON fc.run = c.run
        UNION ALL
        SELECT film_id, fc.run, week + k, CAST(floor(so_far + ahead + 0.5) AS BIGINT), true FROM fc JOIN walk w ON w.run = fc.run WHERE k > 0""",
    ),
    "forecast_trend": with_views("vw", recursive=True, body=_model(_EVERY, _LIVE) + _TREND),
    "trend_direction": with_views(
        "vw",
        recursive=True,
        body=_model(_EVERY, _LIVE)
        + """, l AS (SELECT film_id, run, cut, total AS predicted, lag(total) OVER w AS previous, lead(total) OVER w AS later FROM fc
             WINDOW w AS (PARTITION BY run ORDER BY cut))
        SELECT film_id, run, predicted, previous,
               CASE WHEN abs((predicted - previous)::DOUBLE / previous) < 0.02 THEN 'flat' WHEN predicted > previous THEN 'up' ELSE 'down' END AS direction
        FROM l WHERE later IS NULL AND previous IS NOT NULL""",
    ),
    "forecast_log": with_views(
        "vw",
        body=""", a AS (
          SELECT film_id, weekend_from AS as_of, week_of_run AS weeks, total_admissions AS predicted, weekend_admissions AS low,
                 total_admissions * 2 AS high, weekend_from + to_days(CAST(right(run, 1) AS INTEGER)) AS at_ts FROM vw),
        u AS (SELECT * FROM a UNION ALL
              SELECT film_id, as_of, weeks, predicted + 1, low, high, at_ts + INTERVAL 12 HOUR FROM a WHERE film_id % 2 = 0),
        o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY film_id, as_of ORDER BY at_ts DESC) = 1)
        SELECT film_id, as_of, weeks, predicted, low, high, CAST(at_ts AS TIMESTAMP) AS at_ts FROM o
        QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY as_of DESC) <= 40""",
    ),
    "calibrate_hold": with_views(
        "vw",
        body=_CLEAN
        + """ SELECT b.origin, b.week, count(*) AS n, round(quantile_cont(a.adm::DOUBLE / b.adm, 0.5), 6) AS median_hold
        FROM clean a JOIN clean b ON a.run = b.run AND b.n = a.n - 1 WHERE a.week = b.week + 1 AND b.adm > 0 GROUP BY 1, 2""",
    ),
    "calibrate_decline": with_views(
        "vw",
        body=_CLEAN
        + """ SELECT b.week, count(*) AS n, round(quantile_cont(a.cinemas::DOUBLE / b.cinemas, 0.5), 6) AS median_decline
        FROM clean a JOIN clean b ON a.run = b.run AND b.n = a.n - 1 WHERE a.week = b.week + 1 AND b.adm > 0 AND b.cinemas > 0 GROUP BY 1""",
    ),
    "calibrate_spread": with_views(
        "vw",
        recursive=True,
        body=_model(_EVERY, _NONE)
        + """, act AS (SELECT run, max(greatest(total_admissions, weekend_admissions)) AS actual FROM vw GROUP BY 1),
        q AS (SELECT CAST(least(cut, 5) AS BIGINT) AS stage, actual::DOUBLE / total AS ratio FROM fc JOIN act ON act.run = fc.run)
        SELECT stage, 0.1::DOUBLE AS probability, count(*) AS n, round(quantile_cont(ratio, 0.1), 6) AS ratio FROM q GROUP BY 1
        UNION ALL SELECT stage, 0.9::DOUBLE, count(*), round(quantile_cont(ratio, 0.9), 6) FROM q GROUP BY 1""",
    ),
    "held_out_accuracy": with_views(
        "vw",
        recursive=True,
        body=_model(_EVERY, _NONE)
        + """, act AS (SELECT run, max(greatest(total_admissions, weekend_admissions)) AS actual FROM vw GROUP BY 1),
        q AS (SELECT CAST(least(cut, 5) AS BIGINT) AS stage, total, actual, actual::DOUBLE / total AS ratio, lo, hi,
                     CAST(split_part(fc.run, '/', 2) || '-01' AS DATE) < DATE '1996-01-01' AS early FROM fc JOIN act ON act.run = fc.run),
        band AS (SELECT stage, quantile_cont(ratio, 0.1) AS low, quantile_cont(ratio, 0.9) AS high FROM q WHERE early GROUP BY 1)
        SELECT stage, count(*) AS n, round(avg((abs(total - actual) <= 0.2::DOUBLE * actual)::INT), 6) AS within,
               round(avg(coalesce(ratio BETWEEN low AND high, false)::INT), 6) AS covered, round(avg((ratio BETWEEN lo AND hi)::INT), 6) AS covered_fixed,
               round(any_value(low), 6) AS low, round(any_value(high), 6) AS high
        FROM q LEFT JOIN band USING (stage) WHERE NOT early GROUP BY 1""",
    ),
}
