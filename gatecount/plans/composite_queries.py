"""The composite answers: the whole report, and one whole cycle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecount import rules
from gatecount.functions import times as T
from gatecount.operators import readings as R
from gatecount.operators import resolve as E
from gatecount.operators import settle as S
from gatecount.plans import cycle, official_queries, readings_queries, report, rollup_queries
from gatecount.plans import views as V
from gatecount.plans.views import with_views
from gatecount.session import cut_lineage
from gatecount.sources import snapshots


def _now():
    return T.instant(V.NOW)


def _today():
    return F.lit(V.TODAY).cast("date")


def _ramp(spark, sf_dir):
    """The events' ramp moved into the report's week, so that today has hours."""
    ramp = readings_queries.sales_ramp(spark, sf_dir)
    days = F.datediff(F.lit(V.TODAY).cast("date"), F.lit("2024-01-20").cast("date"))
    return ramp.withColumn("hour", F.col("hour") + F.make_dt_interval(days))


def _report(spark, sf_dir):
    settled = S.settle(V.screenings(spark, sf_dir), _now())
    return report.LiveReport(
        S.working_set(settled, _now()),
        _ramp(spark, sf_dir),
        V.weekly(spark, sf_dir),
        V.annual(spark, sf_dir),
        S.fold_coverage(settled, _now()),
        _now(),
        _today(),
    )


def live_report(spark, sf_dir):
    figures = _report(spark, sf_dir).headline_figures()
    return figures.select("section", "measure", F.round("value", 2).alias("value"))


# Of each answer: key columns, numbers, texts.
_ANSWERS = {
    "today": ("", "admissions seats_offered screenings screenings_done sellouts gross occupancy", ""),
    "week": ("", "admissions seats_offered screenings gross presale occupancy", ""),
    "films": (
        "film_id",
        "today_admissions today_seats today_screenings week_admissions week_seats week_screenings sellouts presale today_occupancy week_occupancy",
        "",
    ),
    "by_day": ("film_id day", "admissions", ""),
    "week_days": ("day", "admissions seats_offered screenings past", ""),
    "breakdowns": ("film_id breakdown value", "admissions seats_offered", ""),
    "cinemas": ("film_id", "cinemas", ""),
    "top_cinemas": ("film_id cinema", "admissions seats_offered", ""),
    "fullest": ("screening_key", "film_id admissions seats ratio", "cinema"),
    "upcoming": ("screening_key", "film_id admissions", "hall starts_at"),
    "today_list": ("screening_key", "film_id admissions seats", "hall starts_at"),
    "ramp_hours": ("hour", "sold", ""),
    "ramp_summary": ("", "sold_today sold_last_hour hours_today sold_week", ""),
    "official": ("film_id", "admissions since_admissions total", "as_of"),
    "forecast": ("film_id", "weeks total low high screen_trend", ""),
    "forecast_trend": ("film_id cut", "week predicted", ""),
    "ranking": ("title_key", "admissions gross year", "title last_seen"),
    "archive": ("", "weekend_total weeks_stored", "weekend_from archive_from"),
    "weekend": ("film_id run", "rank weekend_admissions total_admissions", ""),
    "coverage": ("", "total missed partial", ""),
}


def _digits(measure: str) -> int:
    return 2 if measure == "gross" else 6


def report_answers(spark, sf_dir):
    """All answers of the report in long form."""
    parts = {section: tuple(names.split() for names in of) for section, of in _ANSWERS.items()}
    rows = _report(spark, sf_dir).long_rows(parts)
    money = F.col("measure") == "gross"
    return rows.withColumn("value", F.when(money, F.round("value", 2)).otherwise(F.round("value", 6)))


def report_forecasts(spark, sf_dir):
    """The log rows the report adds: this week's films, planned screens included."""
    rows = _report(spark, sf_dir).forecast_snapshots()
    return rows.select("film_id", "as_of", "weeks", "predicted", "low", "high", F.round("screen_trend", 6).alias("screen_trend"))


def _policy():
    film = F.col("film_id") % 3
    return F.when(film == 0, "hold").when(film == 1, "guard").otherwise("direct")


def ingest_cycle(spark, sf_dir):
    """Two cycles with one reading per show each: what is read second is measured against what was stored first."""
    now = _now()
    # Both cycles read the shows and the weekly lines several times: stored once, they are not joined together each time.
    shows = snapshots.kept(V.screenings(spark, sf_dir), "shows")
    stored_shows = shows.where("starts_at < TIMESTAMP_NTZ '1998-06-20 00:00:00'")
    refreshed = shows.drop("captured_at", "next_look_at").withColumn("position", F.lit(0).cast("bigint"))
    refreshed = refreshed.withColumns(
        {c: F.lit(None).cast("bigint") for c in ("sold", "total")} | {"sold_out": ~F.col("sold_out")}
    )
    near = shows.where("starts_at BETWEEN TIMESTAMP_NTZ '1998-06-07 12:00:00' AND TIMESTAMP_NTZ '1998-06-27 12:00:00'")

    def readings(at, sold):
        return near.select(
            "screening_key", "film_id", F.lit(0).cast("bigint").alias("seq"), at.alias("at_ts"), sold.alias("sold"), "total"
        )

    first = readings(F.col("starts_at") - T.hours(6), F.col("total") - F.col("hall_key") % 2)
    second = readings(F.col("starts_at") - T.minutes(10), F.col("total") - F.col("film_id") % 3)
    weekly = cut_lineage(V.weekly(spark, sf_dir))
    films = E.with_identity(
        weekly.where("country = 'CZE'").select((F.col("film_id") + 1000).alias("film_id"), "title").distinct(), "title", None
    )
    kinds = {
        "ramp": "hour timestamp_ntz, film_id bigint, sold bigint",
        "daily": "day date, film_id bigint, sold bigint, capacity bigint, screenings bigint, gross double",
        "coverage": "day date, total bigint, final bigint, partial bigint, missed bigint",
        "forecasts": "film_id bigint, as_of date, weeks bigint, predicted bigint, low bigint, high bigint, screen_trend double, at_ts timestamp_ntz",
    }
    tables = {name: spark.createDataFrame([], kind) for name, kind in kinds.items()} | {
        "films": films, "screenings": stored_shows, "weekly": weekly, "annual": V.annual(spark, sf_dir)
    }
    one = cycle.ingest_cycle(tables, {"screenings": refreshed, "readings": first}, now, _today(), policy=_policy())
    # Between cycles the tables are stored; folded shows are no longer listed.
    stored = {k: cut_lineage(one[k]) for k in ("ramp", "daily", "coverage", "forecasts")}
    stored["screenings"] = snapshots.kept(one["screenings"], "shows")
    # The first cycle's counts are stored as well, so that its rows need not be held while the second runs.
    first_settled = cut_lineage(one["settled"])
    for rows in one["shared"][1:]:
        rows.unpersist()
    listed = refreshed.where(F.col("starts_at") >= now - T.days(10))
    two = cycle.ingest_cycle(
        tables | stored | {"weekly": one["weekly"]}, {"screenings": listed, "readings": second}, now, _today(), policy=_policy()
    )
    count = lambda name, df, value=F.count(F.lit(1)): df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("measure"), "value")
    parts = [
        count("relinked", one["relinked"]),
        count("relinked again", two["relinked"]),
        first_settled.select(F.concat(F.lit("settled "), "confidence").alias("measure"), F.col("screenings").alias("value")),
        count("settled again", two["settled"], F.coalesce(F.sum("screenings"), F.lit(0))),
        count("working set", two["screenings"]),
        count("working set sold", two["screenings"], F.sum("sold")),
        count("waiting to be confirmed", two["screenings"].where("full_seen_at IS NOT NULL")),
        count("sale closed", two["screenings"].where("sale_closed")),
        count("folded", two["daily"], F.sum("screenings")),
        count("folded sold", two["daily"], F.sum("sold")),
        count("covered", two["coverage"], F.sum("total")),
        count("ramp sold", two["ramp"], F.coalesce(F.sum("sold"), F.lit(0))),
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {f.__name__: f for f in (live_report, report_answers, report_forecasts, ingest_cycle)}

_SHIFT = "to_days(CAST(DATE '1998-06-17' - DATE '2024-01-20' AS INTEGER))"
_RAMP_DAY = "CAST(hour + " + _SHIFT + " AS DATE)"

ORACLES = {
    "live_report": with_views(
        "vs",
        "ramp",
        body=f""", d AS (
          SELECT sum(sold) AS a, sum(total) AS s, count(*) AS n, count(*) FILTER (started) AS dn, count(*) FILTER (sold_out) AS so, sum(gross) AS g FROM vsb WHERE is_today),
        w AS (SELECT sum(sold) AS a, sum(total) AS s, count(*) AS n, sum(gross) AS g, sum(sold) FILTER (NOT started) AS p FROM vsb),
        t AS (SELECT hour, sum(sold) AS sold FROM ramp GROUP BY 1),
        b AS (SELECT *, row_number() OVER (ORDER BY hour DESC) AS back FROM t WHERE {_RAMP_DAY} = DATE '1998-06-17'),
        c AS (SELECT confidence FROM vset WHERE confidence IS NOT NULL AND starts_at >= TIMESTAMP '{V.NOW}' - INTERVAL 7 DAY),
        u AS (
          SELECT 'today' AS section, unnest(['admissions', 'seats_offered', 'screenings', 'screenings_done', 'sellouts', 'gross', 'occupancy']) AS measure,
                 unnest([a::DOUBLE, s, n, dn, so, g, a::DOUBLE / s]) AS value FROM d
          UNION ALL SELECT 'week', unnest(['admissions', 'seats_offered', 'screenings', 'gross', 'presale', 'occupancy']), unnest([a::DOUBLE, s, n, g, p, a::DOUBLE / s]) FROM w
          UNION ALL SELECT 'ramp_summary', unnest(['sold_today', 'sold_last_hour', 'hours_today', 'sold_week']),
            unnest([(SELECT sum(sold) FROM b)::DOUBLE, (SELECT sold FROM b WHERE back = 2), (SELECT count(*) FROM b), (SELECT sum(sold) FROM t WHERE {_RAMP_DAY} >= DATE '1998-06-15')])
          UNION ALL SELECT 'coverage', unnest(['total', 'missed', 'partial']), unnest([count(*)::DOUBLE, count(*) FILTER (confidence = 'missed'), count(*) FILTER (confidence = 'partial')]) FROM c)
        SELECT section, measure, round(value, 2) AS value FROM u""",
    ),
    "report_forecasts": (
        with_views("vs", "vw", recursive=True, body="").replace("vw AS (", "vwa AS (", 1)
        + f""", cur AS (SELECT * FROM vwa WHERE weekend_from >= CAST(TIMESTAMP '{V.NOW}' - INTERVAL 200 DAY AS DATE)),
        pr AS (SELECT film_id AS pf, count(*) FILTER (starts_at < TIMESTAMP '{V.NOW}') AS past, count(*) FILTER (starts_at >= TIMESTAMP '{V.NOW}') AS next FROM vs
               WHERE starts_at >= TIMESTAMP '{V.NOW}' - INTERVAL 7 DAY AND starts_at < TIMESTAMP '{V.NOW}' + INTERVAL 7 DAY GROUP BY 1),
        vw AS (
          SELECT film_id, film_id AS run, origin, week_of_run, weekend_admissions, total_admissions, cinemas FROM cur
          WHERE film_id IN (SELECT film_id FROM vsb)
          QUALIFY row_number() OVER (PARTITION BY film_id, week_of_run ORDER BY weekend_from, rank) = 1)"""
        + official_queries._model(
            official_queries._FULL,
            "(SELECT CASE WHEN past >= 8 THEN next::DOUBLE / past END FROM pr WHERE pf = p.film_id)",
        )
        + """, la AS (SELECT film_id AS f, weekend_from AS as_of FROM cur QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY total_admissions DESC, weekend_from, title) = 1)
        SELECT film_id, as_of, week AS weeks, total AS predicted, greatest(so_far, CAST(floor(total * lo + 0.5) AS BIGINT)) AS low,
               CAST(floor(total * hi + 0.5) AS BIGINT) AS high, round(trend, 6) AS screen_trend
        FROM fc JOIN la ON la.f = fc.film_id"""
    ),
    "ingest_cycle": with_views(
        "vs",
        "vw",
        body=f""", near AS (SELECT * FROM vs WHERE starts_at BETWEEN TIMESTAMP '1998-06-07 12:00:00' AND TIMESTAMP '1998-06-27 12:00:00'),
        rd AS (
          SELECT screening_key, film_id, 0 AS seq, captured_at AS at_ts, sold, total FROM near WHERE starts_at < TIMESTAMP '1998-06-20'
          UNION ALL SELECT screening_key, film_id, 1, starts_at - INTERVAL 6 HOUR, total - hall_key % 2, total FROM near
          UNION ALL SELECT screening_key, film_id, 2, starts_at - INTERVAL 10 MINUTE, total - film_id % 3, total FROM near),
        lk AS (SELECT *, lag(sold) OVER k AS before, coalesce(lag(sold >= total) OVER k, false) AS was_full FROM rd WINDOW k AS (PARTITION BY screening_key ORDER BY seq)),
        sp AS (SELECT *, seq > 0 AND sold >= total AND coalesce(before, 0) < total * {rules.SELLOUT_APPROACH} AS stop FROM lk),
        ct AS (SELECT *, count(*) FILTER (stop) OVER (PARTITION BY screening_key ORDER BY seq) AS stops FROM sp),
        ju AS (SELECT *, CASE WHEN seq = 0 THEN 'recorded'
                 WHEN film_id % 3 = 0 THEN CASE WHEN sold >= total AND NOT was_full THEN 'held' ELSE 'recorded' END
                 WHEN film_id % 3 = 1 THEN CASE WHEN stops = 0 THEN 'recorded' WHEN stops = 1 AND stop THEN 'rejected' ELSE 'closed' END
                 ELSE 'recorded' END AS outcome FROM ct),
        rc AS (SELECT *, sold - lag(sold) OVER (PARTITION BY screening_key ORDER BY seq) AS delta FROM ju WHERE outcome = 'recorded'),
        lr AS (SELECT screening_key, arg_max(sold, seq) AS sold FROM rc GROUP BY 1),
        l1 AS (SELECT screening_key, arg_max(at_ts, seq) AS captured_at FROM rc WHERE seq < 2 GROUP BY 1),
        la AS (SELECT screening_key, arg_max(outcome, seq) AS outcome FROM ju GROUP BY 1),
        m AS (
          SELECT v.screening_key, v.starts_at, coalesce(l.sold, CASE WHEN v.starts_at < TIMESTAMP '1998-06-20' THEN v.sold END) AS sold,
                 coalesce(l1.captured_at, CASE WHEN v.starts_at < TIMESTAMP '1998-06-20' THEN v.captured_at END) AS captured_at, outcome
          FROM vs v LEFT JOIN lr l USING (screening_key) LEFT JOIN l1 USING (screening_key) LEFT JOIN la USING (screening_key)),
        st AS (SELECT *, CASE WHEN starts_at < TIMESTAMP '{V.NOW}' - INTERVAL 30 MINUTE THEN
                 CASE WHEN captured_at IS NULL THEN 'missed' WHEN starts_at - captured_at <= INTERVAL 15 MINUTE THEN 'final' ELSE 'partial' END END AS c FROM m),
        fo AS (SELECT *, starts_at < TIMESTAMP '{V.NOW}' - INTERVAL 10 DAY AS folded FROM st)
        SELECT 'relinked' AS measure, count(*) FILTER (country = 'CZE') AS value FROM vw
        UNION ALL SELECT 'relinked again', 0
        UNION ALL SELECT 'settled ' || c, count(*) FROM fo WHERE c IS NOT NULL GROUP BY c
        UNION ALL SELECT 'settled again', 0
        UNION ALL SELECT 'working set', count(*) FILTER (NOT folded) FROM fo
        UNION ALL SELECT 'working set sold', CAST(sum(sold) FILTER (NOT folded) AS BIGINT) FROM fo
        UNION ALL SELECT 'waiting to be confirmed', count(*) FILTER (outcome = 'held') FROM fo
        UNION ALL SELECT 'sale closed', count(*) FILTER (outcome IN ('rejected', 'closed')) FROM fo
        UNION ALL SELECT 'folded', count(*) FILTER (folded) FROM fo
        UNION ALL SELECT 'folded sold', CAST(sum(coalesce(sold, 0)) FILTER (folded) AS BIGINT) FROM fo
        UNION ALL SELECT 'covered', count(*) FILTER (folded) FROM fo
        UNION ALL SELECT 'ramp sold', CAST(coalesce(sum(delta) FILTER (delta > 0 AND date_trunc('hour', at_ts) >= TIMESTAMP '{V.NOW}' - INTERVAL 21 DAY), 0) AS BIGINT) FROM rc""",
    ),
}

_PLANNED = "(SELECT CASE WHEN past >= 8 THEN next::DOUBLE / past END FROM pr WHERE pf = p.film_id)"
_AT_LAST = f"CASE WHEN p.cut = (SELECT max(n) FROM clean c WHERE c.run = p.run) THEN {_PLANNED} END"
_ROLLUPS = {"today": "day_totals", "week": "week_totals", "films": "film_period", "by_day": "film_by_day", "week_days": "week_spine"} | {
    "breakdowns": "breakdown_sets", "cinemas": "cinemas_per_film", "top_cinemas": "top_cinemas", "fullest": "fullest",
    "upcoming": "upcoming", "today_list": "todays_list",
}
_OFFICIAL = {"ranking": "all_time_ranking", "archive": "archive_summary", "weekend": "newest_weekend"}
_SQL = (
    {section: rollup_queries.ORACLES[name] for section, name in _ROLLUPS.items()}
    | {section: official_queries.ORACLES[name] for section, name in _OFFICIAL.items()}
    | {
        "ramp_hours": with_views("ramp", body=f" SELECT hour + {_SHIFT} AS hour, sum(sold) AS sold FROM ramp GROUP BY 1 HAVING sum(sold) > 0"),
        "ramp_summary": with_views(
            "ramp",
            body=f""", t AS (SELECT hour, sum(sold) AS sold FROM ramp GROUP BY 1),
            b AS (SELECT *, row_number() OVER (ORDER BY hour DESC) AS back FROM t WHERE {_RAMP_DAY} = DATE '1998-06-17')
            SELECT (SELECT sum(sold) FROM b) AS sold_today, (SELECT sold FROM b WHERE back = 2) AS sold_last_hour, (SELECT count(*) FROM b) AS hours_today,
                   (SELECT sum(sold) FROM t WHERE {_RAMP_DAY} >= DATE '1998-06-15') AS sold_week""",
        ),
        "official": with_views("vs", "vw", body="")
        + f""", o AS (
          SELECT film_id, total_admissions AS admissions, weekend_from AS as_of FROM vw
          WHERE weekend_from >= CAST(TIMESTAMP '{V.NOW}' - INTERVAL {rules.CURRENT_RUN_DAYS} DAY AS DATE)
          QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY total_admissions DESC, weekend_from, title) = 1)
        SELECT o.film_id, admissions, as_of, coalesce(sum(sold) FILTER (day >= as_of + {rules.HANDOVER_DAYS}), 0) AS since_admissions,
               admissions + coalesce(sum(sold) FILTER (day >= as_of + {rules.HANDOVER_DAYS}), 0) AS total
        FROM o LEFT JOIN vsb ON vsb.film_id = o.film_id GROUP BY 1, 2, 3""",
        "forecast": f"SELECT * RENAME (predicted AS total) FROM ({ORACLES['report_forecasts']})",
        "forecast_trend": ORACLES["report_forecasts"].split(official_queries._model(official_queries._FULL, _PLANNED))[0]
        + official_queries._model(official_queries._EVERY, _AT_LAST)
        + official_queries._TREND,
        "coverage": with_views(
            "vs",
            body=f""" SELECT count(*) AS total, count(*) FILTER (confidence = 'missed') AS missed, count(*) FILTER (confidence = 'partial') AS partial
            FROM vset WHERE confidence IS NOT NULL AND starts_at >= TIMESTAMP '{V.NOW}' - INTERVAL 7 DAY""",
        ),
    }
)


def _long(section: str) -> str:
    keys, numbers, texts = (names.split() for names in _ANSWERS[section])
    of = lambda items: "[" + ", ".join(items) + "]"
    key = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in keys) + ")" if keys else "''"
    value = of([f"round(CAST({c} AS DOUBLE), {_digits(c)})" for c in numbers] + ["CAST(NULL AS DOUBLE)" for _ in texts])
    text = of(["CAST(NULL AS VARCHAR)" for _ in numbers] + [f"CAST({c} AS VARCHAR)" for c in texts])
    measure = of([f"'{c}'" for c in (*numbers, *texts)])
    return f"SELECT '{section}' AS section, {key} AS key, unnest({measure}) AS measure, unnest({value}) AS value, unnest({text}) AS text FROM ({_SQL[section]})"


ORACLES["report_answers"] = "\nUNION ALL\n".join(_long(section) for section in _ANSWERS)
