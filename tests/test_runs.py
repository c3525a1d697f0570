"""Official tables, settlement, and the run model."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from gatecount import rules
from gatecount.functions import times as T
from gatecount.operators import forecast as M
from gatecount.operators import official as O
from gatecount.operators import rollup as U
from gatecount.operators import settle as S
from gatecount.operators.quantiles import grouped_quantiles
from gatecount.plans import cycle
from gatecount.sources import snapshots

D = dt.date
WEEKLY = (
    "year bigint, week bigint, weekend_from date, rank bigint, title string, country string, week_of_run bigint, "
    "cinemas bigint, weekend_admissions bigint, weekend_gross double, total_admissions bigint, total_gross double, film_id bigint"
)
def now():
    return T.instant("2026-08-01 10:00:00")


def week(day, title, total, film=1, weekend=100, run_week=1, rank=1, country=None, cinemas=10, gross=None):
    iso = day.isocalendar()
    return (iso[0], iso[1], day, rank, title, country, run_week, cinemas, weekend, float(weekend), total, float(gross or total), film)


def weekly(spark, *rows):
    return spark.createDataFrame(list(rows), WEEKLY)


def test_latest_total_is_the_highest_of_the_current_run(spark):
    df = weekly(
        spark,
        week(D(2026, 7, 9), "A", 100),
        week(D(2026, 7, 23), "A", 256291),
        week(D(2023, 7, 20), "A", 999999),
        week(D(2026, 7, 23), "B", 5, film=None),
    )
    out = O.latest_totals(df, now()).collect()
    assert [(r["film_id"], r["admissions"], r["as_of"]) for r in out] == [(1, 256291, D(2026, 7, 23))]


ANNUAL = "year bigint, rank bigint, title string, premiere date, admissions bigint, gross double"


def test_ranking_reconciles_both_sources(spark):
    df = weekly(
        spark,
        week(D(2024, 8, 15), "Vlny", 305232, gross=9),
        week(D(2020, 1, 2), "Ženy v běhu", 1500000),
        week(D(2020, 1, 9), "ŽENY V BĚHU ", 1500000),
    )
    annual = spark.createDataFrame(
        [
            (2024, 1, "vlny", None, 309277, 8.0),
            (2019, 1, "Ženy v běhu", D(2018, 1, 31), 1831714, 7.0),
            (2017, 3, "Jen v ročence", None, 42, 1.0),
        ],
        ANNUAL,
    )
    out = [tuple(r) for r in O.all_time_ranking(df, annual).drop("title_key").collect()]
    assert out == [
        ("Ženy v běhu", 1831714, 1500000.0, D(2020, 1, 9), 2018),
        ("Vlny", 309277, 9.0, D(2024, 8, 15), 2024),
        ("Jen v ročence", 42, 1.0, D(2017, 12, 31), 2017),
    ]
    assert O.all_time_ranking(df, annual, 1).count() == 1


def test_run_series_takes_the_first_line_of_a_week(spark):
    df = weekly(
        spark,
        week(D(2026, 7, 9), "A", 10, weekend=10, run_week=1, rank=2),
        week(D(2026, 7, 9), "A", 11, weekend=11, run_week=1, rank=1),
        week(D(2026, 7, 16), "A", 20, weekend=9, run_week=2, country="CZE"),
    )
    out = {r["week_of_run"]: (r["weekend_admissions"], r["country"]) for r in O.run_series(df, now()).collect()}
    assert out == {1: (11, "CZE"), 2: (9, "CZE")}


def test_week_keys_and_file_names(one):
    assert one(O.week_key(F.col("y"), F.col("w")), y=2026, w=9) == "2026-W09"
    assert tuple(one(O.parse_week_file(F.col("f")), f="https://x/top20-2026-30cz.xls")) == (2026, 30)
    assert tuple(one(O.parse_week_file(F.col("f")), f="https://x/top20-2026-30sk.xls")) == (None, None)
    assert one(O.parse_annual_file(F.col("f")), f="https://x/TOP502024.xlsx") == 2024


def runs(spark, *series, origin="cz"):
    """series: lists of (week, admissions, cinemas); totals run up by 1.5 weekends."""
    rows = []
    for film, points in enumerate(series):
        total = 0
        for point in points:
            w, a, *rest = point
            total += int(a * 1.5)
            rows.append((film, origin, w, a, total, rest[0] if rest else None))
    schema = "film_id bigint, origin string, week_of_run bigint, weekend_admissions bigint, total_admissions bigint, cinemas bigint"
    return M.collect_runs(spark.createDataFrame(rows, schema), keep=("origin",))


def test_normalize_run(spark):
    df = runs(
        spark,
        [(0, 21323), (1, 23523)],
        [(-1, 32299), (1, 56944)],
        [(0, 4716), (1, 74812)],
        [(0, 4716)],
    )
    out = {
        r["film_id"]: [(p["week"], p["admissions"]) for p in r["p"]]
        for r in df.select("film_id", M.normalize_run(F.col("points")).alias("p")).collect()
    }
    assert out == {
        0: [(1, 21323), (2, 23523)],
        1: [(1, 56944)],
        2: [(1, 74812)],
        3: [(1, 4716)],
    }


def model(origin, points, planned=None):
    """The run model as a plain loop over one clean run: (week, admissions, total, cinemas)."""
    hold = lambda w: (rules.HOLD_BY_WEEK[origin][w - 1] if 1 <= w <= 5 else rules.TAIL_HOLD)
    last = points[-1]
    logs = weights = 0.0
    for i in range(1, len(points)):
        (w0, a0, *_), (w1, a1, *_) = points[i - 1], points[i]
        if w1 == w0 + 1 and a0 > 0 and a1 / a0 > 0.05:
            weight = 0.6 ** (len(points) - 1 - i)
            logs += math.log(min(a1 / a0, 0.95) / hold(w0)) * weight
            weights += weight
    strength = math.exp(logs / weights) if weights else 1.0
    if not weights and points[0][3]:
        strength = max(0.6, min(1.3, math.sqrt(points[0][1] / points[0][3] / 160)))
    trend = None
    if planned is not None:
        typical = rules.SCREEN_DECLINE[min(last[0], 6) - 1]
        trend = max(0.5, min(1.6, planned / typical))
    weekend, ahead = last[1], 0.0
    for k in range(10):
        rate = hold(last[0] + k) * strength**0.4 * (trend**0.75 if k == 0 and trend is not None else 1)
        weekend *= min(rate, 0.95)
        if weekend < 300:
            break
        ahead += weekend * rules.WEEKDAY_UPLIFT[origin]
    return math.floor(max(last[2], last[1]) + ahead + 0.5), strength, trend


def test_forecast_equals_the_loop(spark):
    rng = random.Random(11)
    series, expected = [], {}
    for film in range(60):
        points, total, a = [], 0, rng.randrange(2000, 200000)
        for w in range(1, rng.randrange(2, 12)):
            total += int(a * 1.5)
            points.append((w, a, rng.choice([None, rng.randrange(20, 300)])))
            a = int(a * rng.uniform(0.02, 1.2))
        series.append(points)
        clean, total = [], 0
        for w, x, c in points:
            total += int(x * 1.5)
            clean.append((w, x, total, c))
        if clean[-1][1] > 0:
            expected[film] = model("foreign", clean, 0.05 * film if film % 3 else None)
    df = runs(spark, *series, origin="foreign").withColumn(
        "planned", F.when(F.col("film_id") % 3 != 0, F.col("film_id") * 0.05)
    )
    out = {r["film_id"]: r for r in M.forecast(df, planned_ratio="planned").collect()}
    assert out.keys() == expected.keys()
    for film, (total, strength, trend) in expected.items():
        r = out[film]
        assert r["total"] == total and r["so_far"] <= r["low"] <= r["total"] <= r["high"]
        assert math.isclose(r["strength"] if r["strength"] is not None else 1.0, strength, rel_tol=1e-9)
        assert (r["screen_trend"] is None) == (trend is None)
        curve = r["curve"]
        assert [c["projected"] for c in curve] == sorted(c["projected"] for c in curve)
        assert curve[-1]["total"] == total or not curve[-1]["projected"]


def test_forecast_needs_an_opening(spark):
    assert M.forecast(runs(spark, [(1, 0)], [(-1, 500)])).count() == 0


def test_normal_decline_leaves_the_total_alone(spark):
    df = runs(spark, [(1, 50000, 100), (2, 26000, 80)])
    plain = M.forecast(df).first()
    typical = M.forecast(df.withColumn("r", F.lit(0.711)), planned_ratio="r").first()
    assert plain["total"] == typical["total"] and typical["screen_trend"] == 1.0
    floor = M.forecast(df.withColumn("r", F.lit(0.001)), planned_ratio="r").first()
    assert floor["screen_trend"] == 0.5 and floor["total"] < plain["total"]


def test_late_pickup_has_no_multiplier(spark):
    out = M.forecast(runs(spark, [(9, 3000), (10, 2000)])).first()
    assert out["multiplier"] is None and out["weeks"] == 10


def test_trend_ends_at_the_live_value(spark):
    df = runs(spark, [(1, 50000, 100), (2, 20000, 80), (3, 15000, 70)]).withColumn("r", F.lit(1.5))
    trend = {r["cut"]: r["predicted"] for r in M.forecast_trend(df, planned_ratio="r").collect()}
    assert trend[3] == M.forecast(df, planned_ratio="r").first()["total"]
    assert trend[1] == model("cz", [(1, 50000, 75000, 100)])[0]
    direction = M.trend_direction(M.forecast_trend(df, planned_ratio="r")).first()
    assert (direction["predicted"], direction["previous"]) == (trend[3], trend[2])


LOG = "film_id bigint, as_of date, weeks bigint, predicted bigint, low bigint, high bigint, screen_trend double, at_ts timestamp_ntz"


def test_forecast_log_overwrites_a_vintage_and_keeps_the_newest(spark):
    at = dt.datetime(2026, 8, 1)
    old = [(1, D(2026, 1, 1) + dt.timedelta(weeks=i), i, i, 0, 0, None, at) for i in range(45)]
    new = [(1, old[-1][1], 44, 4444, 0, 0, 1.0, at + dt.timedelta(hours=1))]
    out = M.forecast_log(spark.createDataFrame(old, LOG), spark.createDataFrame(new, LOG)).collect()
    assert len(out) == 40 and min(r["as_of"] for r in out) == old[5][1]
    assert [r["predicted"] for r in out if r["as_of"] == old[-1][1]] == [4444]


def test_quantiles_equal_the_builtin(spark):
    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 2)) for _ in range(700)] + [("b", 0.5)] * 300 + [("c", 1.25), ("c", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    mine = grouped_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).collect()
    for r in mine:
        exact = df.where(F.col("g") == r["g"]).agg(F.percentile("v", F.lit(r["probability"]))).first()[0]
        assert math.isclose(r["quantile"], exact, abs_tol=1e-12)
    assert len(mine) == 9


SHOWS = (
    "screening_key string, film_id bigint, kind string, chain string, formats array<string>, cinema string, starts_at timestamp_ntz, "
    "day date, sold bigint, total bigint, sold_out boolean, captured_at timestamp_ntz, price_min double"
)


def show(key, film, hour, sold, total=200, day=1, kind=None, cinema="C", price=None, captured=None):
    start = dt.datetime(2026, 8, day, hour)
    return (key, film, kind, "x", [], cinema, start, start.date(), sold, total, False, captured, price)


def test_events_stay_out_of_the_totals(spark):
    shows = spark.createDataFrame([show("a", 1, 9, 100), show("b", 2, 9, 66, kind="event")], SHOWS)
    rows = U.base(shows, now(), F.lit("2026-08-01").cast("date"))
    total = U.day_totals(rows).first()
    assert (total["admissions"], total["seats_offered"], total["occupancy"], total["gross"]) == (100, 200, 0.5, 20500.0)


def test_settled_value_replaces_the_live_one(spark):
    shows = spark.createDataFrame([show("a", 1, 8, 100, captured=dt.datetime(2026, 8, 1, 7, 50)), show("b", 1, 20, 7)], SHOWS)
    settled = S.settle(shows, now())
    out = {r["screening_key"]: r["settled"] for r in settled.collect()}
    assert out["b"] is None and tuple(out["a"])[:3] == (100, 200, "final")
    again = S.settle(settled.drop("newly_settled").withColumn("sold", F.lit(1).cast("bigint")), now())
    assert again.where("newly_settled").count() == 0
    rows = U.base(again, now(), F.lit("2026-08-01").cast("date"))
    assert U.day_totals(rows).first()["admissions"] == 101


def test_fold_moves_every_old_row_once(spark):
    shows = spark.createDataFrame([show("a", 1, 8, 100), show("b", 1, 9, 50, price=10.0), show("c", 2, 8, 5, day=14)], SHOWS)
    later = T.instant("2026-08-14 12:00:00")
    settled = S.settle(shows, later)
    stored = spark.createDataFrame([(D(2026, 8, 1), 1, 1, 1, 1, 1.0)], "day date, film_id bigint, sold bigint, capacity bigint, screenings bigint, gross double")
    daily = S.fold_daily(settled, later, stored).collect()
    assert [(r["sold"], r["screenings"], r["gross"]) for r in daily] == [(151, 3, 100 * 205 + 500 + 1)]
    assert [r["screening_key"] for r in S.working_set(settled, later).collect()] == ["c"]
    coverage = S.fold_coverage(settled, later)
    total = S.recent_coverage(S.working_set(settled, later), coverage, later, 20).first()
    assert tuple(total) == (3, 3, 0)


def test_of_folded_rows_only_what_they_count_by_is_kept(spark):
    shows = spark.createDataFrame([show("a", 1, 8, 100), show("b", 1, 9, 50, price=10.0), show("c", 2, 8, 5, day=14)], SHOWS)
    later = T.instant("2026-08-14 12:00:00")
    settled = S.settle(shows, later)
    kept = cycle.lean(settled, later)
    assert sorted((r["screening_key"] or "", r["cinema"] or "") for r in kept.collect()) == [("", ""), ("", ""), ("c", "C")]
    for fold in (S.fold_daily, S.fold_coverage, S.working_set):
        assert sorted(fold(kept, later).collect()) == sorted(fold(settled, later).collect())
    assert S.settle_counts(kept).collect() == S.settle_counts(settled).collect()


def test_kept_tables_are_compressed(spark, tmp_path):
    shows = spark.createDataFrame([show("a", 1, 8, 100), show("b", 1, 9, 50, price=10.0), (None,) * 13], SHOWS)
    kept = snapshots.kept(shows, "shows")
    assert kept.schema == shows.schema and sorted(map(str, kept.collect())) == sorted(map(str, shows.collect()))
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles())
    assert snapshots.kept(shows.where("false"), "shows").count() == 0


@pytest.mark.parametrize("past, expected", [(7, None), (8, 0.25)])
def test_planned_ratio_needs_enough_past(spark, past, expected):
    rows = [show(f"p{i}", 1, 8, 1) for i in range(past)] + [show(f"n{i}", 1, 20, 1) for i in range(2)]
    out = U.planned_ratio(spark.createDataFrame(rows, SHOWS), now()).first()
    assert (out["past"], out["next"], out["planned_ratio"]) == (past, 2, expected)


def test_held_out_accuracy_fits_before_and_scores_after(spark):
    import datetime as dt

    from gatecount.operators import forecast as M

    schema = "film_id bigint, week_of_run bigint, weekend_admissions bigint, total_admissions bigint, cinemas bigint, origin string, started date"
    early, late = dt.date(2020, 1, 2), dt.date(2023, 1, 5)
    weekends = [(1, 10_000), (2, 5_000), (3, 3_000)]
    rows = [(i, w, a, a, 100, "foreign", early if i < 2 else late) for i in range(4) for w, a in weekends]
    frame = spark.createDataFrame(rows, schema)
    runs = M.collect_runs(frame, ("film_id",), keep=("origin", "started"))
    said = {(r.film_id, r.cut): r.predicted for r in M.forecast_trend(runs).collect()}
    actual = {i: 10_000 for i in range(4)}
    out = {r.stage: r for r in M.held_out_accuracy(runs, F.lit("2023-01-01").cast("date")).collect()}
    assert sorted(out) == [1, 2, 3]
    for stage, r in out.items():
        ratios = [actual[i] / said[i, stage] for i in (0, 1)]
        assert r.n == 2 and abs(r.low - min(ratios)) < 1e-9 and abs(r.high - max(ratios)) < 1e-9
        assert r.covered == 1.0 and r.within == (abs(said[2, stage] - 10_000) <= 2_000)
    # Without early runs there is no band, and nothing is covered by it.
    none = M.held_out_accuracy(runs, F.lit("2010-01-01").cast("date")).collect()
    assert all(r.n == 4 and r.low is None and r.high is None and r.covered == 0.0 for r in none)
