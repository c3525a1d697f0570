"""Increments, hold, guard, repair, alerts, and the segmented windows under them."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gatecount.functions import times as T
from gatecount.operators import ordered as O
from gatecount.operators import readings as R

SCHEMA = "screening_key bigint, film_id bigint, seq bigint, at_ts timestamp_ntz, sold bigint, total bigint"


def at(text):
    return dt.datetime.fromisoformat(f"2026-08-01 {text}")


def readings(spark, rows, key=1, film=7, total=138):
    return spark.createDataFrame([(key, film, i, at(t), s, total) for i, (t, s) in enumerate(rows)], SCHEMA)


def test_rises_go_to_the_hour_of_their_reading(spark):
    df = readings(spark, [("10:00", 100), ("10:30", 105), ("10:50", 108), ("11:10", 115)])
    assert {(r["hour"].hour, r["sold"]) for r in R.sales_ramp(df).collect()} == {(10, 8), (11, 7)}


def test_falls_and_first_readings_count_nothing(spark):
    assert R.sales_ramp(readings(spark, [("10:00", 100), ("10:30", 96)])).count() == 0
    assert R.sales_ramp(readings(spark, [("10:00", 100)])).count() == 0
    again = R.sales_ramp(readings(spark, [("10:00", 100), ("10:10", 96), ("10:20", 99)])).collect()
    assert [r["sold"] for r in again] == [3]


def test_out_of_order_reading_is_compared_in_arrival_order(spark):
    df = readings(spark, [("11:00", 10), ("12:00", 15), ("11:30", 18)])
    assert {(r["hour"].hour, r["sold"]) for r in R.sales_ramp(df).collect()} == {(12, 5), (11, 3)}


def outcomes(df):
    return [r["outcome"] for r in df.orderBy("seq").collect()]


def test_hold_and_confirm(spark):
    df = readings(spark, [("10:00", 3), ("10:05", 138), ("10:10", 138), ("10:15", 5), ("10:20", 138), ("10:25", 0)])
    assert outcomes(R.hold_confirm(df)) == ["recorded", "held", "recorded", "recorded", "held", "recorded"]


def test_closed_guard(spark):
    df = readings(spark, [("10:00", 10), ("10:05", 120), ("10:10", 138), ("10:15", 20), ("10:20", 138), ("10:25", 30)])
    assert outcomes(R.closed_guard(df)) == ["recorded", "recorded", "recorded", "recorded", "rejected", "closed"]
    assert outcomes(R.closed_guard(readings(spark, [("10:00", 138)]))) == ["rejected"]


def test_repair(spark):
    rows = [
        ("a", "08:00", 122, 122, "11:12"),
        ("b", "08:00", 122, 122, "07:55"),
        ("c", "08:00", 122, 122, "05:00"),
        ("d", "18:00", 122, 122, "11:12"),
        ("e", "08:00", 6, 90, "11:12"),
    ]
    df = spark.createDataFrame(
        [(k, at(s), sold, total, at(c)) for k, s, sold, total, c in rows],
        "screening_key string, starts_at timestamp_ntz, sold bigint, total bigint, captured_at timestamp_ntz",
    )
    out = R.repair_closed(df, T.instant("2026-08-01 11:20:00"), F.lit(True)).where("repaired").collect()
    assert {r["screening_key"] for r in out} == {"a", "b"}
    assert all(r["sold"] is None and r["total"] is None and r["captured_at"] is None for r in out)
    assert R.repair_closed(df, T.instant("2026-08-01 11:20:00"), F.lit(False)).where("repaired").count() == 0


@pytest.mark.parametrize(
    "seats, prices, expected",
    [
        (["FREE", "RESERVED", "OCCUPIED"], [249.0, 0.0, 269.0], (2, 3, 249.0, 269.0)),
        (["FREE", "BROKEN", "OCCUPIED"], [-1.0], (1, 2, None, None)),
    ],
)
def test_seat_occupancy(one, seats, prices, expected):
    assert tuple(one(R.seat_occupancy(F.col("s"), F.col("p")), s=seats, p=prices)) == expected


def test_seat_occupancy_of_nothing(one):
    none = F.lit(None)
    read = R.seat_occupancy(none.cast("array<string>"), none.cast("array<double>"))
    assert tuple(one(read)) == (0, 0, None, None)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows; the others cross segment borders now and then."""
    rng = random.Random(7)
    rows = []
    for seq in range(3000):
        key = 0 if rng.random() < 0.7 else rng.randrange(1, 40)
        rows.append((key, key % 3, seq, dt.datetime(2026, 8, 1) + dt.timedelta(minutes=seq), rng.randrange(0, 100), 99))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("segment", [1, 7, 64, 1 << 20])
def test_previous_equals_plain_lag(skewed, segment):
    plain = skewed.withColumn("p", F.lag("sold").over(Window.partitionBy("screening_key").orderBy("seq")))
    mine = O.with_previous(skewed, ["screening_key"], "seq", ["sold"], segment_rows=segment)
    both = plain.select("seq", "p").join(mine.select("seq", "prev_sold"), "seq")
    assert both.count() == 3000
    assert both.where(~F.col("p").eqNullSafe(F.col("prev_sold"))).count() == 0


@pytest.mark.parametrize("how, function", [("sum", F.sum), ("max", F.max), ("min", F.min)])
def test_running_equals_plain_window(skewed, how, function):
    window = Window.partitionBy("screening_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.withColumn("p", function("sold").over(window))
    mine = O.with_running(skewed, ["screening_key"], "seq", F.col("sold"), "r", how, segment_rows=50)
    both = plain.select("seq", "p").join(mine.select("seq", "r"), "seq")
    assert both.count() == 3000 and both.where("p <> r").count() == 0


def test_ramp_is_the_sum_of_positive_rises(skewed):
    rises = R.increments(skewed, segment_rows=64)
    ramp = R.sales_ramp(skewed, segment_rows=64)
    assert ramp.agg(F.sum("sold")).first()[0] == rises.agg(F.sum("delta")).first()[0]


def test_dense_number(spark):
    df = spark.createDataFrame([(i * 37 % 1009,) for i in range(500)], "pos bigint")
    out = O.dense_number(df, "pos", "n", F.lit(11), segment_rows=16).orderBy("pos").collect()
    assert [r["n"] for r in out] == list(range(11, 511))


def test_hot_key_does_not_meet_in_one_task(skewed):
    """The raw rows are only shuffled by (key, segment)."""
    out = O.with_previous(skewed, ["screening_key"], "seq", ["sold"], segment_rows=64)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [lag(sold" in line]
    assert windows and all("_segment" in line for line in windows)


def alert_loop(series, step=100, quiet=600):
    rings = []
    for t, v in series:
        if not rings or (v - rings[-1][1] >= step and (t - rings[-1][0]).total_seconds() >= quiet):
            rings.append((t, v))
    return rings


def test_threshold_alert_equals_the_loop(spark):
    rng = random.Random(3)
    rows, expected = [], set()
    for key in range(6):
        series, value = [], 0
        for i in range(80):
            value += rng.randrange(0, 60)
            series.append((dt.datetime(2026, 8, 1) + dt.timedelta(minutes=5 * i), value))
            rows.append((key, 1, key * 1000 + i, series[-1][0], value, 10**6))
        expected |= {(key, t, v) for t, v in alert_loop(series)}
    out = R.threshold_alert(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["screening_key"], r["ring_at"], r["ring_value"]) for r in out} == expected


def test_cycles_equal_one_run_over_all_readings(spark):
    """Readings judged cycle by cycle against the stored state come out as if judged at once."""
    from gatecount.plans.cycle import apply_readings, with_memory

    rng = random.Random(17)
    start = dt.datetime(2026, 8, 1, 20)
    shows = [(k, start, *((rng.randrange(0, 50), 50, start - dt.timedelta(days=1)) if k % 2 else (None, None, None)), None, None)
             for k in range(24)]
    schema = "screening_key bigint, starts_at timestamp_ntz, sold bigint, total bigint, captured_at timestamp_ntz, next_look_at timestamp_ntz, price_min double"
    rows = []
    for seq in range(8):
        for k in range(24):
            if rng.random() < 0.8:
                at = start - dt.timedelta(hours=20 - 2 * seq)
                sold = 50 if rng.random() < 0.4 else rng.randrange(20, 50)
                rows.append((k, k % 5, seq, at, sold, 50, float(seq) if rng.random() < 0.5 else None))
    kinds = "screening_key bigint, film_id bigint, seq bigint, at_ts timestamp_ntz, sold bigint, total bigint, price_min double"
    readings = spark.createDataFrame(rows, kinds)
    policy = F.element_at(F.array(*map(F.lit, R.POLICIES)), (F.col("screening_key") % 3 + 1).cast("int"))
    state = with_memory(spark.createDataFrame(shows, schema))
    key = lambda df: {(r["screening_key"], r["seq"]): (r["outcome"], r["delta"]) for r in df.collect()}
    whole = R.judge(readings, state, policy)
    together = apply_readings(state, whole).collect()
    found = {}
    for low, high in ((0, 1), (1, 2), (2, 5), (5, 8)):
        judged = R.judge(readings.where((F.col("seq") >= low) & (F.col("seq") < high)), state, policy)
        found |= key(judged)
        after = apply_readings(state, judged).collect()
        state = spark.createDataFrame(after, state.schema)
    assert found == key(whole)
    assert {"held", "recorded", "rejected", "closed"} == {o for o, _ in found.values()}
    assert sorted(map(str, state.collect())) == sorted(map(str, together))


def test_one_reading_per_cycle_counts_and_sets_the_next_look(spark):
    from gatecount.plans.cycle import apply_readings

    start, at = dt.datetime(2026, 8, 1, 20), dt.datetime(2026, 8, 1, 12)
    stored = spark.createDataFrame(
        [(1, start, 100, 120, at - dt.timedelta(hours=3), None, 150.0)],
        "screening_key bigint, starts_at timestamp_ntz, sold bigint, total bigint, captured_at timestamp_ntz, next_look_at timestamp_ntz, price_min double",
    )
    reading = spark.createDataFrame(
        [(1, 3, 0, at, 108, 120, 180.0)],
        "screening_key bigint, film_id bigint, seq bigint, at_ts timestamp_ntz, sold bigint, total bigint, price_min double",
    )
    judged = R.judge(reading, stored, F.lit("hold"))
    assert [(r["outcome"], r["delta"]) for r in judged.collect()] == [("recorded", 8)]
    row = apply_readings(stored, judged).first()
    assert (row["sold"], row["price_min"], row["captured_at"]) == (108, 180.0, at)
    assert at < row["next_look_at"] < start
