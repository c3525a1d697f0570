"""Streams in several micro-batches against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gatecount.operators import readings as R
from gatecount.functions import times as T
from gatecount.streaming import ramp as S
from gatecount.streaming.settle import PROVIDER, settle_fixed_stream, settle_stream

SCHEMA = "screening_key bigint, film_id bigint, seq bigint, at_ts timestamp_ntz, sold bigint, total bigint"
START = dt.datetime(2026, 8, 1)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Six files in arrival order; one key holds most rows, some readings are late."""
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("readings")
    rows = []
    for seq in range(600):
        key = 0 if rng.random() < 0.6 else rng.randrange(1, 12)
        at = START + dt.timedelta(minutes=seq - (rng.randrange(0, 300) if rng.random() < 0.1 else 0))
        sold = 50 if rng.random() < 0.25 else rng.randrange(0, 50)
        rows.append((key, key % 3, seq, at, sold, 50))
    for i in range(6):
        part = spark.createDataFrame(rows[i * 100 : (i + 1) * 100], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return str(folder / "in"), spark.createDataFrame(rows, SCHEMA), rows


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def as_set(df):
    return {tuple(r) for r in df.select("hour", "film_id", "sold").collect()}


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("confirm", [False, True])
def test_ramp_parity(spark, source, tmp_path, state_store, confirm):
    path, batch, _ = source
    S.write(S.sales_stream(stream(spark, path), confirm), str(tmp_path), "kind").awaitTermination()
    expected = R.confirmed_ramp(batch) if confirm else R.sales_ramp(batch)
    assert as_set(S.ramp(spark, str(tmp_path))) == as_set(expected)
    assert S.looks(spark, str(tmp_path)).isEmpty()


def test_shows_share_a_state(spark, tmp_path, state_store):
    """Many shows, few calls: one state row per bucket, and the same hours as the batch operator, null keys and films too."""
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(90)]), rng.choice([None, 1]), seq, START + dt.timedelta(minutes=seq), rng.randrange(0, 51), 50) for seq in range(1500)]
    for i in range(3):
        spark.createDataFrame(rows[i * 500 : (i + 1) * 500], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = S.write(S.sales_stream(stream(spark, str(tmp_path / "in")), True, buckets=3), str(tmp_path), "kind")
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3
    named = [(90 if r[0] is None else r[0], *r[1:]) for r in rows]  # the batch operator takes no null key
    assert as_set(S.ramp(spark, str(tmp_path))) == as_set(R.confirmed_ramp(spark.createDataFrame(named, SCHEMA)))


def run_batches(spark, root, batches, schema, start):
    """Each list of rows is one micro-batch; the query starts anew for each, from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        start(spark.readStream.schema(schema).parquet(f"{root}/in")).awaitTermination()


def test_no_clock_and_no_pause_loses_a_sale(spark, tmp_path, state_store):
    row = lambda key, seq, day, sold: (key, 1, seq, START + dt.timedelta(days=day), sold, 90)
    # The second key's clock is 400 days ahead; the first one is read again after a month, and one reading comes twice.
    batches = [[row(1, 0, 0, 5), row(2, 1, 400, 5)], [row(2, 2, 400, 6), row(2, 2, 400, 6)], [row(2, 2, 400, 6), row(1, 3, 30, 50)]]
    run_batches(spark, str(tmp_path), batches, SCHEMA, lambda rows: S.write(S.sales_stream(rows, False), str(tmp_path), "kind"))
    assert sorted(r["sold"] for r in S.ramp(spark, str(tmp_path)).collect()) == [1, 45]


SHOWS = SCHEMA + ", starts_at timestamp_ntz, arrived_at timestamp_ntz"


def test_looks_fall_due_and_folded_shows_are_forgotten(spark, tmp_path, state_store):
    begins = minute(0)

    def row(key, seq, m, sold, starts=begins, arrived=None):
        return (key, 1, seq, minute(m), sold, 90, starts, minute(m if arrived is None else arrived))

    batches = [
        [row(1, 0, -600, 10), row(2, 1, -600, 90)],
        # Key 1 is read again before its look at -570; key 2's second look at -595 is missed until the clock has passed.
        [row(1, 2, -590, 20), row(9, 3, -500, 1, minute(90000))],
        [row(9, 4, -400, 1, minute(90000))],
        [row(2, 5, -390, 90), row(9, 6, -389, 2, minute(90000))],
        # Eleven days later: both shows are folded, so a reading of key 1 is a first sight again.
        [row(9, 7, 16000, 3, minute(90000))],
        [row(1, 8, 16100, 90, begins, 16100), row(9, 9, 16200, 3, minute(90000))],
    ]
    root = str(tmp_path)
    run_batches(spark, root, batches, SHOWS, lambda rows: S.write(S.sales_stream(rows, clock="arrived_at", delay="0 seconds"), root, "kind"))
    at = lambda t: None if t is None else int((t - begins).total_seconds() // 60)
    looks = {(r.screening_key, r.seq): (r.outcome, at(r.look_at)) for r in S.looks(spark, root).collect()}
    assert looks[1, 0] == ("recorded", -570) and looks[2, 1] == ("held", -595) and looks[1, 2] == ("recorded", -560)
    assert looks[2, 5] == ("recorded", -360) and looks[1, 8] == ("held", None)
    due = {(r.screening_key, at(r.look_at)) for r in S.due(spark, root).collect() if r.screening_key != 9}
    assert {(2, -595), (1, -560)} <= due and (1, -570) not in due
    sold = {(at(r.hour), r.sold) for r in S.ramp(spark, root).where("hour < TIMESTAMP_NTZ '2026-08-05 00:00:00'").collect()}
    assert sold == {(-600, 10), (-420, 1)}


def test_look_times_equal_the_columns(spark):
    rng = random.Random(4)
    rows = [(minute(0), minute(-rng.choice([rng.randrange(-30, 20), rng.randrange(0, 4000)]))) for _ in range(300)]
    frame = spark.createDataFrame(rows, "s timestamp_ntz, n timestamp_ntz")
    us = lambda t: None if t is None else int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    for r in frame.select("*", T.next_look(F.col("s"), F.col("n")).alias("a"), T.recheck_look(F.col("s"), F.col("n")).alias("b")).collect():
        assert S.next_look(us(r.s), us(r.n)) == us(r.a) and S.recheck_look(us(r.s), us(r.n)) == us(r.b)


def test_alerts_check_once_per_batch(spark, tmp_path, state_store):
    steps = [(0, 10), (3, 130), (11, 130), (30, 200), (45, 235), (60, 500)]
    batches = []
    for epoch, (m, value) in enumerate(steps):
        at = START + dt.timedelta(minutes=m)
        batches.append([(7, epoch * 2, at - dt.timedelta(seconds=30), value - 1), (7, epoch * 2 + 1, at, value)])
        if epoch == 2:
            batches[-1].append((8, 99, at, 1))
    schema = "screening_key bigint, seq bigint, at_ts timestamp_ntz, sold bigint"
    run_batches(spark, str(tmp_path), batches, schema, lambda rows: S.write(S.rings_stream(rows), str(tmp_path)))
    rings = S.read(spark, str(tmp_path), S.RINGS).collect()
    out = {(r["screening_key"], (r["ring_at"] - START).seconds // 60, r["ring_value"]) for r in rings}
    assert len(rings) == 5 and out == {(7, 0, 10), (7, 11, 130), (7, 45, 235), (7, 60, 500), (8, 11, 1)}


SETTLE = "screening_key bigint, starts_at timestamp_ntz, event_at timestamp_ntz, seq bigint, sold bigint, total bigint, arrived_at timestamp_ntz"


def settled(spark, tmp_path, batches, settle=settle_stream, **options):
    for rows in batches:
        spark.createDataFrame(rows, SETTLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        rows = spark.readStream.schema(SETTLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = (
            settle(rows, **options).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return {r["screening_key"]: (r["sold"], r["total"], r["confidence"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def minute(m):
    return START + dt.timedelta(hours=12, minutes=m)


def test_settles_once_with_a_grade(spark, tmp_path):
    day = minute(0)
    batches = [
        [(1, day, minute(-600), 0, None, None), (2, day, minute(-600), 1, None, None), (3, day, minute(-600), 2, None, None)],
        [(1, day, minute(-60), 3, 10, 90), (2, day, minute(-300), 4, 5, 90), (4, minute(500), minute(-10), 5, 1, 9)],
        [(1, day, minute(-10), 6, 33, 90)],
        [(5, minute(400), minute(200), 7, 2, 9), (1, day, minute(100), 8, 77, 90)],
    ]
    out = settled(spark, tmp_path, [[(*r, r[2]) for r in rows] for rows in batches])
    assert out == {1: (33, 90, "final"), 2: (5, 90, "partial"), 3: (0, 0, "missed")}


def test_late_readings_count_and_moved_shows_settle_at_their_new_time(spark, tmp_path):
    day = minute(0)
    batches = [  # key, start, reading at, seq, sold, total, arrived
        [(1, day, minute(-600), 0, None, None, minute(-600)), (2, day, minute(-600), 1, None, None, minute(-600))],
        [(1, day, minute(-200), 2, 10, 90, minute(-200)), (3, day, minute(5), 3, 1, 90, minute(5))],
        # The show of key 2 moves by three hours; key 1's reading is four hours late.
        [(2, minute(180), minute(10), 4, None, None, minute(10)), (1, day, minute(-230), 5, 60, 90, minute(10))],
        [(2, minute(180), minute(100), 6, 60, 90, minute(100)), (9, minute(900), minute(101), 7, 1, 90, minute(101))],
        [(9, minute(900), minute(400), 8, 2, 90, minute(400))],
    ]
    out = settled(spark, tmp_path, batches, clock="arrived_at", delay="0 minutes")
    assert out == {1: (60, 90, "partial"), 2: (60, 90, "partial"), 3: (1, 90, "final")}


def test_by_default_only_arrival_moves_the_timers(spark, tmp_path):
    day = minute(0)
    batches = [  # key, start, reading at, seq, sold, total, arrived
        [(1, day, minute(-600), 0, None, None, minute(-600)), (2, day, minute(-600), 1, None, None, minute(-600))],
        # The clock of key 2 is days ahead; the readings after it are hours late.
        [(1, day, minute(-500), 2, 10, 90, minute(-500)), (2, day, minute(9000), 3, 90, 90, minute(-499))],
        [(1, day, minute(-400), 4, 60, 90, minute(-100)), (2, day, minute(-450), 5, 20, 90, minute(-99))],
        [(1, day, minute(-10), 6, 70, 90, minute(20)), (9, minute(900), minute(30), 7, 1, 90, minute(30))],
        [(9, minute(900), minute(400), 8, 2, 90, minute(400))],
    ]
    assert settled(spark, tmp_path, batches) == {1: (70, 90, "final"), 2: (20, 90, "partial")}


def test_folded_days_leave_the_state(spark, tmp_path):
    """Sixty days, one a micro-batch: the state never holds more than the days that are kept, and each is written once."""
    from gatecount.streaming.fold import daily_stream

    schema = "screening_key bigint, starts_at timestamp, film_id bigint, sold bigint, total bigint, price_min double, confidence string"
    for d in range(0, 60, 3):
        rows = [(d * 10 + i, minute(0) + dt.timedelta(days=d + i // 2), i % 2, i, 9, None, "final") for i in range(6)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = S.write(daily_stream(rows, keep_days=10), str(tmp_path))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held and max(held) <= 2 * (10 + 2 * 3 + 1) < 2 * 60
    days = "film_id bigint, sold bigint, capacity bigint, screenings bigint, gross double, final bigint, partial bigint, missed bigint, day date"
    out = S.read(spark, str(tmp_path), days).collect()
    assert len({(r.day, r.film_id) for r in out}) == len(out) and len(out) >= 2 * 45
    assert all(r.screenings == r.final == 1 and r.capacity == 9 and r.gross == r.sold * 205.0 for r in out)


def test_session_windows_settle_fixed_shows(spark, tmp_path):
    day = minute(0)
    batches = [  # key, start, reading at, seq, sold, total, arrived
        [(k, day, minute(-600), 0, None, None, minute(-600)) for k in (1, 2, 3)] + [(None, day, minute(-600), 0, None, None, minute(-600))],
        # A clock that is days ahead, a reading after the grace time, a null start.
        [(1, day, minute(-60), 2, 10, 90, minute(-60)), (2, day, minute(9000), 3, 90, 90, minute(-50)), (7, None, minute(-40), 4, 1, 2, minute(-40))],
        # Late, and out of order: arrival order (seq) decides.
        [(1, day, minute(-10), 6, 33, 90, minute(100)), (2, day, minute(-300), 5, 5, 90, minute(20)), (1, day, minute(40), 8, 77, 90, minute(40))],
        [(5, minute(900), minute(149), 9, 2, 9, minute(149))],
        [(1, day, minute(-1), 10, 34, 90, minute(148)), (5, minute(900), minute(150), 11, 3, 9, minute(150))],
        # Due at 150: what comes now is too late, and a show that was never listed is not settled.
        [(1, day, minute(-1), 12, 35, 90, minute(151)), (4, day, minute(-1), 13, 35, 90, minute(151)), (5, minute(900), minute(500), 14, 4, 9, minute(500))],
    ]
    out = settled(spark, tmp_path, batches, settle_fixed_stream)
    assert out == {1: (34, 90, "final"), 2: (5, 90, "partial"), 3: (0, 0, "missed"), None: (0, 0, "missed")}


def test_session_windows_settle_like_the_processor(spark, tmp_path):
    rng = random.Random(5)
    starts = {k: minute(rng.randrange(0, 900)) for k in range(12)}
    rows, now = [[(k, s, minute(-400), 0, None, None, minute(-400)) for k, s in starts.items()]], -300
    for seq in range(1, 200):
        key, now = rng.randrange(0, 12) if rng.random() < 0.6 else 0, now + 8
        at = minute(now - (rng.randrange(0, 100) if rng.random() < 0.3 else 0))
        if minute(now) < starts[key]:  # read before the start; some of it arrives late
            rows.append([(key, starts[key], at, seq, rng.randrange(0, 50), 50, minute(now))])
    rows.append([(99, minute(9000), minute(2000), 500, 1, 1, minute(2000))])
    batches = [sum(rows[i : i + 30], []) for i in range(0, len(rows), 30)]
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    out = settled(spark, tmp_path / "a", batches, settle_fixed_stream)
    assert out.keys() == starts.keys() and out == settled(spark, tmp_path / "b", batches)


def test_session_windows_need_no_python(spark, tmp_path):
    spark.createDataFrame([], SETTLE).write.parquet(str(tmp_path / "in"))
    rows = settle_fixed_stream(spark.readStream.schema(SETTLE).parquet(str(tmp_path / "in")))
    assert rows.isStreaming
    plan = settle_fixed_stream(spark.read.schema(SETTLE).parquet(str(tmp_path / "in")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") <= 1
