"""Rings by pointers against a loop, with long and hot series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gatecount.operators import readings as R
from gatecount.operators.alerts import linked_alert

SCHEMA = "screening_key string, seq long, at_ts timestamp_ntz, sold long"
START = dt.datetime(2024, 1, 1)


def rings(ticks, step, quiet_minutes):
    out = []
    for at, value in sorted(ticks.items()):
        if not out or (value - out[-1][1] >= step and at - out[-1][0] >= dt.timedelta(minutes=quiet_minutes)):
            out.append((at, value))
    return out


@pytest.mark.parametrize("step, quiet", [(100, 10), (1, 5), (7, 33), (10**6, 10), (-50, 0)])
def test_pointers_against_a_loop(spark, step, quiet):
    rng = random.Random(step)
    rows, ticks = [], {}
    for key, n, spread in (("hot", 4000, 40_000), ("a", 1, 10), ("b", 40, 100), ("c", 60, 2_000_000), ("d", 300, 400)):
        value = 0
        for seq, minute in enumerate(sorted(rng.sample(range(spread), min(n, spread)))):
            value = max(0, value + rng.choice([-30, 0, 1, 3, 20, 60]))
            at = START + dt.timedelta(minutes=minute, seconds=rng.randrange(60))
            rows.append((key, seq, at, value))
            ticks.setdefault(key, {})[START + dt.timedelta(minutes=minute // 5 * 5)] = value
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = linked_alert(df, step=step, quiet_minutes=quiet).collect()
    want = {(k, at, v) for k, t in ticks.items() for at, v in rings(t, step, max(quiet, 5))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    if quiet >= 5:
        assert {tuple(r) for r in R.threshold_alert(df, step=step, quiet_minutes=quiet).collect()} == want


def test_odd_rows_and_no_rows(spark):
    assert linked_alert(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, 1, START, 5), ("a", 2, None, 5), ("a", 3, START, None), ("a", 4, START, 7), ("a", 4, START, 7), ("b", 5, START, None)]
    assert [tuple(r) for r in linked_alert(spark.createDataFrame(rows, SCHEMA)).collect()] == [("a", START, 7)]


def test_one_series_of_two_hundred_thousand_ticks(spark):
    """No array of a series is built, and the rounds grow with the logarithm of the rings."""
    n = 200_000
    at = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 5).cast("int"))
    df = spark.range(n).select(F.lit("k").alias("screening_key"), F.col("id").alias("seq"), at.alias("at_ts"), F.col("id").alias("sold"))
    out = linked_alert(df, step=100)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.agg(F.count(F.lit(1)), F.sum("ring_value"), F.max("ring_value")).first()
    assert tuple(got) == (n // 100, sum(range(0, n, 100)), n - 100)
