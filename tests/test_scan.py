"""The prefix scan over readings against a loop, across segment borders, and its plan."""

import random

import pytest
from pyspark.sql import functions as F

from gatecount.operators import readings as R
from gatecount.operators.scan import scan
from gatecount.plans import registry

SF = "/root/testdata/sf0.001"
APPROACH = 0.8


def one_by_one(rows):
    """rows of one key in order: (seq, sold, total, policy, known) -> (outcome, delta)."""
    out, before, was_full, stops, value = [], None, False, 0, None
    for _, sold, total, policy, known in rows:
        full = total > 0 and sold >= total
        stop = known != "recorded" and ((sold >= total and (before or 0) < total * APPROACH) or total <= 0)
        stops += stop
        guarded = "recorded" if not stops else "rejected" if stops == 1 and stop else "closed"
        outcome = known or {"hold": "held" if full and not was_full else "recorded", "guard": guarded, "direct": "recorded"}[policy]
        recorded = outcome == "recorded"
        out.append((outcome, max(sold - (sold if value is None else value), 0) if recorded else 0))
        value = sold if recorded else value
        before, was_full = sold, full
    return out


@pytest.mark.parametrize("segment_rows", [1, 3, 7, 1 << 20])
@pytest.mark.parametrize("policies", [("hold",), ("guard",), ("direct",), ("hold", "guard", "direct")])
def test_scan_against_a_loop(spark, segment_rows, policies):
    rng = random.Random(segment_rows * 10 + len(policies))
    rows, want = [], {}
    for key in ("a", "b", "c", "d", "e", "f"):
        seqs = sorted(rng.sample(range(-2, 60), rng.choice([1, 2, 25, 40])))
        mine = [
            (s, rng.choice([0, 3, 7, 9, 10, 10]), rng.choice([10] * 12 + [0]), rng.choice(policies), rng.choice([None] * 9 + ["recorded", "held", "closed"]) if s < 4 else None)
            for s in seqs
        ]
        want |= {(key, r[0]): o for r, o in zip(mine, one_by_one(mine))}
        rows += [(key, *r) for r in mine]
    df = spark.createDataFrame(rows, "screening_key string, seq long, sold int, total int, how string, stands string").repartition(3)
    out = scan(df, policy=F.col("how"), known="stands", approach=APPROACH, segment_rows=segment_rows, keep=["seq", "screening_key"])
    assert out.columns == ["seq", "screening_key", "outcome", "delta"]
    got = out.collect()
    assert len(got) == len(rows) and {(r.screening_key, r.seq): (r.outcome, r.delta) for r in got} == want


def test_no_rows_and_rows_without_a_place(spark):
    schema = "screening_key string, seq long, at_ts timestamp_ntz, sold long, total long"
    assert scan(spark.createDataFrame([], schema)).collect() == []
    for row in ((None, 1, None, 2, 3), ("a", None, None, 2, 3)):
        with pytest.raises(Exception, match="without key or arrival number"):
            scan(spark.createDataFrame([row], schema)).collect()


@pytest.mark.parametrize("name", ["sales_ramp", "confirmed_ramp", "closed_guard", "hold_confirm"])
def test_readings_are_read_and_dealt_once(spark, name):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = registry.queries()[name](spark, SF)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_judged_readings_of_a_cycle_are_read_once(spark, tmp_path):
    spark.createDataFrame([("a", 0, 5, 10), ("b", 0, 10, 10)], "screening_key string, seq long, sold long, total long").selectExpr(
        "*", "TIMESTAMP_NTZ '2024-01-01 10:00:00' AS at_ts"
    ).write.parquet(str(tmp_path / "r"))
    readings = spark.read.parquet(str(tmp_path / "r"))
    state = spark.createDataFrame([("a", 4, 10, None)], "screening_key string, sold long, total long, captured_at timestamp_ntz")
    judged = R.judge(readings, state, F.lit("hold"))
    assert {r.screening_key: (r.outcome, r.delta) for r in judged.collect()} == {"a": ("recorded", 1), "b": ("held", 0)}
    final = judged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
