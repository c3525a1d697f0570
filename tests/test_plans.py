"""What every registered query's physical plan must not contain."""

import os

import pytest

from gatecount.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
# Streams and maintained tables run their batches while the query is built; their result is a plain scan.
NAMES = sorted(n for n in registry.queries() if not n.startswith(("stream_", "maintained_")))


def plan_of(spark, name):
    df = registry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_pairwise_joins_and_no_python(spark, name):
    plan = plan_of(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in plan, f"{operator} in {name}"


@pytest.mark.parametrize("name", ["top_cinemas", "forecast_log", "headline_topk", "union_last_wins", "latest_totals", "first_wins_lookup"])
def test_first_rows_per_key_are_limited_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "ramp_retention")
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    assert "props" not in plan and "event_type" not in plan


@pytest.mark.parametrize("name", ["sales_ramp", "hold_confirm", "closed_guard", "confirmed_ramp"])
def test_readings_are_shuffled_by_key_and_segment_only(spark, name):
    """No exchange or window on the screening key alone sees raw readings."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # Inside a segment, or over the table of one row per (key, segment).
    assert windows and all("_segment" in line for line in windows)


def test_the_long_report_holds_every_answer(spark):
    from gatecount.plans import composite_queries as C
    from gatecount.plans.report import LiveReport

    assert set(C._ANSWERS) == set(LiveReport.ANSWERS)
    rows = C.report_answers(spark, "/root/testdata/sf0.001").groupBy("section").count().collect()
    assert {r["section"] for r in rows} == set(LiveReport.ANSWERS)


def test_long_rows_of_odd_values(spark):
    from gatecount.plans.report import LiveReport

    class Given(LiveReport):
        def films(self):
            return spark.createDataFrame([(1, None, True, None), (1, "x", None, "t"), (None, None, False, "")], "a int, b string, n boolean, t string")

        def week(self):
            return spark.createDataFrame([], "n int")

    report = Given(*[None] * 7)
    out = report.long_rows({"films": (["a", "b"], ["n"], ["t"]), "week": ([], ["n"], [])})
    assert out.columns == ["section", "key", "measure", "value", "text"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [
            ("films", "1", "n", 1.0, None), ("films", "1", "t", None, None), ("films", "1|x", "n", None, None),
            ("films", "1|x", "t", None, "t"), ("films", "", "n", 0.0, None), ("films", "", "t", None, ""),
        ],
        key=str,
    )


@pytest.mark.parametrize("name", ["run_series", "hold_strength", "report_forecasts"])
def test_no_hash_aggregate_holds_a_row_per_supplier(spark, name):
    """A film's week has about as many suppliers as lines: one hash entry each would be the whole input."""
    keyed = [line for line in plan_of(spark, name).splitlines() if "HashAggregate(keys=[" in line]
    assert keyed and not any("l_suppkey" in line.split("functions=")[0] for line in keyed)


@pytest.mark.parametrize("name", ["duplicate_map", "remapped_ramp"])
def test_titles_are_normalised_once_per_different_title(spark, name):
    """Nothing that names a column of the table of parts also normalises."""
    plan = plan_of(spark, name)
    assert r"\p{M}" in plan
    assert not any(r"\p{M}" in line and "p_name" in line for line in plan.splitlines())


def test_stored_feeds_are_packed(spark, tmp_path, monkeypatch):
    from gatecount.plans import store_queries as Q

    monkeypatch.setattr(Q, "_path", lambda spark, name: str(tmp_path / name))
    assert Q.chain_feed(spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    files = [f for f in os.listdir(tmp_path / "feed") if f.startswith("part-")]
    assert files and all(f.endswith(".json.lz4") for f in files)
