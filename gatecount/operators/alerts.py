"""Threshold alerts over series of any length: pointers to the next ring, composed by pointer jumping.

`readings.threshold_alert` folds one array per key, which suits series of a few thousand ticks. Here no key is ever
gathered. Every tick points to the tick that would ring next if it rang itself: the first one that is a quiet time later
and a step higher. The pointers are found in a tree of maxima over time, 32 ticks to a node and 32 nodes to the next
(a node's maxima are an array of 32 places, filled by conditional maxima): up until a node has a later place that is
high enough, then down to its first such tick. Each step is an equality join on key and node, so a key with many ticks
is many nodes. The rings are the ticks on the path from the first one: a set of path ticks, joined with pointers that
skip twice as many rings each round, doubles until it stops growing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecount import rules
from gatecount.session import cut_lineage

BITS = 5
WIDTH = 1 << BITS


def _node(number: Column) -> Column:
    return F.shiftright(number, BITS)


def _place(number: Column) -> Column:
    return number.bitwiseAND(F.lit(WIDTH - 1))


def _tree(ticks: DataFrame, key: str, levels: int) -> list[DataFrame]:
    """Per level: key, node and ``maxima``, the greatest value below each of its places."""
    out, rows = [], ticks.select(key, F.col("_t").alias("_n"), F.col("_v").alias("_m"))
    for _ in range(levels):
        places = [F.max(F.when(_place(F.col("_n")) == i, F.col("_m"))).alias(f"_m{i}") for i in range(WIDTH)]
        level = rows.groupBy(key, _node(F.col("_n")).alias("_node")).agg(*places)
        level = cut_lineage(level.select(key, "_node", F.array(*[f"_m{i}" for i in range(WIDTH)]).alias("_maxima")))
        out.append(level)
        rows = level.select(key, F.col("_node").alias("_n"), F.array_max("_maxima").alias("_m"))
    return out


def _first(maxima: str, least: Column, start: Column) -> Column:
    """The first place from ``start`` on whose maximum is at least ``least``; null for none."""
    fits = F.transform(F.col(maxima), lambda m, i: (i >= start) & F.coalesce(m >= least, F.lit(False)))
    return F.nullif(F.array_position(fits, True), F.lit(0).cast("bigint")) - 1


def _next_rings(ticks: DataFrame, key: str, levels: int, step: int, quiet: int) -> DataFrame:
    """key, _t and _next: the tick that rings next after a ring at _t; rows without one are left out."""
    tree = _tree(ticks, key, levels)
    rows = ticks.select(key, "_t", (F.col("_v") + step).alias("_least"), (F.col("_t") + quiet).alias("_from"), F.lit(None).cast("bigint").alias("_hit"), F.lit(0).alias("_level"))
    for i, level in enumerate(tree):
        # From a place of this level on; where it has none, the search goes on behind the node.
        found = _first("_maxima", F.col("_least"), _place(F.col("_from")).cast("int"))
        joined = rows.withColumn("_node", _node(F.col("_from"))).join(level, [key, "_node"], "left")
        here = F.when(F.col("_hit").isNull(), F.shiftleft("_node", BITS) + found)
        rows = joined.withColumn("_here", here).select(
            key, "_t", "_least",
            (F.col("_node") + 1).alias("_from"),
            F.coalesce("_hit", "_here").alias("_hit"),
            F.when(F.col("_hit").isNull(), F.lit(i)).otherwise(F.col("_level")).alias("_level"),
        )
    rows = cut_lineage(rows.where("_hit IS NOT NULL").select(key, "_t", "_least", "_hit", "_level"))
    for i in reversed(range(levels - 1)):
        joined = rows.withColumn("_node", F.when(F.col("_level") > i, F.col("_hit"))).join(tree[i], [key, "_node"], "left")
        below = F.shiftleft("_node", BITS) + _first("_maxima", F.col("_least"), F.lit(0))
        rows = joined.select(key, "_t", "_least", F.coalesce(below, F.col("_hit")).alias("_hit"), "_level")
    return rows.select(key, "_t", F.col("_hit").alias("_next"))


def linked_alert(
    readings: DataFrame,
    key: str = "screening_key",
    seq: str = "seq",
    at: str = "at_ts",
    value: str = "sold",
    tick_minutes: int = 5,
    step: int = rules.ALERT_STEP,
    quiet_minutes: int = rules.ALERT_QUIET_MINUTES,
) -> DataFrame:
    """Rings (key, ring_at, ring_value) as `readings.threshold_alert` gives them, for series of any length.

    A reading without a time or a value is no tick; a null key is a key of its own, which never rings. An empty table
    gives no rings.
    """
    seconds = int(tick_minutes) * 60
    tick = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds).cast("bigint")
    last = F.max_by(F.col(value).cast("bigint"), F.when(F.col(value).isNotNull(), F.col(seq)))
    ticks = readings.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, tick.alias("_tick")).agg(last.alias("_v")).where("_v IS NOT NULL")
    ticks = cut_lineage(ticks)
    span = ticks.agg(F.min("_tick").alias("first"), F.max("_tick").alias("last")).first()
    if span["first"] is None:
        return ticks.select(key, F.lit(None).cast("timestamp_ntz").alias("ring_at"), F.col("_v").alias("ring_value"))
    ticks = ticks.select(key, (F.col("_tick") - span["first"]).alias("_t"), "_v")
    levels, covered = 1, WIDTH
    while covered <= span["last"] - span["first"]:
        levels, covered = levels + 1, covered * WIDTH

    quiet = -(-int(quiet_minutes) * 60 // seconds)
    pointers = cut_lineage(_next_rings(ticks, key, levels, step, max(quiet, 1)))
    path = front = cut_lineage(ticks.groupBy(key).agg(F.min("_t").alias("_t")))
    while True:
        front = cut_lineage(path.join(pointers, [key, "_t"]).select(key, F.col("_next").alias("_t")))
        if front.isEmpty():
            break
        path = cut_lineage(path.unionByName(front))
        twice = pointers.select(key, F.col("_t").alias("_next"), F.col("_next").alias("_then"))
        pointers = cut_lineage(pointers.join(twice, [key, "_next"]).select(key, "_t", F.col("_then").alias("_next")))
    moment = F.timestamp_seconds((F.col("_t") + span["first"]) * seconds).cast("timestamp_ntz")
    return path.join(ticks, [key, "_t"]).select(key, moment.alias("ring_at"), F.col("_v").alias("ring_value"))
