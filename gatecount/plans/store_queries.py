"""Queries over tables at rest: snapshots read back, a chain's feed, partitions replaced."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from gatecount import rules
from gatecount.plans import views as V
from gatecount.session import checkpoint_root
from gatecount.sources import feeds, snapshots


def _path(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/gatecount-{name}-{uuid.uuid4().hex}"


def snapshot_read(spark, sf_dir):
    """Customers stored as JSON by two writers, the older of which knew no segment; read back in one layout."""
    customer = V.table(spark, sf_dir, "customer")
    layout = Y.StructType.fromDDL("id bigint, name string, nation int, balance double, segment string")
    new = customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("nation"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    new_path, old_path = _path(spark, "snapshot"), _path(spark, "snapshot")
    new.where("id % 2 = 0").write.json(new_path)
    new.where("id % 2 = 1").drop("segment").write.json(old_path)
    older = Y.StructType(layout.fields[:-1])
    both = [snapshots.read_json(spark, p, s) for p, s in ((new_path, layout), (old_path, older), (_path(spark, "never-written"), layout))]
    parts = [snapshots.backfill(df, layout, {"segment": "UNKNOWN"}) for df in both]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chain_feed(spark, sf_dir):
    """Every line item is a presentation; the documents, one per supplier and month, are stored and read as a feed."""
    line = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    wall = F.col("l_shipdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, CAST(9 + l_linenumber * 2 AS INT), CAST(l_partkey % 60 AS INT))")
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    shows = line.select(
        "l_suppkey",
        F.date_trunc("month", "l_shipdate").alias("month"),
        F.struct(
            number.cast("bigint").alias("id"),
            F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"),
            F.when(F.col("l_partkey") % 3 == 0, "").when(F.col("l_partkey") % 3 == 1, F.date_format(F.date_add("l_shipdate", 1), "yyyy-MM-dd")).alias("businessDate"),
            F.concat(F.lit("Film "), F.col("l_partkey").cast("string")).alias("featureName"),
            F.when(F.col("l_partkey") % 4 == 0, "").when(F.col("l_partkey") % 4 == 1, F.lit("Original")).alias("featureAdditionalName"),
            F.col("l_partkey").cast("bigint").alias("featureId"),
            F.col("l_suppkey").cast("bigint").alias("venueId"),
            F.concat(F.lit("Hall "), F.col("l_suppkey").cast("string")).alias("venueName"),
            (F.col("l_suppkey") % 25).cast("bigint").alias("venueLocationId"),
            F.concat(F.lit("Place "), (F.col("l_suppkey") % 25).cast("string")).alias("locationName"),
            (F.col("l_quantity") / 64).alias("availRatio"),
            F.when(F.col("l_returnflag") != "R", (F.col("l_returnflag") == "A").cast("int")).alias("soldout"),
        ).alias("p"),
    )
    path = _path(spark, "feed")
    # Feed documents repeat their field names in every presentation: packed, they take a fraction of the room.
    documents = shows.groupBy("l_suppkey", "month").agg(F.collect_list("p").alias("presentations")).select("presentations")
    documents.write.json(path, compression="lz4")
    out = feeds.presentations(snapshots.read_json(spark, path, feeds.FEED), "a", "In ")
    return out.select(
        "screening_key", "starts_at", "day", "cinema_key", "cinema", "hall_key", "hall", "alias_key", "title", "original_title", "sold_out", "free_ratio"
    )


def partition_sink(spark, sf_dir):
    """Sales per ship day in parts of a month; the parts of 1995 are replaced twice by corrected rows, all others stay."""
    line = V.table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity")
    daily = line.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sold"))
    daily = daily.withColumn("part", F.trunc("day", "month"))
    path = _path(spark, "daily")
    snapshots.replace_partitions(daily, path, "part")
    for _ in range(2):
        corrected = daily.where(F.year("day") == 1995).withColumn("sold", F.col("sold") + 1000)
        snapshots.replace_partitions(corrected, path, "part")
    return snapshots.read_parquet(spark, path, "day date, sold bigint, part date")


QUERIES = {f.__name__: f for f in (snapshot_read, chain_feed, partition_sink)}

ORACLES = {
    "snapshot_read": """
      SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS INTEGER) AS nation, c_acctbal AS balance,
             CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'UNKNOWN' END AS segment FROM customer""",
    "chain_feed": f"""
      WITH w AS (SELECT *, l_shipdate + to_hours(9 + l_linenumber * 2) + to_minutes(l_partkey % 60) AS wall FROM lineitem)
      SELECT 'a:' || (l_orderkey * 8 + l_linenumber) AS screening_key, (wall AT TIME ZONE '{rules.LOCAL_ZONE}') AT TIME ZONE 'UTC' AS starts_at,
             CASE WHEN l_partkey % 3 = 1 THEN CAST(l_shipdate AS DATE) + 1 ELSE CAST(wall - INTERVAL {rules.BUSINESS_DAY_CUTOFF_HOURS} HOUR AS DATE) END AS day,
             'a:' || (l_suppkey % 25) AS cinema_key, 'In Place ' || (l_suppkey % 25) AS cinema, 'a:' || l_suppkey AS hall_key, 'Hall ' || l_suppkey AS hall,
             'a:' || l_partkey AS alias_key, 'Film ' || l_partkey AS title, CASE WHEN l_partkey % 4 = 1 THEN 'Original' END AS original_title,
             l_returnflag = 'A' AS sold_out, l_quantity / 64 AS free_ratio
      FROM w""",
    "partition_sink": """
      SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) + CASE WHEN year(l_shipdate) = 1995 THEN 1000 ELSE 0 END AS BIGINT) AS sold,
             CAST(date_trunc('month', l_shipdate) AS DATE) AS part
      FROM lineitem GROUP BY CAST(l_shipdate AS DATE), year(l_shipdate), CAST(date_trunc('month', l_shipdate) AS DATE)""",
}
