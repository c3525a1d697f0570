"""Sharding by fixed virtual slots.

Each record is hashed into one of `slots` virtual slots, for good. A versioned map says which shard holds a slot:
version 0 deals the slots out in turn; `rebalanced` adds a version whose rows are edits only, moving slots from shards
with too many bytes to the others; `grown` adds one that moves slots into a new shard and nowhere else. `mapped` reads
the map as of a version. All of it is DataFrame operations; the map and the bytes per slot have at most `slots` rows,
however many records there are, which bounds what is broadcast and what one task folds.

Defined cases: a null text has no bytes and the checksum of an empty one; a null id is hashed as null, together with
the text's checksum; records that are equal in id and checksum share a slot, unless together they are a large part of a
shard: then they are told apart by a number of their own and spread over the slots; an empty table gives an empty
result and a map of version 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatecount.llm.common import fresh, written

SLOTS = 8192
#: Equal records with more than this part of an even share are spread; there are at most shards / HEAVY_PART such groups.
HEAVY_PART = 1 / 64
#: Of an even share, what a shard keeps of its own largest slots; the rest is dealt out anew.
KEPT_SHARE = 0.99


def weights(records: DataFrame, slot: str, size: str) -> DataFrame:
    """slot, bytes, n."""
    return records.groupBy(F.col(slot).alias("slot")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """version, slot, shard: version 0."""
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard")
    )


def mapped(versions: DataFrame, version: int | None = None) -> DataFrame:
    """slot, shard, as of a version (default: the newest)."""
    seen = versions if version is None else versions.where(F.col("version") <= version)
    return seen.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))


def _loaded(versions: DataFrame, weight: DataFrame) -> DataFrame:
    return (
        mapped(versions)
        .join(F.broadcast(weight), "slot", "left")
        .select("slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    )


def rebalanced(versions: DataFrame, weight: DataFrame, shards: int, version: int) -> DataFrame:
    """Edits that even out the bytes: version, slot, shard, only for slots that move.

    Each shard keeps its largest slots up to its even share; the other slots, largest first, go to the shard that has
    the fewest bytes so far.
    """
    loaded = _loaded(versions, weight)
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    every = Window.partitionBy("whole")
    judged = (
        loaded.withColumn("whole", F.lit(0))
        .withColumn("share", F.sum("bytes").over(every) / shards * KEPT_SHARE)
        .withColumn("stays", F.sum("bytes").over(largest_first) <= F.col("share"))
    )
    held = [F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)) for s in range(shards)]
    pool = F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "slot", "shard")))
    one = judged.groupBy("whole").agg(F.array(*held).alias("loads"), F.array_sort(pool).alias("pool"))
    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("to"))

    def deal(state, slot):
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda x, i: F.when(i == to, x - slot["less"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["to"], F.array(to)).alias("to"))

    dealt = one.select("pool", F.aggregate("pool", start, deal)["to"].alias("to"))
    moved = dealt.select(F.explode(F.arrays_zip("pool", "to")).alias("m"))
    return moved.where("m.pool.shard <> m.to").select(
        F.lit(version).alias("version"), F.col("m.pool.slot").alias("slot"), F.col("m.to").alias("shard")
    )


def grown(versions: DataFrame, weight: DataFrame, shards: int, version: int) -> DataFrame:
    """Edits for one more shard, number `shards`: each shard hands over its smallest slots that bring it down to the
    new even share. No slot moves between the old shards."""
    loaded = _loaded(versions, weight)
    smallest_first = Window.partitionBy("shard").orderBy("bytes", "slot")
    every = Window.partitionBy("whole")
    judged = (
        loaded.withColumn("whole", F.lit(0))
        .withColumn("share", F.sum("bytes").over(every) / (shards + 1))
        .withColumn("before", F.sum("bytes").over(smallest_first) - F.col("bytes"))
        .withColumn("load", F.sum("bytes").over(Window.partitionBy("shard")))
    )
    gives = (F.col("load") - F.col("before") > F.col("share")) & (F.col("before") + F.col("bytes") <= F.col("load") - F.col("share"))
    return judged.where(gives).select(F.lit(version).alias("version"), "slot", F.lit(shards).alias("shard"))


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text"):
    """(records, map): a row per document with id, size, text_crc32, virtual_slot, shard and its place there, gapless
    from 0; and the map's versions. The law: the shards' sizes are near equal, by bytes."""
    spark = docs.sparkSession
    data = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    records = docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    records = written(records, "sizes")
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    heavy, other, same = (fresh(records, name) for name in ("heavy", "heavy_id", "heavy_crc32"))
    groups = records.groupBy(F.col(f"`{id_col}`").alias(other), F.col("text_crc32").alias(same)).agg(F.sum("size").alias(heavy))
    groups = F.broadcast(groups.where(F.col(heavy) * shards > total * HEAVY_PART))
    equal = F.col(f"`{id_col}`").eqNullSafe(F.col(other)) & (F.col("text_crc32") == F.col(same))
    own = F.when(F.col(heavy).isNotNull(), F.monotonically_increasing_id())
    key = F.when(F.col(heavy).isNull(), F.xxhash64(F.col(f"`{id_col}`"), "text_crc32")).otherwise(F.xxhash64(F.col(f"`{id_col}`"), "text_crc32", own))
    slotted = records.join(groups, equal, "left").withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int"))
    # Written at once, so that a record's number is given once.
    records = written(slotted.drop(heavy, other, same), "records")
    weight = written(weights(records, "virtual_slot", "size"), "slot-bytes")
    first = first_map(spark, shards, slots)
    versions = written(first.unionByName(rebalanced(first, weight, shards, 1)), "slot-map")
    holds = mapped(versions).join(F.broadcast(weight), "slot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    in_turn = Window.partitionBy("shard").orderBy("slot")
    begins = holds.select("slot", "shard", (F.sum("n").over(in_turn) - F.col("n")).alias("begin"))
    place = fresh(records, "place")
    line = Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32")
    placed = (
        records.withColumn(place, F.row_number().over(line))
        .join(F.broadcast(begins.withColumnRenamed("slot", "virtual_slot")), "virtual_slot")
        .select(id_col, "size", "text_crc32", "virtual_slot", "shard", (F.col("begin") + F.col(place) - 1).alias("place"))
    )
    return placed, versions
