"""Streaming queries: the readings arrive as a file stream and are run to the end."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from gatecount import rules
from gatecount.plans import views as V
from gatecount.plans.readings_queries import ORACLES as READINGS
from gatecount.plans.views import with_views
from gatecount.session import checkpoint_root
from gatecount.streaming import ramp as S
from gatecount.streaming.fold import daily_stream, ramp_stream
from gatecount.streaming.settle import OUTPUT, PROVIDER, settle_fixed_stream, settle_stream


def _root(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


PARTS = 4
FILES = 8


def _readings(events, *more):
    return events.select(
        F.col("user_id").alias("screening_key"),
        (F.col("user_id") % 5).alias("film_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("at_ts"),
        F.least(F.floor("value"), F.lit(120)).cast("bigint").alias("sold"),
        F.lit(120).cast("bigint").alias("total"),
        *more,
    )


def _run(spark, sf_dir, root, start, arrange=lambda parts: parts, more=()):
    """The events arrive in PARTS parts by event_id; ``start`` is run to the end after each, from its checkpoint.

    ``arrange`` may change the rows with their ``part``; ``more`` are columns it adds for ``start``.
    """
    parts = arrange(_parted(spark, sf_dir))
    schema = parts.drop("part").schema
    for part in range(PARTS):
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/in")
        start(_readings(spark.readStream.schema(schema).parquet(f"{root}/in"), *more)).awaitTermination()


def _parted(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    after = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    return events.withColumn("part", F.floor(F.col("event_id") * PARTS / after))


def _run_through(spark, sf_dir, root, start):
    """The same parts as micro-batches of one run: each part is FILES files, and files are taken in the order of their times."""
    parts = _parted(spark, sf_dir)
    for part in range(PARTS):
        parts.where(F.col("part") == part).drop("part").repartition(FILES).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(parts.drop("part").schema).option("maxFilesPerTrigger", FILES)
    start(_readings(stream.parquet(f"{root}/in"))).awaitTermination()


@contextmanager
def _state_store(spark):
    """Keyed state needs the RocksDB store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _sales(spark, sf_dir, name: str, confirm: bool):
    root = _root(spark, name)
    with _state_store(spark):
        _run_through(spark, sf_dir, root, lambda readings: S.write(S.sales_stream(readings, confirm), root, "kind"))
    return S.ramp(spark, root)


def stream_sales_ramp(spark, sf_dir):
    return _sales(spark, sf_dir, "ramp", False)


def stream_confirmed_ramp(spark, sf_dir):
    return _sales(spark, sf_dir, "confirmed", True)


def stream_looks(spark, sf_dir):
    """Per part and show the newest reading's outcome and the next look; shows long over are read on and never folded."""
    root = _root(spark, "looks")

    def begin(readings):
        rows = readings.withColumn("starts_at", _starts("screening_key"))
        return S.write(S.sales_stream(rows, clock="at_ts", delay="0 seconds", keep_days=10_000), root, "kind")

    with _state_store(spark):
        _run_through(spark, sf_dir, root, begin)
    return S.looks(spark, root)


def stream_alert(spark, sf_dir):
    root = _root(spark, "alerts")
    with _state_store(spark):
        _run_through(spark, sf_dir, root, lambda readings: S.write(S.rings_stream(readings), root))
    return S.read(spark, root, S.RINGS)


def _starts(key: str):
    """When the show of a user starts."""
    after = F.expr(f"make_dt_interval(CAST({key} % 40 AS INT), CAST({key} % 7 AS INT))")
    return F.lit("2024-01-02 20:00:00").cast("timestamp_ntz") + after


def arrivals(parts):
    """`parts` with ``arrived_at``, and with late and far-future rows.

    Every third reading of a show that is not settled before the next part arrives with that part, up to a quarter of
    all the time late. A part's first reading, if it is on time, comes once more with a clock a year ahead, which no show may count.
    """
    at = F.col("ts").cast("timestamp_ntz")
    begins = parts.groupBy((F.col("part") - 1).alias("part")).agg(F.min(at).alias("next_at"))  # PARTS rows
    late = (F.col("event_id") % 3 == 0) & (F.col("next_at") <= _starts("user_id"))
    moved = parts.join(begins, "part", "left").select(
        *[c for c in parts.columns if c != "part"],
        F.when(late, F.col("part") + 1).otherwise(F.col("part")).alias("part"),
        F.when(late, F.col("next_at")).otherwise(at).alias("arrived_at"),
    )
    ahead = moved.join(parts.groupBy("part").agg(F.min("event_id").alias("event_id")), ["part", "event_id"])
    ahead = ahead.withColumn("ts", (at + F.expr("INTERVAL 365 DAYS")).cast(parts.schema["ts"].dataType))
    return moved.unionByName(ahead)


def stream_settle(spark, sf_dir):
    """Every user is a show with its own start; the stream settles all that are over. See `arrivals`."""
    root = _root(spark, "settle")
    with _state_store(spark):
        _run(spark, sf_dir, root, lambda readings: _settling(readings, root), arrivals, ["arrived_at"])
    out = spark.read.parquet(f"{root}/settled")
    return out.select(
        "screening_key", "sold", "total", "confidence", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("captured_at", "settled_at")]
    )


def _settling(readings, root):
    rows = readings.select(
        "screening_key", _starts("screening_key").alias("starts_at"), F.col("at_ts").alias("event_at"), "seq", "sold", "total", "arrived_at"
    )
    return (
        settle_stream(rows)
        .writeStream.format("parquet")
        .option("path", f"{root}/settled")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def listed(parts):
    """`arrivals`, and one schedule row per show, which has no number and no reading and comes first, long before the start."""
    rows = arrivals(parts)
    shows = rows.select("user_id").distinct()
    at = _starts("user_id") - F.expr(f"INTERVAL '{rules.DISCOVERY_DAYS}' DAY")
    given = {"user_id": F.col("user_id"), "event_id": F.lit(-1), "ts": at, "arrived_at": at, "part": F.lit(0)}
    return rows.unionByName(shows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]))


def stream_settle_fixed(spark, sf_dir):
    """The same shows, all listed beforehand, settled by session windows that end when a show is due."""
    root = _root(spark, "settle-fixed")

    def begin(readings):
        rows = readings.select(
            "screening_key", _starts("screening_key").alias("starts_at"), F.col("at_ts").alias("event_at"), "seq",
            F.when(F.col("seq") >= 0, F.col("sold")).alias("sold"), "total", "arrived_at",
        )
        return S.write(settle_fixed_stream(rows), f"{root}/settled")

    _run(spark, sf_dir, root, begin, listed, ["arrived_at"])
    out = S.read(spark, f"{root}/settled", OUTPUT)
    return out.select(
        "screening_key", "sold", "total", "confidence", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("captured_at", "settled_at")]
    )


def stream_daily(spark, sf_dir):
    """Settled shows of the stream, folded into days by a second stream that follows the first."""
    root = _root(spark, "daily")

    def begin(readings):
        _settling(readings, root).awaitTermination()
        settled = spark.readStream.schema(OUTPUT).parquet(f"{root}/settled")
        film = F.col("screening_key") % 5
        price = F.when(film != 0, (film * 10 + 100).cast("double"))
        return S.write(daily_stream(settled.withColumns({"film_id": film, "price_min": price})), f"{root}/folded")

    with _state_store(spark):
        _run(spark, sf_dir, root, begin, arrivals, ["arrived_at"])
    days = "film_id bigint, sold bigint, capacity bigint, screenings bigint, gross double, final bigint, partial bigint, missed bigint, day date"
    return S.read(spark, f"{root}/folded", days)


def stream_old_hours(spark, sf_dir):
    """Hours of the ramp that are more than three weeks back, summed by a stream that follows the sales."""
    root = _root(spark, "hours")

    def begin(readings):
        S.write(S.sales_stream(readings, False), root, "kind").awaitTermination()
        sales = spark.readStream.schema(S.OUTPUT).parquet(f"{root}/out").where("kind = 'sale'")
        return S.write(ramp_stream(sales), f"{root}/old")

    with _state_store(spark):
        _run(spark, sf_dir, root, begin)
    return S.read(spark, f"{root}/old", "film_id bigint, sold bigint, hour timestamp_ntz")


QUERIES = {f.__name__: f for f in (stream_sales_ramp, stream_confirmed_ramp, stream_looks, stream_alert, stream_settle, stream_settle_fixed, stream_daily, stream_old_hours)}

_SETTLED = """, s AS (
          SELECT DISTINCT screening_key, TIMESTAMP '2024-01-02 20:00:00' + to_days(CAST(screening_key % 40 AS INTEGER)) + to_hours(screening_key % 7) AS starts_at FROM vr),
        o AS (SELECT * FROM s WHERE starts_at + INTERVAL 30 MINUTE < (SELECT max(at_ts) - INTERVAL 2 HOUR FROM vr)),
        l AS (SELECT o.screening_key, starts_at, arg_max(sold, seq) AS sold, max(at_ts) AS at_ts
              FROM o LEFT JOIN vr ON vr.screening_key = o.screening_key AND at_ts <= starts_at + INTERVAL 30 MINUTE GROUP BY 1, 2)"""

ORACLES = {
    "stream_sales_ramp": READINGS["sales_ramp"],
    "stream_confirmed_ramp": READINGS["confirmed_ramp"],
    # One check per part: the first sight rings, then a rise of the step after the quiet time.
    "stream_alert": with_views(
        "vr",
        recursive=True,
        body=f""", bt AS (
          SELECT screening_key, seq * {PARTS} // (SELECT max(seq) + 1 FROM vr) AS part, arg_max(at_ts, seq) AS at_ts, arg_max(sold, seq) AS sold
          FROM vr GROUP BY 1, 2),
        fold AS (
          SELECT 0 AS part, screening_key, NULL::TIMESTAMP AS ring_at, NULL::BIGINT AS ring_value FROM (SELECT DISTINCT screening_key FROM bt)
          UNION ALL
          SELECT f.part + 1, f.screening_key, CASE WHEN rings THEN at_ts ELSE ring_at END, CASE WHEN rings THEN sold ELSE ring_value END
          FROM (
            SELECT fold.*, at_ts, sold, at_ts IS NOT NULL AND (ring_at IS NULL OR (sold - ring_value >= {rules.ALERT_STEP}
                   AND at_ts - ring_at >= INTERVAL {rules.ALERT_QUIET_MINUTES} MINUTE)) AS rings
            FROM fold LEFT JOIN bt ON bt.screening_key = fold.screening_key AND bt.part = fold.part WHERE fold.part < {PARTS}) f)
        SELECT DISTINCT screening_key, ring_at, ring_value FROM fold WHERE ring_at IS NOT NULL""",
    ),
    "stream_looks": with_views(
        "vr",
        body=f""", j AS (
          SELECT *, seq * {PARTS} // (SELECT max(seq) + 1 FROM vr) AS part, TIMESTAMP '2024-01-02 20:00:00' + to_days(CAST(screening_key % 40 AS INTEGER)) + to_hours(screening_key % 7) AS starts_at,
                 CASE WHEN sold >= total AND NOT coalesce(lag(sold >= total) OVER (PARTITION BY screening_key ORDER BY seq), false) THEN 'held' ELSE 'recorded' END AS outcome FROM vr),
        n AS (SELECT *, epoch(starts_at) - epoch(at_ts) AS ahead FROM j QUALIFY row_number() OVER (PARTITION BY screening_key, part ORDER BY seq DESC) = 1),
        c AS (SELECT *, at_ts + to_minutes(CASE WHEN ahead <= 7200 THEN 10 WHEN ahead <= 43200 THEN 30 WHEN ahead <= 172800 THEN 120 ELSE 720 END) AS candidate, starts_at - INTERVAL 5 MINUTE AS last_chance FROM n),
        l AS (SELECT *, CASE WHEN ahead > 0 THEN CASE WHEN candidate > last_chance THEN greatest(at_ts, last_chance) ELSE candidate END END AS look FROM c)
        SELECT screening_key, seq, outcome, CASE WHEN outcome = 'held' AND look IS NOT NULL THEN least(look, at_ts + INTERVAL 5 MINUTE) ELSE look END AS look_at FROM l""",
    ),
    "stream_settle": with_views(
        "vr",
        body=_SETTLED
        + """
        SELECT screening_key, coalesce(sold, 0) AS sold, CASE WHEN at_ts IS NULL THEN 0 ELSE 120 END::BIGINT AS total,
               CASE WHEN at_ts IS NULL THEN 'missed' WHEN starts_at - at_ts <= INTERVAL 15 MINUTE THEN 'final' ELSE 'partial' END AS confidence,
               at_ts AS captured_at, starts_at + INTERVAL 30 MINUTE AS settled_at
        FROM l""",
    ),
    "stream_daily": with_views(
        "vr",
        body=_SETTLED
        + f""", g AS (
          SELECT screening_key % 5 AS film_id, coalesce(sold, 0) AS sold, CASE WHEN at_ts IS NULL THEN 0 ELSE 120 END AS total, CAST(starts_at - INTERVAL 5 HOUR AS DATE) AS day,
                 CASE WHEN screening_key % 5 <> 0 THEN screening_key % 5 * 10.0 + 100 ELSE {rules.DEFAULT_PRICE} END AS price,
                 CASE WHEN at_ts IS NULL THEN 'missed' WHEN starts_at - at_ts <= INTERVAL 15 MINUTE THEN 'final' ELSE 'partial' END AS c
          FROM l)
        SELECT day, film_id, CAST(sum(sold) AS BIGINT) AS sold, CAST(sum(total) AS BIGINT) AS capacity, count(*) AS screenings, CAST(sum(sold * price) AS DOUBLE) AS gross,
               count(*) FILTER (c = 'final') AS final, count(*) FILTER (c = 'partial') AS partial, count(*) FILTER (c = 'missed') AS missed
        FROM g WHERE day + INTERVAL 29 HOUR <= (SELECT max(starts_at) - INTERVAL {rules.FOLD_AFTER_DAYS} DAY FROM l) GROUP BY 1, 2""",
    ),
    "stream_old_hours": with_views(
        "ramp", body=f" SELECT * FROM ramp WHERE hour + INTERVAL 1 HOUR <= (SELECT max(hour) - INTERVAL {rules.RAMP_RETENTION_DAYS} DAY FROM ramp)"
    ),
}
ORACLES["stream_settle_fixed"] = ORACLES["stream_settle"]
