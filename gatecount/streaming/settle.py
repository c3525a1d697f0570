"""Streaming settlement: one final value per item, some time after its start.

The state of an item is its last reading; an event-time timer fires when the grace
time after the start is over, emits the value with its confidence and leaves a mark
that expires. Input rows are schedule rows (no reading) and readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gatecount import rules
from gatecount.functions.times import minutes

OUTPUT = "screening_key bigint, sold bigint, total bigint, confidence string, captured_at timestamp, settled_at timestamp, starts_at timestamp"
STATE = "starts_us bigint, seq bigint, at_us bigint, sold bigint, total bigint, settled boolean, listed bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Settle(StatefulProcessor):
    def __init__(self, grace_us: int, final_us: int, ttl_ms: int):
        self.grace_us, self.final_us, self.ttl_ms = grace_us, final_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        if state is not None and state[5]:
            return
        starts, seq, at, sold, total = state[:5] if state is not None else (None, -1, None, None, None)
        listed = state[6] if state is not None else -1
        before = starts
        # The newest row says when the show starts; readings are judged by the start known with them.
        for chunk in rows:
            newest = chunk.loc[chunk["seq"].idxmax()]
            if int(newest["seq"]) > listed:
                listed, starts = int(newest["seq"]), int(newest["starts_us"])
            read = chunk[chunk["sold"].notna() & (chunk["at_us"] <= starts + self.grace_us) & (chunk["seq"] > seq)]
            if len(read):
                newest = read.loc[read["seq"].idxmax()]
                seq, at = int(newest["seq"]), int(newest["at_us"])
                sold, total = int(newest["sold"]), int(newest["total"])
        if state is None and timerValues.getCurrentWatermarkInMs() >= self._due(starts) + self.ttl_ms:
            return  # settled and forgotten long ago
        self.last.update((starts, seq, at, sold, total, False, listed))
        if before != starts:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(starts))
        return
        yield  # a generator without rows

    def _due(self, starts: int) -> int:
        return -(-(starts + self.grace_us) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        starts, seq, at, sold, total, settled, listed = self.last.get()
        if settled:
            # The second timer: nothing about this item can arrive any more.
            self.last.clear()
            return
        if at is None:
            confidence = "missed"
        else:
            confidence = "final" if starts - at <= self.final_us else "partial"
        self.last.update((starts, seq, at, sold, total, True, listed))
        self.handle.registerTimer(fired + self.ttl_ms)
        yield pd.DataFrame(
            {
                "screening_key": [key[0]],
                "sold": [sold or 0],
                "total": [total or 0],
                "confidence": [confidence],
                "captured_at": [pd.NaT if at is None else pd.Timestamp(at, unit="us")],
                "settled_at": [pd.Timestamp(fired, unit="ms")],
                "starts_at": [pd.Timestamp(starts, unit="us")],
            }
        )

    def close(self) -> None:
        pass


def settle_stream(
    rows: DataFrame,
    delay: str = "2 hours",
    clock: str = "arrived_at",
    grace_minutes: int = rules.SETTLE_GRACE_MINUTES,
    keep_days: int = rules.FOLD_AFTER_DAYS,
) -> DataFrame:
    """Settled rows of a stream with screening_key, starts_at, event_at, seq, sold, total and ``clock``.

    ``event_at`` is the reading's time, or for a schedule row (sold null) the time it
    was listed. Readings count in arrival order (``seq``), the newest schedule row says
    when a show starts, and a moved show is settled at its new time.

    ``clock`` names the column that drives the timers, and them alone: the time of arrival,
    which only grows. A late reading is then folded like any other while its show is not
    settled, and one whose own clock is ahead moves nobody's timer. (Spark drops rows whose
    ``clock`` is behind its newest value by more than ``delay``; with the readings' own
    times that would be every late reading.) The session must use the RocksDB state store
    (see ``PROVIDER``).
    """
    timed = rows.select(
        "screening_key",
        F.col(clock).cast("timestamp").alias("clock"),
        F.unix_micros(F.col("starts_at").cast("timestamp")).alias("starts_us"),
        F.unix_micros(F.col("event_at").cast("timestamp")).alias("at_us"),
        "seq",
        "sold",
        "total",
    ).withWatermark("clock", delay)
    processor = _Settle(grace_minutes * 60_000_000, rules.FINAL_LEAD_MINUTES * 60_000_000, keep_days * 86_400_000)
    return timed.groupBy("screening_key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
    )


def settle_fixed_stream(
    rows: DataFrame, delay_minutes: int = 120, clock: str = "arrived_at", grace_minutes: int = rules.SETTLE_GRACE_MINUTES
) -> DataFrame:
    """What `settle_stream` gives for shows whose start never moves, on Spark's own session windows: no Python, no timers.

    A row opens a session from its arrival until the show is due: ``grace_minutes`` after the start and ``delay_minutes``
    more, in which late readings still arrive. All rows of a show end at the same instant, so they are one session with
    one state row, and it is written once, when the newest arrival reaches that end. A row that arrives later opens
    nothing; a show that is never listed or read in time is therefore not settled at all, so list each show beforehand.
    Rows with a null start or arrival are left out. Where a show is announced with several starts, the latest of them
    ends its session, and readings are judged by the start they come with; `settle_stream` follows moves.
    """
    starts, at = F.col("starts_at").cast("timestamp"), F.col("event_at").cast("timestamp")
    counts = F.col("sold").isNotNull() & (F.col("seq") >= 0) & (at <= starts + minutes(grace_minutes))
    timed = rows.select(
        "screening_key",
        F.col(clock).cast("timestamp").alias("clock"),
        starts.alias("starts_at"),
        (starts + minutes(grace_minutes + delay_minutes)).alias("_due"),
        F.when(counts, F.col("seq")).alias("_seq"),
        F.struct(at.alias("captured_at"), "sold", "total").alias("_read"),
    ).withWatermark("clock", "0 seconds")
    left = F.concat((F.unix_micros("_due") - F.unix_micros("clock")).cast("string"), F.lit(" microseconds"))
    last = timed.where("_due > clock").groupBy("screening_key", F.session_window("clock", left)).agg(
        F.max_by("_read", "_seq").alias("_last"), F.max("starts_at").alias("starts_at")
    )
    captured = F.col("_last.captured_at")
    grade = F.when(captured.isNull(), "missed").when(captured >= F.col("starts_at") - minutes(rules.FINAL_LEAD_MINUTES), "final")
    return last.select(
        "screening_key",
        F.coalesce("_last.sold", F.lit(0)).cast("bigint").alias("sold"),
        F.coalesce("_last.total", F.lit(0)).cast("bigint").alias("total"),
        grade.otherwise("partial").alias("confidence"),
        captured.alias("captured_at"),
        (F.col("starts_at") + minutes(grace_minutes)).alias("settled_at"),
        "starts_at",
    )
