"""Streaming hourly sales with hold-and-confirm and looks, and streaming alerts, on Spark's keyed state.

What a key has to remember is a handful of numbers: the last reading taken, whether it was full, the last value recorded;
or the last ring. Keys share a value state by the bucket of their hash, and a bucket's readings of a micro-batch are worked
off side by side: a call into Python costs milliseconds, and shows have few readings each. Spark's state store keeps it per micro-batch and restores it after a failure, and
the results go through Spark's file sink, whose commit log lets a repeated micro-batch count once. Readers sum or pick
from the files (`ramp`, `looks`, `rings`).

Readings count in arrival order (``seq``, which grows with arrival) and are booked to the hour of the reading, so late
ones are never dropped; one that was taken before is passed over. A bucket's readings of one micro-batch are put in order
in one task: how many that can be is bounded by the source's rows per trigger. The keys of a bucket are read and written
together: more ``buckets`` make that less, and cost more calls.

Where shows have a start, an event-time timer (one per bucket) on the time of arrival fires when a look is due (and again at the regular
pace until the start, should no reading follow), and the state of a show goes when it is folded. The session must use
the RocksDB state store (`gatecount.streaming.settle.PROVIDER`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gatecount import rules

ROW = ("screening_key", "film_id", "seq", "at_ts", "sold", "total")
MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
#: kind 'sale': hour, film_id, sold. 'look': the newest reading of a micro-batch, its outcome and the next look.
#: 'due': a look whose time has come.
OUTPUT = "kind string, screening_key bigint, film_id bigint, hour timestamp_ntz, sold bigint, seq bigint, outcome string, look_at timestamp_ntz"
#: One entry per show of a bucket, sorted by key; and the bucket's timer, in milliseconds.
STATE = (
    "screening_key array<bigint>, seq array<bigint>, full array<bigint>, value array<bigint>, starts_us array<bigint>, "
    "look_us array<bigint>, timer_ms bigint"
)
#: Stands for null among integers, and for a time that never comes.
NONE = -(2**63)
NEVER = 2**63 - 1
#: Shows share a state by the hash of their key: what a call costs is paid per bucket and micro-batch, not per show.
BUCKETS = 1024
RINGS = "screening_key bigint, ring_at timestamp_ntz, ring_value bigint"


def _next_looks(starts: np.ndarray, now: np.ndarray) -> np.ndarray:
    """`gatecount.functions.times.next_look` for many shows, in microseconds; ``NONE`` once started."""
    ahead = starts - now
    pace = np.full(len(now), rules.FAR_LOOK_MINUTES * MINUTE)
    for within, step in reversed(rules.LOOK_TIERS):
        pace[ahead <= within * MINUTE] = step * MINUTE
    candidate, last_chance = now + pace, starts - rules.LAST_LOOK_LEAD_MINUTES * MINUTE
    return np.where(ahead > 0, np.where(candidate > last_chance, np.maximum(now, last_chance), candidate), NONE)


def _recheck_looks(starts: np.ndarray, now: np.ndarray) -> np.ndarray:
    regular = _next_looks(starts, now)
    return np.where(regular == NONE, NONE, np.minimum(regular, now + rules.RECHECK_MINUTES * MINUTE))


def _one(looks, starts: int, now: int) -> int | None:
    at = int(looks(np.array([starts]), np.array([now]))[0])
    return None if at == NONE else at


def next_look(starts: int, now: int) -> int | None:
    return _one(_next_looks, starts, now)


def recheck_look(starts: int, now: int) -> int | None:
    return _one(_recheck_looks, starts, now)


def _nullable(values: np.ndarray) -> pd.api.extensions.ExtensionArray:
    return pd.arrays.IntegerArray(values, values == NONE)


def _times(values: np.ndarray) -> np.ndarray:
    """Microseconds as instants; ``NONE`` is NaT."""
    return values.astype("datetime64[us]")


def _whole(rows: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> list[np.ndarray]:
    """A bucket's readings of the micro-batch, by column: by key and arrival, one row per key and number."""
    chunks = [[c[name].to_numpy() for name in columns] for c in rows]
    arrays = chunks[0] if len(chunks) == 1 else [np.concatenate(parts) for parts in zip(*chunks)]
    key, seq = arrays[0], arrays[1]
    order = np.lexsort((seq, key))
    key, seq = key[order], seq[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (seq[1:] != seq[:-1])
    return [a[order[new]] for a in arrays]


def _get(state, empty: tuple[int, ...]) -> list[np.ndarray]:
    """The columns of a bucket's state, one entry per key, sorted by the first, the key."""
    row = state.get()
    return [np.empty(0, np.int64) for _ in empty] if row is None else [np.array(c, np.int64) for c in row[: len(empty)]]


def _later(held: list[np.ndarray], arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The rows (key, seq, ..) that were not taken before."""
    key, seq = held[0], held[1]
    if not len(key):
        return [a[arrays[1] > -1] for a in arrays]
    at = np.minimum(np.searchsorted(key, arrays[0]), len(key) - 1)
    fresh = arrays[1] > np.where(key[at] == arrays[0], seq[at], -1)
    return [a[fresh] for a in arrays]


def _with_keys(held: list[np.ndarray], keys: np.ndarray, empty: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The state with an entry for each of ``keys``, and where these are; ``empty`` gives the columns of a new key."""
    merged = np.union1d(held[0], keys)
    at = np.searchsorted(merged, held[0])
    out = [merged]
    for column, nothing in zip(held[1:], empty[1:]):
        whole = np.full(len(merged), nothing, np.int64)
        whole[at] = column
        out.append(whole)
    return out, np.searchsorted(merged, keys)


class _Sales(StatefulProcessor):
    #: What a key without readings remembers: key, seq, full, value, starts_us, look_us.
    EMPTY = (NONE, -1, 0, NONE, NONE, NONE)

    def __init__(self, confirm: bool, keep_us: int):
        self.confirm, self.keep_us = confirm, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def _timer(self) -> int | None:
        row = self.last.get()
        return None if row is None else row[len(self.EMPTY)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = _get(self.last, self.EMPTY)
        keys, seq, at, film, sold, total, told = _later(held, _whole(rows, ("screening_key", "seq", "at_us", "film_id", "sold", "total", "starts_us")))
        if not len(keys):
            return
        if (at == NONE).any():
            raise ValueError("a reading without a time")
        # Rows are sorted by key and arrival: a show's rows are a run, from first to last.
        begins = np.ones(len(keys), bool)
        begins[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(keys)) - 1
        run = np.cumsum(begins) - 1
        held, mine = _with_keys(held, keys[first], self.EMPTY)
        _, seqs, fulls, values, starts, looks = held
        full = (total > 0) & (sold >= total)
        before = np.concatenate(([False], full[:-1]))
        before[first] = fulls[mine] == 1
        waits = full & ~before if self.confirm else np.zeros(len(keys), bool)
        yield from self._booked(keys, run, at, film, sold, ~waits, values, mine)
        # The newest start that a reading names.
        named = np.maximum.accumulate(np.where(told != NONE, np.arange(len(keys)), -1))[last]
        starts[mine] = np.where(named >= first, told[named], starts[mine])
        known = starts[mine] != NONE
        again = np.where(waits[last], _recheck_looks(starts[mine], at[last]), _next_looks(starts[mine], at[last]))
        looks[mine] = np.where(known, again, NONE)
        seqs[mine], fulls[mine] = seq[last], full[last]
        self._keep(held, self._timer())
        if known.any():
            newest = last[known]
            outcome = np.where(waits[newest], "held", "recorded").astype(object)
            yield self._out("look", keys[newest], film=film[newest], seq=seq[newest], outcome=outcome, look=looks[mine][known])

    def _booked(self, keys, run, at, film, sold, counts, values, mine) -> Iterator[pd.DataFrame]:
        """Rises between the readings that count, per show, hour and film; ``values`` get the last one of a show."""
        if not counts.any():
            return
        keys, run, hour, film, sold = keys[counts], run[counts], at[counts] // HOUR * HOUR, film[counts], sold[counts]
        begins = np.ones(len(run), bool)
        begins[1:] = run[1:] != run[:-1]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(run)) - 1
        before = np.concatenate(([NONE], sold[:-1]))
        before[first] = values[mine[run[first]]]
        if (sold[last] == NONE).any():
            raise ValueError("a show's last reading has no count")
        values[mine[run[last]]] = sold[last]
        up = np.flatnonzero((sold != NONE) & (before != NONE) & (sold > before))
        if not len(up):
            return
        up = up[np.lexsort((film[up], hour[up], run[up]))]
        changes = np.ones(len(up), bool)
        changes[1:] = (run[up][1:] != run[up][:-1]) | (hour[up][1:] != hour[up][:-1]) | (film[up][1:] != film[up][:-1])
        cells = np.flatnonzero(changes)
        rise = np.add.reduceat((sold - before)[up], cells)
        yield self._out("sale", keys[up][cells], film=film[up][cells], hour=hour[up][cells], sold=rise)

    def _out(self, kind: str, keys: np.ndarray, film=None, hour=None, sold=None, seq=None, outcome=None, look=None) -> pd.DataFrame:
        nothing = np.full(len(keys), NONE)
        whole = lambda v: nothing if v is None else v
        return pd.DataFrame(
            {
                "kind": kind,
                "screening_key": _nullable(keys),
                "film_id": _nullable(whole(film)),
                "hour": _times(whole(hour)),
                "sold": _nullable(whole(sold)),
                "seq": _nullable(whole(seq)),
                "outcome": np.full(len(keys), None, object) if outcome is None else outcome,
                "look_at": _times(whole(look)),
            }
        )

    def _due_ms(self, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """When each key's look and its fold are due, in milliseconds, rounded up; never: NEVER."""
        starts, looks = held[4], held[5]
        up = lambda us, when: np.where(when, -(-us // 1000), NEVER)
        return up(looks, looks != NONE), up(starts + self.keep_us, starts != NONE)

    def _keep(self, held: list[np.ndarray], timer: int | None, after: int | None = None) -> None:
        """Store a bucket, with one timer for whatever is due first; ``after``: a time that is being handled."""
        if not len(held[0]):
            self.last.clear()
            wanted = None
        else:
            look, fold = self._due_ms(held)
            wanted = int(min(look.min(), fold.min()))
            wanted = None if wanted == NEVER else wanted if after is None else max(wanted, after + 1)
            self.last.update((*[c.tolist() for c in held], wanted))
        if timer != wanted:
            if timer is not None and timer != after:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = _get(self.last, self.EMPTY)
        if not len(held[0]):
            return
        timer, fired, now = self._timer(), expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        look, fold = self._due_ms(held)
        due = np.flatnonzero((look <= now) & (look < fold))
        if len(due):
            keys, seqs, starts, looks = held[0][due], held[1][due], held[4][due], held[5][due]
            # No reading has come: the next try follows at the regular pace.
            again = _next_looks(starts, np.maximum(looks, now * 1000))
            held[5][due] = np.where(again > looks, again, NONE)
            yield self._out("due", keys, seq=seqs, look=looks)
        self._keep([c[fold > now] for c in held], timer, fired)

    def close(self) -> None:
        pass


class _Rings(StatefulProcessor):
    #: What a key without readings remembers: key, seq, and the time and value of its last ring.
    EMPTY = (NONE, -1, NONE, NONE)

    def __init__(self, step: int, quiet_us: int):
        self.step, self.quiet_us = step, quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "screening_key array<bigint>, seq array<bigint>, at_us array<bigint>, value array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = _get(self.ring, self.EMPTY)
        keys, seq, at, sold = _later(held, _whole(rows, ("screening_key", "seq", "at_us", "sold")))
        if not len(keys):
            return
        # Only the newest reading of a key counts.
        newest = np.append(keys[1:] != keys[:-1], True)
        keys, seq, at, sold = keys[newest], seq[newest], at[newest], sold[newest]
        if (at == NONE).any() or (sold == NONE).any():
            raise ValueError("a reading without a time or a count")
        held, mine = _with_keys(held, keys, self.EMPTY)
        _, seqs, since, value = held
        rings = (since[mine] == NONE) | ((sold - value[mine] >= self.step) & (at - since[mine] >= self.quiet_us))
        seqs[mine] = seq
        since[mine[rings]], value[mine[rings]] = at[rings], sold[rings]
        self.ring.update(tuple(c.tolist() for c in held))
        if rings.any():
            yield pd.DataFrame({"screening_key": _nullable(keys[rings]), "ring_at": _times(at[rings]), "ring_value": sold[rings]})

    def close(self) -> None:
        pass


def _bucketed(readings: DataFrame, buckets: int, columns: dict[str, Column], *more: str) -> DataFrame:
    """Integer columns without nulls, so that pandas keeps them whole, and the bucket of the key."""
    whole = [F.coalesce(c.cast("bigint"), F.lit(NONE)).alias(name) for name, c in columns.items()]
    bucket = F.pmod(F.xxhash64("screening_key"), F.lit(buckets)).alias("bucket")
    return readings.where(F.col("seq").isNotNull()).select(bucket, *whole, *more)


def _columns(*names: str) -> dict[str, Column]:
    return {name: F.col(name) for name in names} | {"at_us": F.unix_micros(F.col("at_ts").cast("timestamp"))}


def sales_stream(
    readings: DataFrame,
    confirm: bool = True,
    clock: str | None = None,
    delay: str = "2 hours",
    keep_days: int = rules.FOLD_AFTER_DAYS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rows of ``OUTPUT`` for a stream of readings with the columns of ``ROW``.

    ``confirm``: a full plan counts when it is seen twice in a row. With ``clock``, the name of the column with the time
    of arrival, readings also carry ``starts_at`` (null where unknown): looks are then planned and fall due, and a show
    is forgotten ``keep_days`` after its start. ``buckets`` must stay the same for the life of a checkpoint.
    """
    columns = _columns("screening_key", "film_id", "seq", "sold", "total")
    mode = "None"
    if clock is None:
        rows = _bucketed(readings, buckets, columns | {"starts_us": F.lit(None)})
    else:
        mode = "EventTime"
        timed = readings.withColumn("clock", F.col(clock).cast("timestamp"))
        starts = F.unix_micros(F.col("starts_at").cast("timestamp"))
        rows = _bucketed(timed, buckets, columns | {"starts_us": starts}, "clock").withWatermark("clock", delay)
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Sales(confirm, keep_days * DAY), outputStructType=OUTPUT, outputMode="append", timeMode=mode
    )


def rings_stream(
    readings: DataFrame, step: int = rules.ALERT_STEP, quiet_minutes: int = rules.ALERT_QUIET_MINUTES, buckets: int = BUCKETS
) -> DataFrame:
    """Rings: the first sight, then a rise of ``step`` since the last ring and a quiet time over.

    One check per micro-batch: of each key only its newest reading counts, as for a reader who looks at every refresh.
    """
    rows = _bucketed(readings, buckets, _columns("screening_key", "seq", "sold"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Rings(step, quiet_minutes * MINUTE), outputStructType=RINGS, outputMode="append", timeMode="None"
    )


def write(rows: DataFrame, root: str, by: str | None = None, **trigger) -> StreamingQuery:
    """To Parquet files under ``root``, through Spark's file sink."""
    writer = rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    return (writer.partitionBy(by) if by else writer).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What the stream has written and committed so far."""
    return spark.read.schema(schema).parquet(f"{root}/out")


def ramp(spark: SparkSession, root: str) -> DataFrame:
    """Hourly sales per film: the increments of all micro-batches, summed."""
    sales = read(spark, root, OUTPUT).where("kind = 'sale'")
    return sales.groupBy("hour", "film_id").agg(F.sum("sold").cast("bigint").alias("sold"))


def looks(spark: SparkSession, root: str) -> DataFrame:
    """Per micro-batch and show: the newest reading's outcome and when to look again."""
    return read(spark, root, OUTPUT).where("kind = 'look'").select("screening_key", "seq", "outcome", "look_at")


def due(spark: SparkSession, root: str) -> DataFrame:
    """Looks whose time came before another reading did."""
    return read(spark, root, OUTPUT).where("kind = 'due'").select("screening_key", "seq", "look_at")
