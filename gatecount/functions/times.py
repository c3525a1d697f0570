"""Local time, cinema days, look schedules and confidence.

An instant is a UTC wall clock in ``timestamp_ntz``: it does not move with the
session time zone, and intervals between instants are exact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatecount import rules


def minutes(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' MINUTE")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' HOUR")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' DAY")


def instant(value: str | dt.datetime) -> Column:
    """A literal instant; ``now`` is always passed in, never read from a clock."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def parse_naive(text: Column) -> Column:
    """Wall clock written without an offset; anything else is an error."""
    part = [F.regexp_extract(text, rules.WALL_CLOCK_PATTERN, i) for i in range(1, 7)]
    seconds = F.when(part[5] == "", F.lit("00")).otherwise(part[5])
    stamp = F.concat_ws(
        " ",
        F.concat_ws("-", *part[:3]),
        F.concat_ws(":", part[3], part[4], seconds),
    ).cast("timestamp_ntz")
    failure = F.raise_error(F.concat(F.lit("not a date and time of day: "), text))
    return (
        F.when(text.isNull(), F.lit(None).cast("timestamp_ntz"))
        .when(text.rlike(rules.WALL_CLOCK_PATTERN), stamp)
        .otherwise(failure.cast("timestamp_ntz"))
    )


def local_to_utc(wall: Column, zone: str = rules.LOCAL_ZONE) -> Column:
    """Instant of a local wall clock; an hour that occurs twice means its second pass."""
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    second = first + hours(1)
    return F.when(utc_to_local(second, zone) == wall, second).otherwise(first)


def utc_to_local(at: Column, zone: str = rules.LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def business_day(wall: Column, cutoff_hours: int = rules.BUSINESS_DAY_CUTOFF_HOURS) -> Column:
    """The day a show belongs to: small hours count to the evening before."""
    return (wall - hours(cutoff_hours)).cast("date")


def local_date(at: Column, zone: str = rules.LOCAL_ZONE) -> Column:
    return utc_to_local(at, zone).cast("date")


def wall_clock(at: Column, zone: str = rules.LOCAL_ZONE) -> Column:
    return F.date_format(utc_to_local(at, zone), "yyyy-MM-dd'T'HH:mm:ss")


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def hour_bucket(at: Column) -> Column:
    return F.date_trunc("hour", at).cast("timestamp_ntz")


def next_look(starts_at: Column, now: Column) -> Column:
    """When to read again: tighter towards the start, never past it, null once started."""
    ahead = starts_at - now
    candidate = now + minutes(rules.FAR_LOOK_MINUTES)
    for within, step in reversed(rules.LOOK_TIERS):
        candidate = F.when(ahead <= minutes(within), now + minutes(step)).otherwise(candidate)
    last_chance = starts_at - minutes(rules.LAST_LOOK_LEAD_MINUTES)
    pulled = F.when(candidate > last_chance, F.greatest(now, last_chance)).otherwise(candidate)
    return F.when(starts_at > now, pulled)


def recheck_look(starts_at: Column, now: Column) -> Column:
    """A second look at a doubtful reading, never later than the regular one."""
    regular = next_look(starts_at, now)
    return F.when(regular.isNotNull(), F.least(regular, now + minutes(rules.RECHECK_MINUTES)))


def settle_confidence(starts_at: Column, captured_at: Column) -> Column:
    return (
        F.when(captured_at.isNull(), "missed")
        .when(starts_at - captured_at <= minutes(rules.FINAL_LEAD_MINUTES), "final")
        .otherwise("partial")
    )


def printed_date(text: Column) -> Column:
    """``dd.mm.yyyy`` and nothing else, else null."""
    return F.when(text.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_date(text, "dd.MM.yyyy"))


def caption_date(caption: Column, pattern: str = rules.WEEKEND_CAPTION_PATTERN) -> Column:
    """Day, month and year captured by a caption pattern, else null."""
    day, month, year = (F.regexp_extract(caption, pattern, i) for i in (1, 2, 3))
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(caption.rlike(pattern), F.try_to_date(text, "yyyy-MM-dd"))


def serial_date(serial: Column) -> Column:
    """Spreadsheet day number (day 0 = 1899-12-30), accepted in 20000..60000."""
    days_in = F.floor(serial).cast("int")
    return F.when(serial.between(20000, 60000), F.date_add(F.lit("1899-12-30").cast("date"), days_in))


def expected_weekend(today: Column) -> Column:
    """Opening Thursday of the last weekend that is over on ``today``."""
    return F.date_sub(week_start(today), 4)
