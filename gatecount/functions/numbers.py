"""Numeric column rules: rounding, ratios, counts read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatecount import rules


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity (``round`` sends -0.5 to -1)."""
    return F.floor(x + F.lit(0.5))


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is no whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def seats_from_ratio(capacity: Column, free_ratio: Column) -> Column:
    """Struct(sold, residual): seats sold from the share still free.

    ``residual`` is how far capacity x ratio lies from a whole seat; a large one
    means the capacity no longer explains the ratio.
    """
    free = capacity * free_ratio
    whole = round_half_up(free)
    sold = F.greatest(F.lit(0), F.least(capacity, capacity - whole)).cast("bigint")
    return F.struct(sold.alias("sold"), F.abs(free - whole).alias("residual"))


def clean_number(text: Column) -> Column:
    """Number printed with spaces between thousands and a decimal comma, else 0."""
    digits = F.replace(F.regexp_replace(text, r"[\s\u00A0]", ""), F.lit(","), F.lit("."))
    value = F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), digits.try_cast("double"))
    return F.coalesce(value, F.lit(0.0))


def admissions(settled_sold: Column, sold: Column) -> Column:
    """The settled figure when there is one, else the live one, else 0."""
    return F.coalesce(settled_sold, sold, F.lit(0)).cast("bigint")


def price(price_min: Column, default: float = rules.DEFAULT_PRICE) -> Column:
    return F.coalesce(price_min, F.lit(default))
