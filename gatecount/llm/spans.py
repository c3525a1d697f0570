"""Spans of regular expressions in whole texts, as DataFrame expressions.

A span is a struct (start, kind, end, value): code points, end exclusive, kind a position in a list of names. `found`
walks a text once: each match is anchored where the one before ended, together with the gap before it, and the running
length of gaps and matches gives the places. Failing matches are dropped, but what they covered stays used up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def nothing() -> Column:
    return F.array().cast(SPAN)


def found(text: Column, kind: int, pattern: str, keep: Callable[[Column], Column], run: str = "") -> Column:
    """The spans of `pattern` whose text passes `keep`.

    `run`: a character class such that a match which does not follow another one directly starts only where the
    character before is not of the class. It spares trying each character of a long run in turn.
    """
    gap = f"(|(?s:.*?)[^{run}])" if run else "((?s:.*?))"
    anchored = F.lit(rf"\G{gap}({pattern})")
    parts = F.arrays_zip(
        F.regexp_extract_all(text, anchored, 1).alias("gap"), F.regexp_extract_all(text, anchored, 2).alias("match")
    )

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["match"].alias("value"))
        spans = F.when(keep(part["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing().alias("spans")), step)["spans"]
    first = f"(?<![{run}])" if run else ""
    return F.when(text.rlike(f"{first}(?:{pattern})"), walked).otherwise(nothing())


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined, by start, then kind."""
    name = F.array(*map(F.lit, names))
    texts = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(texts, ",")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of `others`."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def remainders(spans: Column, others: Column) -> Column:
    """What `others` (they may overlap) leave of each span, in pieces."""
    ordered = F.array_sort(others)

    def pieces(s: Column) -> Column:
        cuts = F.filter(ordered, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"]))

        def piece(start: Column, end: Column) -> Column:
            own = F.substring(s["value"], start - s["start"] + 1, F.greatest(end - start, F.lit(0)))
            return F.struct(start.alias("start"), s["kind"].alias("kind"), end.alias("end"), own.alias("value"))

        def step(state: Column, o: Column) -> Column:
            grown = F.concat(state["out"], F.array(piece(state["at"], o["start"])))
            out = F.when(o["start"] > state["at"], grown).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], o["end"]).alias("at"), out.alias("out"))

        def close(state: Column) -> Column:
            last = F.concat(state["out"], F.array(piece(state["at"], s["end"])))
            return F.when(state["at"] < s["end"], last).otherwise(state["out"])

        walked = F.aggregate(cuts, F.struct(s["start"].alias("at"), nothing().alias("out")), step, close)
        return F.when(F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])), walked).otherwise(F.array(s))

    return F.flatten(F.transform(spans, pieces))


def replaced(text: Column, spans: Column, by: str) -> Column:
    """The text with each span (they may overlap) replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        out = F.when(fresh, F.concat(state["out"], between, F.lit(by))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    walked = F.aggregate(F.array_sort(spans), start, step)
    rest = F.substring(text, walked["at"] + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(walked["out"], rest)).otherwise(text)
