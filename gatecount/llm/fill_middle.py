"""Fill-in-the-middle transformation by one match with repeated captures.

A text is cut into units (by default lines, each with its line end). One fullmatch of `(unit)*` with the regex library
keeps every repetition of its group: the ends of the captures say how many units there are and where each ends, so that
both cuts are looked up by number and the text is never walked unit by unit. Where a document is cut and in which order
its parts are written follows from four numbers hashed from its key, so the result depends on neither partitions nor
the order of rows. Nothing is shuffled; a task holds one batch of texts.

Forms: `plain` is the text itself; `psm` is `<P>`prefix`<S>`suffix`<M>`middle; `spm` is `<S>`suffix`<P>`prefix`<M>`middle.
`restored` gives the text back from output and form alone.

Defined cases: a null text is empty; an empty text, one that holds a mark, and one left out by `rate` is plain, its
lengths null; a null key is hashed as no digits; rows of one key and text give equal results; an empty table gives none.
A text that units do not cover from end to end is an error (the default unit covers any text).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecount.llm.common import ROWS_AT_ONCE, fresh, quoted

LINE = r"[^\n]*\n|[^\n]+"
#: The marks before prefix, suffix and middle. None may begin with the end of another (`restored` relies on it).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
COLUMNS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32: the first four groups of eight digits of the SHA-256 of `seed:key`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]


def transformed(
    docs: DataFrame, key: Column, keep: list[str], unit: str = LINE, rate: int = 100, spm: int = 50, seed: int = 7, text: str = "text"
) -> DataFrame:
    """The columns `keep` and n (units), form, prefix_chars, middle_chars, output.

    `rate` percent of the documents are transformed, `spm` percent of these with the suffix first. Columns of `keep`
    that clash with the new ones give way to them.
    """
    keep = [c for c in keep if c.lower() not in COLUMNS]
    kept = docs.select(*quoted(keep)).schema.fields
    own = [fresh(docs, name) for name in ("whole", "h1", "h2", "h3", "h4")]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(*[c.alias(o) for c, o in zip([whole, *draws(key, seed)], own)], *quoted(keep))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [f.name for f in kept] + COLUMNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        fullmatch = regex.compile(f"({unit})*").fullmatch

        def cut(t: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
            matched = fullmatch(t)
            if matched is None:
                raise ValueError("a text is not made of units")
            ends = matched.ends(1)
            n = len(ends)
            if not t or any(m in t for m in MARKS) or h3 % 100 >= rate:
                return n, "plain", None, None, t
            first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = ends[first - 1] if first else 0, ends[last - 1] if last else 0
            before, middle, after = t[:a], t[a:b], t[b:]
            if h4 % 100 < spm:
                return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
            return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                rows = [cut(*row) for row in zip(*(c.to_pylist() for c in some.columns[:5]))]
                made = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*some.columns[5:], *made], names=names)

    new = zip(COLUMNS, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()))
    return source.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, k) for n, k in new)]))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from output and form: the marks cut the output into its parts, since no transformed text holds one."""
    part = F.split(F.col(f"`{output}`"), "|".join(MARKS))
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    kind = F.col(f"`{form}`")
    return F.when(kind == "plain", F.col(f"`{output}`")).when(kind == "psm", psm).otherwise(spm)
