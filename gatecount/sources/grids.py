"""Report sheets as a long table of cells: file, row, col, text, num.

Tables are found by the words above them, never by fixed columns alone. Finding
the layout reduces each file to a few rows; the cells are then joined to that
small table and folded into records by one partial aggregate on (file, row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecount import rules
from gatecount.functions import numbers as N
from gatecount.functions import text as X
from gatecount.functions import times as T
from gatecount.operators.official import parse_annual_file, parse_week_file


def cell_text() -> Column:
    return F.coalesce(X.trim_all(F.col("text")), F.col("num").cast("string"), F.lit(""))


def cell_number() -> Column:
    return F.coalesce(F.col("num"), N.clean_number(F.col("text")))


def sheet_heads(cells: DataFrame) -> DataFrame:
    """One row per file with the text cells of its leading rows.

    The array is bounded by the sheet's width times the leading rows; everything
    about a file's layout is read from it without going back to the cells.
    """
    top = cells.where(F.col("row") <= rules.WEEK_HEADER_ROWS).select(
        "file", F.struct("row", "col", cell_text().alias("text")).alias("c")
    )
    return top.groupBy("file").agg(F.sort_array(F.collect_list("c")).alias("cells"))


def week_layout(cells: DataFrame) -> DataFrame:
    """Rows (file, weekend_from, header_row, name, col): where each column of each file is.

    The header is the first of the leading rows that names the title column; files
    without admissions columns have no layout.
    """
    head_col, head_word = rules.WEEK_HEADER
    headers = F.filter(
        "cells",
        lambda c: (c["row"] < rules.WEEK_HEADER_ROWS) & (c["col"] == head_col) & (c["text"] == head_word),
    )
    captions = F.filter("cells", lambda c: (c["row"] < 6) & (c["col"] == 0))
    dates = F.transform(captions, lambda c: T.caption_date(c["text"]))
    found = (
        sheet_heads(cells)
        .withColumns(
            {"header_row": F.get(headers, F.lit(0))["row"], "weekend_from": F.array_max(dates)}
        )
        .where(F.col("header_row").isNotNull())
    )
    rows = found.select(
        "file",
        "weekend_from",
        "header_row",
        F.filter("cells", lambda c: c["row"] == F.col("header_row")).alias("upper"),
        F.filter("cells", lambda c: c["row"] == F.col("header_row") + 1).alias("lower"),
    )

    def place(first: str, second: str, prefix: bool, leftmost: bool) -> Column:
        def below(c: Column) -> Column:
            match = lambda d: (d["col"] == c["col"]) & (
                d["text"].startswith(second) if prefix else d["text"] == second
            )
            return F.exists("lower", match)

        hits = F.transform(F.filter("upper", lambda c: (c["text"] == first) & below(c)), lambda c: c["col"])
        return F.array_min(hits) if leftmost else F.array_max(hits)

    # The first cinema count is meant, of any other repeated label the last.
    places = {
        name: place(first, second, prefix, name == "cinemas")
        for name, first, second, prefix in rules.WEEK_COLUMNS
    }
    places |= {name: F.lit(col) for name, col in rules.WEEK_FIXED_COLUMNS.items()}
    placed = rows.select("file", "weekend_from", "header_row", *[c.alias(n) for n, c in places.items()])
    complete = placed.where(F.col("weekend_admissions").isNotNull() & F.col("total_admissions").isNotNull())
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("int").alias("col")) for n in places])
    long = complete.select("file", "weekend_from", "header_row", F.explode(pairs).alias("p"))
    return long.select("file", "weekend_from", "header_row", "p.name", "p.col").where(F.col("col").isNotNull())


def _text_of(name: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("name") == name, F.col("_text"))), F.lit(""))


def _number_of(name: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("name") == name, F.col("_num"))), F.lit(0.0))


def weekly_table(cells: DataFrame, strict: bool = True) -> DataFrame:
    """Report rows of every weekly sheet, with year and week of the file name (null for another name).

    Lines without rank or title are not report rows. A file whose columns cannot be
    found is an error; with ``strict`` off it is left out, and ``unrecognised_files``
    names it.
    """
    layout = week_layout(cells)
    body = cells.join(layout, ["file", "col"]).where(F.col("row") >= F.col("header_row") + 2)
    long = body.select(
        "file", "row", "weekend_from", "name", cell_text().alias("_text"), cell_number().alias("_num")
    )
    records = long.groupBy("file", "row", "weekend_from").agg(
        _number_of("rank").cast("bigint").alias("rank"),
        *[_text_of(c).alias(c) for c in ("title", "distributor", "country")],
        *[
            _number_of(c).cast("bigint").alias(c)
            for c in ("week_of_run", "cinemas", "weekend_admissions", "total_admissions")
        ],
        *[_number_of(c).alias(c) for c in ("weekend_gross", "total_gross")],
    )
    found = records.where((F.col("rank") != 0) & (F.col("title") != ""))
    if strict:
        # The condition needs the layout's side of the join, so no file is judged before it.
        known = week_layout(cells).select("file").distinct().withColumn("_known", F.lit(True))
        problem = F.raise_error(F.concat(F.lit("no weekly table in "), F.col("file"))).cast("boolean")
        every = cells.select("file").distinct().join(known, "file", "left")
        rejects = every.where(F.when(F.col("_known").isNull(), problem).otherwise(F.lit(False))).select("file")
        found = found.unionByName(rejects, allowMissingColumns=True)
    named = found.withColumn("_named", parse_week_file(F.col("file")))
    return named.select("*", F.col("_named.year").alias("year"), F.col("_named.week").alias("week")).drop("_named")


def unrecognised_files(cells: DataFrame) -> DataFrame:
    """Files without a weekly layout, to be reported instead of dropped in silence."""
    return cells.select("file").distinct().join(week_layout(cells).select("file"), "file", "left_anti")


def annual_layout(cells: DataFrame) -> DataFrame:
    """(file, header_row, lifetime_col); a sheet that lacks either is an error."""
    (c0, w0), (c1, w1) = rules.ANNUAL_HEADER
    texts = cells.select("file", "row", "col", cell_text().alias("_t"))
    left = texts.where((F.col("col") == c0) & (F.col("_t") == w0)).select("file", "row")
    right = texts.where((F.col("col") == c1) & (F.col("_t") == w1)).select("file", "row")
    header = left.join(right, ["file", "row"], "left_semi").groupBy("file").agg(F.min("row").alias("header_row"))
    captions = (
        texts.where(F.col("_t").rlike(rules.LIFETIME_CAPTION_PATTERN))
        .join(header, "file")
        .where(F.col("row") < F.col("header_row"))
        .groupBy("file")
        .agg(F.min(F.struct("row", "col")).alias("_first"))
    )
    every = cells.select("file").distinct().join(header, "file", "left").join(captions, "file", "left")

    def required(value: Column, what: str) -> Column:
        failure = F.raise_error(F.concat(F.lit(f"annual sheet has no {what}: "), F.col("file"))).cast("int")
        return F.when(value.isNull(), failure).otherwise(value)

    return every.select(
        "file",
        required(F.col("header_row"), "header row").alias("header_row"),
        required(F.col("_first.col"), "lifetime columns").alias("lifetime_col"),
    )


def annual_table(cells: DataFrame) -> DataFrame:
    """Rows of annual sheets, with the figures of the lifetime block and the year of the file name."""
    body = cells.join(annual_layout(cells), "file").where(F.col("row") > F.col("header_row"))
    name = F.lit(None).cast("string")
    for column, col in rules.ANNUAL_COLUMNS.items():
        name = F.when(F.col("col") == col, column).otherwise(name)
    for i, column in enumerate(rules.ANNUAL_LIFETIME):
        name = F.when(F.col("col") == F.col("lifetime_col") + i, column).otherwise(name)
    long = body.select(
        "file", "row", name.alias("name"), cell_text().alias("_text"), cell_number().alias("_num"), F.col("num").alias("_raw")
    ).where(F.col("name").isNotNull())
    serial = F.max(F.when(F.col("name") == "premiere", F.col("_raw")))
    records = long.groupBy("file", "row").agg(
        _number_of("rank").cast("bigint").alias("rank"),
        *[_text_of(c).alias(c) for c in ("title", "original_title", "distributor", "country")],
        T.serial_date(serial).alias("premiere"),
        _number_of("screenings").cast("bigint").alias("screenings"),
        _number_of("admissions").cast("bigint").alias("admissions"),
        _number_of("gross").alias("gross"),
    )
    return records.where((F.col("rank") != 0) & (F.col("title") != "")).withColumn("year", parse_annual_file(F.col("file")))
