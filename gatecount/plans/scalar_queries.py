"""Queries over single-row rules: tags, time, numbers, headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecount.functions import numbers as N
from gatecount.functions import text as X
from gatecount.functions import times as T
from gatecount.plans import views as V

NBSP = " "


def _tags():
    words = F.array(*[F.lit(w) for w in ("3d", "IMAX ", " 4dx", "atmos", "comfort", "ScreenX", "70MM")])
    k = F.col("p_partkey")
    return F.array(
        F.get(words, (k % 7).cast("int")), F.get(words, (k % 5).cast("int")), F.upper(F.get(words, (F.col("p_size") % 7).cast("int")))
    )


def normalize_formats(spark, sf_dir):
    formats = X.normalize_formats(_tags())
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(formats, "+").alias("formats"), X.format_label(formats).alias("label")
    )


def split_version(spark, sf_dir):
    tail = F.get(F.array(F.lit(" DABING"), F.lit("  titulky "), F.lit(" "), F.lit(" dabing 3d")), (F.col("p_partkey") % 4).cast("int"))
    split = X.split_version(F.concat(F.lit(" "), "p_name", tail))
    return V.table(spark, sf_dir, "part").select("p_partkey", split.alias("s")).select("p_partkey", "s.title", "s.version")


def language_version(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda *w: F.get(F.array(*[F.lit(x) for x in w]), (k % len(w)).cast("int"))
    return V.table(spark, sf_dir, "part").select(
        "p_partkey",
        X.version_from_tags(F.array(pick("4K", "Dabing ", "Premiéra"), pick("Titulky", "HIT", "dabing", "x"))).alias("by_tags"),
        X.version_from_languages(pick("cs", None, "en"), pick(None, "cs", "", "sk", "cs")).alias("by_languages"),
        X.version_from_label(pick("DAB", "tit", "ORIG", None)).alias("by_label"),
    )


def origin_of(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda *w: F.get(F.array(*[F.lit(x) for x in w]), (k % len(w)).cast("int"))
    origin = X.origin_of(
        pick("CZE", " cz ", "USA", "", None), F.col("p_name"), F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "Other")
    )
    return V.table(spark, sf_dir, "part").select("p_partkey", origin.alias("origin"))


def local_to_utc(spark, sf_dir):
    """Wall clocks as text; a fifth of them fall on the days the clocks change."""
    k = F.col("o_orderkey")
    day = (
        F.when(k % 10 == 0, F.lit("1998-10-25").cast("timestamp_ntz"))
        .when(k % 10 == 1, F.lit("1998-03-29").cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate").cast("timestamp_ntz"))
    )
    wall = day + F.expr("make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT))")
    text = F.when(k % 2 == 0, F.date_format(wall, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"))
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.alias("wall"), T.local_to_utc(T.parse_naive(text)).alias("utc")
    )


def business_day(spark, sf_dir):
    wall = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT))")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", T.business_day(wall).alias("day"))


def local_date(spark, sf_dir):
    """Instants spread over the year, in local time."""
    at = F.col("ts").cast("timestamp_ntz") + F.expr("make_dt_interval(CAST(event_id % 366 AS INT))")
    return V.table(spark, sf_dir, "events").select(
        "event_id", T.local_date(at).alias("day"), T.wall_clock(at).alias("wall"), T.business_day(T.utc_to_local(at)).alias("cinema_day")
    )


def week_start(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", T.week_start(day).alias("monday"), F.date_add(T.week_start(day), 6).alias("sunday")
    )


def seats_from_ratio(spark, sf_dir):
    """Ratios with four decimals of known capacities, a few of them stale or out of range."""
    size = (F.lit(30) + F.lit(13) * (F.col("l_suppkey") % 11)).cast("bigint")
    ratio = F.round((size - F.col("l_quantity")) / size, 4)
    line = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", size.alias("capacity"), ratio.alias("ratio"))
    read = N.seats_from_ratio(F.col("capacity"), F.col("ratio"))
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "capacity", "ratio", read["sold"].alias("sold"), F.round(read["residual"], 4).alias("residual"),
        (read["residual"] > 0.05).alias("stale"),
    )


def clean_number(spark, sf_dir):
    """Prices printed with a blank between thousands and a decimal comma, some of them not numbers."""
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = F.floor(cents / 100).cast("bigint"), cents % 100
    blank = F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit(NBSP))
    text = F.concat(
        F.floor(whole / 1000).cast("string"), blank, F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(","), F.lpad(part.cast("string"), 2, "0")
    )
    printed = F.when(k % 13 == 0, F.lit("n/a")).when(k % 13 == 1, F.lit(" ")).otherwise(text)
    return V.table(spark, sf_dir, "orders").select("o_orderkey", N.clean_number(printed).alias("number"))


def serial_date(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    serial = (F.datediff(day, F.lit("1899-12-30").cast("date")) * F.when(k % 7 == 0, 2).otherwise(1)).cast("double") + (k % 24) / F.lit(24.0)
    printed = F.when(k % 5 == 0, F.date_format(day, "d.M.yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    caption = F.concat(F.lit("TOP 20 - VÍKEND OD: "), F.date_format(day, "d. M. yyyy"), F.lit(" - CR"))
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", T.serial_date(serial).alias("from_serial"), T.printed_date(printed).alias("from_print"),
        T.caption_date(caption).alias("from_caption"),
    )


def headline_split(spark, sf_dir):
    """Whole documents as headlines: the publisher follows the last dash."""
    k = F.col("doc_id")
    text = F.concat(
        F.when(k % 9 == 0, F.lit("Recenze: ")).when(k % 9 == 1, F.lit("Hodnocení ")).otherwise(F.lit("")),
        F.col("text"), F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" - "), F.col("source"))),
    )
    headline = F.when(k % 25 == 0, F.concat(F.lit("short - "), F.col("source"))).otherwise(text)
    split = X.split_headline(headline)
    rows = V.table(spark, sf_dir, "documents").select("doc_id", split.alias("s"))
    return rows.select(
        "doc_id", F.md5("s.title").alias("title"), "s.publisher", X.is_review(F.col("s.title")).alias("is_review")
    )


QUERIES = {
    f.__name__: f
    for f in (
        normalize_formats,
        split_version,
        language_version,
        origin_of,
        local_to_utc,
        business_day,
        local_date,
        week_start,
        seats_from_ratio,
        clean_number,
        serial_date,
        headline_split,
    )
}

_WORDS = "['3d', 'IMAX ', ' 4dx', 'atmos', 'comfort', 'ScreenX', '70MM']"
_WALL = """CASE o_orderkey % 10 WHEN 0 THEN TIMESTAMP '1998-10-25' WHEN 1 THEN TIMESTAMP '1998-03-29' ELSE o_orderdate END
           + to_minutes(o_orderkey % 1440)"""

ORACLES = {
    "normalize_formats": f"""
        WITH t AS (SELECT p_partkey, unnest([{_WORDS}[p_partkey % 7 + 1], {_WORDS}[p_partkey % 5 + 1], {_WORDS}[p_size % 7 + 1]]) AS tag FROM part),
        c AS (SELECT DISTINCT p_partkey, CASE lower(trim(tag)) WHEN '3d' THEN '3D' WHEN 'imax' THEN 'IMAX' WHEN '4dx' THEN '4DX'
                      WHEN '70mm' THEN '70mm' WHEN 'screenx' THEN 'ScreenX' END AS f FROM t)
        SELECT p_partkey, coalesce(string_agg(f, '+' ORDER BY f), '') AS formats, coalesce(string_agg(f, ' + ' ORDER BY f), '2D') AS label
        FROM c GROUP BY 1""",
    "split_version": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN p_name || ' dabing 3d' ELSE p_name END AS title,
               CASE p_partkey % 4 WHEN 0 THEN 'dabing' WHEN 1 THEN 'titulky' END AS version FROM part""",
    "language_version": """
        SELECT p_partkey,
               CASE WHEN p_partkey % 3 = 1 THEN 'dabing' WHEN p_partkey % 4 = 0 THEN 'titulky' WHEN p_partkey % 4 = 2 THEN 'dabing' END AS by_tags,
               CASE WHEN p_partkey % 3 = 0 THEN 'dabing' WHEN p_partkey % 5 IN (1, 3, 4) THEN 'titulky' END AS by_languages,
               CASE p_partkey % 4 WHEN 0 THEN 'dabing' WHEN 1 THEN 'titulky' END AS by_label
        FROM part""",
    "origin_of": """
        SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'cz' WHEN 1 THEN 'cz' WHEN 2 THEN 'foreign'
               ELSE CASE WHEN p_partkey % 3 < 2 THEN 'foreign' ELSE 'cz' END END AS origin FROM part""",
    "local_to_utc": f"""
        WITH w AS (SELECT o_orderkey, {_WALL} AS t FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(t, '%Y-%m-%d %H:%M') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S') END AS wall,
               (t AT TIME ZONE 'Europe/Prague') AT TIME ZONE 'UTC' AS utc FROM w""",
    "business_day": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) - CASE WHEN (o_orderkey % 1440) // 60 < 5 THEN 1 ELSE 0 END AS day FROM orders""",
    "local_date": """
        WITH l AS (SELECT event_id, ((ts + to_days(CAST(event_id % 366 AS INTEGER))) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague' AS t FROM events)
        SELECT event_id, CAST(t AS DATE) AS day, strftime(date_trunc('second', t), '%Y-%m-%dT%H:%M:%S') AS wall,
               CAST(t - INTERVAL 5 HOUR AS DATE) AS cinema_day FROM l""",
    "week_start": """
        SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 AS INTEGER) AS DATE) AS monday,
               CAST(CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 AS INTEGER) + 6 AS DATE) AS sunday FROM orders""",
    "seats_from_ratio": """
        WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(30 + 13 * (l_suppkey % 11) AS BIGINT) AS capacity,
                          round((30 + 13 * (l_suppkey % 11) - l_quantity) / (30 + 13 * (l_suppkey % 11)), 4) AS ratio FROM lineitem)
        SELECT *, CAST(greatest(0, least(capacity, capacity - floor(capacity * ratio + 0.5))) AS BIGINT) AS sold,
               round(abs(capacity * ratio - floor(capacity * ratio + 0.5)), 4) AS residual,
               abs(capacity * ratio - floor(capacity * ratio + 0.5)) > 0.05 AS stale FROM f""",
    "clean_number": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 13 < 2 THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) / 100.0::DOUBLE END AS number FROM orders""",
    "serial_date": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS from_serial,
               CASE WHEN o_orderkey % 5 <> 0 OR (day(o_orderdate) >= 10 AND month(o_orderdate) >= 10) THEN CAST(o_orderdate AS DATE) END AS from_print,
               CAST(o_orderdate AS DATE) AS from_caption FROM orders""",
    "headline_split": """
        WITH h AS (
          SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN 'short - ' || source
                 ELSE CASE doc_id % 9 WHEN 0 THEN 'Recenze: ' WHEN 1 THEN 'Hodnocení ' ELSE '' END || text || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' - ' || source END END AS h
          FROM documents),
        s AS (SELECT doc_id, h, string_split(h, ' - ') AS p FROM h),
        q AS (SELECT doc_id, h, p[-1] AS tail, length(h) - length(p[-1]) - 3 AS cut FROM s)
        SELECT doc_id, md5(CASE WHEN cut > 20 THEN h[:cut] ELSE h END) AS title, CASE WHEN cut > 20 THEN tail ELSE '' END AS publisher,
               regexp_matches(CASE WHEN cut > 20 THEN h[:cut] ELSE h END, '(?i)(^|[^\\p{L}\\p{N}_])(recenze|kritika|hodnocen[íi]|dojmy)($|[^\\p{L}\\p{N}_])') AS is_review
        FROM q""",
}
