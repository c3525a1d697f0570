"""The engine's input tables, derived from the supplied star schema.

Each view exists twice: as a DataFrame for the engine and as a SQL fragment for
the oracle. ``with_views`` puts the fragments a query needs before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

NOW = "1998-06-17 12:00:00"
TODAY = "1998-06-17"
EVENTS_NOW = "2024-01-20 15:30:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_number(brand: str = "p_brand"):
    return F.regexp_extract(brand, r"(\d+)$", 1).cast("bigint")


# --- readings -----------------------------------------------------------------


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter readings: a user is a screening, the event value its seats sold."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("screening_key"),
        (F.col("user_id") % 5).alias("film_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("at_ts"),
        F.least(F.floor("value"), F.lit(120)).cast("bigint").alias("sold"),
        F.lit(120).cast("bigint").alias("total"),
    )


VR = """vr AS (
  SELECT user_id AS screening_key, user_id % 5 AS film_id, event_id AS seq, ts AS at_ts,
         least(CAST(floor(value) AS BIGINT), 120) AS sold, CAST(120 AS BIGINT) AS total
  FROM events)"""

# Recorded hourly sales of the readings, written with a plain lag.
VRAMP = """deltas AS (
  SELECT film_id, at_ts, sold - lag(sold) OVER (PARTITION BY screening_key ORDER BY seq) AS delta FROM vr),
ramp AS (
  SELECT date_trunc('hour', at_ts) AS hour, film_id, CAST(sum(delta) AS BIGINT) AS sold
  FROM deltas WHERE delta > 0 GROUP BY 1, 2)"""


# --- screenings ---------------------------------------------------------------


def screenings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screenings: a line item is a show of its brand's film in its supplier's hall."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    film = brand_number()
    total = (F.lit(30) + F.lit(10) * (F.col("l_suppkey") % 4)).cast("bigint")
    start = F.col("l_shipdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 3 * l_linenumber + 5)")
    key = F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.col("l_quantity").cast("bigint").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
        F.date_format("l_shipdate", "yyyyMMdd"),
    )
    rows = joined.select(
        key.alias("screening_key"),
        F.col("l_returnflag").alias("chain"),
        film.alias("film_id"),
        F.when(film % 8 == 0, "event").alias("kind"),
        F.col("l_suppkey").alias("hall_key"),
        F.col("s_name").alias("hall"),
        F.col("n_name").alias("cinema"),
        F.split("p_name", " ").alias("formats"),
        start.alias("starts_at"),
        F.least(F.col("l_quantity").cast("bigint"), total).alias("sold"),
        total.alias("total"),
        F.when(film % 5 != 0, F.col("p_retailprice")).alias("price_min"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
    )
    lead = F.expr("make_dt_interval(0, 0, CAST(l_partkey % 40 - 5 AS INT))")
    look = F.expr("make_dt_interval(0, CAST(l_partkey % 50 AS INT))")
    return rows.select(
        "screening_key",
        "chain",
        "film_id",
        "kind",
        "hall_key",
        "hall",
        "cinema",
        "formats",
        "starts_at",
        (F.col("starts_at") - F.expr("INTERVAL '5' HOUR")).cast("date").alias("day"),
        "sold",
        "total",
        (F.col("sold") >= F.col("total")).alias("sold_out"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("starts_at") - lead).alias("captured_at"),
        F.when(F.col("l_partkey") % 3 != 0, F.col("starts_at") - look).alias("next_look_at"),
        "price_min",
    )


VS = f"""vs0 AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT),
                   CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d')) AS screening_key,
         l_returnflag AS chain, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS film_id,
         l_suppkey AS hall_key, s_name AS hall, n_name AS cinema, p_name, p_retailprice, l_partkey, l_suppkey,
         l_shipdate + to_hours(3 * l_linenumber + 5) AS starts_at,
         CAST(30 + 10 * (l_suppkey % 4) AS BIGINT) AS total, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey),
vs AS (
  SELECT screening_key, chain, film_id, CASE WHEN film_id % 8 = 0 THEN 'event' END AS kind, hall_key, hall, cinema,
         replace(p_name, ' ', ' + ') AS format, starts_at, CAST(starts_at - INTERVAL 5 HOUR AS DATE) AS day,
         least(CAST(l_quantity AS BIGINT), total) AS sold, total,
         least(CAST(l_quantity AS BIGINT), total) >= total AS sold_out,
         CASE WHEN l_suppkey % 10 <> 0 THEN starts_at - to_minutes(l_partkey % 40 - 5) END AS captured_at,
         CASE WHEN l_partkey % 3 <> 0 THEN starts_at - to_hours(l_partkey % 50) END AS next_look_at,
         CASE WHEN film_id % 5 <> 0 THEN p_retailprice END AS price_min
  FROM vs0),
vsb AS (
  SELECT *, sold * coalesce(price_min, 205.0) AS gross, starts_at <= TIMESTAMP '{NOW}' AS started,
         day = DATE '{TODAY}' AS is_today
  FROM vs WHERE kind IS NULL AND day BETWEEN DATE '1998-06-15' AND DATE '1998-06-21'),
vset AS (
  SELECT *, CASE WHEN starts_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE THEN
              CASE WHEN captured_at IS NULL THEN 'missed'
                   WHEN starts_at - captured_at <= INTERVAL 15 MINUTE THEN 'final' ELSE 'partial' END END AS confidence
  FROM vs)"""


# --- weekly and annual tables ----------------------------------------------------


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly report lines: a brand's sales per week, one run per calendar quarter."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # A film's week has nearly as many suppliers as lines, so a hash aggregate per supplier would hold every line. The
    # lines are sorted by supplier instead, which spills, and the first of each is counted; the sums combine before they move.
    lines = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        brand_number().alias("film_id"),
        F.date_trunc("quarter", "l_shipdate").cast("date").alias("quarter"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("weekend_from"),
        "l_suppkey",
        "l_quantity",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
    )
    of_supplier = Window.partitionBy("film_id", "quarter", "weekend_from", "l_suppkey").orderBy("l_suppkey")
    sums = (
        lines.withColumn("_nth", F.row_number().over(of_supplier))
        .groupBy("film_id", "quarter", "weekend_from")
        .agg(
            (F.sum("l_quantity") * 100).cast("bigint").alias("weekend_admissions"),
            F.sum("cents").alias("cents"),
            F.count(F.when((F.col("_nth") == 1) & F.col("l_suppkey").isNotNull(), 1)).alias("cinemas"),
        )
    )
    run = Window.partitionBy("film_id", "quarter").orderBy("weekend_from")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    ranked = Window.partitionBy("weekend_from").orderBy(F.desc("weekend_admissions"), "film_id", "quarter")
    start = F.first("weekend_from").over(upto)
    return sums.select(
        "film_id",
        F.concat(F.col("film_id").cast("string"), F.lit("/"), F.date_format("quarter", "yyyy-MM")).alias("run"),
        F.year(F.date_add("weekend_from", 3)).cast("bigint").alias("year"),
        F.weekofyear("weekend_from").cast("bigint").alias("week"),
        "weekend_from",
        F.row_number().over(ranked).cast("bigint").alias("rank"),
        F.concat(F.lit("Film "), F.col("film_id").cast("string")).alias("title"),
        F.when(F.col("film_id") % 2 == 0, "CZE").otherwise("USA").alias("country"),
        F.when(F.col("film_id") % 2 == 0, "cz").otherwise("foreign").alias("origin"),
        (F.datediff("weekend_from", start) / 7 + F.col("film_id") % 3 - 1).cast("bigint").alias("week_of_run"),
        "cinemas",
        "weekend_admissions",
        (F.col("cents") / F.lit(100.0)).alias("weekend_gross"),
        F.sum("weekend_admissions").over(upto).alias("total_admissions"),
        (F.sum("cents").over(upto) / F.lit(100.0)).alias("total_gross"),
    )


VW = """vw0 AS (
  SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS film_id,
         CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS weekend_from,
         CAST(sum(l_quantity) * 100 AS BIGINT) AS weekend_admissions,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents,
         count(DISTINCT l_suppkey) AS cinemas
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
vw AS (
  SELECT film_id, film_id || '/' || strftime(quarter, '%Y-%m') AS run,
         CAST(isoyear(weekend_from) AS BIGINT) AS year, CAST(weekofyear(weekend_from) AS BIGINT) AS week, weekend_from,
         row_number() OVER (PARTITION BY weekend_from ORDER BY weekend_admissions DESC, film_id, quarter) AS rank,
         'Film ' || film_id AS title, CASE WHEN film_id % 2 = 0 THEN 'CZE' ELSE 'USA' END AS country,
         CASE WHEN film_id % 2 = 0 THEN 'cz' ELSE 'foreign' END AS origin,
         CAST((weekend_from - min(weekend_from) OVER (PARTITION BY film_id, quarter)) // 7 + film_id % 3 - 1 AS BIGINT) AS week_of_run,
         CAST(cinemas AS BIGINT) AS cinemas, weekend_admissions, CAST(cents AS DOUBLE) / 100.0 AS weekend_gross,
         CAST(sum(weekend_admissions) OVER (PARTITION BY film_id, quarter ORDER BY weekend_from) AS BIGINT) AS total_admissions,
         CAST(sum(cents) OVER (PARTITION BY film_id, quarter ORDER BY weekend_from) AS DOUBLE) / 100.0 AS total_gross
  FROM vw0)"""


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual lists: some titles shouted, some known only here, some without a premiere."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sums = (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(brand_number().alias("film"), F.year("l_shipdate").cast("bigint").alias("year"))
        .agg(
            (F.sum("l_quantity") * 30).cast("bigint").alias("admissions"),
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
            F.min("l_shipdate").cast("date").alias("first_day"),
        )
    )
    shouted = F.when(F.col("year") % 2 == 0, "FILM ").otherwise("Film ")
    prefix = F.when(F.col("film") % 7 == 0, "Only listed ").otherwise(shouted)
    ranked = Window.partitionBy("year").orderBy(F.desc("admissions"), "film")
    return sums.select(
        "year",
        F.row_number().over(ranked).cast("bigint").alias("rank"),
        F.concat(prefix, F.col("film").cast("string")).alias("title"),
        F.when((F.col("film") + F.col("year")) % 3 == 0, F.col("first_day")).alias("premiere"),
        "admissions",
        (F.col("cents") / F.lit(100.0)).alias("gross"),
    )


VA = """va0 AS (
  SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS film, CAST(year(l_shipdate) AS BIGINT) AS year,
         CAST(sum(l_quantity) * 30 AS BIGINT) AS admissions,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, CAST(min(l_shipdate) AS DATE) AS first_day
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
va AS (
  SELECT year, row_number() OVER (PARTITION BY year ORDER BY admissions DESC, film) AS rank,
         CASE WHEN film % 7 = 0 THEN 'Only listed ' WHEN year % 2 = 0 THEN 'FILM ' ELSE 'Film ' END || film AS title,
         CASE WHEN (film + year) % 3 = 0 THEN first_day END AS premiere, admissions, CAST(cents AS DOUBLE) / 100.0 AS gross
  FROM va0)"""


# --- titles -------------------------------------------------------------------


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part under the spelling of two sources; the second never has the original title."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"))
    first = part.select(
        (F.col("p_partkey") * 2).alias("position"),
        F.concat(F.lit("a:"), F.col("p_partkey").cast("string")).alias("alias_key"),
        F.concat(F.initcap(name), F.lit(" 3D")).alias("title"),
        F.when(
            F.col("p_partkey") % 3 != 0,
            F.concat(F.lit("The "), F.col("p_name"), F.lit(" "), (F.floor(F.col("p_size") / 10)).cast("string")),
        ).alias("original_title"),
    )
    second = part.select(
        (F.col("p_partkey") * 2 + 1).alias("position"),
        F.concat(F.lit("b:"), F.col("p_partkey").cast("string")).alias("alias_key"),
        F.concat(F.translate(F.upper(name), "AEIOU", "ÁÉÍÓŮ"), F.lit(": TITULKY")).alias("title"),
        F.lit(None).cast("string").alias("original_title"),
    )
    return first.unionByName(second)


VT = """vt AS (
  SELECT p_partkey * 2 AS position, 'a:' || p_partkey AS alias_key,
         array_to_string(list_transform(string_split(p_name || ' ' || p_size, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' 3D' AS title,
         CASE WHEN p_partkey % 3 <> 0 THEN 'The ' || p_name || ' ' || (p_size // 10) END AS original_title
  FROM part
  UNION ALL
  SELECT p_partkey * 2 + 1, 'b:' || p_partkey, translate(upper(p_name || ' ' || p_size), 'AEIOU', 'ÁÉÍÓŮ') || ': TITULKY', NULL
  FROM part),
vtn AS (
  SELECT position, alias_key, title, original_title,
         trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(title)),
           '\\b(dabing|dabovan[eya]|titulky|tit\\.?)\\b', ' ', 'g'), '\\b(2d|3d|4dx|imax|screenx|4k|hfr|vip|premium)\\b', ' ', 'g'),
           '\\b(cz|sk|en|ua)\\s*(dab|tit)\\b', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS local_key,
         trim(regexp_replace(lower(original_title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS original_key
  FROM vt),
vti AS (
  SELECT position, alias_key, title, original_title, coalesce(original_key, local_key) AS match_key,
         replace(coalesce(original_key, local_key), ' ', '') AS tight_key, local_key
  FROM vtn)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored catalogue that knows the titles up to size 20, half of them without the original."""
    from gatecount.operators.resolve import with_identity

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    known = part.groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("k")).where("p_size <= 20")
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"))
    return with_identity(
        known.select(
            (F.col("k") + 1).alias("film_id"),
            F.initcap(name).alias("title"),
            F.when(
                F.col("k") % 2 == 1,
                F.concat(F.lit("The "), F.col("p_name"), F.lit(" "), F.floor(F.col("p_size") / 10).cast("string")),
            ).alias("original_title"),
        )
    )


VC = """vc0 AS (SELECT p_name, p_size, min(p_partkey) AS k FROM part GROUP BY 1, 2),
vc AS (
  SELECT k + 1 AS film_id,
         array_to_string(list_transform(string_split(p_name || ' ' || p_size, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
         CASE WHEN k % 2 = 1 THEN 'The ' || p_name || ' ' || (p_size // 10) END AS original_title,
         lower(p_name || ' ' || p_size) AS local_key,
         lower(CASE WHEN k % 2 = 1 THEN 'The ' || p_name || ' ' || (p_size // 10) ELSE p_name || ' ' || p_size END) AS match_key,
         replace(lower(CASE WHEN k % 2 = 1 THEN 'The ' || p_name || ' ' || (p_size // 10) ELSE p_name || ' ' || p_size END), ' ', '') AS tight_key
  FROM vc0 WHERE p_size <= 20)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


_FRAGMENTS = {"vr": VR, "ramp": f"{VR},\n{VRAMP}", "vs": VS, "vw": VW, "va": VA, "vt": VT, "vc": VC}


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named fragments, then the query; ``body`` may start with more CTEs and a comma."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(_FRAGMENTS[n] for n in names) + body
