"""Queries over titles and keyed upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatecount.functions import text as X
from gatecount.functions import times as T
from gatecount.operators import arrival
from gatecount.operators import resolve as E
from gatecount.operators.ordered import top_per_key
from gatecount.plans import views as V
from gatecount.plans.views import with_views
from gatecount.sources import snapshots


def normalize_title(spark, sf_dir):
    return V.titles(spark, sf_dir).select("position", X.normalize_title(F.col("title")).alias("normalized"))


def film_identity(spark, sf_dir):
    return E.with_identity(V.titles(spark, sf_dir)).select("position", *E.KEYS, "title", "original_title")


def _aliases(spark, sf_dir):
    """Economy parts were seen before, under a film the catalogue knows."""
    films = V.catalogue(spark, sf_dir).select("film_id", "title")
    part = V.table(spark, sf_dir, "part").where("p_type = 'ECONOMY'")
    title = F.initcap(F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string")))
    keyed = part.select(F.concat(F.lit("a:"), F.col("p_partkey").cast("string")).alias("alias_key"), title.alias("title"))
    return keyed.join(films, "title").select("alias_key", "film_id")


def resolve_entities(spark, sf_dir):
    resolved, _ = E.resolve_entities(V.titles(spark, sf_dir), V.catalogue(spark, sf_dir), _aliases(spark, sf_dir))
    return resolved


def resolved_catalogue(spark, sf_dir):
    _, films = E.resolve_entities(V.titles(spark, sf_dir), V.catalogue(spark, sf_dir), _aliases(spark, sf_dir))
    return films.select("film_id", "match_key", "tight_key", "local_key", "original_title")


def _in_order(spark, sf_dir):
    return arrival.resolve_in_order(V.titles(spark, sf_dir), V.catalogue(spark, sf_dir), _aliases(spark, sf_dir))


def resolve_in_order(spark, sf_dir):
    """Every title under its film as a matcher finds it that takes one title after the other."""
    return _in_order(spark, sf_dir)[0]


def catalogue_in_order(spark, sf_dir):
    return _in_order(spark, sf_dir)[1].select("film_id", "match_key", "tight_key", "local_key", "original_title")


def _report_lines(spark, sf_dir):
    """Stored report lines under both spellings; some unlinked, some linked to a wrong film."""
    rows = V.titles(spark, sf_dir)
    return rows.select(
        "position",
        F.concat(F.lit("  "), F.when(F.col("position") % 4 == 0, F.upper("title")).otherwise(F.col("title"))).alias("title"),
        F.when(F.col("position") % 5 != 0, F.col("position") % 40 + 2).alias("film_id"),
    )


def relink(spark, sf_dir):
    out = E.relink(_report_lines(spark, sf_dir), V.catalogue(spark, sf_dir))
    return out.select("position", "film_id", "changed")


def first_wins_lookup(spark, sf_dir):
    """A listing with several entries per normalised title."""
    listing = V.titles(spark, sf_dir).select(
        "position", "title", F.concat(F.lit("/film/"), "alias_key").alias("path")
    )
    films = V.catalogue(spark, sf_dir).select("film_id", "title")
    return E.first_wins_lookup(films, listing).select("film_id", "listing_position", "listing_path")


def _doubled(spark, sf_dir):
    """A catalogue in which every part is a film: the same title comes many times."""
    part = V.table(spark, sf_dir, "part")
    name = F.concat(F.initcap("p_name"), F.lit(" "), (F.col("p_size") % 10).cast("string"))
    original = F.when(F.col("p_partkey") % 4 == 3, F.concat(F.lit("The "), F.col("p_name")))
    rows = part.select(
        (F.col("p_partkey") + 1).alias("film_id"),
        name.alias("title"),
        original.alias("original_title"),
        F.when(F.col("p_partkey") % 5 == 0, "event").alias("kind"),
        F.when(F.col("p_partkey") % 6 == 5, F.col("p_retailprice")).alias("rating"),
    )
    return E.with_identity_by_title(rows)


def duplicate_map(spark, sf_dir):
    return E.duplicate_map(_doubled(spark, sf_dir))


def merge_duplicates(spark, sf_dir):
    merged = E.merge_films(_doubled(spark, sf_dir))
    return merged.select("film_id", "title", "original_title", "match_key", "kind", "rating")


def remapped_ramp(spark, sf_dir):
    """Sales per month and film after duplicate films became one."""
    line = V.table(spark, sf_dir, "lineitem")
    ramp = line.groupBy(
        F.date_trunc("month", "l_shipdate").cast("date").alias("month"), (F.col("l_partkey") + 1).alias("film_id")
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sold"))
    return E.remap(ramp, E.duplicate_map(_doubled(spark, sf_dir)), sums=["sold"])


def upsert_halls(spark, sf_dir):
    supplier = V.table(spark, sf_dir, "supplier")
    stored = supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("hall_key"),
        F.col("s_nationkey").cast("bigint").alias("cinema_key"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") + 30).alias("capacity"),
        F.lit(None).cast("string").alias("seatplan_id"),
    )
    incoming = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("hall_key"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_p"),
        "l_partkey",
    )
    incoming = incoming.select(
        "hall_key",
        (F.col("_p") * 1000000 + F.col("l_partkey")).alias("position"),
        (F.col("l_partkey") % 25).alias("cinema_key"),
        F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("Hall "), F.col("l_partkey").cast("string"))).alias("name"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey").cast("string")).alias("seatplan_id"),
    )
    return E.upsert_halls(stored, incoming)


def _order_screenings(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '20' HOUR")
    return orders.select(
        F.col("o_orderkey").alias("screening_key"),
        F.col("o_custkey").alias("film_id"),
        (F.col("o_custkey") % 100).alias("hall_key"),
        start.alias("starts_at"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.array("o_orderstatus").alias("formats"),
        F.lit(None).cast("string").alias("lang"),
        (F.col("o_orderkey") % 2 == 0).alias("sold_out"),
        F.floor("o_totalprice").cast("bigint").alias("sold"),
    )


def _order_changes(spark, sf_dir):
    """Two refreshes per row: the first names the language, the second moves the start."""
    base = _order_screenings(spark, sf_dir).where("day >= DATE '1997-01-01'").drop("sold")
    first = base.withColumns({"position": F.col("screening_key") * 2, "lang": F.lit("dabing")})
    moved = F.col("starts_at") + F.expr("make_dt_interval(0, 0, CAST(screening_key % 2 * 600 AS INT))")
    second = base.withColumns(
        {
            "position": F.col("screening_key") * 2 + 1,
            "film_id": F.col("film_id") + 1,
            "lang": F.lit("titulky"),
            "starts_at": moved,
            "day": (moved - F.expr("INTERVAL '5' HOUR")).cast("date"),
            "formats": F.array(F.lit("3D"), F.lit("IMAX")),
            "sold_out": ~F.col("sold_out"),
        }
    )
    return first.unionByName(second)


def upsert_merge(spark, sf_dir):
    stored = _order_screenings(spark, sf_dir).where("day < DATE '2000-01-01'")
    out = E.upsert_screenings(stored, _order_changes(spark, sf_dir))
    return out.withColumn("formats", F.array_join("formats", "+"))


def upsert_replace(spark, sf_dir):
    """Cinemas are replaced as a whole by their last incoming row."""
    nation = V.table(spark, sf_dir, "nation")
    stored = nation.select(F.col("n_nationkey").cast("bigint").alias("cinema_key"), F.col("n_name").alias("name"))
    customer = V.table(spark, sf_dir, "customer")
    incoming = customer.select(
        F.col("c_nationkey").cast("bigint").alias("cinema_key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("position")
    )
    return E.upsert_replace(stored, incoming, "cinema_key")


def reschedule(spark, sf_dir):
    stored = _order_screenings(spark, sf_dir)
    urgent = V.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("screening_key"))
    shift = F.expr("make_dt_interval(0, CAST(screening_key % 5 * 7 AS INT))")
    schedule = stored.join(urgent, "screening_key", "left_semi").select("screening_key", (F.col("starts_at") + shift).alias("new_start"))
    return E.reschedule(stored, schedule, T.instant("1998-06-17 12:00:00"))


def flag_by_tag(spark, sf_dir):
    """Films = brands, titles = parts; some parts carry the tag of the other programme."""
    part = V.table(spark, sf_dir, "part")
    tagged = part.select(
        F.col("p_partkey").alias("title_id"),
        F.array("p_type", F.when((F.col("p_size") == 7) & (F.col("p_partkey") % 2 == 0), "ALTERNATIVNÍ program").otherwise(F.lit("Premiéra"))).alias("properties"),
    )
    titles = part.select(F.col("p_partkey").alias("title_id"), V.brand_number().alias("film_id"))
    films = titles.select("film_id").distinct().withColumn("kind", F.when(F.col("film_id") % 6 == 0, "event"))
    return E.flag_by_tag(films, tagged, titles)


def horizon_filter(spark, sf_dir):
    events = V.screenings(spark, sf_dir).select("screening_key", "hall_key", "starts_at")
    halls = V.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("hall_key"), F.col("s_nationkey").cast("bigint").alias("cinema_key")
    )
    return E.horizon_filter(events, halls, T.instant(V.NOW)).select("screening_key", "hall_key", "cinema_key", "starts_at")


def sample_per_key(spark, sf_dir):
    events = V.screenings(spark, sf_dir).where(F.col("starts_at") > T.instant(V.NOW))
    rows = events.select(F.col("hall_key").alias("title_id"), F.col("screening_key").alias("event_id"), "starts_at")
    return E.sample_per_key(rows, "title_id")


def union_last_wins(spark, sf_dir):
    """Three scans of the orders' events, each seeing a part of them, the last one rules."""
    orders = V.table(spark, sf_dir, "orders")
    scans = [
        orders.where(F.col("o_orderstatus") != status).select(
            (F.col("o_custkey")).alias("event_id"), F.col("o_orderkey").alias("position"), F.lit(i).cast("bigint").alias("scan"), "o_orderstatus"
        )
        for i, status in enumerate("FOP")
    ]
    return E.union_last_wins(scans, "event_id")


def source_priority(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    films = part.select(
        F.col("p_partkey").alias("film_id"), F.when(F.col("p_partkey") % 2 == 0, F.lit(1.0)).alias("rating")
    )
    first = part.where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("film_id"), F.col("p_retailprice").alias("rating"))
    second = part.where("p_size < 20").select(
        F.col("p_partkey").alias("film_id"), F.col("p_size").cast("double").alias("rating")
    )
    return E.source_priority(films, [first, second], "rating").withColumn("source", F.col("source").cast("bigint"))


def schema_backfill(spark, sf_dir):
    """Nations of an old layout next to customers of the new one, and the next free id."""
    from pyspark.sql import types as Y

    layout = Y.StructType(
        [
            Y.StructField("id", Y.LongType()),
            Y.StructField("name", Y.StringType()),
            Y.StructField("segment", Y.StringType()),
            Y.StructField("balance", Y.DoubleType()),
        ]
    )
    old = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    new = V.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 100).alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )
    defaults = {"segment": "NONE"}
    every = snapshots.backfill(old, layout, defaults).unionByName(snapshots.backfill(new, layout, defaults))
    following = snapshots.next_id(every, "id").select("next_id")
    return every.withColumn("next_id", following.scalar())


def headline_topk(spark, sf_dir):
    """Newest headlines per feed, one per text: documents are articles, sources feeds."""
    from gatecount.sources.markup import newest_headlines

    rows = V.table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang").alias("feed"),
        F.col("doc_id").alias("item_no"),
        F.col("text").alias("title"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(CAST(doc_id * 37 % 401 AS INT))")).alias("published_at"),
    )
    return newest_headlines(rows, "feed").select("feed", "item_no", "published_at", F.md5("title").alias("headline"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_title,
        film_identity,
        resolve_entities,
        resolved_catalogue,
        resolve_in_order,
        catalogue_in_order,
        relink,
        first_wins_lookup,
        duplicate_map,
        merge_duplicates,
        remapped_ramp,
        upsert_halls,
        upsert_merge,
        upsert_replace,
        reschedule,
        flag_by_tag,
        horizon_filter,
        sample_per_key,
        union_last_wins,
        source_priority,
        schema_backfill,
        headline_topk,
    )
}

# Batch resolution: cascade, lessons, then connected groups by transitive closure.
_RESOLVE = """, al AS (
  SELECT 'a:' || p_partkey AS alias_key, vc.film_id FROM part JOIN vc ON vc.local_key = lower(p_name || ' ' || p_size) WHERE p_type = 'ECONOMY'),
rw AS (SELECT vti.*, al.film_id AS alias_id FROM vti LEFT JOIN al USING (alias_key)),
di AS (
  SELECT match_key, tight_key, local_key, min(position) AS pos, arg_min(original_title, position) FILTER (original_title IS NOT NULL) AS original_title,
         min(position) FILTER (original_title IS NOT NULL) AS taught
  FROM rw WHERE alias_id IS NULL GROUP BY 1, 2, 3),
m1 AS (
  SELECT di.*, coalesce((SELECT min(film_id) FROM vc WHERE vc.match_key = di.match_key), (SELECT min(film_id) FROM vc WHERE vc.tight_key = di.tight_key),
                        (SELECT min(film_id) FROM vc WHERE vc.local_key = di.local_key)) AS cat FROM di),
le AS (
  SELECT cat AS film_id, arg_min(m1.original_title, taught) AS original_title, arg_min(m1.match_key, taught) AS match_key, arg_min(m1.tight_key, taught) AS tight_key
  FROM m1 JOIN vc ON vc.film_id = m1.cat WHERE vc.original_title IS NULL AND taught IS NOT NULL GROUP BY 1),
m2 AS (
  SELECT m1.match_key, m1.tight_key, m1.local_key, pos, original_title, taught,
         coalesce(cat, (SELECT min(film_id) FROM le WHERE le.match_key = m1.match_key), (SELECT min(film_id) FROM le WHERE le.tight_key = m1.tight_key)) AS cat
  FROM m1),
fr AS (SELECT * FROM m2 WHERE cat IS NULL),
reach AS (
  SELECT pos AS root, pos AS node FROM fr
  UNION
  SELECT r.root, b.pos FROM reach r JOIN fr a ON a.pos = r.node JOIN fr b ON b.tight_key = a.tight_key OR b.local_key = a.local_key),
lb AS (SELECT node AS pos, min(root) AS label FROM reach GROUP BY 1),
gr AS (SELECT label, (SELECT max(film_id) FROM vc) + dense_rank() OVER (ORDER BY label) AS film_id FROM (SELECT DISTINCT label FROM lb)),
ids AS (
  SELECT match_key, tight_key, local_key, coalesce(cat, gr.film_id) AS film_id
  FROM m2 LEFT JOIN lb ON lb.pos = m2.pos LEFT JOIN gr USING (label))"""


def _resolve(tail: str) -> str:
    return with_views("vt", "vc", recursive=True, body=_RESOLVE + tail)


# One title after the other: the films so far are lists in the order of their ids, and each step looks one title up.
_IN_ORDER = """, al AS (
  SELECT 'a:' || p_partkey AS alias_key, vc.film_id FROM part JOIN vc ON vc.local_key = lower(p_name || ' ' || p_size) WHERE p_type = 'ECONOMY'),
known AS (SELECT list(film_id ORDER BY film_id) AS films FROM vc),
queue AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY position) AS n, * FROM vti WHERE alias_key NOT IN (SELECT alias_key FROM al)),
run(k, n, m, t, l, o, ids) USING KEY (k) AS (
  SELECT 1, 0::BIGINT, list(match_key ORDER BY film_id), list(tight_key ORDER BY film_id), list(local_key ORDER BY film_id),
         list(coalesce(original_title, '') ORDER BY film_id), []::BIGINT[] FROM vc
  UNION
  SELECT 1, n,
         CASE WHEN i IS NULL THEN list_append(m, match_key) WHEN teach THEN m[:i - 1] || [match_key] || m[i + 1:] ELSE m END,
         CASE WHEN i IS NULL THEN list_append(t, tight_key) WHEN teach THEN t[:i - 1] || [tight_key] || t[i + 1:] ELSE t END,
         CASE WHEN i IS NULL THEN list_append(l, local_key) ELSE l END,
         CASE WHEN i IS NULL THEN list_append(o, coalesce(original_title, '')) WHEN teach THEN o[:i - 1] || [original_title] || o[i + 1:] ELSE o END,
         list_append(ids, coalesce(i, len(m) + 1))
  FROM (SELECT *, o[i] = '' AND original_title IS NOT NULL AS teach FROM (
    SELECT q.n, q.match_key, q.tight_key, q.local_key, q.original_title, r.m, r.t, r.l, r.o, r.ids,
           coalesce(nullif(list_position(m, match_key), 0), nullif(list_position(t, tight_key), 0), nullif(list_position(l, local_key), 0)) AS i
    FROM run r JOIN queue q ON q.n = r.n + 1))
),
found AS (SELECT unnest(range(1, len(ids) + 1)) AS n, unnest(ids) AS i FROM run),
numbered AS (SELECT n, CASE WHEN i <= len(films) THEN films[i] ELSE films[-1] + i - len(films) END AS film_id FROM found, known)"""


def _in_order_sql(tail: str) -> str:
    return with_views("vt", "vc", recursive=True, body=_IN_ORDER + tail)


_LOCAL = "lower(p_name) || ' ' || (p_size % 10)"
_ORIGINAL = "CASE WHEN p_partkey % 4 = 3 THEN 'The ' || p_name END"
_INIT = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_DOUBLED = f"""db AS (
  SELECT p_partkey + 1 AS film_id, {_INIT} || ' ' || (p_size % 10) AS title, {_ORIGINAL} AS original_title,
         coalesce('the ' || CASE WHEN p_partkey % 4 = 3 THEN lower(p_name) END, {_LOCAL}) AS match_key, {_LOCAL} AS local_key,
         CASE WHEN p_partkey % 5 = 0 THEN 'event' END AS kind, CASE WHEN p_partkey % 6 = 5 THEN p_retailprice END AS rating
  FROM part),
dm AS (SELECT film_id, min(film_id) OVER (PARTITION BY local_key) AS survivor_id FROM db)"""

_CHANGED = "o_orderdate + INTERVAL 20 HOUR + to_minutes(o_orderkey % 2 * 600)"

ORACLES = {
    "resolve_in_order": _in_order_sql(
        " SELECT position, alias_key, coalesce(al.film_id, numbered.film_id) AS film_id"
        " FROM vti LEFT JOIN al USING (alias_key) LEFT JOIN queue USING (position, alias_key) LEFT JOIN numbered USING (n)"
    ),
    "catalogue_in_order": _in_order_sql(
        " SELECT CASE WHEN i <= len(films) THEN films[i] ELSE films[-1] + i - len(films) END AS film_id, m[i] AS match_key, t[i] AS tight_key,"
        " l[i] AS local_key, nullif(o[i], '') AS original_title FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM run), known"
    ),
    "normalize_title": with_views("vt", body=" SELECT position, local_key AS normalized FROM vti"),
    "film_identity": with_views("vt", body=" SELECT position, match_key, tight_key, local_key, title, original_title FROM vti"),
    "resolve_entities": _resolve(
        """ SELECT position, alias_key, coalesce(alias_id, ids.film_id) AS film_id
        FROM rw LEFT JOIN ids ON rw.match_key = ids.match_key AND rw.tight_key = ids.tight_key AND rw.local_key = ids.local_key"""
    ),
    "resolved_catalogue": _resolve(
        """ SELECT vc.film_id, coalesce(le.match_key, vc.match_key) AS match_key, coalesce(le.tight_key, vc.tight_key) AS tight_key,
               vc.local_key, coalesce(le.original_title, vc.original_title) AS original_title FROM vc LEFT JOIN le USING (film_id)
        UNION ALL
        SELECT gr.film_id, coalesce(arg_min(match_key, taught) FILTER (taught IS NOT NULL), arg_min(match_key, fr.pos)),
               coalesce(arg_min(tight_key, taught) FILTER (taught IS NOT NULL), arg_min(tight_key, fr.pos)),
               arg_min(local_key, fr.pos), arg_min(original_title, taught) FILTER (taught IS NOT NULL)
        FROM fr JOIN lb USING (pos) JOIN gr USING (label) GROUP BY 1"""
    ),
    "relink": with_views(
        "vt",
        "vc",
        body=""", l AS (SELECT position, CASE WHEN position % 5 <> 0 THEN position % 40 + 2 END AS old, local_key FROM vti),
        f AS (SELECT l.*, coalesce((SELECT min(film_id) FROM vc WHERE vc.match_key = l.local_key),
                                   (SELECT min(film_id) FROM vc WHERE vc.tight_key = replace(l.local_key, ' ', '')),
                                   (SELECT min(film_id) FROM vc WHERE vc.local_key = l.local_key)) AS found FROM l)
        SELECT position, coalesce(found, old) AS film_id, found IS NOT NULL AND found IS DISTINCT FROM old AS changed FROM f""",
    ),
    "first_wins_lookup": with_views(
        "vt",
        "vc",
        body=""", l AS (SELECT local_key, min(position) AS p FROM vti GROUP BY 1)
        SELECT vc.film_id, l.p AS listing_position, '/film/' || vti.alias_key AS listing_path
        FROM vc LEFT JOIN l ON l.local_key = vc.local_key LEFT JOIN vti ON vti.position = l.p""",
    ),
    "duplicate_map": f"WITH {_DOUBLED} SELECT film_id, survivor_id FROM dm",
    "merge_duplicates": f"""WITH {_DOUBLED}
        SELECT survivor_id AS film_id, arg_min(title, film_id) AS title, arg_min(original_title, film_id) FILTER (original_title IS NOT NULL) AS original_title,
               coalesce(arg_min(match_key, film_id) FILTER (original_title IS NOT NULL), arg_min(match_key, film_id)) AS match_key,
               CASE WHEN (survivor_id - 1) % 5 = 0 THEN 'event' END AS kind, arg_min(rating, film_id) FILTER (rating IS NOT NULL) AS rating
        FROM db JOIN dm USING (film_id) GROUP BY survivor_id""",
    "remapped_ramp": f"""WITH {_DOUBLED}
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, survivor_id AS film_id, CAST(sum(l_quantity) AS BIGINT) AS sold
        FROM lineitem JOIN dm ON dm.film_id = l_partkey + 1 GROUP BY 1, 2""",
    "upsert_halls": """
        WITH i AS (
          SELECT l_suppkey AS hall_key, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS position, l_partkey % 25 AS cinema_key,
                 CASE WHEN l_partkey % 7 = 0 THEN 'Hall ' || l_partkey END AS name, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) END AS seatplan_id
          FROM lineitem),
        n AS (SELECT hall_key, arg_max(cinema_key, position) AS cinema_key, arg_max(name, position) FILTER (name IS NOT NULL) AS name,
                     arg_max(seatplan_id, position) FILTER (seatplan_id IS NOT NULL) AS seatplan_id FROM i GROUP BY 1),
        o AS (SELECT s_suppkey AS hall_key, s_nationkey AS cinema_key, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name,
                     CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey + 30 END AS capacity FROM supplier WHERE s_acctbal > 0)
        SELECT coalesce(n.hall_key, o.hall_key) AS hall_key, CAST(coalesce(n.cinema_key, o.cinema_key) AS BIGINT) AS cinema_key,
               coalesce(n.name, o.name) AS name, capacity, seatplan_id
        FROM n FULL JOIN o ON n.hall_key = o.hall_key""",
    "upsert_merge": f"""
        WITH o AS (SELECT *, o_orderdate >= TIMESTAMP '1997-01-01' AS seen, o_orderdate < TIMESTAMP '2000-01-01' AS known FROM orders)
        SELECT o_orderkey AS screening_key, o_custkey AS film_id, o_custkey % 100 AS hall_key,
               CASE WHEN seen THEN {_CHANGED} ELSE o_orderdate + INTERVAL 20 HOUR END AS starts_at,
               CASE WHEN seen THEN CAST({_CHANGED} - INTERVAL 5 HOUR AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day,
               CASE WHEN seen THEN '3D+IMAX' ELSE o_orderstatus END AS formats, CASE WHEN NOT known THEN 'dabing' END AS lang,
               CASE WHEN seen THEN o_orderkey % 2 <> 0 ELSE o_orderkey % 2 = 0 END AS sold_out,
               CASE WHEN known THEN CAST(floor(o_totalprice) AS BIGINT) END AS sold
        FROM o""",
    "upsert_replace": """
        SELECT CAST(n_nationkey AS BIGINT) AS cinema_key, coalesce(c.name, n_name) AS name
        FROM nation LEFT JOIN (SELECT c_nationkey, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1) c
             ON c.c_nationkey = n_nationkey""",
    "reschedule": """
        WITH m AS (
          SELECT o_orderkey AS screening_key, o_orderdate + INTERVAL 20 HOUR AS old_start,
                 o_orderdate + INTERVAL 20 HOUR + to_hours(o_orderkey % 5 * 7) AS starts_at, TIMESTAMP '1998-06-17 12:00:00' AS now
          FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 5 <> 0),
        a AS (SELECT *, date_diff('second', now, starts_at) AS ahead,
                     (starts_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Prague' AS wall FROM m),
        c AS (SELECT *, now + CASE WHEN ahead <= 7200 THEN INTERVAL 10 MINUTE WHEN ahead <= 43200 THEN INTERVAL 30 MINUTE
                              WHEN ahead <= 172800 THEN INTERVAL 2 HOUR ELSE INTERVAL 12 HOUR END AS candidate FROM a)
        SELECT screening_key, old_start, starts_at, CAST(wall - INTERVAL 5 HOUR AS DATE) AS day,
               CASE WHEN ahead > 0 THEN CASE WHEN candidate > starts_at - INTERVAL 5 MINUTE THEN greatest(now, starts_at - INTERVAL 5 MINUTE) ELSE candidate END END AS next_look_at
        FROM c""",
    "flag_by_tag": """
        WITH t AS (SELECT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS film_id, p_size = 7 AND p_partkey % 2 = 0 AS tag FROM part)
        SELECT film_id, CASE WHEN bool_or(tag) OR film_id % 6 = 0 THEN 'event' END AS kind, bool_or(tag) AND film_id % 6 <> 0 AS marked
        FROM t GROUP BY 1""",
    "horizon_filter": with_views(
        "vs",
        body=f""" SELECT screening_key, hall_key, CAST(s_nationkey AS BIGINT) AS cinema_key, starts_at FROM vs JOIN supplier ON s_suppkey = hall_key
        WHERE s_acctbal > 0 AND starts_at BETWEEN TIMESTAMP '{V.NOW}' AND TIMESTAMP '{V.NOW}' + INTERVAL 45 DAY""",
    ),
    "sample_per_key": with_views(
        "vs",
        body=f""" SELECT hall_key AS title_id, screening_key AS event_id, starts_at FROM vs WHERE starts_at > TIMESTAMP '{V.NOW}'
        QUALIFY row_number() OVER (PARTITION BY hall_key ORDER BY starts_at, screening_key) = 1""",
    ),
    "union_last_wins": """
        WITH u AS (SELECT o_custkey AS event_id, o_orderkey AS position, s.scan, o_orderstatus
                   FROM orders, (SELECT unnest([0, 1, 2]) AS scan) s WHERE o_orderstatus <> ['F', 'O', 'P'][s.scan + 1])
        SELECT event_id, position, CAST(scan AS BIGINT) AS scan, o_orderstatus FROM u
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY scan DESC, position DESC) = 1""",
    "source_priority": """
        SELECT p_partkey AS film_id,
               CASE WHEN p_type = 'ECONOMY' THEN p_retailprice WHEN p_size < 20 THEN p_size::DOUBLE WHEN p_partkey % 2 = 0 THEN 1.0 END AS rating,
               CAST(CASE WHEN p_type = 'ECONOMY' THEN 0 WHEN p_size < 20 THEN 1 END AS BIGINT) AS source
        FROM part""",
    "schema_backfill": """
        WITH u AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'NONE' AS segment, CAST(NULL AS DOUBLE) AS balance FROM nation
                   UNION ALL
                   SELECT c_custkey + 100, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NONE' END, c_acctbal FROM customer)
        SELECT *, (SELECT max(id) + 1 FROM u) AS next_id FROM u""",
    "headline_topk": """
        WITH r AS (SELECT source || '/' || lang AS feed, doc_id AS item_no, text, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id * 37 % 401 AS INTEGER)) AS published_at FROM documents),
        s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY feed, lower(text) ORDER BY item_no) = 1)
        SELECT feed, item_no, published_at, md5(text) AS headline FROM s
        QUALIFY row_number() OVER (PARTITION BY feed ORDER BY published_at DESC, item_no) <= 8""",
}
