"""Queries over stored payloads: the pages as they are, and documents built from the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatecount import rules
from gatecount.functions import text as X
from gatecount.functions import times as T
from gatecount.operators import official as O
from gatecount.plans import views as V
from gatecount.plans.views import with_views
from gatecount.sources import feeds, grids, markup


def strip_markup(spark, sf_dir):
    text = X.strip_markup(F.col("html"))
    return V.pages(spark, sf_dir).select("page_id", F.md5(text).alias("text_md5"), F.char_length(text).cast("bigint").alias("n_chars"))


def html_nested_extract(spark, sf_dir):
    """Parts of a page (nav, article), their headed sections, and the items in each."""
    items = markup.nested_items(
        V.pages(spark, sf_dir),
        ["page_id"],
        "html",
        label_pattern=r"<(nav|article|footer)>",
        block_pattern=r"<(?:nav|article|footer)>",
        section_pattern=r"<(ul|h1)>",
        item_pattern=r"(?s)<(?:li|p)>(.*?)</(?:li|p)>",
    )
    return items.select(
        "page_id", F.col("block_no").cast("bigint"), "label", F.col("section_no").cast("bigint"), "section",
        F.col("item_no").cast("bigint"), F.md5("item").alias("item_md5"),
    )


def markup_count(spark, sf_dir):
    """List items as seats: those linking to a lower-case path count as taken."""
    read = markup.markup_occupancy(F.col("html"), r"(<li>.*?</li>)", r'href="/[a-z]', r">(\d+(?:,\d+)?)<")
    return V.pages(spark, sf_dir).select("page_id", read.alias("r")).select("page_id", "r.sold", "r.total", "r.sellable")


def _programme_line(order: Column, line: Column, put) -> tuple[Column, Column]:
    """The label and the block of one line of an order."""
    film, number, venue = line["l_partkey"], line["l_linenumber"], line["l_suppkey"]

    def show(last: int, hour: int, tooltip: str):
        number_of = order * 100 + number * 10 + last
        at = put(F.lit(hour) + number, ":", F.lpad((film % 60).cast("string"), 2, "0"))
        return put('<div class="item" title="', tooltip, '" onclick="getScreening(', number_of, ', this)" >', at, "</div>")

    first = put(
        "<li><a href='/filmy/detail/?id=", film, "'>Film ", film, "</a><div Class='location-icon'><i></i> Hall ", venue % 9, "</div>",
        "<UL class='notes'><li>a note<ol><li/>deep</ol><li>an open note</UL><span style='font-size: 0.8em;'>DAB</span>",
        show(1, 2, "3D, 90 minut"), show(2, 12, "90 minut"), F.when(number % 2 == 0, F.lit("</li>")).otherwise(F.lit("\n")),
    )
    second = put('<li class="row"><a href=\'/filmy/detail/?id=', film + 1, "'>Film &amp; ", film + 1, "</a>", show(3, 14, ""), "</li>")
    block = put("<div class='tab-item x'><h2 class=\"cinema-name\">Venue ", venue, "</h2><ul>", first, second, "</ul></div>")
    return put('<a class="big-date-a">', F.date_format(line["l_shipdate"], "dd.MM.yyyy"), "</a>"), block


def programme(spark, sf_dir):
    """Programme pages, one per order: a day and a venue per line, rows with lists inside, every other one without its end tag."""
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    # The numbers move, not the texts made of them.
    orders = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = lambda i: F.array_join(F.transform("lines", lambda x: _programme_line(F.col("l_orderkey"), x, put)[i]), "")
    pages = orders.select(F.col("l_orderkey").alias("page_id"), F.concat(text(0), text(1)).alias("html"))
    out = markup.programme(pages)
    return out.withColumn("attributes", F.array_join("attributes", "+"))


def seat_prices(spark, sf_dir):
    """Seat plans, one per order: a seat per line at its price, taken where the line was returned, the fifth line's free of charge."""
    cents = F.when(F.col("l_linenumber") == 5, F.lit(0)).otherwise(F.round(F.col("l_extendedprice") * 100)).cast("bigint")
    crowns = F.floor(cents / 100)
    printed = F.concat(
        F.floor(crowns / 1000).cast("string"), F.lit("\u00a0"), F.lpad((crowns % 1000).cast("string"), 3, "0"),
        F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"),
    )
    css = F.when(F.col("l_returnflag") == "R", F.lit("vip occupied")).otherwise(F.lit("vip"))
    seat = F.concat(F.lit('<g class="seat-item '), css, F.lit('"><title>Cena: '), printed, F.lit(" Kč</title></g>\n"))
    plans = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(seat), "").alias("html"))
    return plans.select(F.col("l_orderkey").alias("page_id"), markup.markup_occupancy(F.col("html")).alias("r")).select("page_id", "r.*")


def link_listing_dedup(spark, sf_dir):
    """First link per page and case-folded initial of the path."""
    out = markup.link_listing(
        V.pages(spark, sf_dir), link_pattern=r'(href="/[^"]*">[^<]*)<', id_pattern=r'href="/([^"])', path_pattern=r'href="(/[^"]*)"'
    )
    return out.select("page_id", F.col("position").cast("bigint"), "link_id", "path", "title")


def distinct_links(spark, sf_dir):
    return markup.distinct_links(V.pages(spark, sf_dir), r'href="(/[^"]*)"')


def payload_deref(spark, sf_dir):
    """Pages whose script holds index-referenced events, one per order, and their halls."""
    line = V.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    quote = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    flat = F.concat(
        F.lit('[["Shallow",1],'),
        F.lit('{"EventId":3,"Start":4,"TitleId":5,"ObjectId":6,"Properties":7},'),
        F.lit('{"CinemaId":9,"ObjectId":6},'),
        quote(k), F.lit(","),
        quote(F.date_format("o_orderdate", "yyyy-MM-dd'T'20:30:00'+02:00'")), F.lit(","),
        quote(F.col("o_custkey")), F.lit(","),
        quote(k % 17), F.lit(","),
        F.lit('[8,10],{"Name":11},'),
        quote(k % 5), F.lit(","),
        F.lit('{"Name":"4K"},"Titulky"]'),
    )
    broken = F.when(k % 10 == 0, F.lit("[{")).otherwise(flat)
    html = F.concat(
        F.lit('<html><script type="application/json" data-x="1" id="__NUXT_DATA__">'), broken, F.lit("</script></html>")
    )
    pages = line.select(k.alias("page_id"), html.alias("html"))
    return feeds.payload_screenings(pages).select(
        "page_id", "event_id", "starts_at", "title_id", "hall_id", F.array_join("properties", "+").alias("properties"), "cinema_id"
    )


def event_documents(spark, sf_dir):
    """Event documents written as JSON from parts and read back as canonical rows."""
    k = F.col("p_partkey")
    wall = F.date_format(F.lit("1998-10-24").cast("timestamp_ntz") + F.expr("make_dt_interval(0, CAST(p_partkey % 48 AS INT))"), "yyyy-MM-dd'T'HH:mm:ss")
    document = F.struct(
        k.alias("eventid"),
        (k % 100).alias("cinemaid"),
        F.col("p_size").alias("venueid"),
        F.col("p_type").alias("venue"),
        wall.alias("start"),
        V.brand_number().alias("title_groupid"),
        F.concat("p_name", F.when(k % 2 == 0, F.lit(" TITULKY")).otherwise(F.lit(""))).alias("title"),
        F.col("p_name").alias("title_group"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("The "), "p_name")).alias("subtitle_group"),
        F.array(
            F.struct(F.lit(1).alias("propertyid"), F.when(k % 4 == 0, F.lit("imax")).otherwise(F.lit("HIT")).alias("name")),
            F.struct(F.lit(2).alias("propertyid"), F.lit("3D").alias("name")),
        ).alias("event_properties"),
    )
    docs = V.table(spark, sf_dir, "part").select(F.to_json(document).alias("body"))
    out = feeds.events(docs, "p")
    return out.withColumn("formats", F.array_join("formats", "+"))


def hall_capacity(spark, sf_dir):
    """Seat plans with one section per line of an order's supplier; some lack a capacity."""
    k = F.col("s_suppkey")
    plan = F.concat(
        F.lit('{"sections":{"a":{"Capacity":'), (k % 90).cast("string"), F.lit('},"b":{"Capacity":'),
        F.when(k % 4 == 0, F.lit("null")).otherwise((k % 7 + 20).cast("string")), F.lit('},"c":{}}}'),
    )
    docs = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.from_json(plan, feeds.SEAT_PLAN).alias("p"))
    return docs.select("s_suppkey", feeds.hall_capacity(F.col("p.sections")).alias("capacity"))


def feed_articles(spark, sf_dir):
    """Feeds of ten documents each, with numeric entities, publishers and dates, some unreadable."""
    k = F.col("doc_id")
    title = F.concat(
        F.when(k % 3 == 0, F.lit("Recenze: v&#225;lka &#xe9; ")).otherwise(F.lit("Film &amp;lt; a spol. ")),
        F.translate("text", "<>&\n", "    "), F.lit(" - "), F.col("source"),
    )
    date = F.when(k % 7 == 0, F.lit("soon")).otherwise(
        F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(CAST(doc_id % 300 AS INT), CAST(doc_id % 24 AS INT))"), "'Mon, 'dd MMM yyyy HH:mm:ss' GMT'")
    )
    source = F.when(k % 2 == 0, F.concat(F.lit('<source url="x">'), F.lit("Daily "), F.col("lang"), F.lit("</source>"))).otherwise(F.lit(""))
    item = F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>http://x/"), k.cast("string"), F.lit("</link><pubDate>"), date, F.lit("</pubDate>"), source, F.lit("</item>")
    )
    docs = V.table(spark, sf_dir, "documents")
    # Ten items per feed, so a feed document stays small at any scale.
    feed = docs.groupBy(F.floor(k / 10).alias("feed_id")).agg(
        F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("items")
    )
    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("items", lambda i: i["item"]), ""), F.lit("</channel></rss>"))
    rows = markup.articles(feed.select("feed_id", xml.alias("xml")), T.instant("2025-01-01 00:00:00"))
    return rows.select(
        "feed_id", F.col("item_no").cast("bigint"), F.trim("title").alias("title"), "url", "publisher", "published_at", "is_review"
    )


def embedded_rating(spark, sf_dir):
    k = F.col("p_partkey")
    page = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"Movie","aggregateRating":{"@type":"AggregateRating","ratingValue":'),
        F.round(F.col("p_retailprice") / 20, 2).cast("string"), F.lit(', "ratingCount" : '), (k % 60).cast("string"), F.lit("}}</script>"),
    )
    html = F.when(k % 8 == 0, F.lit("<p>? %</p>")).otherwise(page)
    rows = V.table(spark, sf_dir, "part").select("p_partkey", markup.embedded_rating(html).alias("r"))
    return rows.where(F.col("r").isNotNull()).select("p_partkey", "r.percent", "r.votes")


def first_usable_hit(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    k = F.col("p_partkey")

    def search(priority: int, shift: int):
        hit = F.struct(
            (k * 10 + priority).alias("id"),
            (F.col("p_size") / F.lit(8.0)).alias("vote_average"),
            ((k * shift) % 50).alias("vote_count"),
        )
        worse = F.struct(F.lit(-1).cast("bigint").alias("id"), F.lit(9.0).alias("vote_average"), F.lit(999).cast("bigint").alias("vote_count"))
        results = F.when((k + priority) % 6 == 0, F.array().cast("array<struct<id:bigint,vote_average:double,vote_count:bigint>>")).otherwise(F.array(hit, worse))
        return part.select(k.alias("film_id"), F.lit(priority).cast("bigint").alias("priority"), results.alias("results"))

    return feeds.first_usable_hit(search(0, 3).unionByName(search(1, 7)))


def _week_cells(spark, sf_dir):
    """The weekly table laid out as sheets: captions, a two-row header at changing depth, rows, notes."""
    rows = V.weekly(spark, sf_dir)
    file = F.concat(F.date_format("weekend_from", "yyyyMMdd"), F.lit("/top20-"), F.year("weekend_from"), F.lit("-"), F.month("weekend_from"), F.lit("cz.xls"))
    head = (F.lit(3) + F.dayofmonth("weekend_from") % 4).cast("int")

    def cell(row, col, text=None, num=None):
        return F.struct(
            row.cast("int").alias("row"), F.lit(col).cast("int").alias("col"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
            (F.lit(None) if num is None else num).cast("double").alias("num"),
        )

    spaced = F.concat(F.floor(F.col("weekend_admissions") / 1000).cast("string"), F.lit(" "), F.lpad((F.col("weekend_admissions") % 1000).cast("string"), 3, "0"))
    line = head + 1 + F.col("rank")
    body = F.array(
        cell(line, 0, num=F.col("rank")),
        cell(line, 2, text=F.concat(F.lit(" "), "title", F.lit(" "))),
        cell(line, 3, text=F.lit("Dist")),
        cell(line, 4, text=F.col("country")),
        cell(line, 5, num=F.col("week_of_run")),
        cell(line, 6, num=F.col("cinemas")),
        cell(line, 7, num=F.col("weekend_gross")),
        cell(line, 8, text=spaced),
        cell(line, 10, num=F.col("total_admissions")),
        cell(line, 11, num=F.lit(7)),
    )
    cells = rows.select(file.alias("file"), F.explode(body).alias("c")).select("file", "c.*")
    caption = F.concat(F.lit("Víkend od: "), F.date_format("weekend_from", "d. M. yyyy"))
    labels = [(2, "Film", ""), (3, "Distributor", ""), (5, "Poč", "týdnů"), (6, "Poč.", "kin"), (7, "Víkend", "tržby"), (8, "Víkend", "diváci"), (10, "Celkem", "diváci"), (11, "Poč.", "kin")]
    top = [cell(F.lit(0), 0, text=F.lit("TOP 20")), cell(F.lit(1), 0, text=caption)]
    for col, first, second in labels:
        top += [cell(head, col, text=F.lit(first)), cell(head + 1, col, text=F.lit(second))]
    top += [cell(F.lit(900), 0, text=F.lit("(c) note")), cell(F.lit(901), 2, text=F.lit("no rank"))]
    files = rows.select("weekend_from").distinct()
    heads = files.select(file.alias("file"), F.explode(F.array(*top)).alias("c")).select("file", "c.*")
    return cells.unionByName(heads)


def header_anchored_table(spark, sf_dir):
    return grids.weekly_table(_week_cells(spark, sf_dir))


def sheets_to_archive(spark, sf_dir):
    """From sheets straight to the archive's lines: the file names date the reports."""
    table = header_anchored_table(spark, sf_dir)
    lines = table.withColumn("week_key", O.week_key(F.col("year"), F.col("week")))
    return lines.groupBy("year", "week_key").agg(
        F.count_distinct("weekend_from").alias("reports"),
        F.sum("weekend_admissions").alias("admissions"),
        F.max_by("title", F.struct("weekend_admissions", "weekend_from", "title")).alias("top_title"),
    )


def annual_table(spark, sf_dir):
    """Annual lists as sheets, their lifetime block found by its caption."""
    rows = V.annual(spark, sf_dir)
    file = F.concat(F.lit("top50"), F.col("year").cast("string"), F.lit(".xls"))
    shift = (F.col("year") % 3).cast("int")

    def cell(row, col, text=None, num=None):
        return F.struct(
            row.cast("int").alias("row"), (col if not isinstance(col, int) else F.lit(col)).cast("int").alias("col"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
            (F.lit(None) if num is None else num).cast("double").alias("num"),
        )

    serial = F.datediff("premiere", F.lit("1899-12-30").cast("date"))
    line = F.col("rank") + 4
    body = F.array(
        cell(line, 0, num=F.col("rank")), cell(line, 1, text=F.col("title")), cell(line, 3, text=F.lit("Dist")),
        cell(line, 5, num=serial), cell(line, 6, text=F.lit("CZE")), cell(line, 7, num=F.lit(-1)),
        cell(line, shift + 9, num=F.lit(11)), cell(line, shift + 10, num=F.col("admissions")), cell(line, shift + 11, num=F.col("gross")),
    )
    cells = rows.select(file.alias("file"), F.explode(body).alias("c")).select("file", "c.*")
    top = F.array(
        cell(F.lit(0), 0, text=F.lit("TOP 50")), cell(F.lit(2), shift + 9, text=F.lit("Hodnoty od premiéry")),
        cell(F.lit(4), 0, text=F.lit("Poř.")), cell(F.lit(4), 1, text=F.lit("Titul")),
    )
    heads = rows.select("year").distinct().select(file.alias("file"), F.explode(top).alias("c")).select("file", "c.*")
    out = grids.annual_table(cells.unionByName(heads))
    return out.select("file", "year", "rank", "title", "premiere", "screenings", "admissions", "gross")


QUERIES = {
    f.__name__: f
    for f in (
        strip_markup,
        html_nested_extract,
        markup_count,
        programme,
        seat_prices,
        link_listing_dedup,
        distinct_links,
        payload_deref,
        event_documents,
        hall_capacity,
        feed_articles,
        embedded_rating,
        first_usable_hit,
        header_anchored_table,
        sheets_to_archive,
        annual_table,
    )
}

_ENT = "html"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
    _ENT = f"replace({_ENT}, '{_e}', '{_c}')"
_STRIPPED = "trim(regexp_replace(" + _ENT.replace("html", "regexp_replace(html, '<[^>]*>', ' ', 'g')", 1) + ", '[\\s\\x{00A0}]+', ' ', 'g'))"

ORACLES = {
    "strip_markup": f"SELECT page_id, md5({_STRIPPED}) AS text_md5, length({_STRIPPED}) AS n_chars FROM pages",
    "html_nested_extract": """
        WITH b AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS block_no, unnest(l) AS label, unnest(p[2:]) AS block
                   FROM (SELECT page_id, regexp_extract_all(html, '<(nav|article|footer)>', 1) AS l, string_split_regex(html, '<(?:nav|article|footer)>') AS p FROM pages)),
        s AS (SELECT page_id, block_no, label, generate_subscripts(h, 1) - 1 AS section_no, unnest(h) AS section, unnest(p[2:]) AS body
              FROM (SELECT *, regexp_extract_all(block, '<(ul|h1)>', 1) AS h, string_split_regex(block, '<(?:ul|h1)>') AS p FROM b)),
        i AS (SELECT page_id, block_no, label, section_no, section, generate_subscripts(x, 1) - 1 AS item_no, unnest(x) AS item
              FROM (SELECT *, regexp_extract_all(body, '(?s)<(?:li|p)>(.*?)</(?:li|p)>', 1) AS x FROM s))
        SELECT page_id, block_no, label, section_no, section, item_no, md5(item) AS item_md5 FROM i""",
    "markup_count": """
        WITH l AS (SELECT page_id, regexp_extract_all(html, '<li>.*?</li>') AS l FROM pages),
        c AS (SELECT page_id, CAST(len(list_filter(l, lambda x: regexp_matches(x, 'href="/[a-z]'))) AS BIGINT) AS sold, CAST(len(l) AS BIGINT) AS total FROM l)
        SELECT *, total > 0 AND sold < total AS sellable FROM c""",
    "programme": f"""
        WITH w AS (
          SELECT *, l_orderkey * 100 + l_linenumber * 10 + s AS id, CAST(l_shipdate AS DATE) AS day, l_partkey + CAST(s = 3 AS INTEGER) AS film,
                 CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_hours(CAST([2, 12, 14][s] + l_linenumber AS INTEGER)) + to_minutes(CAST(l_partkey % 60 AS INTEGER)) AS wall
          FROM lineitem, (SELECT unnest([1, 2, 3]) AS s))
        SELECT l_orderkey AS page_id, CAST(id AS VARCHAR) AS screening_id, day, wall, (wall AT TIME ZONE '{rules.LOCAL_ZONE}') AT TIME ZONE 'UTC' AS starts_at,
               'Venue ' || l_suppkey AS venue, CASE WHEN s < 3 THEN 'Hall ' || l_suppkey % 9 ELSE 'Venue ' || l_suppkey END AS hall, CAST(film AS VARCHAR) AS film_ext_id,
               CASE WHEN s < 3 THEN 'Film ' ELSE 'Film & ' END || film AS title, CASE WHEN s < 3 THEN 'DAB' END AS version, CASE WHEN s < 3 THEN 'dabing' END AS lang,
               CASE WHEN s = 1 THEN '3D' ELSE '' END AS attributes
        FROM w""",
    "seat_prices": """
        WITH p AS (SELECT l_orderkey, l_returnflag = 'R' AS taken, CASE WHEN l_linenumber = 5 THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS cents FROM lineitem)
        SELECT l_orderkey AS page_id, count(*) FILTER (taken) AS sold, count(*) AS total, CAST(min(cents) FILTER (NOT taken AND cents > 0) AS DOUBLE) / 100 AS price_min,
               CAST(max(cents) FILTER (NOT taken AND cents > 0) AS DOUBLE) / 100 AS price_max, count(*) FILTER (NOT taken) > 0 AS sellable
        FROM p GROUP BY 1""",
    "link_listing_dedup": """
        WITH l AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS position, unnest(x) AS link
                   FROM (SELECT page_id, regexp_extract_all(html, '(href="/[^"]*">[^<]*)<', 1) AS x FROM pages)),
        r AS (SELECT page_id, position, regexp_extract(link, 'href="/([^"])', 1) AS link_id, regexp_extract(link, 'href="(/[^"]*)"', 1) AS path,
                     trim(replace(regexp_extract(link, '>([^<>]*)$', 1), '&amp;', '&')) AS title FROM l)
        SELECT * FROM r WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY page_id, link_id ORDER BY position) = 1""",
    "distinct_links": """
        SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pages""",
    "payload_deref": """
        SELECT o_orderkey AS page_id, CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_orderdate + INTERVAL 18 HOUR + INTERVAL 30 MINUTE AS TIMESTAMP) AS starts_at,
               CAST(o_custkey AS VARCHAR) AS title_id, CAST(o_orderkey % 17 AS VARCHAR) AS hall_id, 'Titulky+4K' AS properties,
               CAST(o_orderkey % 5 AS VARCHAR) AS cinema_id
        FROM orders WHERE o_orderkey % 10 <> 0""",
    "event_documents": """
        SELECT 'p:' || p_partkey AS screening_key, ((TIMESTAMP '1998-10-24' + to_hours(p_partkey % 48)) AT TIME ZONE 'Europe/Prague') AT TIME ZONE 'UTC' AS starts_at,
               CAST(p_partkey % 100 AS VARCHAR) AS cinema_id, CAST(p_size AS VARCHAR) AS hall_id, p_type AS hall,
               'p:' || regexp_extract(p_brand, '(\\d+)$', 1) AS alias_key, p_name AS title, CASE WHEN p_partkey % 3 <> 0 THEN 'The ' || p_name END AS original_title,
               CASE WHEN p_partkey % 4 = 0 THEN '3D+IMAX' ELSE '3D' END AS formats, CASE WHEN p_partkey % 2 = 0 THEN 'titulky' END AS lang
        FROM part""",
    "hall_capacity": """
        SELECT s_suppkey, s_suppkey % 90 + CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 7 + 20 END AS capacity FROM supplier""",
    "feed_articles": """
        WITH d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN 'Recenze: válka é ' ELSE 'Film &lt; a spol. ' END
                          || translate(text, '<>&' || chr(10), '    ') AS head, text FROM documents),
        t AS (SELECT *, trim(regexp_replace(head || ' - ' || source, '^\\s+', '')) AS raw FROM d),
        s AS (SELECT *, string_split(raw, ' - ') AS p FROM t),
        q AS (SELECT *, length(raw) - length(p[-1]) - 3 AS cut FROM s)
        SELECT doc_id // 10 AS feed_id, doc_id - min(doc_id) OVER (PARTITION BY doc_id // 10) AS item_no,
               trim(CASE WHEN cut > 20 THEN raw[:cut] ELSE raw END) AS title, 'http://x/' || doc_id AS url,
               CASE WHEN doc_id % 2 = 0 THEN 'Daily ' || lang WHEN cut > 20 THEN p[-1] ELSE '' END AS publisher,
               CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2025-01-01' ELSE TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INTEGER)) + to_hours(doc_id % 24) END AS published_at,
               doc_id % 3 = 0 AS is_review
        FROM q""",
    "embedded_rating": """
        SELECT p_partkey, CAST(floor(round(p_retailprice / 20, 2) + 0.5) AS BIGINT) AS percent, p_partkey % 60 AS votes
        FROM part WHERE p_partkey % 8 <> 0 AND p_partkey % 60 >= 20""",
    "first_usable_hit": """
        WITH s AS (SELECT p_partkey AS film_id, p_size / 8.0::DOUBLE AS v, i.pr, (p_partkey * CASE WHEN i.pr = 0 THEN 3 ELSE 7 END) % 50 AS votes
                   FROM part, (SELECT unnest([0, 1]) AS pr) i WHERE (p_partkey + i.pr) % 6 <> 0)
        SELECT film_id, CAST(floor(v * 10 + 0.5) AS BIGINT) AS percent, votes, film_id * 10 + pr AS hit_id FROM s
        WHERE votes >= 20 AND v <> 0 QUALIFY row_number() OVER (PARTITION BY film_id ORDER BY pr) = 1""",
    "header_anchored_table": with_views(
        "vw",
        body=""" SELECT strftime(weekend_from, '%Y%m%d') || '/top20-' || year(weekend_from) || '-' || month(weekend_from) || 'cz.xls' AS file,
          year(weekend_from) AS year, month(weekend_from) AS week,
          CAST(3 + day(weekend_from) % 4 + 1 + rank AS INTEGER) AS row, rank, title, 'Dist' AS distributor, country, week_of_run, cinemas,
          weekend_admissions, total_admissions, weekend_gross, 0.0::DOUBLE AS total_gross, weekend_from
        FROM vw""",
    ),
    "sheets_to_archive": with_views(
        "vw",
        body=""" SELECT year(weekend_from) AS year, year(weekend_from) || '-W' || lpad(month(weekend_from)::VARCHAR, 2, '0') AS week_key,
          count(DISTINCT weekend_from) AS reports, CAST(sum(weekend_admissions) AS BIGINT) AS admissions,
          arg_max(title, (weekend_admissions, weekend_from, title)) AS top_title
        FROM vw GROUP BY 1, 2""",
    ),
    "annual_table": with_views(
        "va", body=" SELECT 'top50' || year || '.xls' AS file, CAST(year AS BIGINT) AS year, rank, title, premiere, CAST(11 AS BIGINT) AS screenings, admissions, gross FROM va"
    ),
}
