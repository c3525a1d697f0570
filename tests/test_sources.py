"""Stored payloads: snapshots, feeds, markup, sheets."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from gatecount.functions import times as T
from gatecount.sources import feeds, grids, markup, snapshots

FILMS = "films array<struct<id:bigint,title:string>>, next_id bigint"


def test_missing_snapshot_is_empty_and_a_damaged_one_is_an_error(spark, tmp_path):
    assert snapshots.read_json(spark, str(tmp_path / "none.json"), FILMS).count() == 0
    assert snapshots.read_parquet(spark, str(tmp_path / "none"), FILMS).count() == 0
    bad = tmp_path / "bad.json"
    bad.write_text('{"films": [{"id": 7, "ti')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        snapshots.read_json(spark, str(bad), FILMS, multiline=True).count()


def test_older_layouts_are_completed(spark, tmp_path):
    path = tmp_path / "state.json"
    path.write_text(json.dumps({"films": [{"id": 7}, {"id": 12, "title": "x"}]}))
    state = snapshots.read_json(spark, str(path), FILMS, multiline=True)
    films = state.select(F.explode("films").alias("f")).select("f.*")
    assert snapshots.next_id(films, "id").first()["next_id"] == 13
    assert snapshots.next_id(films, "id", 20).first()["next_id"] == 20
    schema = Y.StructType([Y.StructField("id", Y.LongType()), Y.StructField("kind", Y.StringType())])
    assert [tuple(r) for r in snapshots.backfill(films, schema, {"kind": "film"}).orderBy("id").collect()] == [
        (7, "film"),
        (12, "film"),
    ]


def test_tables_go_out_partitioned_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2026, 8, 1), 5), (dt.date(2026, 8, 2), 6)], "day date, sold bigint")
    snapshots.write_table(df, str(tmp_path / "daily"), ["day"])
    snapshots.write_table(df, str(tmp_path / "daily"), ["day"])
    back = snapshots.read_parquet(spark, str(tmp_path / "daily"), "sold bigint, day date")
    assert back.where("day = DATE '2026-08-02'").first()["sold"] == 6 and back.count() == 2
    assert json.loads(snapshots.as_document(df.limit(1)).first()["document"])["sold"] in (5, 6)


def test_feed(spark, tmp_path):
    base = {
        "id": 10, "dateTime": "2026-07-31 12:00", "businessDate": "", "featureName": "Vlny", "featureAdditionalName": "",
        "featureId": 3, "venueId": 44, "venueName": "Sál 1", "seatplanId": 9, "venueCity": "Praha", "venueLocationId": 1,
        "locationName": "Chodov", "availRatio": 0.2405, "soldout": 1, "featureAttributes": ["3d", "atmos"],
        "dubbedLanguageISO": None, "subbedLanguageISO": "cs", "ignored": [1, 2],
    }
    late = dict(base, id=11, dateTime="2026-08-01T01:30:00", soldout=0, dubbedLanguageISO="cs", featureAttributes=None)
    (tmp_path / "feed.json").write_text(json.dumps({"presentations": [base, late]}))
    out = {r["screening_key"]: r for r in feeds.read_feed(spark, str(tmp_path / "feed.json"), "cc", "City ").collect()}
    a, b = out["cc:10"], out["cc:11"]
    assert a["starts_at"] == dt.datetime(2026, 7, 31, 10) and a["day"] == dt.date(2026, 7, 31)
    assert (a["formats"], a["lang"], a["sold_out"], a["original_title"], a["cinema"]) == (["3D"], "titulky", True, None, "City Chodov")
    assert b["day"] == dt.date(2026, 7, 31) and (b["formats"], b["lang"], b["sold_out"]) == ([], "dabing", False)


def test_hall_capacity(one):
    plan = F.from_json(F.col("p"), feeds.SEAT_PLAN)["sections"]
    assert one(feeds.hall_capacity(plan), p='{"sections":{"a":{"Capacity":150},"b":{"Capacity":8},"c":{}}}') == 158
    assert one(feeds.hall_capacity(plan), p="{}") == 0


def page(flat):
    return f'<html><script type="application/json" data-nuxt="x" id="__NUXT_DATA__">{json.dumps(flat)}</script></html>'


def test_payload(spark):
    flat = [
        ["Reactive", 1],
        {"EventId": 4, "Start": 5, "TitleId": 6, "ObjectId": 7, "Properties": 8},
        {"CinemaId": 11, "ObjectId": 7},
        {"EventId": 4},
        "1742965", "2026-08-01T10:00:00+02:00", "10912", "646", [9, 10], {"Name": 12}, {"Name": 13}, "11", "Dabing", "4K",
        {"EventId": "literal", "Start": "no date", "TitleId": 6, "ObjectId": 7, "Properties": 8},
    ]
    df = spark.createDataFrame([(1, page(flat)), (2, "<html></html>"), (3, page(flat).replace("]<", "<"))], "page_id bigint, html string")
    events = feeds.payload_events(df).collect()
    assert [(r["page_id"], r["event_id"], r["starts_at"], r["title_id"], r["hall_id"], r["properties"]) for r in events] == [
        (1, "1742965", dt.datetime(2026, 8, 1, 8), "10912", "646", ["Dabing", "4K"])
    ]
    assert [tuple(r) for r in feeds.payload_halls(df).collect()] == [(1, "646", "11")]


def test_event_document(spark):
    event = {
        "eventid": 1744000, "titleid": 1, "title_groupid": 10572, "venueid": 597, "venue": "Sál 3", "start": "2026-08-01T15:50:00",
        "cinemaid": 2, "title": "Odyssea TITULKY", "title_group": "Odyssea", "subtitle_group": "The Odyssey",
        "event_properties": [{"propertyid": 1, "name": "4K", "type": "x"}],
    }
    out = feeds.events(spark.createDataFrame([(json.dumps(event),)], "body string"), "cs").first()
    assert (out["screening_key"], out["cinema_id"], out["hall_id"], out["alias_key"]) == ("cs:1744000", "2", "597", "cs:10572")
    assert (out["starts_at"], out["lang"], out["formats"]) == (dt.datetime(2026, 8, 1, 13, 50), "titulky", [])


PROGRAMME = """
<a class="big-date-a">02.08.2026</a><a class="big-date-a">03.08.2026</a>
<div Class='tab-item active'><h2 class="cinema-name">Multikino</h2><ul>
<li><a href='/filmy/detail/?id=12' class='x'>Vlny &amp; spol. <div class='other-val'>klub</div></a>
<div Class='location-icon'><i></i> Sál 4</div><span style='font-size: 0.8em;'>DAB</span>
<div class="item" title="4K, 90 minut" onclick="getScreening(161487, this)" >20:45</div>
<div class="item" title="90 minut" onclick="getScreening(161488, this)">9:15</div></li>
<li>no film</li></ul>
<h2 class="cinema-name">Malé kino</h2><ul><li><a href='/filmy/detail/?id=7'>Odyssea</a>
<div class="item" title="" onclick="getScreening(5, this)">00:30</div></li></ul></div>
<div Class='tab-item'><h2 class="cinema-name">Multikino</h2></div>
<div Class='tab-item'><h2 class="cinema-name">Undated</h2><ul><li><a href='/filmy/detail/?id=7'>X</a>
<div class="item" title="" onclick="getScreening(6, this)">10:00</div></li></ul></div>
"""


def test_programme(spark):
    df = spark.createDataFrame([(1, PROGRAMME)], "page_id bigint, html string")
    out = {r["screening_id"]: r for r in markup.programme(df).collect()}
    assert out.keys() == {"161487", "161488", "5"}
    a = out["161487"]
    assert (a["day"], a["starts_at"], a["venue"], a["hall"]) == (dt.date(2026, 8, 2), dt.datetime(2026, 8, 2, 18, 45), "Multikino", "Sál 4")
    assert (a["title"], a["film_ext_id"], a["version"], a["lang"], a["attributes"]) == ("Vlny & spol.", "12", "DAB", "dabing", ["4K"])
    assert out["161488"]["starts_at"] == dt.datetime(2026, 8, 2, 7, 15) and out["161488"]["attributes"] == []
    assert (out["5"]["venue"], out["5"]["hall"], out["5"]["version"]) == ("Malé kino", "Malé kino", None)


def test_items_by_nesting(spark):
    cases = {
        "plain": ("x<ul><li>a</li> <li class='b'>b</li></ul>", ["a", "b"]),
        "no list around": ("<li>a</li>z<LI>b</LI>", ["a", "b"]),
        "lists inside": ("<ul><li>a<ol><li>1</li><li>2<ul><li>3</ul></ol>z</li>gap<li>b</li></ul>", ["a<ol><li>1</li><li>2<ul><li>3</ul></ol>z", "b"]),
        "no end tags": ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>tail<li>", ["a", "b<ul><li>c</ul>", "d", ""]),
        "two lists": ("<ul><li>a</ul>gap<ol><li>b</ol>", ["a", "b"]),
        "stray ends": ("</li></li><ul><li>a</li></li>gap</ul>", ["a"]),
        "other tags": ("<ul><link><li>a<lié></li><ulx></ul>", ["a<lié>"]),
        "lines": ("<ul>\n<li\nid='1'>a\nb</li>\n</ul>", ["a\nb"]),
        "never closed": ("<ul><li>a<ul><li>b</li><li>c", ["a<ul><li>b</li><li>c"]),
        "empty item": ("<ul><li></li><li/></ul>", ["", ""]),
        "empty": ("", []),
        "none": (None, []),
    }
    rows = [(name, name, body) for name, (body, _) in cases.items()] + [(None, "plain", "<li>n"), ("plain", "plain", cases["plain"][0])]
    out = markup.balanced_items(spark.createDataFrame(rows, "item string, tag string, _body string").withColumnRenamed("item", "name"))
    assert out.columns == ["name", "tag", "item_no", "item"]
    found = {}
    for r in out.orderBy("item_no").collect():
        found.setdefault(r["name"], []).append(r["item"])
    wanted = {name: items for name, (_, items) in cases.items() if items} | {None: ["n"], "plain": ["a", "a", "b", "b"]}
    assert found == wanted


def test_items_are_cut_within_a_row(spark):
    rows = spark.createDataFrame([(1, "<ul><li>a<li>b</ul>")], "k int, _body string")
    plan = markup.balanced_items(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("BatchEvalPython") == 1


def test_items_of_no_rows(spark):
    assert markup.balanced_items(spark.createDataFrame([], "k int, _body string")).collect() == []


def test_seat_plan(one):
    seat = lambda css, price: f'<g class="seat-item {css}"><title>Cena: {price} Kč</title></g>'
    read = markup.markup_occupancy(F.col("h"))
    plan = seat("", "219") + seat("vip", "1 219,50") + seat("occupied", "99") + seat("unoccupiedish", "0")
    assert tuple(one(read, h=plan)) == (1, 4, 219.0, 1219.5, True)
    assert tuple(one(read, h=seat("x occupied", "1") * 3)) == (3, 3, None, None, False)
    assert tuple(one(read, h="")) == (0, 0, None, None, False)


RSS = """<rss><channel><title>feed</title>
<item><title><![CDATA[Odyssea d&#225;l v&#225;lcuje kina po celém světě - Deník]]></title><link>http://a/1</link>
<pubDate>Fri, 31 Jul 2026 08:00:00 GMT</pubDate><source url="x">Deník N</source></item>
<item><title>Recenze: Odyssea je film roku a možná dekády - Kinobox</title><link>http://a/2</link><pubDate>nonsense</pubDate></item>
<item><title>Bez odkazu</title></item>
<item><title>ODYSSEA dál válcuje kina po celém světě - Jiný</title><link>http://a/3</link></item>
</channel></rss>"""


def test_articles(spark):
    df = spark.createDataFrame([(1, RSS)], "feed_id bigint, xml string")
    now = T.instant("2026-08-01 10:00:00")
    rows = markup.articles(df, now)
    out = {r["url"]: r for r in rows.collect()}
    assert out.keys() == {"http://a/1", "http://a/2", "http://a/3"}
    assert (out["http://a/1"]["title"], out["http://a/1"]["publisher"]) == ("Odyssea dál válcuje kina po celém světě", "Deník N")
    assert out["http://a/1"]["published_at"] == dt.datetime(2026, 7, 31, 8) and not out["http://a/1"]["is_review"]
    assert (out["http://a/2"]["publisher"], out["http://a/2"]["is_review"]) == ("Kinobox", True)
    kept = markup.newest_headlines(rows, "feed_id")
    assert {r["url"] for r in kept.collect()} == {"http://a/1", "http://a/2"}
    assert [r["url"] for r in markup.reviews_first(kept, "feed_id").collect()] == ["http://a/2", "http://a/1"]


def test_listing_and_rating(spark, one):
    html = (
        '<a href="/film/12-vlny/prehled/" class="x" title="Vlny (2024)">img</a><a href="/film/12-vlny/">Vlny</a>'
        '<a href="/film/7-odyssea/"></a><a href="/film/7-odyssea/recenze/">Odyssea &amp; co</a><a href="/kino/">x</a>'
    )
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    out = {r["link_id"]: (r["path"], r["title"]) for r in markup.link_listing(df).collect()}
    assert out == {"12": ("/film/12-vlny", "Vlny (2024)"), "7": ("/film/7-odyssea", "Odyssea & co")}
    rating = markup.embedded_rating(F.col("h"))
    block = '{"aggregateRating": {"@type":"x","ratingValue": %s,"ratingCount": %s}}'
    assert tuple(one(rating, h=block % ("83.5", 1200))) == (84, 1200)
    assert one(rating, h=block % ("83.5", 19)) is None and one(rating, h="? %") is None


def sheet(file, lines):
    return [
        (file, r, c, v if isinstance(v, str) else None, float(v) if isinstance(v, (int, float)) else None)
        for r, line in enumerate(lines)
        for c, v in enumerate(line)
        if v is not None
    ]


CELLS = "file string, row int, col int, text string, num double"
HEAD = ["", None, "Film", "Distributor", "Země", "Poč", "Poč.", "Víkend", "Víkend", "Celkem", "Celkem", "Poč."]
SUB = ["", None, "", "", "", "týd.", "kin", "tržby", "diváci", "tržby", "diváci", "kin"]


def test_weekly_sheet(spark):
    good = [["TOP 20"], ["Víkend od: 23.07.2026"], [], ["x"], HEAD, SUB]
    good += [[1, None, " Odyssea ", "Cinemart", "USA", 2, 210, "17 200 000,5", 86017, 51000000, "256 291", 9], [None, None, "note"], ["(c) note"]]
    bad = [["nothing"], [None, None, "Film"], []]
    cells = spark.createDataFrame(sheet("w.xls", good) + sheet("b.xls", bad), CELLS)
    out = grids.weekly_table(cells, strict=False).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["rank"], r["title"], r["weekend_from"], r["week_of_run"], r["cinemas"]) == (1, "Odyssea", dt.date(2026, 7, 23), 2, 210)
    assert (r["weekend_gross"], r["weekend_admissions"], r["total_admissions"]) == (17200000.5, 86017, 256291)
    assert [f["file"] for f in grids.unrecognised_files(cells).collect()] == ["b.xls"]
    with pytest.raises(Exception, match="no weekly table in b.xls"):
        grids.weekly_table(cells).collect()


def test_annual_sheet(spark):
    lines = [["TOP 50"], [None] * 8 + ["Hodnoty od premiéry"], ["Poř.", "Titul", "Originál"]]
    lines += [[1, "Vlny", "", "Bontonfilm", None, 45519, "CZE", 700000, 12000, 885767, 150000000.5], ["", "Součet"]]
    out = grids.annual_table(spark.createDataFrame(sheet("top502024.xls", lines), CELLS)).collect()
    assert [(r["rank"], r["title"], r["premiere"], r["screenings"], r["admissions"], r["gross"]) for r in out] == [
        (1, "Vlny", dt.date(2024, 8, 15), 12000, 885767, 150000000.5)
    ]
    with pytest.raises(Exception, match="lifetime columns"):
        grids.annual_table(spark.createDataFrame(sheet("x.xls", [["Poř.", "Titul"], [1, "a"]]), CELLS)).collect()


def test_first_usable_hit(spark):
    schema = "film_id bigint, priority bigint, results array<struct<id:bigint,vote_average:double,vote_count:bigint>>"
    rows = [
        (1, 0, [(5, 8.0, 3)]), (1, 1, [(6, 7.26, 40), (9, 9.0, 900)]),
        (2, 0, [(7, 6.0, 20)]), (2, 1, [(8, 9.0, 50)]), (3, 0, []), (3, 1, [(4, 0.0, 99)]),
    ]
    out = {r["film_id"]: (r["percent"], r["votes"], r["hit_id"]) for r in feeds.first_usable_hit(spark.createDataFrame(rows, schema)).collect()}
    assert out == {1: (73, 40, 6), 2: (60, 20, 7)}
