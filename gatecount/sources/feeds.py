"""JSON payloads: the whole-chain feed, page payloads, event documents, search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecount import rules
from gatecount.functions import numbers as N
from gatecount.functions import text as X
from gatecount.functions import times as T
from gatecount.functions.binding import bind
from gatecount.sources.snapshots import read_json

PRESENTATION = (
    "struct<id:bigint,dateTime:string,businessDate:string,featureName:string,"
    "featureAdditionalName:string,featureId:bigint,durationInMinutes:int,venueId:bigint,"
    "venueName:string,seatplanId:bigint,venueCity:string,venueLocationId:bigint,"
    "locationName:string,availRatio:double,soldout:int,featureAttributes:array<string>,"
    "dubbedLanguageISO:string,subbedLanguageISO:string>"
)
FEED = f"presentations array<{PRESENTATION}>"
EVENT = (
    "eventid bigint, titleid bigint, title_groupid bigint, venueid bigint, venue string, "
    "start string, duration_minutes int, cinemaid bigint, title string, title_group string, "
    "subtitle_group string, event_properties array<struct<propertyid:int,name:string,type:string>>"
)
SEAT_PLAN = "sections map<string,struct<Capacity:int>>"
HALL = (
    "seats array<struct<state:string,row:string,seat:int>>, "
    "prices array<struct<price_categoryid:int,price:double,currency:string>>"
)


def read_feed(spark: SparkSession, path: str, chain: str, cinema_prefix: str = "") -> DataFrame:
    """Canonical screenings of stored feed documents."""
    return presentations(read_json(spark, path, FEED, multiline=True), chain, cinema_prefix)


def presentations(feed: DataFrame, chain: str, cinema_prefix: str = "") -> DataFrame:
    """One canonical row per presentation of a feed document."""
    p = feed.select(F.explode("presentations").alias("p")).select("p.*")
    wall = T.parse_naive(F.col("dateTime"))
    published = F.nullif(F.col("businessDate"), F.lit("")).cast("date")
    return p.select(
        F.lit(chain).alias("chain"),
        F.concat(F.lit(f"{chain}:"), F.col("id").cast("string")).alias("screening_key"),
        T.local_to_utc(wall).alias("starts_at"),
        F.coalesce(published, T.business_day(wall)).alias("day"),
        F.concat(F.lit(f"{chain}:"), F.col("venueLocationId").cast("string")).alias("cinema_key"),
        F.concat(F.lit(cinema_prefix), F.col("locationName")).alias("cinema"),
        F.col("venueCity").alias("city"),
        F.concat(F.lit(f"{chain}:"), F.col("venueId").cast("string")).alias("hall_key"),
        F.col("venueName").alias("hall"),
        F.col("seatplanId").cast("string").alias("seatplan_id"),
        F.concat(F.lit(f"{chain}:"), F.col("featureId").cast("string")).alias("alias_key"),
        F.col("featureName").alias("title"),
        F.nullif(F.col("featureAdditionalName"), F.lit("")).alias("original_title"),
        X.normalize_formats(F.col("featureAttributes")).alias("formats"),
        X.version_from_languages(F.col("dubbedLanguageISO"), F.col("subbedLanguageISO")).alias("lang"),
        F.coalesce(F.col("soldout") == 1, F.lit(False)).alias("sold_out"),
        F.col("availRatio").alias("free_ratio"),
    )


def hall_capacity(sections: Column) -> Column:
    """Sum over a map of sections; a section without a capacity counts 0."""
    values = F.coalesce(F.map_values(sections), F.array().cast("array<struct<Capacity:int>>"))
    return F.aggregate(
        values, F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s["Capacity"], F.lit(0))
    )


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "variant")


def _deref(flat: Column, value: Column) -> Column:
    """A whole number is the position of the value, anything else is the value."""
    at = F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return bind(
        at, lambda i: F.when((i >= 0) & (i < F.size(flat)), F.get(flat, i.cast("int"))).otherwise(value)
    )


def _text(flat: Column, value: Column) -> Column:
    return bind(
        _deref(flat, value),
        lambda v: F.coalesce(F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit("")),
    )


def _payload(html: str, pattern: str) -> Column:
    script = F.regexp_extract(F.col(html), pattern, 1)
    return F.try_variant_get(F.try_parse_json(script), "$", "array<variant>")


def _events_in(flat: Column) -> Column:
    def event(r: Column) -> Column:
        props = F.try_variant_get(_deref(flat, _field(r, "Properties")), "$", "array<variant>")
        names = F.transform(props, lambda p: _text(flat, _field(_deref(flat, p), "Name")))
        return F.struct(
            _text(flat, _field(r, "EventId")).alias("event_id"),
            _text(flat, _field(r, "Start")).alias("start"),
            _text(flat, _field(r, "TitleId")).alias("title_id"),
            _text(flat, _field(r, "ObjectId")).alias("hall_id"),
            F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>")).alias("properties"),
        )

    def is_event(r: Column) -> Column:
        named = _field(r, "EventId").isNotNull() & _field(r, "Start").isNotNull()
        return named & ~(_field(r, "CinemaId").isNotNull() & _field(r, "ObjectId").isNotNull())

    return F.transform(F.filter(flat, is_event), event)


def _halls_in(flat: Column) -> Column:
    halls = F.filter(flat, lambda r: _field(r, "CinemaId").isNotNull() & _field(r, "ObjectId").isNotNull())
    return F.transform(
        halls,
        lambda r: F.struct(
            _text(flat, _field(r, "ObjectId")).alias("hall_id"), _text(flat, _field(r, "CinemaId")).alias("cinema_id")
        ),
    )


def _last_events(found: DataFrame, page_id: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``found``: page_id, no, e (an event) and ``more``. The last record of an event id wins."""
    start = F.try_to_timestamp(F.col("e.start"))
    rows = found.select(
        page_id,
        "no",
        "e.event_id",
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), start.cast("timestamp_ntz")).alias("starts_at"),
        "e.title_id",
        "e.hall_id",
        "e.properties",
        *more,
    ).where((F.col("event_id") != "") & F.col("starts_at").isNotNull())
    kept = ("starts_at", "title_id", "hall_id", "properties", *more)
    last = rows.groupBy(page_id, "event_id").agg(F.max(F.struct("no", *kept)).alias("_last"))
    return last.select(page_id, "event_id", *[F.col(f"_last.{c}") for c in kept])


def payload_events(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", pattern: str = rules.PAYLOAD_SCRIPT
) -> DataFrame:
    """Scheduled events in the index-referenced payload of a page.

    The payload is one flat array whose records hold positions instead of values.
    It is parsed once and references are followed inside the row, so a page is
    neither joined with itself nor repeated per record. A page without a readable
    payload gives no rows; the last record of an event id wins.
    """
    found = pages.select(page_id, F.posexplode(bind(_payload(html, pattern), _events_in)).alias("no", "e"))
    return _last_events(found, page_id)


def payload_screenings(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", pattern: str = rules.PAYLOAD_SCRIPT
) -> DataFrame:
    """Events with the cinema of their hall, from one parse of each page and without a join.

    The last record that names a hall's cinema counts; an event in another hall is left out.
    """
    both = bind(
        _payload(html, pattern),
        lambda flat: F.struct(_events_in(flat).alias("events"), _halls_in(flat).alias("halls")),
    )
    parsed = pages.select(page_id, both.alias("p")).select(
        page_id, F.col("p.halls").alias("_halls"), F.posexplode("p.events").alias("no", "e")
    )
    named = F.filter("_halls", lambda h: (h["hall_id"] == F.col("e.hall_id")) & (h["cinema_id"] != ""))
    cinema = F.try_element_at(named, F.lit(-1))["cinema_id"]
    found = parsed.select(page_id, "no", "e", F.when(F.col("e.hall_id") != "", cinema).alias("cinema_id"))
    return _last_events(found, page_id, ("cinema_id",)).where(F.col("cinema_id").isNotNull())


def payload_halls(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", pattern: str = rules.PAYLOAD_SCRIPT
) -> DataFrame:
    """Hall -> cinema pairs of the same payload."""
    rows = pages.select(page_id, F.posexplode(bind(_payload(html, pattern), _halls_in)).alias("no", "h"))
    named = rows.where((F.col("h.hall_id") != "") & (F.col("h.cinema_id") != ""))
    return named.groupBy(page_id, F.col("h.hall_id").alias("hall_id")).agg(
        F.max_by("h.cinema_id", "no").alias("cinema_id")
    )


def events(documents: DataFrame, chain: str, body: str = "body") -> DataFrame:
    """Canonical rows of event documents (JSON text in ``body``)."""
    e = documents.select(F.from_json(F.col(body), EVENT, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    tags = F.transform("event_properties", lambda p: p["name"])
    return e.select(
        F.concat(F.lit(f"{chain}:"), F.col("eventid").cast("string")).alias("screening_key"),
        T.local_to_utc(T.parse_naive(F.col("start"))).alias("starts_at"),
        F.col("cinemaid").cast("string").alias("cinema_id"),
        F.col("venueid").cast("string").alias("hall_id"),
        F.col("venue").alias("hall"),
        # The group id joins the dubbed and the subtitled variant of one film.
        F.concat(F.lit(f"{chain}:"), F.col("title_groupid").cast("string")).alias("alias_key"),
        F.col("title_group").alias("title"),
        F.nullif(F.col("subtitle_group"), F.lit("")).alias("original_title"),
        X.normalize_formats(tags).alias("formats"),
        X.split_version(F.col("title"))["version"].alias("lang"),
    )


def first_usable_hit(
    searches: DataFrame, key: str = "film_id", min_votes: int = rules.MIN_VOTES
) -> DataFrame:
    """Rating of the first search, by priority, whose top hit has enough votes.

    ``searches``: key, priority, results array<struct<id, vote_average, vote_count>>.
    """
    hit = F.get("results", F.lit(0))
    usable = searches.withColumn("_h", hit).where(
        (F.col("_h.vote_count") >= min_votes) & (F.col("_h.vote_average") != 0)
    )
    best = usable.groupBy(key).agg(F.min(F.struct("priority", "_h.id", "_h.vote_average", "_h.vote_count")).alias("_b"))
    return best.select(
        key,
        N.round_half_up(F.col("_b.vote_average") * 10).alias("percent"),
        F.col("_b.vote_count").alias("votes"),
        F.col("_b.id").alias("hit_id"),
    )
