"""Identity across sources, duplicate films, upserts by key."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gatecount.functions import times as T
from gatecount.operators import resolve as E

FILMS = "film_id bigint, match_key string, tight_key string, local_key string, title string, original_title string"
INPUT = "position bigint, alias_key string, title string, original_title string"


def catalogue(spark, rows):
    """rows: (film_id, title, original_title)"""
    df = spark.createDataFrame(rows, "film_id bigint, title string, original_title string")
    return E.with_identity(df).select("film_id", *E.KEYS, "title", "original_title")


def resolve(spark, inputs, films=(), aliases=()):
    inputs = spark.createDataFrame([(i, *r) for i, r in enumerate(inputs)], INPUT)
    known = spark.createDataFrame(list(aliases), "alias_key string, film_id bigint")
    resolved, new = E.resolve_entities(inputs, catalogue(spark, list(films)), known)
    ids = {r["alias_key"]: r["film_id"] for r in resolved.collect()}
    return ids, {r["film_id"]: r for r in new.collect()}


def test_sources_meet_on_the_original_title(spark):
    ids, films = resolve(
        spark,
        [
            ("a:1", "Spider-Man: Zbrusu nový den", "Spider-Man: Brand New Day"),
            ("b:9", "SPIDERMAN Zcela nový den", "Spider-Man: Brand New Day"),
            ("c:5", "Spider-Man: Zbrusu nový den", None),
            ("a:2", "Vlny", None),
            ("b:3", "Uma", "Uma Musume Pretty Derby"),
            ("a:4", "Umamusume", "Umamusume Pretty Derby"),
        ],
    )
    assert ids == {"a:1": 1, "b:9": 1, "c:5": 1, "a:2": 2, "b:3": 3, "a:4": 3}
    assert films[1]["original_title"] == "Spider-Man: Brand New Day"


def test_alias_wins_over_a_renamed_title(spark):
    ids, _ = resolve(spark, [("a:1", "Úplně jiný název", None)], [(4, "Vlny", None)], [("a:1", 4)])
    assert ids == {"a:1": 4}


def test_the_first_input_of_a_new_alias_decides(spark):
    ids, films = resolve(spark, [("a:1", "Vlny", None), ("a:1", "Vlny (repríza)", "Waves"), ("b:1", "Vlny (repríza)", None)])
    assert ids == {"a:1": 1, "b:1": 2} and set(films) == {1, 2}
    inputs = spark.createDataFrame([(0, None, "Vlny", None), (1, None, "Jiné", None), (2, None, "Vlny", None)], INPUT)
    resolved, _ = E.resolve_entities(inputs, catalogue(spark, []), spark.createDataFrame([], "alias_key string, film_id bigint"))
    assert sorted((r["position"], r["film_id"]) for r in resolved.collect()) == [(0, 1), (1, 2), (2, 1)]


def test_a_film_without_local_key_is_found_by_its_title_and_takes_the_key(spark):
    films = catalogue(spark, [(7, "Gamma", "Gamma Rays")]).withColumn("local_key", F.lit(None).cast("string"))
    inputs = spark.createDataFrame([(0, "a:1", "Gamma", None)], INPUT)
    resolved, new = E.resolve_entities(inputs, films, spark.createDataFrame([], "alias_key string, film_id bigint"))
    assert [r["film_id"] for r in resolved.collect()] == [7]
    assert [(r["film_id"], r["local_key"]) for r in new.collect()] == [(7, "gamma")]


def test_an_input_without_a_title_is_an_error(spark):
    with pytest.raises(Exception, match="without a title"):
        resolve(spark, [("a:1", None, None)])


def test_a_film_learns_its_original_title(spark):
    ids, films = resolve(
        spark,
        [("a:1", "Vlny", "Waves"), ("b:1", "Jiné vlny", "Waves"), ("b:2", "Nic", None)],
        [(4, "Vlny", None), (9, "Něco", "Something")],
    )
    assert ids["a:1"] == ids["b:1"] == 4 and ids["b:2"] == 10
    assert (films[4]["original_title"], films[4]["match_key"], films[4]["local_key"]) == ("Waves", "waves", "vlny")


def test_chains_of_shared_keys_are_one_film(spark):
    chain = [(f"a:{i}", f"Title {i // 2}x", f"Original {(i + 1) // 2}y") for i in range(24)]
    ids, films = resolve(spark, list(reversed(chain)) + [("b:1", "Alone", None)])
    assert len({v for k, v in ids.items() if k.startswith("a:")}) == 1
    assert ids["b:1"] != ids["a:0"] and len(films) == 2


def test_copies_of_one_title_take_part_once(spark):
    ids, films = resolve(spark, [(f"a:{i}", "Vlny", None) for i in range(300)])
    assert set(ids.values()) == {1} and len(films) == 1


def test_merge_duplicates(spark):
    films = spark.createDataFrame(
        [
            (1, "Spider-Man: Zbrusu nový den", None, None, 70.0),
            (45, "Spider-Man: Zbrusu nový den", "Spider-Man: Brand New Day", "event", 80.0),
            (3, "Vlny", None, None, None),
        ],
        "film_id bigint, title string, original_title string, kind string, rating double",
    )
    films = E.with_identity(films)
    mapping = E.duplicate_map(films)
    assert {tuple(r) for r in mapping.collect()} == {(1, 1), (45, 1), (3, 3)}
    merged = {r["film_id"]: r for r in E.merge_films(films).collect()}
    assert merged.keys() == {1, 3}
    kept = merged[1]
    assert kept["original_title"] == "Spider-Man: Brand New Day" and kept["match_key"] == "spider man brand new day"
    # The survivor's own kind stays: being an event is not inherited.
    assert kept["kind"] is None and kept["rating"] == 70.0
    ramp = spark.createDataFrame([("h", 1, 10), ("h", 45, 4), ("h", 3, 5)], "hour string, film_id bigint, sold bigint")
    assert {tuple(r) for r in E.remap(ramp, mapping, ["sold"]).collect()} == {("h", 1, 14), ("h", 3, 5)}


def test_relink_adds_and_corrects_but_never_drops(spark):
    films = catalogue(spark, [(1, "Vlny", "Waves"), (2, "Odyssea", None)])
    lines = spark.createDataFrame(
        [(1, " VLNY ", None), (2, "Odyssea", 77), (3, "Neznámý", 5), (4, "Odyssea 3D", 2), (5, "Nikdo", None)],
        "n bigint, title string, film_id bigint",
    )
    out = {r["n"]: (r["film_id"], r["changed"]) for r in E.relink(lines, films).collect()}
    assert out == {1: (1, True), 2: (2, True), 3: (5, False), 4: (2, False), 5: (None, False)}


def test_upsert_screenings_touches_only_the_schedule(spark):
    day, start = dt.date(2026, 8, 1), dt.datetime(2026, 8, 1, 18)
    schema = (
        "screening_key string, film_id bigint, starts_at timestamp_ntz, day date, formats array<string>, "
        "lang string, sold_out boolean, sold bigint"
    )
    stored = spark.createDataFrame(
        [("a", 1, start, day, ["3D"], "dabing", False, 9), ("old", 2, start, day, [], None, False, 3)], schema
    )
    later = start + dt.timedelta(hours=1)
    incoming = spark.createDataFrame(
        [(0, "a", 5, start, day, [], "titulky", True), (1, "a", 6, later, day, ["IMAX"], None, False), (2, "b", 7, start, day, [], "dabing", False)],
        "position bigint, screening_key string, film_id bigint, starts_at timestamp_ntz, day date, formats array<string>, lang string, sold_out boolean",
    )
    out = {r["screening_key"]: r for r in E.upsert_screenings(stored, incoming).collect()}
    assert tuple(out["a"]) == ("a", 1, later, day, ["IMAX"], "dabing", False, 9)
    assert tuple(out["b"]) == ("b", 7, start, day, [], "dabing", False, None)
    assert tuple(out["old"]) == ("old", 2, start, day, [], None, False, 3)


def test_upsert_halls_keeps_capacity(spark):
    stored = spark.createDataFrame(
        [("h", "c", "Sál 1", 158, None)], "hall_key string, cinema_key string, name string, capacity bigint, seatplan_id string"
    )
    incoming = spark.createDataFrame(
        [(0, "h", "d", None, "p1"), (1, "h", "d", None, None), (2, "n", "e", "Sál 9", None)],
        "position bigint, hall_key string, cinema_key string, name string, seatplan_id string",
    )
    out = {r["hall_key"]: tuple(r) for r in E.upsert_halls(stored, incoming).collect()}
    assert out == {"h": ("h", "d", "Sál 1", 158, "p1"), "n": ("n", "e", "Sál 9", None, None)}


def test_reschedule_and_horizon(spark):
    start = dt.datetime(2026, 8, 1, 18)
    stored = spark.createDataFrame([("a", start), ("b", start)], "screening_key string, starts_at timestamp_ntz")
    schedule = spark.createDataFrame(
        [("a", start), ("b", dt.datetime(2026, 8, 2, 2, 30))], "screening_key string, new_start timestamp_ntz"
    )
    out = E.reschedule(stored, schedule, T.instant("2026-08-01 10:00:00")).collect()
    assert [(r["screening_key"], r["day"]) for r in out] == [("b", dt.date(2026, 8, 1))]
    events = spark.createDataFrame(
        [("x", "h1", start), ("y", "h2", start), ("z", "h1", start + dt.timedelta(days=60))],
        "event_id string, hall_key string, starts_at timestamp_ntz",
    )
    halls = spark.createDataFrame([("h1", "c1")], "hall_key string, cinema_key string")
    kept = E.horizon_filter(events, halls, T.instant("2026-08-01 10:00:00")).collect()
    assert [(r["event_id"], r["cinema_key"]) for r in kept] == [("x", "c1")]


def test_flag_is_given_once_per_film(spark):
    films = spark.createDataFrame([(1, None), (2, "event"), (3, None)], "film_id bigint, kind string")
    tagged = spark.createDataFrame(
        [("t1", ["4K", "Alternativní program"]), ("t1", ["alternativni PROGRAM"]), ("t2", ["Alternativní program"]), ("t3", ["Alternativní programy"])],
        "title_id string, properties array<string>",
    )
    titles = spark.createDataFrame([("t1", 1), ("t2", 2), ("t3", 3)], "title_id string, film_id bigint")
    out = {r["film_id"]: (r["kind"], r["marked"]) for r in E.flag_by_tag(films, tagged, titles).collect()}
    assert out == {1: ("event", True), 2: ("event", False), 3: (None, False)}


def test_first_entry_of_a_listing_wins(spark):
    films = spark.createDataFrame([(1, "Odyssea"), (2, "Vlny")], "film_id bigint, title string")
    listing = spark.createDataFrame(
        [(0, "ODYSSEA 3D", "/1"), (1, "Odyssea", "/2")], "position bigint, title string, path string"
    )
    out = {r["film_id"]: r["listing_path"] for r in E.first_wins_lookup(films, listing).collect()}
    assert out == {1: "/1", 2: None}


def test_restrict_and_only_new(spark):
    series = spark.createDataFrame([(1, 5), (2, 6)], "film_id bigint, sold bigint")
    listed = spark.createDataFrame([(1,), (1,)], "film_id bigint")
    assert [tuple(r) for r in E.restrict_to(series, listed).collect()] == [(1, 5)]
    assert [tuple(r) for r in E.only_new(series, listed, ["film_id"]).collect()] == [(2, 6)]


def test_identity_by_title_is_the_identity_of_each_row(spark):
    rows = [(1, " Válka 3D ", None), (2, " Válka 3D ", None), (3, None, None), (4, "", ""), (5, "A", " The A "), (6, "A", None), (7, None, "B"), (8, "3D", " ")]
    films = spark.createDataFrame(rows, "film_id bigint, title string, original_title string")
    columns = ["film_id", *E.KEYS, "title", "original_title"]
    made = E.with_identity_by_title(films).select(*columns)
    assert sorted(made.collect()) == sorted(E.with_identity(films).select(*columns).collect())


def test_upsert_moves_every_show_once(spark):
    """What joins by show after an upsert finds it dealt out by show already."""
    kind = "screening_key string, starts_at timestamp_ntz, day date, formats array<string>, sold_out boolean, hall string, sold bigint"
    stored = spark.createDataFrame([("a", None, None, ["2D"], True, "old", 7), ("b", None, None, None, False, None, None)], kind)
    told = [("a", None, None, ["3D"], False, "new", None, 2), ("a", None, None, None, True, "newer", None, 1), ("c", None, None, None, None, "x", None, 5), ("c", None, None, ["V"], None, None, None, 9)]
    incoming = spark.createDataFrame(told, kind + ", position bigint").drop("sold")
    out = E.upsert_screenings(stored, incoming)
    assert out.columns == stored.columns
    rows = {r[0]: tuple(r[3:]) for r in out.collect()}
    assert rows == {"a": (["3D"], False, "old", 7), "b": (None, False, None, None), "c": (["V"], None, "x", None)}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = spark.range(9).select(F.col("id").cast("string").alias("screening_key"), "id").groupBy("screening_key").count()
        plan = out.join(read, "screening_key", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning(screening_key") == 2
