"""One identity for a title spelled differently in several sources, and upserts by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatecount import rules
from gatecount.functions import text as X
from gatecount.functions import times as T
from gatecount.operators.ordered import dense_number, first_per_key
from gatecount.session import cut_lineage

KEYS = ("match_key", "tight_key", "local_key")


def with_identity(df: DataFrame, title: str = "title", original: str | None = "original_title") -> DataFrame:
    """Add match_key, tight_key, local_key and the trimmed title and original title."""
    source = F.col(original) if original else F.lit(None).cast("string")
    out = df.withColumn("_id", X.identity(F.col(title), source))
    return out.withColumns(
        {k: F.col(f"_id.{k}") for k in (*KEYS, "title", "original_title")}
    ).drop("_id")


def with_identity_by_title(df: DataFrame, title: str = "title", original: str = "original_title") -> DataFrame:
    """`with_identity` where titles repeat: the keys are made once per different pair of titles.

    Normalising costs far more than moving a title. The distinct pairs are spread over all tasks, however few files
    or row groups ``df`` is read from, and no filter on a key normalises every row again.
    """
    told = df.groupBy(F.col(title).alias("_told"), F.col(original).alias("_told_original"))
    # Made from aggregates, not from the group's keys: Spark moves filters on these below the aggregate, to every row.
    pairs = told.agg(F.min(title).alias("_t"), F.min(original).alias("_o"))
    made = pairs.select("_told", "_told_original", X.identity(F.col("_t"), F.col("_o")).alias("_id"))
    same = F.col(title).eqNullSafe(F.col("_told")) & F.col(original).eqNullSafe(F.col("_told_original"))
    out = df.join(made, same)
    return out.withColumns({k: F.col(f"_id.{k}") for k in (*KEYS, "title", "original_title")}).drop("_id", "_told", "_told_original")


def _lookup(films: DataFrame, key: str, name: str) -> DataFrame:
    """Lowest id per key; the aggregate makes the key unique, so joins never multiply rows."""
    return films.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("film_id").alias(name))


def cascade(rows: DataFrame, films: DataFrame, keys: Sequence[str] = KEYS, name: str = "film_id") -> DataFrame:
    """Add the id of the first key, in order, that the catalogue knows; null if none does."""
    out = rows
    for i, key in enumerate(keys):
        out = out.join(_lookup(films, key, f"_hit{i}"), key, "left")
    hits = [f"_hit{i}" for i in range(len(keys))]
    return out.select(*rows.columns, F.coalesce(*hits).alias(name))


def _component_labels(identities: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Label = lowest first position among all identities linked by tight or local key.

    Each round takes the minimum per tight key, then per local key, then follows
    the label's own label, which halves the remaining distance. The rounds run on
    distinct identities and are cut by a reliable checkpoint.
    """
    labels = cut_lineage(identities.withColumn("label", F.col("first_position")))
    for _ in range(max_rounds):
        moved = labels.withColumn("_old", F.col("label"))
        for key in ("tight_key", "local_key"):
            lowest = moved.groupBy(key).agg(F.min("label").alias("_low"))
            moved = moved.join(lowest, key).withColumn("label", F.col("_low")).drop("_low")
        jump = moved.select(F.col("first_position").alias("label"), F.col("label").alias("_next"))
        moved = (
            moved.join(jump, "label", "left")
            .withColumn("label", F.least("label", F.coalesce("_next", "label")))
            .drop("_next")
        )
        moved = cut_lineage(moved)
        labels = moved.drop("_old")
        if moved.where(F.col("label") < F.col("_old")).isEmpty():
            return labels
    raise RuntimeError("identity labels did not settle")


def resolve_entities(
    inputs: DataFrame, films: DataFrame, aliases: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Give every input row a film id. Returns (inputs with film_id, new catalogue).

    ``inputs``: position (unique arrival number), alias_key, title, original_title.
    ``films``: film_id, match_key, tight_key, local_key, title, original_title.
    ``aliases``: alias_key, film_id.

    Known aliases win, and of several inputs with one new alias the first decides for
    all. Misses match the catalogue by match, tight, then local key (a film of an older
    snapshot without a local key is found by its title, and keeps the key it is found
    by); a film without an original title learns it, with its keys, from the first
    input that has one. What is still unmatched is grouped: identities linked by
    a shared tight or local key, directly or through others, are one new film,
    numbered on from the highest id in order of first arrival. Only distinct
    identities take part, so many copies of one title cost one row. An input
    without a title is an error.
    """
    known = aliases.select("alias_key", F.col("film_id").alias("_alias_id"))
    no_title = F.raise_error(F.concat(F.lit("input without a title: "), F.col("position").cast("string"))).cast("string")
    rows = inputs.select("position", "alias_key", F.coalesce("title", no_title).alias("title"), "original_title")
    rows = rows.join(known, "alias_key", "left")
    new = rows.where(F.col("_alias_id").isNull())
    # The first input of an alias; an input without one stands for itself.
    asked = with_identity(
        first_per_key(new.where(F.col("alias_key").isNotNull()), ["alias_key"], [F.col("position")])
        .unionByName(new.where(F.col("alias_key").isNull()))
        .drop("_alias_id")
    )
    title_key = X.identity(F.col("title"), F.lit(None).cast("string"))["match_key"]
    indexed = films.withColumn("local_key", F.coalesce("local_key", title_key))

    distinct = (
        asked.groupBy(*KEYS)
        .agg(
            F.min("position").alias("first_position"),
            F.min_by("title", "position").alias("title"),
            F.min(F.when(F.col("original_title").isNotNull(), F.col("position"))).alias("taught_at"),
            F.min_by(
                "original_title", F.when(F.col("original_title").isNotNull(), F.col("position"))
            ).alias("original_title"),
        )
    )
    matched = cut_lineage(cascade(distinct, indexed, KEYS, "_cat_id"))

    # Learning: the first input with an original title teaches a film that has none.
    open_films = films.where(F.col("original_title").isNull()).select(F.col("film_id").alias("_cat_id"))
    lessons = (
        matched.where(F.col("_cat_id").isNotNull() & F.col("taught_at").isNotNull())
        .join(open_films, "_cat_id", "left_semi")
        .groupBy(F.col("_cat_id").alias("film_id"))
        .agg(
            *[F.min_by(c, "taught_at").alias(f"_new_{c}") for c in ("original_title", "match_key", "tight_key")]
        )
    )
    learned = films.join(lessons, "film_id", "left").select(
        *[
            F.coalesce(f"_new_{c}", c).alias(c) if c in ("original_title", "match_key", "tight_key") else F.col(c)
            for c in films.columns
        ]
    )
    taught = learned.join(lessons.select("film_id"), "film_id", "left_semi")
    second = cascade(matched.where(F.col("_cat_id").isNull()).drop("_cat_id"), taught, KEYS[:2], "_cat_id")

    fresh = second.where(F.col("_cat_id").isNull()).drop("_cat_id")
    labels = _component_labels(fresh)
    heads = labels.groupBy("label").agg(
        F.min_by("title", "first_position").alias("title"),
        F.min_by("local_key", "first_position").alias("local_key"),
        # The keys follow the first original title of the group, if it has one.
        *[
            F.coalesce(F.min_by(c, "taught_at"), F.min_by(c, "first_position")).alias(c)
            for c in ("match_key", "tight_key", "original_title")
        ],
    )
    highest = films.agg(F.coalesce(F.max("film_id"), F.lit(0)))
    minted = dense_number(heads, "label", "film_id", highest.scalar() + 1)

    ids = (
        matched.where(F.col("_cat_id").isNotNull())
        .select(*KEYS, "_cat_id")
        .unionByName(second.where(F.col("_cat_id").isNotNull()).select(*KEYS, "_cat_id"))
        .unionByName(
            labels.join(minted.select("label", F.col("film_id").alias("_cat_id")), "label").select(*KEYS, "_cat_id")
        )
    )
    # A film without a local key takes that of the first input that found it.
    keyless = films.where(F.col("local_key").isNull()).select(F.col("film_id").alias("_cat_id"))
    first_found = (
        matched.select("_cat_id", "local_key", "first_position")
        .unionByName(second.select("_cat_id", "local_key", "first_position"))
        .join(keyless, "_cat_id", "left_semi")
        .groupBy(F.col("_cat_id").alias("film_id"))
        .agg(F.min_by("local_key", "first_position").alias("_new_local"))
    )
    learned = learned.join(first_found, "film_id", "left").select(
        *[F.coalesce("local_key", "_new_local").alias(c) if c == "local_key" else F.col(c) for c in films.columns]
    )
    # One row per identity on the right, then one per alias; a hot title is a skewed
    # left side, which the adaptive skew join splits.
    found = asked.join(ids, list(KEYS), "left").select("position", "alias_key", "_cat_id")
    by_alias = found.where(F.col("alias_key").isNotNull()).select("alias_key", "_cat_id")
    by_position = found.where(F.col("alias_key").isNull()).select("position", F.col("_cat_id").alias("_own_id"))
    resolved = (
        rows.join(by_alias, "alias_key", "left")
        .join(by_position, "position", "left")
        .select("position", "alias_key", F.coalesce("_alias_id", "_cat_id", "_own_id").alias("film_id"))
    )
    catalogue = learned.unionByName(minted.select("film_id", *KEYS, "title", "original_title"), allowMissingColumns=True)
    return resolved, catalogue


def relink(lines: DataFrame, films: DataFrame) -> DataFrame:
    """Re-resolve stored report lines; links are corrected or added, never dropped.

    Only distinct titles go through the cascade. Adds ``changed``.
    """
    keyed = lines.withColumn("_title_key", F.lower(X.trim_all(F.col("title"))))
    titles = with_identity(keyed.select(F.col("_title_key").alias("title")).distinct(), "title", None)
    local = F.coalesce("local_key", X.identity(F.col("title"), F.lit(None).cast("string"))["match_key"])
    indexed = films.withColumn("local_key", local)
    found = cascade(titles, indexed, KEYS, "_found").select(F.col("title").alias("_title_key"), "_found")
    joined = keyed.join(found, "_title_key", "left")
    changed = F.col("_found").isNotNull() & ~F.col("_found").eqNullSafe(F.col("film_id"))
    return joined.select(
        *[F.coalesce("_found", "film_id").alias(c) if c == "film_id" else F.col(c) for c in lines.columns],
        changed.alias("changed"),
    )


def first_wins_lookup(films: DataFrame, listing: DataFrame, title: str = "title") -> DataFrame:
    """Left join a listing (position, title, ...) by normalised title; its first entry wins."""
    key = X.identity(F.col(title), F.lit(None).cast("string"))["match_key"]
    payload = [c for c in listing.columns if c != title]
    index = first_per_key(
        listing.withColumn("_key", key), ["_key"], [F.col("position")]
    ).select("_key", *[F.col(c).alias(f"listing_{c}") for c in payload])
    return films.withColumn("_key", key).join(index, "_key", "left").drop("_key")


def duplicate_map(films: DataFrame) -> DataFrame:
    """film_id -> survivor_id: the lowest id among films with the same local key."""
    key = F.coalesce("local_key", X.identity(F.col("title"), F.lit(None).cast("string"))["match_key"])
    keyed = films.select("film_id", key.alias("_key")).where(F.col("_key").isNotNull() & (F.col("_key") != ""))
    keepers = keyed.groupBy("_key").agg(F.min("film_id").alias("survivor_id"))
    return keyed.join(keepers, "_key").select("film_id", "survivor_id")


def merge_films(films: DataFrame) -> DataFrame:
    """The catalogue with duplicates folded into their survivor.

    The survivor keeps its title and kind; original title and keys come from the
    lowest id that has an original title; other columns from the lowest id that
    has a value.
    """
    key = F.coalesce("local_key", X.identity(F.col("title"), F.lit(None).cast("string"))["match_key"])
    own_group = F.concat(F.lit("\0"), F.col("film_id").cast("string"))
    mapped = films.withColumn("_group", F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(own_group))
    has_original = F.col("original_title").isNotNull() & (F.col("original_title") != "")
    with_original = F.when(has_original, F.col("film_id"))
    own = [c for c in ("title", "kind", "local_key") if c in films.columns]
    tied = ("original_title", "match_key", "tight_key")
    rest = [c for c in films.columns if c not in (*own, *tied, "film_id")]
    return mapped.groupBy("_group").agg(
        F.min("film_id").alias("film_id"),
        *[F.min_by(c, "film_id").alias(c) for c in own],
        *[F.coalesce(F.min_by(c, with_original), F.min_by(c, "film_id")).alias(c) for c in tied],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("film_id"))).alias(c) for c in rest],
    ).select(*films.columns)


def remap(df: DataFrame, mapping: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """Replace film ids by their survivors; with ``sums`` re-add rows that now coincide."""
    moved = mapping.where(F.col("film_id") != F.col("survivor_id"))
    out = df.join(moved, "film_id", "left").select(
        *[F.coalesce("survivor_id", "film_id").alias(c) if c == "film_id" else F.col(c) for c in df.columns]
    )
    if not sums:
        return out
    keys = [c for c in df.columns if c not in sums]
    return out.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums]).select(*df.columns)


def upsert_replace(stored: DataFrame, incoming: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Incoming rows replace stored ones; the last of several wins."""
    last = first_per_key(incoming, [key], [F.desc(position)]).select(*stored.columns)
    return stored.join(last, key, "left_anti").unionByName(last)


def _latest(column: str, position: str) -> Column:
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(position))).alias(column)


def upsert_halls(stored: DataFrame, incoming: DataFrame, position: str = "position") -> DataFrame:
    """Names and plan ids keep their last known value; capacity is never overwritten."""
    new = incoming.groupBy("hall_key").agg(
        *[_latest(c, position) for c in ("cinema_key", "name", "seatplan_id")]
    )
    old = stored.select("hall_key", *[F.col(c).alias(f"_{c}") for c in ("cinema_key", "name", "capacity", "seatplan_id")])
    return new.join(old, "hall_key", "full_outer").select(
        "hall_key",
        F.coalesce("cinema_key", "_cinema_key").alias("cinema_key"),
        F.coalesce("name", "_name").alias("name"),
        F.col("_capacity").alias("capacity"),
        F.coalesce("seatplan_id", "_seatplan_id").alias("seatplan_id"),
    )


SCHEDULED = ("starts_at", "day", "formats", "sold_out")


def upsert_screenings(stored: DataFrame, incoming: DataFrame, position: str = "position") -> DataFrame:
    """A refresh changes start, day, formats and the sold-out flag of a known row, nothing else.

    New rows take the rest from their first appearance.
    """
    # Stored and incoming rows of a show meet in one exchange and one sort, by which the result stays dealt out. A full
    # outer join forgets that, so whatever joins by show next would move every row again, and an aggregate over strings
    # would sort every task's rows once more before they move.
    told = [F.col(c) for c in incoming.columns if c in stored.columns]
    new = incoming.select(*told, F.col(position).alias("_position"), F.lit(True).alias("_new"))
    rows = stored.withColumns({"_position": F.lit(None).cast(new.schema["_position"].dataType), "_new": F.lit(False)})
    both = rows.unionByName(new, allowMissingColumns=True)
    arrived = Window.partitionBy("screening_key").orderBy("_new", "_position")
    rest = [c for c in stored.columns if c not in (*SCHEDULED, "screening_key")]
    last = both.withColumns({"_first": F.first(F.struct(*rest)).over(arrived), "_later": F.lead(F.lit(True)).over(arrived)})
    return last.where(F.col("_later").isNull()).select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in stored.columns])


def reschedule(
    stored: DataFrame, schedule: DataFrame, now: Column, zone: str = rules.LOCAL_ZONE
) -> DataFrame:
    """Rows whose start moved, with the corrected start, day and next look.

    ``schedule``: screening_key (unique), new_start.
    """
    moved = stored.join(schedule.select("screening_key", "new_start"), "screening_key").where(
        F.col("starts_at") != F.col("new_start")
    )
    return moved.select(
        "screening_key",
        F.col("starts_at").alias("old_start"),
        F.col("new_start").alias("starts_at"),
        T.business_day(T.utc_to_local(F.col("new_start"), zone)).alias("day"),
        T.next_look(F.col("new_start"), now).alias("next_look_at"),
    )


def only_new(seen: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return seen.join(stored.select(*keys), list(keys), "left_anti")


def restrict_to(series: DataFrame, listed: DataFrame, key: str = "film_id") -> DataFrame:
    """Keep the rows of a series whose key is listed."""
    return series.join(listed.select(key), key, "left_semi")


def flag_by_tag(
    films: DataFrame,
    tagged: DataFrame,
    titles: DataFrame,
    pattern: str = rules.ALTERNATIVE_PATTERN,
) -> DataFrame:
    """Mark a film 'event' when any of its rows carries the tag; ``marked`` counts it once.

    ``tagged``: title_id, properties. ``titles``: title_id, film_id. ``films``: film_id, kind.
    """
    flagged = tagged.where(F.exists("properties", lambda p: p.rlike(pattern))).select("title_id").distinct()
    hits = titles.join(flagged, "title_id", "left_semi").select("film_id").distinct()
    joined = films.join(hits.withColumn("_hit", F.lit(True)), "film_id", "left")
    already = F.coalesce(F.col("kind") == "event", F.lit(False))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return joined.select(
        *[F.when(hit, "event").otherwise(F.col("kind")).alias(c) if c == "kind" else F.col(c) for c in films.columns],
        (hit & ~already).alias("marked"),
    )


def horizon_filter(
    events: DataFrame, halls: DataFrame, now: Column, days_ahead: int = rules.DISCOVERY_DAYS
) -> DataFrame:
    """Events from now to the horizon whose hall is known; the rest cannot be placed."""
    start = F.col("starts_at")
    return events.where((start >= now) & (start <= now + T.days(days_ahead))).join(
        halls.select("hall_key", "cinema_key"), "hall_key"
    )


def sample_per_key(events: DataFrame, key: str, event: str = "event_id", start: str = "starts_at") -> DataFrame:
    """One sample event per key, the nearest start (lowest event id on a tie)."""
    return events.groupBy(key).agg(
        F.min(F.struct(F.col(start), F.col(event))).alias("_first")
    ).select(key, F.col(f"_first.{event}").alias(event), F.col(f"_first.{start}").alias(start))


def union_last_wins(tables: Sequence[DataFrame], key: str, position: str = "position") -> DataFrame:
    """Union of several scans of the same events; a later table, then position, wins."""
    numbered = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    every = reduce(DataFrame.unionByName, numbered)
    return first_per_key(every, [key], [F.desc("_table"), F.desc(position)]).drop("_table")


def source_priority(
    films: DataFrame, sources: Sequence[DataFrame], value: str, key: str = "film_id"
) -> DataFrame:
    """The value of the first source that has one, else the film's own; adds ``source``.

    Sources are unique per key.
    """
    out, picks, names = films, [], []
    for i, source in enumerate(sources):
        out = out.join(source.select(key, F.col(value).alias(f"_s{i}")), key, "left")
        picks.append(F.col(f"_s{i}"))
        names.append(F.when(F.col(f"_s{i}").isNotNull(), F.lit(i)))
    return out.select(
        *[F.coalesce(*picks, F.col(value)).alias(c) if c == value else F.col(c) for c in films.columns],
        F.coalesce(*names).alias("source"),
    )
