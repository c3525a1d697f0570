"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction of what they miss.

`base` finds e-mail addresses, IPv4 addresses, card numbers and phone numbers. They are the seeds. A pattern is the two
words left of the word in which an entity starts; an instance is a token between blanks, however long, that looks like an
identifier (an at sign, or four digits or more) and that no seed touches. Seeds in one word follow its pattern once. Spark scores the graph of patterns and instances in rounds: a pattern is worth the confidence of what
followed it over everything that followed it in any document, an instance as much as its best pattern, seeds count in
full. Patterns that end with CONFIDENCE or more and have followed SUPPORT distinct seeds at least
discover the instances after them, in all documents; the kind is that of most of the pattern's seeds.

All of it is DataFrame expressions and joins. The texts are read twice: spans and contexts go to a written table, which
the rounds and the result read; then the pairs of words of all texts are counted that may be a seed's pattern. A table
of bits, of bounded size, drops nearly all others before anything moves; the join that follows is exact. Hot patterns
("of the") are pre-aggregated before any shuffle and joined to one row per pattern, so the adaptive skew join may split
them.

Defined cases: a null text is empty and has no spans; each row of a repeated id is scanned; context words are compared
in lower case; an entity at the start of a text has an empty context, which is no pattern; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecount.functions.binding import bind
from gatecount.llm import spans
from gatecount.llm.common import quoted, text_or_empty, written

KINDS = ["email", "ip", "card", "phone", "near_email", "near_ip", "near_card", "near_phone"]
SEED_KINDS = 4
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A whole token between blanks that holds an at sign or four digits.
TOKEN = r"(?=[^\s]*?(?:@|(?:[0-9][^\s0-9]{0,2}){4}))[^\s]{4,}+"
ROUNDS = 3
CONFIDENCE = 0.8
SUPPORT = 3
#: Characters looked at to the left of an entity for its two words: more if these do not hold them whole, at last all.
LEFT = (120, 2400, 48_000)
#: Bits of the table that tells which pairs of words may be patterns: so many per pattern, and at most.
BITS_EACH, BITS = 16, 1 << 22


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(_digits(match)), "")
    value = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: d.cast("int") * (1 + i % 2))
    total = F.aggregate(value, F.lit(0), lambda t, v: t + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def _card(match: Column) -> Column:
    return F.char_length(_digits(match)).between(14, 19) & _luhn(match)


def base(text: Column) -> Column:
    return F.concat(
        spans.found(text, 0, EMAIL, lambda m: F.lit(True), run="A-Za-z0-9._%+-"),
        spans.found(text, 1, IP, lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), run="0-9"),
        spans.found(text, 2, CARD, _card),
        spans.found(text, 3, PHONE, lambda m: F.char_length(_digits(m)).between(10, 15)),
    )


def context(text: Column, span: Column) -> Column:
    """pattern: the two words before the word in which a span starts, in lower case (empty if there are not two); at:
    where that word starts."""

    def of(words: Column) -> Column:
        # The last is what the span's own word has before it, the first may be empty.
        a, b = (F.coalesce(F.get(words, F.size(words) - k), F.lit("")) for k in (3, 2))
        pair = F.when((a != "") & (b != ""), F.lower(F.concat_ws(" ", a, b))).otherwise("")
        own = F.char_length(F.element_at(words, -1))
        return F.struct(pair.alias("pattern"), (span["start"] - own).alias("at"))

    def within(width: int) -> Column:
        start = span["start"]
        left = F.substring(text, F.greatest(start - width + 1, F.lit(1)), F.least(start, F.lit(width)))
        # The first word may be cut unless the text starts with it.
        return bind(F.split(left, r"\s+"), lambda w: F.when((start <= width) | (F.size(w) > 3), of(w)))

    whole = bind(F.split(F.substring(text, F.lit(1), span["start"]), r"\s+"), of)
    return F.coalesce(*[within(width) for width in LEFT], whole)


def contexts_of_words(text: Column) -> Column:
    """The pairs of words that something follows, in lower case."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    many = F.greatest(F.size(words) - 2, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), many), F.slice(words, F.lit(2), many), lambda a, b: F.concat_ws(" ", a, b))


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """A written table: the columns `keep`, and base, seeds and loose (spans with their contexts) and a row number that
    no other row has."""
    t = text_or_empty(text)
    with_base = docs.select(*quoted(keep), t.alias("_t")).withColumn("_base", base(F.col("_t")))
    loose = spans.found(F.col("_t"), 0, TOKEN, lambda m: F.lit(True), run=r"\S")
    with_loose = with_base.withColumn("_loose", spans.apart(loose, F.col("_base")))

    def near(found: Column) -> Column:
        return F.transform(
            found, lambda s: bind(context(F.col("_t"), s), lambda c: F.struct(s.alias("span"), c["pattern"].alias("pattern"), c["at"].alias("at")))
        )

    return written(
        with_loose.select(
            F.monotonically_increasing_id().alias("_row"),
            *quoted(keep),
            F.col("_base"),
            near(F.col("_base")).alias("_seeds"),
            near(F.col("_loose")).alias("_loose"),
        ),
        "pii",
    )


def maybe(patterns: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for every one of `patterns` (one row each) and for few other texts."""
    bits = 64
    while bits < BITS and bits < BITS_EACH * patterns.count():
        bits *= 2
    place = lambda text: F.pmod(F.xxhash64(text), F.lit(bits))
    in_longs = patterns.select(place(F.col("pattern")).alias("at")).selectExpr(
        "cast(at div 64 as int) as long", "shiftleft(1L, cast(at % 64 as int)) as bit"
    )
    # At most BITS / 64 rows, whatever the corpus.
    held = {r["long"]: r["bits"] for r in in_longs.groupBy("long").agg(F.bit_or("bit").alias("bits")).collect()}
    table = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")

    def test(text: Column) -> Column:
        at = place(text)
        return F.getbit(F.element_at(table, F.floor(at / 64).cast("int") + 1), (at % 64).cast("int")) == 1

    return test


def patterns(scanned: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """pattern, kind: what the rounds trust in the end."""
    seeds = (
        scanned.select("_row", F.explode("_seeds").alias("s"))
        .select("_row", "s.pattern", "s.at", "s.span.kind", F.lower("s.span.value").alias("instance"))
        .where("pattern <> ''")
    )
    per_kind = seeds.groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    support = seeds.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count("*").alias("support"))
    in_words = seeds.select("_row", "at", "pattern").distinct().groupBy("pattern").agg(F.count("*").alias("seeds"))
    known = (
        per_kind.groupBy("pattern")
        .agg(F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"))
        .join(in_words, "pattern")
        .join(support, "pattern")
    )
    known = written(known, "seeded")
    seeded = maybe(known)
    # In every document: what a pattern meets where there are no seeds speaks against it.
    followed = (
        docs.select(F.explode(contexts_of_words(text_or_empty(text))).alias("pattern"))
        .where(seeded(F.col("pattern")))
        .groupBy("pattern")
        .count()
    )
    known = written(
        known.join(followed, "pattern", "left").select(
            "pattern", "kind", "support", "seeds", F.greatest(F.coalesce("count", F.lit(0)), "seeds").alias("followed")
        ),
        "patterns",
    )
    loose = (
        scanned.select(F.explode("_loose").alias("s"))
        .select("s.pattern", F.lower("s.span.value").alias("instance"))
        .where((F.col("pattern") != "") & seeded(F.col("pattern")))
    )
    edges = written(
        loose.groupBy("pattern", "instance").agg(F.count("*").alias("n")).join(known.select("pattern"), "pattern"), "edges"
    )
    worth = known.select("pattern", (F.col("seeds") / F.col("followed")).alias("confidence"))
    for _ in range(ROUNDS):
        # An instance is worth its best pattern; a pattern, what it was followed by.
        instances = edges.join(worth, "pattern").groupBy("instance").agg(F.max("confidence").alias("belief"))
        gained = edges.join(instances, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("belief")).alias("gain"))
        worth = known.join(gained, "pattern", "left").select(
            "pattern",
            F.least(F.lit(1.0), (F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / F.col("followed")).alias("confidence"),
        )
    trusted = known.join(worth, "pattern").where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
    return trusted.select("pattern", (F.col("kind") + SEED_KINDS).alias("kind"))


def found(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, base_spans and all_spans."""
    scanned = scan(docs, keep, text)
    trusted = written(patterns(scanned, docs, text), "trusted").withColumnRenamed("kind", "_kind")
    more = (
        scanned.select("_row", F.explode("_loose").alias("s"))
        .select("_row", "s.pattern", "s.span")
        .join(trusted, "pattern")
        .groupBy("_row")
        .agg(F.collect_set(F.col("span").withField("kind", F.col("_kind"))).alias("_more"))
    )
    return scanned.join(more, "_row", "left").select(
        *quoted(keep),
        F.col("_base").alias("base_spans"),
        F.concat("_base", F.coalesce("_more", spans.nothing())).alias("all_spans"),
    )
