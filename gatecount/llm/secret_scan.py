"""Secret scans: fixed patterns, and two character Markov models that find random strings the patterns miss.

The models are first-order chains over the characters of keys and identifiers. One is trained on what the fixed
patterns caught in all documents (random strings), the other on identifiers outside those matches, too short to be
judged themselves, in a bounded sample of documents (about SAMPLE_DOCS, chosen by a hash of the id; SAMPLE_WORDS of each). Only pair counts, a fixed number of rows,
leave the training pass; what was not seen leans on the single characters. Of every run of such characters, each part of LEAST or more
that no fixed pattern covers is scored by its log-likelihood ratio, random against ordinary, and reported from `bar` nats on. Without
any labelled random string there is no model and only the fixed patterns speak.

All of it is DataFrame expressions. Defined cases: a null text is empty and has no spans; each row of a repeated id is
scanned; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatecount.llm import spans
from gatecount.llm.common import text_or_empty

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
SIDE = len(ALPHABET) + 1
LEAST = 20
SAMPLE_DOCS, SAMPLE_WORDS = 4000, 500
BAR = 15.0
SMOOTHING = 0.5
#: Pairs that the single characters' frequencies weigh as much as.
LEAN = 8.0


def value(match: Column) -> Column:
    return F.regexp_replace(match, VALUE, "")


def base(text: Column) -> Column:
    return F.concat(
        spans.found(text, 0, ASSIGN, lambda m: F.char_length(value(m)) >= 6),
        spans.found(text, 1, "AKIA[A-Z0-9]{16,}", lambda m: F.lit(True)),
        spans.found(text, 2, "[0-9a-f]{24,}", lambda m: F.lit(True)),
    )


def _code(char: Column) -> Column:
    return F.position(char, F.lit(ALPHABET))


def _codes(text: Column) -> Column:
    """Positions in ALPHABET, from 1, of each character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), _code)


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> list[float] | None:
    """Log-likelihood ratios of each pair of characters: SIDE * SIDE numbers, by code before, code."""
    spark = docs.sparkSession
    share = SAMPLE_DOCS / max(1, docs.count())
    sampled = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1_000_000)) < F.lit(int(min(1.0, share) * 1_000_000))
    whole = text_or_empty(text)
    own = docs.select(whole.alias("t"), sampled.alias("sampled")).select("t", "sampled", base(F.col("t")).alias("base"))
    random = F.transform("base", lambda s: F.struct(F.lit(1).alias("random"), value(s["value"]).alias("word")))
    bare = spans.replaced(F.col("t"), F.col("base"), " ")
    # What is long enough to be judged is no label: a secret nobody knows would vouch for itself.
    short = F.filter(F.regexp_extract_all(bare, F.lit("[A-Za-z0-9+/_=-]{4,}"), 0), lambda w: F.char_length(w) < LEAST)
    words = F.slice(short, 1, SAMPLE_WORDS)
    ordinary = F.when(
        F.col("sampled"), F.transform(words, lambda w: F.struct(F.lit(0).alias("random"), w.alias("word")))
    ).otherwise(F.array().cast("array<struct<random:int,word:string>>"))
    rows = own.select(F.explode(F.concat(random, ordinary)).alias("r")).select("r.random", _codes(F.col("r.word")).alias("c"))
    pairs = rows.select(
        "random", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("c")).alias("a"), F.col("c").alias("b"))).alias("p")
    ).where("p.a is not null and p.b is not null")
    counts = pairs.groupBy("random", (F.col("p.a") * SIDE + F.col("p.b")).alias("pair")).count()
    every = spark.range(SIDE * SIDE).select(F.col("id").cast("int").alias("pair"))
    wide = counts.groupBy("pair").agg(
        *[F.sum(F.when(F.col("random") == k, F.col("count"))).alias(f"n{k}") for k in (0, 1)]
    )
    table = every.join(wide, "pair", "left").select(
        "pair", F.lit(0).alias("all"), F.floor(F.col("pair") / SIDE).alias("a"), (F.col("pair") % SIDE).alias("b"),
        *[F.coalesce(f"n{k}", F.lit(0)).alias(f"n{k}") for k in (0, 1)],
    )

    def log(k: int) -> Column:
        """Of the pair's conditional probability, leaning on how frequent the second character is anywhere."""
        over = lambda c: F.sum(f"n{k}").over(Window.partitionBy(c))
        anywhere = (over("b") + SMOOTHING) / (over("all") + SMOOTHING * SIDE)
        return F.log((F.col(f"n{k}") + LEAN * anywhere) / (over("a") + LEAN))

    # SIDE * SIDE rows, whatever the corpus.
    model = table.select("pair", "n1", (log(1) - log(0)).alias("ratio")).collect()
    if not any(r["n1"] for r in model):
        return None
    return [r["ratio"] for r in sorted(model, key=lambda r: r["pair"])]


def ratio(word: Column, model: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(state: Column, code: Column) -> Column:
        pair = state["last"] * SIDE + code
        return F.struct(code.alias("last"), (state["sum"] + F.element_at(table, pair + 1)).alias("sum"))

    return F.aggregate(_codes(word), start, step)["sum"]


def added(text: Column, base: Column, model: list[float] | None, bar: float = BAR) -> Column:
    """Spans of random strings that overlap no base span."""
    if model is None:
        return spans.nothing()
    pattern = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
    long = spans.found(text, 3, pattern, lambda m: F.lit(True), run="A-Za-z0-9+/_=-")
    left = F.filter(spans.remainders(long, base), lambda s: s["end"] - s["start"] >= LEAST)
    return F.filter(left, lambda s: ratio(s["value"], model) >= bar)


def scanned(docs: DataFrame, model: list[float] | None, base_name: str, all_name: str, text: str = "text") -> DataFrame:
    """`docs` plus two arrays of spans: those of the fixed patterns, and all."""
    with_base = docs.withColumn(base_name, base(text_or_empty(text)))
    more = added(text_or_empty(text), F.col(base_name), model)
    return with_base.withColumn(all_name, F.concat(F.col(base_name), more))
