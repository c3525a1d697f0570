"""Quality rules with risk-controlled thresholds.

`measure` counts what the rules look at in each whole text. `fit` learns one cutoff per stratum from labelled
documents: half of them (chosen by a hash of the id) give each signal its scale, the other half is the holdout.
A document's score is its worst signal on that scale. A cutoff is certified if an exact binomial test on the holdout
rejects "more than `limit` of the good documents score above it"; the level is `alpha`, divided by the number of
strata times the number of cutoffs tried (Bonferroni), so that with probability 1 - alpha every chosen cutoff in every
stratum keeps its promise. Among the certified cutoffs the most lenient one that still catches nearly as many bad
documents as the best is taken. A stratum with too few labelled rows to certify anything has no cutoff and keeps all.

Defined cases: a null text has no words and fails the base rules; a null stratum is a stratum of its own; labels with
a null id or a quality other than 0 and 1 are not used; an id labelled more than once counts with its lowest quality,
and each row of a repeated id counts; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecount.llm.common import fresh, quoted, strings, written

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")
#: Cutoffs on the score, lenient to strict; 1 is the score of the good documents' extreme quantile.
CUTOFFS = (12.0, 8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.1)
EXTREME = 0.995
#: Strata are joined by broadcast up to this many; beyond it the join shuffles.
STRATA_BROADCAST = 10_000


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a window of WINDOW words that occurs at least twice. Windows are numbered by doubling."""
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    width = 1
    while width < WINDOW:
        pairs = at[:-width] * (int(at.max()) + 1) + at[width:]
        values, at = np.unique(pairs, return_inverse=True)
        if len(values) == len(at):
            return 0
        width *= 2
    starts = np.flatnonzero(np.bincount(at)[at] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def count_text(text: str) -> tuple[int, ...]:
    """COUNTS of one text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    blanks = sum(text.count(c) for c in BLANKS)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words),
        len(lines), capitals, text.count("!"),
    )


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, str]:
    """The columns `keep` and one struct of COUNTS, under a name that clashes with none of them (returned too)."""
    name = fresh(docs, "counts")
    kept = docs.select(*quoted(keep)).schema.fields
    struct = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    own = fresh(docs, "measured_text")
    counts_type = pa.struct([(c, pa.int64()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_text(t) for t in strings(batch.column(0))]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            counts = pa.StructArray.from_arrays(columns, fields=list(counts_type))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], counts], names=[f.name for f in kept] + [name])

    source = docs.select(F.col(f"`{text}`").cast("string").alias(own), *quoted(keep))
    schema = T.StructType([*kept, T.StructField(name, struct)])
    return source.mapInArrow(run, schema), name


def base_failed(counts: str) -> Column:
    n, repeat = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < 20) | (repeat * 100 > n * 30)


def signals(counts: str) -> list[Column]:
    """What grows as a document gets worse, rounded so that exact percentiles hold few distinct values."""
    c = lambda name: F.col(f"{counts}.{name}").cast("double")
    words, chars, lines = (F.greatest(c(x), F.lit(1.0)) for x in ("n_words", "word_chars", "n_lines"))
    found = (
        c("n_symbols") / words,
        c("n_dup_lines") / lines,
        c("n_repeat_words") / words,
        c("n_capitals") / chars,
        c("n_exclaims") / words,
        c("word_chars") / words,
        words / lines,
        -c("word_chars") / words,
    )
    return [F.round(s, 3) for s in found]


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly summed: the p-value of "the true rate is p or more" after k of n."""
    if n == 0 or k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(good: int, good_above: list[int], bad: int, bad_above: list[int], limit: float, level: float) -> float | None:
    """The cutoff of one stratum, or None. `*_above` follow CUTOFFS."""
    sure = [i for i in range(len(CUTOFFS)) if binomial_tail(good_above[i], good, limit) <= level]
    best = max((bad_above[i] for i in sure), default=0)
    if not best:
        return None
    return next(CUTOFFS[i] for i in sure if bad_above[i] >= best - 0.01 * bad)


def fit(
    measured: DataFrame, counts: str, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang",
    limit: float = 0.02, alpha: float = 0.05,
) -> DataFrame:
    """One row per stratum: stratum, middles, spreads (arrays over the signals), cutoff (null: none certified)."""
    quality = (
        labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"))
        .where("id is not null and quality in (0, 1)")
        .groupBy("id")
        .agg(F.min("quality").alias("quality"))
    )
    rows = measured.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        base_failed(counts).alias("failed"),
        F.array(*signals(counts)).alias("s"),
    ).join(quality, "id")
    # What fails the base rules is gone already: the thresholds answer for the rest.
    rows = written(rows.where("not failed").withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2))), "labelled")
    many = len(signals(counts))
    scale = (
        rows.where("half = 0 and quality = 1")
        .groupBy("stratum")
        .agg(
            F.array(*[F.percentile(F.col("s")[i], F.lit(0.5)) for i in range(many)]).alias("middles"),
            F.array(*[F.percentile(F.col("s")[i], F.lit(EXTREME)) for i in range(many)]).alias("extremes"),
        )
        .select(
            "stratum", "middles",
            F.zip_with("middles", "extremes", lambda m, e: F.greatest(e - m, F.lit(0.02))).alias("spreads"),
        )
    )
    scale = written(scale, "scale")
    strata = scale.count()
    scored = rows.where("half = 1").join(small(scale, strata), "stratum").withColumn("score", score(F.col("s")))
    above = [F.count_if((F.col("quality") == q) & (F.col("score") > c)).alias(f"a{q}_{i}")
             for q in (1, 0) for i, c in enumerate(CUTOFFS)]
    held = scored.groupBy("stratum").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), *above
    )
    level = alpha / max(1, strata * len(CUTOFFS))

    def pick(frames):
        for frame in frames:
            out = [
                choose(
                    int(r["good"]), [int(r[f"a1_{i}"]) for i in range(len(CUTOFFS))],
                    int(r["bad"]), [int(r[f"a0_{i}"]) for i in range(len(CUTOFFS))], limit, level,
                )
                for r in frame.to_dict("records")
            ]
            yield frame[["stratum"]].assign(cutoff=np.array([math.nan if c is None else c for c in out], float))

    cutoffs = held.mapInPandas(pick, "stratum string, cutoff double").withColumn(
        "cutoff", F.when(~F.isnan("cutoff"), F.col("cutoff"))
    )
    return written(scale.join(cutoffs, "stratum", "left"), "cutoffs")


def small(strata: DataFrame, count: int) -> DataFrame:
    return F.broadcast(strata) if count <= STRATA_BROADCAST else strata


def score(found: Column, middles: str = "middles", spreads: str = "spreads") -> Column:
    """The worst signal: its distance from the good documents' middle over the distance of their extreme quantile."""
    distance = F.zip_with(found, F.col(middles), lambda s, m: s - m)
    return F.array_max(F.zip_with(distance, F.col(spreads), lambda d, w: d / w))


def judge(measured: DataFrame, counts: str, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """`measured` with two more columns in the struct: failed (base rules) and kept."""
    key, rule = fresh(measured, "rule_stratum"), fresh(measured, "rule")
    rules = cutoffs.select(F.col("stratum").alias(key), F.struct("middles", "spreads", "cutoff").alias(rule))
    of = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(""))
    joined = measured.join(small(rules, cutoffs.count()), of == F.col(key), "left")
    worst = score(F.array(*signals(counts)), f"{rule}.middles", f"{rule}.spreads")
    failed = base_failed(counts)
    kept = ~failed & ~F.coalesce(worst > F.col(f"{rule}.cutoff"), F.lit(False))
    judged = F.col(counts).withField("failed", failed).withField("kept", kept)
    return joined.withColumn(counts, judged).select(*quoted(measured.columns))


def filtered(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their columns. Texts are counted twice rather than shuffled."""
    measured, counts = measure(docs, ["doc_id", "lang"])
    rules = fit(written(measured, "measured"), counts, labels, **options)
    whole, counts = measure(docs, docs.columns)
    return judge(whole, counts, rules).where(f"{counts}.kept").drop(counts)
