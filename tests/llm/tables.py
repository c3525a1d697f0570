"""Small document tables with everything that may go wrong in them."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, counts string, at int, n string"


def docs(spark, texts, langs=None, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, l, "src0", len(t or ""), "x", 1, "y") for i, t, l in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(rng: random.Random) -> list:
    """Null, empty, blank, repeated, one long text, ties."""
    again = words(rng, 60)
    return [None, "", " \n\t ", "x", again, again, again, words(rng, 6000), "é" * 500, "a" * 3000, "\u0000 b", again + " end"]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
