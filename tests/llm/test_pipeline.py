"""The pipeline against loops, stage by stage, and every registered query on the smallest tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from gatecount.llm import queries
from tests.llm import test_jaccard, test_suffixes
from tests.llm.tables import words
from tests.llm.test_rules import counted_plainly
from tests.llm.test_spans import SECRETS
from tests.llm.test_tokens import valid
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def corpus(rng):
    base = [words(rng, rng.randint(25, 120), 4000) for _ in range(40)]
    passage = words(rng, 60, 4000)
    texts = base + [base[3], base[3], base[5] + " end", "short one", None, "", (words(rng, 9) + " ") * 6]
    texts += [words(rng, 30, 4000) + "\n" + passage + "\n" + words(rng, 30, 4000) for _ in range(4)]
    texts += [words(rng, 30, 4000) + " password = hunter2hunter2 " + words(rng, 9, 4000)]
    return texts


def plain(texts):
    """What reaches the last stage: id -> text. With so few labels, quality rules are the base rules."""
    left = []
    for i, t in enumerate(texts):
        n, _, _, _, repeats = counted_plainly(t or "")
        if n >= 20 and 100 * repeats <= 30 * n:
            left.append((i, t))
    component = test_jaccard.plain(left, 80, 5)
    left = [(i, t) for i, t in left if component[i][1] == i]
    first: dict = {}
    for i, t in left:
        b = t.encode()
        for s in range(len(b) - 99):
            first.setdefault(b[s : s + 100], (i, s))
    out = {}
    for i, t in left:
        b = t.encode()
        gone = set()
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (i, s):
                gone.update(range(s, s + 100))
        kept = bytes(x for j, x in enumerate(b) if j not in gone).decode()
        if not kept.strip():
            continue
        for _, pattern, good in SECRETS:
            kept = pattern.sub(lambda m, good=good: "[SECRET]" if good(m) else m[0], kept)
        out[i] = kept
    return out


def test_pipeline_equals_loops(spark, tmp_path):
    texts = corpus(random.Random(21))
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    now = now.cache()
    assert {r["doc_id"]: r["text"] for r in now.collect()} == plain(texts)
    assert now.where(F.col("n_chars") != F.char_length("text")).isEmpty()
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == set(plain(texts)) and valid(last, 2048) >= 1


def test_pipeline_on_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    assert queries.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLES:
        ok, note = compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
        assert ok, note
    else:
        table = "pages" if name == "op5_urls" else "documents"
        assert queries.QUERIES[name](spark, SF).count() >= (0 if name == "pipeline" else spark.read.parquet(f"{SF}/{table}.parquet").count())
