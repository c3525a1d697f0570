import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatecount.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score int"


def plain(rows, asks, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
          if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    found = set()
    for q, a in ok:
        if asks(q):
            near = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q and len(b) == len(a))
            found |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(near[:k])}
    return found


def search(spark, rows, k=5):
    frame = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    return {tuple(r) for r in topk.search(frame, F.col("vec_id") % 5 == 0, k).collect()}


def test_equals_all_scores(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).astype("float32").tolist()) for i in range(300)]
    rows += [(300 + i, rows[10][1]) for i in range(12)]  # ties
    rows += [(400, None), (405, []), (410, [None] * 16), (415, [math.nan] * 16), (420, [math.inf] + [0.0] * 15)]
    rows += [(425, [0.5, 0.25]), (426, [1.0, -1.0])]
    assert search(spark, rows) == plain(rows, lambda q: q % 5 == 0, 5)


def test_few_candidates_large_values_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (5, [-1.0, 0.5])]
    assert search(spark, rows) == plain(rows, lambda q: q % 5 == 0, 5)
    assert search(spark, []) == set()


def test_large_scores_are_exact_or_an_error(spark):
    for power in (19, 21, 22):  # scores around 2**54, 2**58 and 2**60
        big = [(i, [float(2**power + i), -float(2 ** (power - 1)), i / 256]) for i in range(6)]
        assert search(spark, big, 2) == plain(big, lambda q: q % 5 == 0, 2)
    # Far above 2**63 term by term, yet the scores fit.
    far = [(0, [2.0**40, 2.0**40, 1.0]), (1, [2.0**40, -(2.0**40), 3.0]), (2, [-(2.0**40), 2.0**40, 2.0])]
    assert search(spark, far, 2) == plain(far, lambda q: q % 5 == 0, 2)
    for x in (2.0**26, 1e30):
        with pytest.raises(Exception, match="does not fit"):
            search(spark, [(i, [x, -x / 2]) for i in range(6)], 2)


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(2)
    block = np.floor(rng.normal(0, 60, (200, 8)))
    queries = np.floor(rng.normal(0, 60, (9, 8)))
    got = topk.group_top(queries, np.arange(1000, 1009), block, np.arange(200), 3)
    for q in range(9):
        scores = (block @ queries[q]).astype(int)
        best = sorted(zip(-scores, range(200)))[:3]
        mine = sorted((-s, c) for i, c, s in got if i == 1000 + q)[:3]
        assert mine == [(int(a), b) for a, b in best]
