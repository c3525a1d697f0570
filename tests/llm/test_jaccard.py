import random

import numpy as np
import pytest

from gatecount.llm import jaccard
from gatecount.llm.graph import components
from tests.llm.tables import by_id, docs, odd_texts, words


def plain(rows, percent, width):
    """id -> n_shingles, component, links, by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()))
    label = {k: k for k in range(len(sets))}
    links = dict.fromkeys(label, 0)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links[a] += 1
                links[b] += 1
                label[root(a)] = root(b)
    lowest: dict = {}
    for k, (i, _) in enumerate(sets):
        lowest[root(k)] = min(i, lowest.get(root(k), i))
    return {i: (len(s), lowest[root(k)], links[k]) for k, (i, s) in enumerate(sets)}


def near_copies(rng, groups, size):
    texts = []
    for _ in range(groups):
        base = words(rng, rng.randint(5, 150), 5000).split()
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"E{rng.randrange(40)}"
            if rng.random() < 0.2:
                w = w[: max(1, len(w) - rng.randint(0, 6))]
            texts.append(" ".join(w).title() if rng.random() < 0.1 else " ".join(w))
    return texts


@pytest.mark.parametrize("leaf,pivots,rounds,stuck", [(512, 16, 5, 4.0), (6, 3, 2, 100.0), (6, 3, 3, 1.5), (8, 1, 0, 4.0)])
def test_equals_all_pairs(spark, monkeypatch, leaf, pivots, rounds, stuck):
    changes = {"LEAF": leaf, "PIVOTS": pivots, "ROUNDS": rounds, "CHUNK": 10, "STUCK_ROWS": stuck, "STUCK_SHARE": stuck, "BLOCK": 12}
    for name, value in changes.items():
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(7)
    texts = near_copies(rng, 12, 18) + odd_texts(rng)
    rng.shuffle(texts)
    got = by_id(jaccard.classes(docs(spark, texts)), "n_shingles", "component_id", "n_links")
    assert got == plain(list(enumerate(texts)), 90, 3)


def test_other_width_and_similarity_and_what_stays(spark):
    rng = random.Random(8)
    texts = near_copies(rng, 10, 8)
    want = plain(list(enumerate(texts)), 80, 5)
    frame = docs(spark, texts)
    assert by_id(jaccard.classes(frame, 80, 5), "n_shingles", "component_id", "n_links") == want
    kept = jaccard.representatives(frame, 80, 5)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in want.values()})


def test_null_and_repeated_ids_and_empty_table(spark):
    text = "one two three four five"
    got = jaccard.classes(docs(spark, [text, text, text, None, ""], ids=[None, 7, 7, 8, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["n_links"]) for r in got) == [
        ("7", "7", 2), ("7", "7", 2), ("8", "8", 0), ("None", "7", 2), ("None", "None", 0)
    ]
    assert jaccard.classes(docs(spark, [])).collect() == []


def test_one_row_of_a_component_stays_whatever_its_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e = (words(rng, 40, 5000) for _ in range(5))
    rows = [
        (1, a), (2, b), (2, b), (2, b),  # repeated rows
        (5, a), (5, c),  # a copy of a smaller id next to a row that stays
        (None, a), (None, d), (None, d), (None, e), (None, None), (None, ""),  # null ids, copies among them
        (7, e.upper()), (8, ""), (9, None), (9, None), (3, d + " end"), (6, c),
    ]
    frame = docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    kept = jaccard.representatives(frame, 80, 3)
    assert kept.columns == frame.columns and kept.schema == frame.schema
    want = [(1, a), (2, b), (3, d + " end"), (5, c), (7, e.upper()), (8, ""), (9, None), (9, None), (None, None), (None, "")]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    nameless = docs(spark, [a, a, a + " end", b], ids=[None] * 4)
    assert len({r["text"][:20] for r in jaccard.representatives(nameless, 80, 3).collect()}) == 2
    assert jaccard.representatives(nameless, 80, 3).count() == 2


def test_keys_lose_no_link():
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 6, 1 << jaccard.BITS).astype(np.uint8)
    linked = 0
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        drop, add = rng.integers(0, n // 15 + 2, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 90 * (len(a) + len(b) - common) and not np.array_equal(a, b):
            linked += 1
            assert len(np.intersect1d(jaccard.keys(a, levels), jaccard.keys(b, levels)))
    assert linked > 500


@pytest.mark.parametrize("percent", [88, 90, 97])
def test_part_keys_lose_no_link(monkeypatch, percent):
    rng = np.random.default_rng(4)
    # Also with many empty parts in a set: a few parts share all shingles, and no part may be empty for nothing.
    for spread, spare in ((1 << 63, None), (1 << 60, None), (1 << 63, 0)):
        jaccard.class_parts.cache_clear()
        if spare is not None:
            made = jaccard.class_parts.__wrapped__
            monkeypatch.setattr(jaccard, "class_parts", lambda p, n: made(p, n) - made(p, n)[:, 1:])
        linked = 0
        for _ in range(700):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, spread, n, dtype=np.uint64) * np.uint64(2))
            drop, add = rng.integers(0, n * (100 - percent) // 150 + 2, 2)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, spread, add, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
                linked += 1
                row, key = jaccard.part_keys([a, np.empty(0, np.uint64), b], percent)
                assert len(np.intersect1d(key[row == 0], key[row == 2])) and not (row == 1).any()
        assert linked > 150


def test_unlike_texts_that_share_much_have_no_key_in_common():
    """A fifth of each set is common to all: by single shingles, without counters fine enough, they would be one neighbourhood."""
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    of = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 240, dtype=np.uint64) * np.uint64(2)])) for _ in range(300)]
    row, key = jaccard.part_keys(of)
    _, at = np.unique(key, return_inverse=True)
    shared = np.bincount(at)[at] > 1
    assert len(np.unique(row[shared])) < 60
    levels = np.zeros(1 << jaccard.BITS, np.uint8)  # as when shingles outnumber the counters by far
    single = [jaccard.keys(s, levels) for s in of]
    assert len(np.unique(np.concatenate(single))) < sum(map(len, single))


def test_texts_that_share_a_passage_are_no_neighbours(spark, monkeypatch):
    """Also where the counters do not tell its shingles from others, as in a corpus with far more shingles than counters."""
    monkeypatch.setattr(jaccard, "frequencies", lambda docs, width, text: np.zeros(1 << jaccard.BITS, np.uint8))
    rows, write = {}, jaccard.written

    def written(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "written", written)
    rng = random.Random(11)
    passage = words(rng, 40, 5000)
    texts = [f"{words(rng, 60, 5000)} {passage} {words(rng, 60, 5000)}" for _ in range(10)]
    texts += [f"{t} end" for t in texts[:3]]
    got = by_id(jaccard.classes(docs(spark, texts), 80, 5), "n_shingles", "component_id", "n_links")
    assert got == plain(list(enumerate(texts)), 80, 5)
    assert rows["members"] == 6


@pytest.mark.parametrize("paired,batch", [(2, 10000), (5, 3), (64, 1)])
def test_keys_of_few_and_of_many_rows_lose_no_link(spark, monkeypatch, paired, batch):
    """Few rows are compared in pairs and many taken together, also where they go on over several batches."""
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rng = random.Random(12)
        texts = near_copies(rng, 10, 9) + odd_texts(rng)
        got = by_id(jaccard.classes(docs(spark, texts), 80, 5), "n_shingles", "component_id", "n_links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain(list(enumerate(texts)), 80, 5)


def test_a_forest_has_the_components_of_its_edges():
    a, b = (np.array(x, np.int64) for x in zip((5, 3), (3, 9), (9, 5), (1, 2), (7, 8), (8, 6), (6, 2)))
    assert sorted(zip(*(x.tolist() for x in jaccard._forest(a, b)))) == [(2, 1), (5, 3), (6, 1), (7, 1), (8, 1), (9, 3)]
    assert [len(x) for x in jaccard._forest(a[:0], b[:0])] == [0, 0]


def test_signatures_give_up_no_link():
    rng = np.random.default_rng(6)
    linked = unlike = 0
    for _ in range(2000):
        n, percent = int(rng.integers(1, 400)), int(rng.integers(60, 100))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        drop, add = rng.integers(0, n * (100 - percent) // 60 + 2, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        a, common = np.unique(a), len(np.intersect1d(a, b))
        if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
            linked += 1
            assert jaccard.can_link(jaccard.signature(a), jaccard.signature(b), len(a) + len(b), percent)
        other = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        unlike += not jaccard.can_link(jaccard.signature(a), jaccard.signature(other), 3 * n, percent)
    assert linked > 400 and unlike > 1500


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
