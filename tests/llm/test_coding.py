"""Vector codes against plain rounds, word BPE against the tokenizers library, fill-in-middle against a walk over lines."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gatecount.llm import fill_middle, queries, vector_codes, word_bpe
from tests.llm.tables import by_id, docs, odd_texts, words

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts, entries, rounds, scale=4096):
    """rows: (id, vector). Codes and errors in the order of the rows, and the codebooks, in Python integers."""
    whole = [[int(np.floor(scale * float(x))) for x in v] for _, v in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [float(x) for x in rows[i][1]]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in cut:
                held.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for k, members in held.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], books


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, label, "x", 7, "y") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, rows int, trees string"
    ).repartition(3)


@pytest.mark.parametrize("block, leaf", [(4096, 64), (37, 4), (5, 1)])
def test_codes_equal_plain_rounds(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    rng = random.Random(block)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    near = lambda: [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centers)]
    rows = [(i, near(), rng.choice([0, 1, None])) for i in range(240)]
    # Repeated rows, ids and vectors, ties between coarse vectors, and what is dropped.
    rows += [(3, rows[3][1], 1)] * 30 + [(None, rows[5][1], None)] + [(i, [float(i % 2)] * 8, 2) for i in range(300, 340)]
    odd = [(900, None, 0), (901, [], 0), (902, [float("nan")] * 8, 0), (903, [1.0] * 7 + [None], 0), (904, [float("-inf")] * 8, 1)]
    found, books = vector_codes.compressed(vectors(spark, rows + odd), ["vec_id", "embedding", "label", "code", "rows"], parts=4, entries=8, rounds=4)
    assert found.columns == ["vec_id", "embedding", "label", "rows", "code", "error"]
    want, plain_books = plain_codes([r[:2] for r in rows], 4, 8, 4)
    assert [b.tolist() for b in books] == plain_books
    got = Counter((r["vec_id"], tuple(r["embedding"]), r["code"], r["error"]) for r in found.collect())
    assert got == Counter((i, tuple(v), c, e) for (i, v, _), (c, e) in zip(rows, want))
    sums = Counter()
    for (_, _, label), (_, e) in zip(rows, want):
        sums[label] += e
    for share in (1 / 64, 0.9):
        monkeypatch.setattr(vector_codes, "HOT_SHARE", share)
        summed = vector_codes.with_sums(found, "label", "error", "label_error").collect()
        assert len(summed) == len(rows) and all(r["label_error"] == sums[r["label"]] for r in summed)


def test_few_none_and_unfit_vectors(spark):
    rows = [(2, [0.5, -0.5], 0), (1, [0.25, 0.0], 0), (9, [0.25, 0.1], 1)]
    found, books = vector_codes.compressed(vectors(spark, rows), ["vec_id"], parts=2)
    want, plain_books = plain_codes([r[:2] for r in rows], 2, 16, 6)
    assert [b.tolist() for b in books] == plain_books and by_id(found.withColumnRenamed("vec_id", "doc_id"), "code", "error") == {
        r[0]: w for r, w in zip(rows, want)
    }
    found, books = vector_codes.compressed(vectors(spark, [(1, None, 0)]), ["vec_id", "label"])
    assert found.collect() == [] and books == [] and found.columns == ["vec_id", "label", "code", "error"]
    assert vector_codes.with_sums(found, "label", "error", "label_error").collect() == []
    with pytest.raises(ValueError):
        vector_codes.compressed(vectors(spark, rows), ["vec_id"], parts=8)
    for bad in ([(1, [0.1] * 8, 0), (2, [0.1] * 16, 0)], [(1, [0.1] * 8, 0), (2, [1e30] * 8, 0)]):
        with pytest.raises(Exception, match="different lengths|beyond"):
            vector_codes.compressed(vectors(spark, bad), ["vec_id"])


def test_balls_hold_their_points_and_lists_shrink():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c * 900, 60, (700, 4)) for c in range(6)]).astype(np.int64)
    tree = vector_codes.Tree.load(vector_codes.grown(points).dump())
    assert sorted(tree.order.tolist()) == list(range(len(points))) and (points[tree.order] == tree.points).all()
    for node, (a, b) in enumerate(zip(tree.low, tree.high)):
        held = tree.points[a:b].astype(np.int64)
        assert (held.sum(0) == tree.total[node]).all()
        assert vector_codes.distances(held, tree.center[node]).max() <= tree.radius[node] + 1e-6
    book = points[::700].copy()
    whole = sum(int((tree.high - tree.low)[what].sum()) for kind, what, _ in vector_codes.owned(tree, book) if kind == "balls")
    assert whole > len(points) / 2
    sums, numbers = vector_codes.totals(tree, book)
    nearest = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert numbers.tolist() == np.bincount(nearest, minlength=6).tolist()
    assert all((sums[k] == points[nearest == k].sum(0)).all() for k in range(6))
    assert (vector_codes.assigned(tree, book)[0] == nearest).all()


# ---------------------------------------------------------------- word BPE

ODD = [
    " ", "a", "don't  we'll 'TIS", "日本語テキスト" * 90, "ß" * 700, "supercalifragilistic" * 30, "<|endoftext|> <|STARTOFTEXT|>x<|startoftext|><|endoftext|>",
    "é ́x Ångström Å", "ΑΣ ΣΑΣ. İstanbul ǅ", "\r\n\t x\x1cy\x85z .", "1234567 12 ½２", "word.., ,.word", "K\u0000k", "ﬁ \U0001f600‍",
]


def test_words_equal_the_library(spark):
    rng = random.Random(3)
    letters = ["a", "the", "'s", "é", "́", " ", "\x1c", "日", "Σ", "1", "½", ".", ",", "!!", "<|endoftext|>", "<|", "\n", "ก็", "_", "ª"]
    texts = odd_texts(rng) + ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    tool = Tokenizer.from_file(WORDS)
    frame = docs(spark, texts)
    ids = word_bpe.encode(frame, WORDS, ["doc_id", "at", "n"])
    back = word_bpe.decode(ids, WORDS, ["doc_id", "ids", "n"])
    assert back.columns == ["doc_id", "ids", "n", "decoded"]
    encoded = [tool.encode(t or "", add_special_tokens=False).ids for t in texts]
    want = {i: (e, tool.decode(e, skip_special_tokens=False)) for i, e in enumerate(encoded)}
    assert by_id(back, "ids", "decoded") == want
    assert by_id(word_bpe.encode_and_decode(frame, WORDS, ["doc_id"]), "ids", "decoded") == want
    assert word_bpe.encode(docs(spark, []), WORDS, ["doc_id"]).collect() == []
    null = spark.createDataFrame([(1, None), (2, [320, None, 10**6, 320])], "doc_id long, ids array<int>")
    assert by_id(word_bpe.decode(null, WORDS, ["doc_id"]), "decoded") == {1: ("",), 2: (tool.decode([320, 320]),)}


def test_cache_overflow_and_the_library_splitter(monkeypatch):
    rng = random.Random(5)
    texts = [words(rng, 40, 5000) for _ in range(30)] + [t for t in ODD]
    tool = Tokenizer.from_file(WORDS)
    want = [np.array(tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(word_bpe, "CACHE_ENTRIES", 50)
    codec = word_bpe.Codec(WORDS)
    assert codec.by_chunk and [codec.encode([t])[0] for t in texts] == want
    codec.by_chunk = False
    assert codec.encode(texts) == want


def test_trees_side_by_side_and_alone_agree():
    rng = random.Random(6)
    merges = word_bpe.Codec(WORDS).merges
    some = [bytes(rng.choice(b"aeinrst\xc3\xa9") for _ in range(rng.randint(1, 64))) for _ in range(500)]
    found = merges.encode(set(some))
    for w in some:
        assert np.frombuffer(found[w], "<u4").tolist() == merges.alone(w) == leftmost_lowest(merges, w)


def leftmost_lowest(merges, word):
    ids = [*merges.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(merges.last[word[-1]])]
    while True:
        ranked = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := merges.rank_of.get(a * merges.base + b)) is not None]
        if not ranked:
            return ids
        r, i = min(ranked)
        ids[i : i + 2] = [int(merges.merged[r])]


def test_registered_word_bpe(spark):
    got = {r["doc_id"]: r for r in queries.op12_word_bpe(spark, SF).collect()}
    tool = Tokenizer.from_file(WORDS)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = tool.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(tool.decode(ids, skip_special_tokens=False)))


# ---------------------------------------------------------------- fill in the middle


def walked(i, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[a : a + 8], 16) for a in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 20), (0, 0), (100, 100)])
def test_parts_against_a_walk(spark, rate, spm):
    rng = random.Random(7)
    lines = lambda: "".join(rng.choice(["a b", "", "é\U0001f600", "<P", "S>", "<", "\r", " "]) + rng.choice(["\n", "", "\n\n"]) for _ in range(rng.randint(0, 12)))
    texts = odd_texts(rng) + ["\n", "\n\n", "a\n", "x<P>y\nz", "<M>", "line\n" * 30000] + [lines() for _ in range(200)]
    ids = [None, 4, 4, *range(3, len(texts))]
    made = fill_middle.transformed(docs(spark, texts, ids=ids), F.col("doc_id"), ["doc_id", "text", "n", "at"], rate=rate, spm=spm)
    assert made.columns == ["doc_id", "text", "at", *fill_middle.COLUMNS]
    rows = made.select("*", fill_middle.restored().alias("again")).collect()
    got = Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in rows)
    assert got == Counter((i, t, *walked(i, t, rate, spm)) for i, t in zip(ids, texts))


def test_other_units_and_empty_table(spark):
    some = docs(spark, ["one two  three", ""])
    made = by_id(fill_middle.transformed(some, F.col("doc_id"), ["doc_id"], unit=r"\S+\s*|\s+"), "n", "form")
    assert made[0][0] == 3 and made[1] == (0, "plain")
    with pytest.raises(Exception, match="not made of units"):
        fill_middle.transformed(docs(spark, ["ab"]), F.col("doc_id"), ["doc_id"], unit="a").collect()
    assert fill_middle.transformed(docs(spark, []), F.col("doc_id"), ["doc_id"]).collect() == []


def test_registered_fill_middle(spark):
    got = {r["doc_id"]: tuple(r) for r in queries.op13_fill_middle(spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        *head, output, text = walked(r["doc_id"], r["text"])
        want[r["doc_id"]] = (r["doc_id"], *head, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert got == want
