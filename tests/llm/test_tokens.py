"""Byte-level BPE against tiktoken, packing against the tokenizer and small exhaustive searches."""

import base64
import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from gatecount.llm import bpe, packing
from tests.llm.tables import by_id, docs, odd_texts, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    " ", "  a b", " a", "a ", "a  b", "a \nb", "x\u00a0 y", "x \u00a0y", "a b\n c", "\n", "a\x1c b", "a \x1cb", "don't  we'll 'tis", "日本語テキスト" * 90,
    "ß" * 700, "supercalifragilistic" * 30, "<|endoftext|> <|startoftext|>", "e\u0301 \u0301x", "ΑΣ ΣΑΣ. İstanbul", "\r\n\t x", "1234567 12 3",
]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_tiktoken_and_decoding_returns_the_text(spark):
    texts = odd_texts(random.Random(2)) + ODD
    ids = bpe.encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN, ["doc_id", "at", "n"])
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN, ["doc_id", "ids", "n"])
    assert back.columns == ["doc_id", "ids", "n", "decoded"]
    tool = reference()
    want = {i: (np.array(tool.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in enumerate(texts)}
    assert {i: (bytes(a), bytes(b)) for i, (a, b) in by_id(back, "ids", "decoded").items()} == want


def test_both_in_one_pass(spark):
    texts = odd_texts(random.Random(2)) + ODD
    frame = docs(spark, texts)
    split = bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN, ["doc_id"]), RANKS, public_tokenizers.PATTERN, ["doc_id", "ids"])
    both = bpe.encode_and_decode(frame, RANKS, public_tokenizers.PATTERN, ["doc_id"])
    assert by_id(both, "ids", "decoded") == by_id(split, "ids", "decoded")


def test_other_pattern_and_empty_table(spark):
    ids = bpe.encode(docs(spark, ["abc def", None]), RANKS, r"\S+|\s+", ["doc_id"])
    back = by_id(bpe.decode(ids, RANKS, r"\S+|\s+", ["doc_id"]), "decoded")
    assert {i: bytes(b) for i, (b,) in back.items()} == {0: b"abc def", 1: b""}
    assert bpe.encode(docs(spark, []), RANKS, public_tokenizers.PATTERN, ["doc_id"]).collect() == []


def test_disordered_rows_are_noticed(monkeypatch):
    """With the quick recursion made wrong, the ordered one answers."""
    quick = bpe.ENCODE
    wrong = type("Wrong", (str,), {"format": lambda self, line: quick.format(line=line) if line else quick.format(line="ORDER BY pos DESC")})
    monkeypatch.setattr(bpe, "ENCODE", wrong(quick))
    text = "retitioning thanedble ndreahent"
    got = np.frombuffer(bpe.Codec(RANKS, public_tokenizers.PATTERN).encode([text])[0], "<u4").tolist()
    assert got == reference().encode_ordinary(text)


def test_pieces_equal_the_tokenizer(spark):
    texts = odd_texts(random.Random(2)) + ODD
    cut = packing.pieces(docs(spark, texts), WORDS, ["doc_id", "counts"], 64)
    tool = Tokenizer.from_file(WORDS)
    tool.encode_special_tokens = True
    want = {}
    for i, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 64)):
            want[i, p] = (a, len(ids[a : a + 64]), np.array(ids[a : a + 64], "<u4").tobytes())
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], bytes(r["ids"])) for r in cut.collect()} == want


def valid(rows, capacity):
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packed_places_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED_AT_ONCE", 5)
    rng = random.Random(4)
    texts = odd_texts(rng) + [words(rng, rng.randint(1, 200)) for _ in range(150)] + [words(rng, 20)] * 60
    ids = [None, 3, 3, *range(3, len(texts))]
    got = packing.packed(docs(spark, texts, ids=ids), WORDS, 512).collect()
    cut = packing.pieces(docs(spark, texts, ids=ids), WORDS, ["doc_id"], 512).collect()
    key = lambda r, crc: (str(r["doc_id"]), r["piece"], r["start"], r["length"], crc)
    assert sorted(key(r, r["ids_crc32"]) for r in got) == sorted(key(r, zlib.crc32(bytes(r["ids"]))) for r in cut)
    total = sum(r["length"] for r in got)
    assert valid(got, 512) <= -(-total // 512) + 1
    assert packing.packed(docs(spark, []), WORDS).collect() == []


def fewest(lengths, capacity):
    """By trying every assignment, canonical bins only."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity:
                go(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1 :])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_plan_against_exhaustive_search(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(3, 28) for _ in range(rng.randint(1, 9))), reverse=True)
    counts = np.bincount(lengths, minlength=33)
    found = packing.plan(counts, 32)
    used = np.zeros(33, int)
    for copies, bin_ in found:
        assert sum(bin_) <= 32
        for x in bin_:
            used[x] += copies
    assert (used == counts).all()
    bins = sum(c for c, _ in found)
    assert packing.lower_bound(counts, 32) <= fewest(lengths, 32) <= bins <= sum(c for c, _ in packing.best_fit(counts, 32))
    assert bins == fewest(lengths, 32)


def test_dominated():
    assert packing.dominated((3, 4), (7,)) and packing.dominated((), (1,)) and not packing.dominated((5, 5), (9,))
    for a, b in product([(2, 2), (4,), (1, 3)], [(4,), (2, 3)]):
        assert packing.dominated(a, b) == (b == (4,) or (a == (2, 2)) or a == (1, 3))


def test_chunks_are_looked_up_once_per_group_and_kept_in_one_array(monkeypatch):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    rng = random.Random(21)
    tool = packing.WordTokenizer(WORDS)
    texts = ["", " ", "A.B, don't. x's", "\u00e9t\u00e9., \u00e9a.\u0301 \u0130x", "1,000.5 !!, ...", "<|endoftext|>.", "q" * 300 + "."]
    for cap in (1_500_000, 20):
        monkeypatch.setattr(packing, "CACHE_ENTRIES", cap)
        for _ in range(6):
            some = texts + [" ".join(rng.choice(["the", "The.", "of,", "and..", f"w{rng.randrange(40)}"]) for _ in range(50)) for _ in range(5)]
            want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
            assert tool.encode(some) == want
    assert tool.encode([]) == [] and tool.used <= len(tool.ids) and len(tool.known) <= len(tool.spans)


def test_repeated_pieces_are_encoded_and_decoded_once_and_the_caches_stay_small(monkeypatch):
    rng = random.Random(22)
    parts = ["thanedble", "Ndreah.", "Élève!\nretitioning?", "it's", "", "\n", "×x", "é", "q" * 300]
    same = pa.array([" ".join(rng.choice(parts) for _ in range(200)) for _ in range(50)])
    tool = reference()

    def exact(codec, texts):
        ids, spelled = codec.coded(texts)
        assert ids.to_pylist() == [np.array(tool.encode_ordinary(t), "<u4").tobytes() for t in texts.to_pylist()]
        assert spelled.to_pylist() == [t.encode() for t in texts.to_pylist()]

    codec, rows = bpe.Codec(RANKS, public_tokenizers.PATTERN), []
    start = codec._start
    monkeypatch.setattr(codec, "_start", lambda lengths, ids: (rows.append(len(ids)), start(lengths, ids)))
    exact(codec, same)
    met = len(rows)
    exact(codec, same)
    assert len(rows) == met and sum(rows) < 5_000
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    small = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for _ in range(6):
        exact(small, pa.array([" ".join(rng.choice([*parts, f"w{rng.randrange(40)}x"]) for _ in range(9)) for _ in range(3)]))
    assert all(len(m.columns[0]) <= 100 for m in (small.pieces, small.chunks))


def test_a_word_met_before_is_not_encoded_again_with_other_signs(monkeypatch):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    tool, asked = packing.WordTokenizer(WORDS), []
    learn = tool.learn_words
    monkeypatch.setattr(tool, "learn_words", lambda words: (asked.extend(words.to_pylist()), learn(words))[1])
    words = ["thanedble", "Ndreah", "Élève", "straße", "įsakymas", "don't", "ét", "İx"]
    for signs in ("", ".", "?!", "'", "<|", "_%"):
        text = " ".join(w + signs for w in words)
        assert tool.encode([text, ""]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), b""]
    assert sorted(w.decode() for w in asked) == sorted(["thanedble", "ndreah", "élève", "straße", "įsakymas", ".", "?!", "'", "<|", "_%"])
