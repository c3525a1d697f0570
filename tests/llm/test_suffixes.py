import hashlib
import random

import numpy as np
import pytest

from gatecount.llm import suffixes
from tests.llm.tables import by_id, docs, odd_texts


def plain(rows):
    """(id, text) -> n_bytes, n_removed, n_spans, sha256, by a dictionary of all strings."""
    order = lambda i: suffixes.LAST if i is None else i
    first: dict = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            first[w] = min(first.get(w, (order(i), s)), (order(i), s))
    found = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (order(i), s):
                gone[s : s + 100] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone[1:] > gone[:-1]).sum() + gone[0])
        found.append((i, len(b), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def some_texts(rng):
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 400))) for _ in range(10)]
    texts = []
    for _ in range(40):
        t = ""
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            t += rng.choice([p[rng.randint(0, 20) :], p, "ab"[rng.randint(0, 1)] * rng.randint(50, 200), "é" * 60])
            t += "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40)))
        texts.append(t)
    return texts


@pytest.mark.parametrize("frequent", [suffixes.FREQUENT, 2])
def test_equals_all_strings_in_a_dictionary(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    rng = random.Random(3)
    texts = some_texts(rng)
    texts += odd_texts(rng)[:7] + [texts[3], texts[3], "x" * 99, "x" * 100, "x" * 101]
    ids = [*range(len(texts) - 2), 5, None]
    rng.shuffle(ids)
    got = suffixes.deduplicated(docs(spark, texts, ids=ids)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(list(zip(ids, texts)))


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdef") for _ in range(300))
    got = suffixes.deduplicated(docs(spark, [long, long, long], ids=[4, 4, 9])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(4, 0), (4, 0), (9, 300)]
    assert suffixes.deduplicated(docs(spark, [])).collect() == []


def test_a_wrong_hash_is_noticed(monkeypatch):
    """With a hash that says everything is equal, the bytes decide."""
    data = [b"a" * 50 + bytes(range(60, 160)), b"b" * 50 + bytes(range(60, 160)), b"c" * 150]
    at = np.array([suffixes.packed_at(0, 51, 60, i) for i in range(3)], np.int64)
    args = (np.zeros(3, np.int64), np.arange(3), at, data)
    good = [x.tolist() for x in suffixes.covered_windows(*args)]
    monkeypatch.setattr(suffixes.Hashed, "of", lambda self, at, length: np.zeros(len(at), np.uint64))
    assert [x.tolist() for x in suffixes.covered_windows(*args)] == good


def test_rewritten_keeps_columns_and_whole_characters(spark):
    rng = random.Random(2)
    shared = "".join(rng.choice("éàüñ") for _ in range(70))  # 140 bytes
    # The last text shares the first byte of the character before the passage as well: that character stays.
    frame = docs(spark, ["é" + shared + "1 one", "x" + shared + "2 two", None, "ê" + shared + "3 three"])
    out = suffixes.rewritten(frame)
    assert out.columns == frame.columns
    assert by_id(out, "text") == {0: ("é" + shared + "1 one",), 1: ("x2 two",), 2: (None,), 3: ("ê3 three",)}
    assert suffixes.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]
    assert suffixes.whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)]
    assert suffixes.whole_characters("é".encode(), [(1, 2)]) == []
