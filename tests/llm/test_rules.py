"""URL rules, quality rules, sharding."""

import random
import re
import zlib
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from gatecount.llm import quality, sharding, urls
from gatecount.llm.queries import URL_RULES
from tests.llm.tables import by_id, docs, odd_texts, words

# ---------------------------------------------------------------- URLs

LOWER = str.maketrans(urls.CAPITALS, urls.SMALL)


def split_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def judged_plainly(url, listed):
    host, path = split_url(url)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    name = re.sub(r"^www\.", "", host) + re.sub(r"(\.html|/+)$", "", path) if host else None
    return host, path, best and best.name, best.verdict if best else "block" if name is not None and name in listed else "allow"


def test_urls_equal_loops(spark):
    rng = random.Random(6)
    hosts = ["a.org", "www.b.net", "COM", "x.com", "example.com", "www.example.com", "m.www.Example.com", "notexample.com", "net", "É.org", ""]
    tails = ["", "/", "/en/", "/en/1", "/fr/2.html", "/es", "/es/9/", "/q?x=://y/", "/p#top", "?a", "#b", "/p//"]
    some = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(600)]
    some += [None, "", "no scheme", "://", "a://b://c/d", "http://hot.org/p"] + ["http://hot.org/p"] * 200
    listed = ["hot.org/p", "a.org/p", "b.net", None, "a.org/p", "É.org/en/1"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(some)], "page_id long, url string, judged string, canonical string")
    table = spark.createDataFrame([(u,) for u in listed], "canonical string")
    out = urls.judge(pages, URL_RULES, table)
    got = {r["page_id"]: tuple(r["judged_"]) for r in out.collect()}
    assert got == {i: judged_plainly(u, set(listed)) for i, u in enumerate(some)}
    assert out.columns == [*pages.columns, "judged_"]


def test_no_list_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "canonical string")
    assert urls.judge(pages, URL_RULES, none).select("judged.verdict").first()["verdict"] == "allow"
    assert urls.judge(pages.limit(0), URL_RULES, none).count() == 0


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("a.org/"), "id").alias("u"))
    blocks = 2000 * urls.BITS_PER_URL // 512
    table = urls.bloom(listed, "u", blocks)
    probe = spark.range(20000).select(F.concat(F.lit("a.org/"), "id").alias("u")).withColumn("block", urls.block(F.col("u"), blocks))
    hit = F.lit(True)
    for i, m in enumerate(urls.masks(F.col("u"))):
        hit = hit & (F.col("words")[i].bitwiseAND(m) != 0)
    found = {r["u"] for r in probe.join(table, "block").where(hit).collect()}
    assert {f"a.org/{i}" for i in range(2000)} <= found
    assert len(found) < 2000 + 18000 * 0.02


# ---------------------------------------------------------------- quality


def counted_plainly(text):
    words_ = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words_[i : i + 8]) for i in range(len(words_) - 7))
    covered = {j for i in range(len(words_) - 7) if windows[tuple(words_[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words_), sum(map(len, words_)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_loops(spark):
    rng = random.Random(9)
    texts = odd_texts(rng) + [words(rng, rng.randint(1, 80), 4) for _ in range(60)]
    texts += ["\n".join(rng.choice(["a b", "a b ", "", " ", "é#|", "x\u00a0y \x85z\x0b", "a\rb"]) for _ in range(12)) for _ in range(30)]
    measured, counts = quality.measure(docs(spark, texts), ["doc_id", "counts"])
    assert counts not in docs(spark, texts).columns
    got = by_id(measured, counts)
    assert {i: tuple(c[0])[:5] for i, c in got.items()} == {i: counted_plainly(t or "") for i, t in enumerate(texts)}


def test_binomial_tail_is_exact():
    for n, k, p in [(10, 0, 0.1), (50, 3, 0.02), (300, 2, 0.05), (7, 7, 0.5), (0, 0, 0.5)]:
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n else 1.0
        assert quality.binomial_tail(k, n, p) == pytest.approx(min(1.0, want), rel=1e-9)


def test_choose_takes_a_certified_lenient_cutoff():
    n = len(quality.CUTOFFS)
    assert quality.choose(2000, [0] * n, 100, [0, 10, 90, 90, 95, 95, 95, 95, 95, 95, 95, 95], 0.02, 0.001) == quality.CUTOFFS[4]
    assert quality.choose(2000, [0] * 4 + [500] * (n - 4), 100, [0, 10, 90, 91] + [100] * (n - 4), 0.02, 0.001) == quality.CUTOFFS[2]
    assert quality.choose(50, [0] * n, 100, [90] * n, 0.02, 0.001) is None
    assert quality.choose(2000, [0] * n, 0, [0] * n, 0.02, 0.001) is None


def junk_and_good(rng, n):
    good = [words(rng, rng.randint(30, 90)) for _ in range(n)]
    junk = [" ".join(w + "%%%" for w in words(rng, rng.randint(30, 60)).split()) for _ in range(n // 4)]
    return good, junk


def test_thresholds_hold_on_other_rows(spark):
    rng = random.Random(10)
    good, junk = junk_and_good(rng, 1600)
    texts = good + junk + [None, "too short"] + good[:5]
    langs = ["en"] * 2000 + [None] * 3 + ["xx"] * 4
    ids = list(range(len(texts)))
    labels = spark.createDataFrame(
        [(i, int(i < 1600), 0) for i in range(0, 2000, 2)] + [(None, 1, 0), (3, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int"
    )
    frame = docs(spark, texts, langs, ids)
    out = quality.filtered(frame, labels)
    assert out.columns == frame.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert len([i for i in range(1600) if i not in kept]) <= 32
    assert not [i for i in range(1600, 2000) if i in kept]
    assert not {2000, 2001} & kept  # null and too short
    assert set(range(2003, 2007)) <= kept  # a stratum without labels keeps all
    assert {r["doc_id"] for r in quality.filtered(frame, labels.limit(0)).collect()} >= set(range(2000))
    assert quality.filtered(docs(spark, []), labels).collect() == []


# ---------------------------------------------------------------- sharding


def test_shards_are_even_gapless_and_right(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randint(1, 300)) for _ in range(3000)] + odd_texts(rng) + [words(rng, 50)] * 900
    ids = [*range(len(texts) - 2), None, None]
    placed, versions = sharding.sharded(docs(spark, texts, ids=ids), shards=7, slots=512)
    rows = placed.collect()
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    loads = Counter()
    for s in range(7):
        mine = [r for r in rows if r["shard"] == s]
        loads[s] = sum(r["size"] for r in mine)
        assert sorted(r["place"] for r in mine) == list(range(len(mine)))
    assert max(loads.values()) < 1.03 * sum(loads.values()) / 7
    current = {r["slot"]: r["shard"] for r in sharding.mapped(versions).collect()}
    assert len(current) == 512 and all(current[r["virtual_slot"]] == r["shard"] for r in rows)
    before = {r["slot"]: r["shard"] for r in sharding.mapped(versions, 0).collect()}
    edits = {r["slot"]: r["shard"] for r in versions.where("version = 1").collect()}
    assert before == {s: s % 7 for s in range(512)} and current == before | edits
    assert all(before[s] != to for s, to in edits.items())


@pytest.mark.parametrize("equal", [(7, "same text " * 20), (None, None), (7, "")])
def test_repeated_rows_keep_the_law(spark, equal):
    rng = random.Random(14)
    texts = [words(rng, rng.randint(1, 60)) for _ in range(400)] + [equal[1]] * 3600
    ids = [*range(100, 500)] + [equal[0]] * 3600
    rows = sharding.sharded(docs(spark, texts, ids=ids), shards=4, slots=512)[0].collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t in zip(ids, texts))
    loads, places = Counter(), {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["place"])
    assert max(loads.values()) < 1.03 * sum(loads.values()) / 4
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_growing_moves_rows_only_into_the_new_shard(spark):
    rng = random.Random(13)
    placed, versions = sharding.sharded(docs(spark, [words(rng, rng.randint(1, 90)) for _ in range(3000)]), shards=4, slots=512)
    weight = sharding.weights(placed, "virtual_slot", "size")
    grown = versions.unionByName(sharding.grown(versions, weight, 4, 2))
    old, new = ({r["slot"]: r["shard"] for r in sharding.mapped(grown, v).collect()} for v in (1, 2))
    assert all(new[s] in (old[s], 4) for s in old)
    loads = Counter()
    for r in weight.collect():
        loads[new[r["slot"]]] += r["bytes"]
    assert max(loads.values()) < 1.1 * sum(loads.values()) / 5 and len(loads) == 5


def test_empty_table(spark):
    placed, versions = sharding.sharded(docs(spark, []), shards=4, slots=16)
    assert placed.collect() == [] and versions.count() == 16
