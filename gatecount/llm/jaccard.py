"""Exact Jaccard join of documents on word n-grams, in the metric space of Jaccard distances.

Two documents link when 100 * intersection >= percent * union of their shingle sets.

1. Equal sets become one class, named by a 64-bit fingerprint of the set.
2. Which classes can link at all? Those that share a key. Sizes of linked sets differ by less than the factor, so size
   classes are cut such that partners are in the same or the next one, and keys meet only there. There are two kinds.
   From PARTS_FROM percent on, hashing deals all shingles to a few parts more than linked sets of the size class can
   differ in; some parts are then equal in both, and the content of each part is a key. It takes several equal shingles
   to share one, so unlike texts hardly ever do, whatever the size of the corpus. Parts may be empty: the spare parts
   outnumber the empty ones of nearly every set, so that a full part is equal too; only sets with more empty parts have
   keys for these as well.
   Below, where parts would hold too few shingles each, they are put in one order for all sets, rare ones first. Of n
   shingles, linked sets share all but a few, so the first n - ceil(n * percent / 100) + 1 of each have one in common:
   these are its keys. A passage that many documents share comes last in the order and is no key where a document has
   enough text of its own. How rare a shingle is, is counted over all documents in a table of 2 ** BITS counters, whatever
   the size of the corpus; counters that shingles share make the order worse, never wrong: any order gives the same links.
   Two sets that share a key are a candidate pair. Each set has a signature of about as many bits as elements; bits in
   which two signatures differ are elements in which the sets do, so a pair that differs in too many is given up. That
   keeps sets apart which share a passage only, however many shingles share a counter. Keys of more than PAIRED rows make
   no pairs: their sets are taken together as they are, those of more than PAIRED sets of a batch before they are shuffled.
   Components of the pairs that are left are disjoint neighbourhoods, and every link is inside one.
3. A neighbourhood of up to LEAF sets is one region and joined in one task. A larger one is cut into Voronoi regions:
   pivots are chosen in it, each set goes home to its nearest pivot, and is replicated, as a visitor, to every pivot at
   most 2 * epsilon farther away. If d(x, y) <= epsilon, the triangle inequality puts y into the region where x is at
   home. Regions are cut again by new pivots until they are small. A region that pivots do not cut (all sets about
   equally far apart) is joined block by block, each pair of blocks in a task of its own, so that nothing is left out.
4. Links give components; copies come back through their class.

Distances are compared exactly, in integers, where they decide a link. Shingles are 64-bit hashes.

Defined cases: a null text has no words; without words there is no set, no link, and a component of its own; each row of
a repeated id is a document; a null id joins its class, and the component is the smallest id that is not null. Of each
component one row stays, also where its rows share an id or have none; a row without words stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from gatecount.llm.common import fresh, quoted, strings, written
from gatecount.llm.graph import components

WIDTH = 3
PERCENT = 90
#: From this percentage on a part holds seven shingles or more, and its content is a key.
PARTS_FROM = 88
#: Sets, and bytes of their shingles, that one task joins.
LEAF = 3072
LEAF_BYTES = 64 << 20
PIVOTS = 16
CHUNK = 1000
ROUNDS = 5
#: A region is stuck when pivots make more than so many rows of one, or leave a part with this share of it.
STUCK_ROWS, STUCK_SHARE = 4.0, 0.7
#: Counters of shingles: a byte each where keys are made, two in the tasks that count. They travel in slabs, sent before
#: a counter of two bytes can overflow by documents alone.
BITS = 24
SLAB = 16384
DOCUMENTS = 32768
#: Documents whose keys are made at once.
ROWS = 2048
#: Rows of a key, at most, that are compared in pairs.
PAIRED = 16
#: The low bits of a key say its size class.
CLASS = np.uint64(255)
#: Steps of a counter's level per doubling.
STEPS = 8
BLOCK = 3072
COLUMNS = 2048
#: Rows of a region whose products are added at once.
BAND = 256

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    x = (x ^ (x >> np.uint64(32))) * _D
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The document's set: sorted distinct 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), n)], np.uint64)
    s = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        s = mixed(s * _A + h[i : n - width + 1 + i] + _B)
    return np.unique(s)


@lru_cache(maxsize=None)
def size_classes(percent: int, largest: int) -> np.ndarray:
    """Upper ends of the size classes, up to one beyond `largest`."""
    ends = [0]
    while ends[-1] <= largest:
        ends.append((ends[-1] + 1) * 100 // percent)
    ends.append((ends[-1] + 1) * 100 // percent)
    return np.array(ends[1:])


def differences(end: int, percent: int) -> int:
    """In how many elements linked sets of up to `end` elements can differ."""
    return 2 * end * (100 - percent) // (100 + percent)


def counter(of: np.ndarray) -> np.ndarray:
    """The place of each shingle in the table of counters."""
    return (mixed(of) >> np.uint64(64 - BITS)).astype(np.int64)


def size_class(n: int, percent: int) -> int:
    return int(np.searchsorted(size_classes(percent, 1 << max(4, n.bit_length())), n))


def keys(of: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of which linked, unequal sets share one at least. `of` is sorted; `levels`: how frequent, per counter."""
    n = len(of)
    # Where sets of the next size class cannot differ either, only equal sets link.
    if not n or not differences(int(size_classes(percent, 1 << max(4, n.bit_length()))[size_class(n, percent) + 1]), percent):
        return np.empty(0, np.uint64)
    return mixed(of[np.argsort(levels[counter(of)], kind="stable")[: n - -(-percent * n // 100) + 1]] + _C)


def signature(of: np.ndarray) -> bytes:
    """A bit per share of the hashes, set where `of` has one: as many bits as elements, or up to twice as many."""
    bits = max(3, (len(of) - 1).bit_length())
    marks = np.zeros(1 << bits, bool)
    marks[(mixed(of ^ _B) >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def can_link(a: bytes, b: bytes, elements: int, percent: int) -> bool:
    """False only if sets with these signatures, of so many elements together, do not link."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(x) < len(y):
        y = np.packbits(np.unpackbits(y).reshape(len(x) * 8, -1).any(axis=1))
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= elements * (100 - percent)


@lru_cache(maxsize=None)
def class_parts(percent: int, largest: int) -> np.ndarray:
    """For each size class the number of parts (0: only equal sets link) and of those that may be empty."""
    ends = size_classes(percent, largest)
    found = []
    for c, end in enumerate(ends.tolist()):
        differ, smallest = differences(end, percent), int(ends[c - 2]) + 1 if c > 1 else 1
        best = (2.0, 0)
        for spare in range(differ + 8 if differ else 0):
            # The share of the smallest sets that have more empty parts than that.
            parts = differ + 1 + spare
            empty = parts * (1 - 1 / parts) ** smallest
            at_most, term = 0.0, math.exp(-empty)
            for i in range(spare + 1):
                at_most, term = at_most + term, term * empty / (i + 1)
            best = min(best, (1 - at_most, spare))
            if 1 - at_most < 1e-5:
                break
        found.append((differ + 1 + best[1] if differ else 0, best[1]))
    return np.array(found, np.int64)


def part_keys(of: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which linked, unequal sets share one at least, and whose they are (places in `of`).

    Linked sets agree in more parts than may be empty. If a part that is not empty is among them, its content is their
    key. Otherwise both have these parts empty; of so many in common, one is among the first of either set, up to the
    number by which its empty parts exceed those that may be empty.
    """
    sizes = np.array([len(s) for s in of], np.int64)
    if not sizes.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    flat, row = np.concatenate(of), np.repeat(np.arange(len(of)), sizes)
    share, value = flat >> np.uint64(32), mixed(flat ^ _A)
    largest = 1 << max(4, int(sizes.max()).bit_length())
    ends, parts = size_classes(percent, largest), class_parts(percent, largest)
    rows, keys_ = [], []
    for later in (0, 1):
        c = np.searchsorted(ends, sizes) + later
        many, spare = np.where(sizes > 0, parts[c, 0], 0), parts[c, 1]
        start, whose = np.cumsum(many) - many, np.repeat(np.arange(len(of)), many)
        kept = many[row] > 0
        spot = start[row[kept]] + ((share[kept] * many[row[kept]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        content, full = np.zeros(len(whose), np.uint64), np.zeros(len(whose), bool)
        np.add.at(content, spot, value[kept])
        full[spot] = True
        before = np.cumsum(~full) - ~full
        nth = before - np.repeat(before[np.minimum(start, len(before) - 1)] if len(before) else start, many)
        empty = many - np.bincount(whose[full], minlength=len(of))
        taken = full | (nth < (empty - spare)[whose])
        part = (np.arange(len(whose)) - start[whose]).astype(np.uint64)
        seed = mixed(part * _B + (c[whose].astype(np.uint64) + np.uint64(1)) * _C)
        rows.append(whose[taken])
        keys_.append(mixed(np.where(full, content ^ seed, seed))[taken])
    return np.concatenate(rows), np.concatenate(keys_)


SETS = "doc_id long, n_shingles long, node long, signature binary"
KEYS = "key long, node long, head long"


def _batch_sets(texts: pa.Array, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    of = [shingles(text, width) for text in strings(texts)]
    return of, np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in of], np.uint64).view(np.int64)


def sets(docs: DataFrame, width: int, id_col: str, text: str) -> DataFrame:
    """doc_id, n_shingles, node (fingerprint of the set, null without one), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, node = _batch_sets(batch.column(1), width)
            size = np.array([len(s) for s in of], np.int64)
            signatures = pa.array([signature(s) if len(s) else None for s in of], pa.binary())
            columns = [batch.column(0), pa.array(size), pa.array(node, mask=size == 0), signatures]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "signature"])

    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    ).mapInArrow(run, SETS)


def frequencies(docs: DataFrame, width: int, text: str) -> np.ndarray:
    """A level per counter, one byte each: how many documents have its shingles, on a scale of logarithms.

    A task sends its counters compressed, in slabs; slabs are added up as they arrive, so that memory is bounded by the
    table. What comes to the driver is the table: 2 ** BITS bytes.
    """
    slabs = (1 << BITS) // SLAB

    def sent(counts: np.ndarray) -> pa.RecordBatch:
        rows = counts.reshape(slabs, SLAB)
        used = np.flatnonzero(rows.any(axis=1))
        packed = [pa.compress(rows[i].tobytes(), codec="zstd", asbytes=True) for i in used]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(packed, pa.binary())], names=["slab", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << BITS, np.uint16), 0
        for batch in batches:
            for value in strings(batch.column(0)):
                np.add.at(counts, counter(shingles(value, width)), np.uint16(1))
                seen += 1
                if seen == DOCUMENTS:
                    yield sent(counts)
                    counts[:], seen = 0, 0
        yield sent(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(pa.decompress(packed.as_buffer(), SLAB * 2, codec="zstd"), np.uint16)
                sums[slab] = sums.get(slab, 0) + counts.astype(np.int64)
        level = [np.minimum(STEPS * np.log2(1.0 + c), 255).astype(np.uint8).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(level, pa.binary())], names=["slab", "levels"])

    counted = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "slab long, counts binary")
    summed = written(counted.repartition("slab").mapInArrow(add, "slab long, levels binary"), "frequencies")
    levels = np.zeros((slabs, SLAB), np.uint8)
    for row in summed.toLocalIterator():
        levels[row["slab"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.reshape(-1)


def keyed(docs: DataFrame, width: int, percent: int, text: str) -> DataFrame:
    """key, node, and head where the row is no key but says that node and head met in a batch.

    Rows of a batch that share keys of more than PAIRED sets, directly or through others, are reduced to one: the smallest
    node has all their keys, the others only name it. The low bits of a key are the size class where keys are single
    shingles, and 0 where they are contents of parts, which have it in them. The keys are never written.
    """
    levels = None if percent >= PARTS_FROM else frequencies(docs, width, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            of, node = _batch_sets(batch.column(0), width)
            if levels is None:
                row, key = part_keys(of, percent)
                of_class = np.uint64(0)
            else:
                found = [keys(s, levels, percent) for s in of]
                key = np.concatenate([*found, np.empty(0, np.uint64)])
                row = np.repeat(np.arange(len(of)), [len(k) for k in found]).astype(np.int64)
                of_class = np.array([size_class(len(s), percent) for s in of], np.uint64)[row]
            key = ((key & ~CLASS) | of_class).view(np.int64)
            label = neighbours(node, row, key)
            head = label[row]
            order = np.lexsort((head, key))
            key, head = key[order], head[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (head[1:] != head[:-1]))) if len(key) else np.empty(0, bool)
            key, head = key[new], head[new]
            met = np.unique(np.stack([node, label])[:, node != label], axis=1)
            # Pairs that met travel with the keys, spread by their node.
            columns = [
                pa.array(np.concatenate([key, mixed(met[0].view(np.uint64)).view(np.int64)])),
                pa.array(np.concatenate([head, met[0]])),
                pa.array(np.concatenate([head, met[1]]), mask=np.arange(len(key) + met.shape[1]) < len(key)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "head"])

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, KEYS)


def neighbours(node: np.ndarray, row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row of a batch the smallest node that keys of more than PAIRED sets lead to. `row` and `key`: who has which key."""
    label = node.copy()
    order = np.lexsort((node[row], key))
    row, key = row[order], key[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    other = new | np.concatenate(([True], node[row[1:]] != node[row[:-1]])) if len(key) else new
    shared = (np.bincount(group, other) > PAIRED)[group] if len(key) else new
    row, new = row[shared], new[shared]
    if not len(row):
        return label
    begin, group = np.flatnonzero(new), np.cumsum(new) - 1
    while True:
        lowest = np.minimum.reduceat(label[row], begin)
        lower = label.copy()
        np.minimum.at(lower, row, lowest[group])
        if (lower == label).all():
            return label
        label = lower


PAIR, STAR, MET = 0, 1, 2


def _starred(key: np.ndarray, node: np.ndarray, last: tuple | None) -> tuple[list[np.ndarray], tuple | None]:
    """Edges of sorted rows of frequent keys: each node with the smallest of its key, and that with the one of the size
    class before. `last`: the key that the rows before ended with, and its smallest node."""
    if not len(key):
        return [], last
    if last is not None:
        key, node = np.append(last[0], key), np.append(last[1], node)
    first = np.concatenate(([True], key[1:] != key[:-1]))
    smallest = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    next_class = np.flatnonzero(first[1:] & (key[1:] == key[:-1] + 1)) + 1
    edges = [np.stack([node, smallest]), np.stack([smallest[next_class], smallest[next_class - 1]])]
    return edges, (key[-1], smallest[-1])


def _paired(key: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """All pairs of rows that share a key, in the same or the next size class."""
    group, of_class = key >> 8, key & 255
    at, step, pairs = np.arange(len(key)), 1, []
    while len(at := at[at + step < len(key)]) and len(at := at[group[at] == group[at + step]]):
        near = at[of_class[at + step] - of_class[at] <= 1]
        pairs.append(np.stack([node[near], node[near + step]]))
        step += 1
    return pairs


def candidates(rows: DataFrame) -> DataFrame:
    """Edges a, b between nodes that share a key (`rows` as `keyed` gives them), and their kind: PAIR of a key of a few
    rows; STAR of a key of many, each node with the smallest; MET in a batch, and b stands for a."""

    def edges(parts: list[np.ndarray], kind: int) -> pa.RecordBatch:
        a, b = np.concatenate([*parts, np.empty((2, 0), np.int64)], axis=1)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = (a != b) & np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
        return pa.RecordBatch.from_arrays(
            [pa.array(a[new]), pa.array(b[new]), pa.array(np.full(int(new.sum()), kind, np.int32))], names=["a", "b", "kind"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are sorted by key, then node. Those of the last key may go on: few are held, many go on as a star.
        key = node = np.empty(0, np.int64)
        last = None
        for batch in chain(batches, [None]):
            if batch is not None:
                is_key = batch.column(2).is_null().to_numpy(zero_copy_only=False)
                met = batch.filter(pa.array(~is_key))
                kind = pa.array(np.full(met.num_rows, MET, np.int32))
                yield pa.RecordBatch.from_arrays([met.column(1), met.column(2), kind], names=["a", "b", "kind"])
                key = np.append(key, np.asarray(batch.column(0))[is_key])
                node = np.append(node, np.asarray(batch.column(1))[is_key])
            if not len(key):
                continue
            group = key >> 8
            _, of, size = np.unique(group, return_inverse=True, return_counts=True)
            many = size[of] > PAIRED
            if last is not None:
                many |= group == last[0] >> 8
            held = ~many & (group == group[-1]) if batch is not None else np.zeros(len(key), bool)
            stars, last = _starred(key[many], node[many], last)
            yield edges(stars, STAR)
            yield edges(_paired(key[~many & ~held], node[~many & ~held]), PAIR)
            key, node = key[held], node[held]

    sorted_ = rows.repartition(F.shiftright("key", 8)).sortWithinPartitions("key", "node")
    return sorted_.mapInArrow(run, "a long, b long, kind int").distinct()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of the edges a, b: each node but the smallest of its component, and that one."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        lower, lowest = label.copy(), np.minimum(label[x], label[y])
        np.minimum.at(lower, x, lowest)
        np.minimum.at(lower, y, lowest)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(len(node))
    return node[moved], node[label[moved]]


def neighbourhoods(found: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Edges a, b whose components are the neighbourhoods: candidates (of `keyed` rows) without the pairs that cannot link.

    A node that stands for others has no signature of its own, and its pairs stay.
    """
    edges = written(candidates(rows), "candidates")
    pairs = edges.where(F.col("kind") == PAIR).select("a", "b")
    heads = edges.where(F.col("kind") == MET).select(F.col("b").alias("node")).distinct()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(heads, "node", "left_anti")
    known = found.join(asked, "node", "left_semi").groupBy("node").agg(F.first(F.struct("n_shingles", "signature")).alias("of"))
    known = written(known.select("node", "of.*"), "signatures")
    for end in ("a", "b"):
        side = known.select(F.col("node").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("signature").alias(f"of_{end}"))
        pairs = pairs.join(side, end, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = (batch.column(i) for i in (2, 3, 4))
            stays = [
                not x.is_valid or not y.is_valid or can_link(x.as_buffer(), y.as_buffer(), elements, percent)
                for x, y, elements in zip(a, b, n.to_pylist())
            ]
            ab = batch.filter(pa.array(stays, pa.bool_()))
            # Like texts are linked all to all: an edge per node says as much.
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _forest(np.asarray(ab.column(0)), np.asarray(ab.column(1)))], names=["a", "b"])

    left = pairs.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "of_a", "of_b").mapInArrow(run, "a long, b long")
    return written(left.unionByName(edges.where(F.col("kind") != PAIR).select("a", "b")), "pairs")


# ---------------------------------------------------------------- regions

REGION = "region long, node long, home boolean, weight long, shingles binary"
CUT = "parent long, region long, node long, home boolean"


def distances(members: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(m) for m in members])
    flat = np.concatenate(members)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(members), len(pivots)))
    for j, p in enumerate(pivots):
        at = np.minimum(np.searchsorted(p, flat), len(p) - 1)
        common = np.add.reduceat((p[at] == flat).astype(np.int64), starts)
        out[:, j] = 1.0 - common / (sizes + len(p) - common)
    return out


def cut_regions(regions: DataFrame, sizes: DataFrame, percent: int, turn: int) -> DataFrame:
    """Voronoi regions of regions, with boundary sets replicated: parent, region, node, home. `sizes`: region, n."""
    epsilon = 1.0 - percent / 100.0
    by_hash = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    pivots = (
        regions.select("region", "node", "shingles")
        .withColumn("number", F.row_number().over(by_hash))
        .where(F.col("number") <= PIVOTS)
        .join(sizes, "region")
        .select("region", "number", "shingles", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        .toDF("region", "number", "shingles", "chunk")  # columns of its own: both sides come from `regions`
    )
    members = regions.join(sizes, "region").withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).drop("n")

    def run(member: pd.DataFrame, pivot: pd.DataFrame) -> pd.DataFrame:
        names = ["parent", "region", "node", "home"]
        if not len(member):
            return pd.DataFrame(columns=names)
        pivot = pivot.sort_values("number")
        d = distances([np.frombuffer(b, "<u8") for b in member["shingles"]], [np.frombuffer(b, "<u8") for b in pivot["shingles"]])
        nearest = d.argmin(axis=1)
        rows, at = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * epsilon + 1e-9)
        out = member.iloc[rows].reset_index(drop=True).assign(parent=member["region"].iloc[0])
        out["home"] = out["home"].to_numpy(bool) & (at == nearest[rows])
        seed = np.array([int(member["region"].iloc[0])], np.int64).view(np.uint64) * _A + np.array([turn + 1], np.uint64)
        out["region"] = mixed(seed + (at.astype(np.uint64) + np.uint64(1)) * _B).view(np.int64)
        return out[names]

    return members.groupBy("region", "chunk").cogroup(pivots.groupBy("region", "chunk")).applyInPandas(run, CUT)


def links_of(members: pd.DataFrame, percent: int, across: bool = False) -> pd.DataFrame:
    """node, links (the documents linked to a set that is at home here; copies of linked sets count), to (the smallest
    node that links inside the group lead to). With `across`, only pairs between the two sides count."""
    of = [np.frombuffer(b, "<u8") for b in members["shingles"]]
    sizes = np.array([len(s) for s in of])
    _, column = np.unique(np.concatenate(of), return_inverse=True)
    seen = np.bincount(column)
    row = np.repeat(np.arange(len(of)), sizes)
    shared = seen[column] > 1
    row, column = row[shared], (np.cumsum(seen > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(of), len(of)), np.float32)
    for at in range(0, int((seen > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(of), COLUMNS), np.float32)
        x[row[a:b], column[a:b] - at] = 1.0
        for i in range(0, len(of), BAND):
            common[i : i + BAND] += x[i : i + BAND] @ x.T
    link = np.empty(common.shape, bool)
    for i in range(len(of)):
        both = common[i].astype(np.int64)
        link[i] = 100 * both >= percent * (sizes[i] + sizes - both)
    np.fill_diagonal(link, False)
    if across:
        side = members["side"].to_numpy()
        link &= side[:, None] != side[None, :]
    weight, home, node = members["weight"].to_numpy(), members["home"].to_numpy(bool), members["node"].to_numpy()
    label = node
    while True:
        lower = np.array([label[near].min(initial=label[i]) for i, near in enumerate(link)], np.int64)
        if (lower == label).all():
            break
        label = lower
    links = np.array([weight[near].sum() for near in link], np.int64)
    return pd.DataFrame({"node": node, "links": np.where(home, links, 0), "to": label}).astype("int64")


LINKS = "node long, links long, to long"


def joined(members: DataFrame, percent: int) -> DataFrame:
    """node, links, to: over all regions. `members` has region, node, home, weight, shingles."""
    regions, found = members, None

    def add(more: DataFrame) -> None:
        nonlocal found
        found = more if found is None else found.unionByName(more)

    inside = lambda group: links_of(group, percent)
    for turn in range(ROUNDS + 1):
        sizes = regions.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
        sizes = written(sizes, "sizes")
        fits = (F.col("n") <= LEAF) & (F.col("bytes") <= LEAF_BYTES)
        small = regions.join(sizes.where(fits).select("region"), "region", "left_semi")
        add(written(small.groupBy("region").applyInPandas(inside, LINKS), "links"))
        large = sizes.where(~fits)
        if large.isEmpty():
            return found
        regions = written(regions.join(large.select("region"), "region", "left_semi"), "regions")
        if turn == ROUNDS:
            add(blockwise(regions, large, percent))
            return found
        # Without the sets first: what turns out stuck would carry them many times over.
        cut = written(cut_regions(regions, large.select("region", "n"), percent, turn), "cut")
        parts = cut.groupBy("parent", "region").agg(F.count("*").alias("part"))
        stuck = (
            parts.groupBy("parent")
            .agg(F.sum("part").alias("rows"), F.max("part").alias("largest"))
            .join(large.withColumnRenamed("region", "parent"), "parent")
            .where((F.col("rows") > STUCK_ROWS * F.col("n")) | (F.col("largest") > STUCK_SHARE * F.col("n")))
            .select("parent")
        )
        stuck = written(stuck, "stuck")
        held = stuck.withColumnRenamed("parent", "region")
        add(blockwise(regions.join(held, "region", "left_semi"), large.join(held, "region", "left_semi"), percent))
        whole = regions.select(F.col("region").alias("parent"), "node", "weight", "shingles")
        regions = cut.join(stuck, "parent", "left_anti").join(whole, ["parent", "node"]).drop("parent")
    return found


def blockwise(regions: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """node, links, to of regions that pivots do not cut: blocks of sets, each with itself and with each other."""
    blocks = F.greatest(F.ceil(F.col("n") / (BLOCK // 2)), F.ceil(F.col("bytes") / (LEAF_BYTES // 2))).cast("int")
    placed = regions.join(sizes, "region").withColumn("many", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    paired = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other")).select(
        "region", "node", "home", "weight", "shingles", F.col("block").alias("side"),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return links_of(group, percent, across=int(group["i"].iloc[0]) != int(group["j"].iloc[0]))

    return written(paired.groupBy("region", "i", "j").applyInPandas(run, LINKS), "links")


def classes(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, for every row of `docs`."""
    return grouped(docs, percent, width, id_col, text).select("doc_id", "n_shingles", "component_id", "n_links")


def grouped(docs: DataFrame, percent: int, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """What `classes` gives, with node and with group: one number per component (null without a set)."""
    found = written(sets(docs, width, id_col, text), "sets")
    copies = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"))
    hoods = components(neighbourhoods(found, keyed(docs, width, percent, text), percent))
    reps = written(hoods.join(copies, "node").select("node", F.col("label").alias("region"), "rep", "weight"), "members")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, values, rows = np.asarray(batch.column(0)), [], []
            for i, text in enumerate(strings(batch.column(3))):
                s = shingles(text, width)
                # Of rows that share an id, only the one with the set that is asked for.
                if len(s) and np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) == nodes[i]:
                    rows.append(i)
                    values.append(s.tobytes())
            of = pa.array(rows, pa.int64())
            columns = [batch.column(i).take(of) for i in range(3)]
            home = pa.array(np.ones(len(rows), bool))
            yield pa.RecordBatch.from_arrays(
                [columns[1], columns[0], home, columns[2], pa.array(values, pa.binary())],
                names=["region", "node", "home", "weight", "shingles"],
            )

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text}`").cast("string").alias("text"))
    wanted = reps.select(F.col("rep").alias("_rep"), "node", "region", "weight")
    many = written(found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "repeated-ids")
    is_many = F.col("_rep").eqNullSafe(F.col("doc_id"))

    def members_of(wanted: DataFrame) -> DataFrame:
        # What is wanted grows with the corpus: no broadcast, however small it is here.
        with_text = wanted.hint("merge").join(texts, F.col("_rep").eqNullSafe(F.col("rep"))).select("node", "region", "weight", "text")
        return with_text.mapInArrow(read, REGION)

    if many.isEmpty():
        members = members_of(wanted)
    else:
        # Only rows that share an id can give a set twice; the others' sets do not move for it.
        again = members_of(wanted.join(many, is_many, "left_semi")).dropDuplicates(["node"])
        members = members_of(wanted.join(many, is_many, "left_anti")).unionByName(again)
    members = written(members, "regions")
    links = written(joined(members, percent), "all-links")
    linked = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    lowest = linked.join(reps, "node").groupBy("label").agg(F.min("rep").alias("component"))
    per_node = (
        copies.join(linked.join(lowest, "label").select("node", "component", "label"), "node", "left")
        .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .select(
            "node", F.coalesce("label", "node").alias("group"), F.coalesce("component", "rep").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
        )
    )
    full = found.where("node is not null").join(per_node, "node").select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("links").alias("n_links"), "node", "group"
    )
    bare = found.where("node is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"),
        "node", F.col("node").alias("group"),
    )
    return full.unionByName(bare)


def representatives(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """`docs` with one row of each component, and the rows without words.

    It is the row with the smallest id (null is last), then fingerprint, then text. An id that no other row has names
    its row; rows of repeated and null ids are told apart by their sets and numbered.
    """
    rows = written(grouped(docs, percent, width).select("doc_id", "node", "group"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    chosen = rows.where("node is not null").groupBy("group").agg(first).select("first.doc_id", "first.node")
    many = written(rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "many-ids")
    own = F.col("doc_id").cast("long")
    keep = chosen.select("doc_id").unionByName(rows.where("node is null").select("doc_id")).where("doc_id is not null")
    keep = keep.distinct().join(many, "doc_id", "left_anti").withColumnRenamed("doc_id", "_kept")
    kept = docs.join(keep, own == F.col("_kept"), "left_semi")
    if many.isEmpty():
        return kept
    shared = docs.join(many.withColumnRenamed("doc_id", "_shared"), own == F.col("_shared"), "left_semi")
    shared = written(with_node(shared.unionByName(docs.where(own.isNull())), node := fresh(docs, "node"), width), "shared-ids")
    same = own.eqNullSafe(F.col("_id")) & (F.col(node) == F.col("_node"))
    ours = shared.join(chosen.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")), same, "left_semi")
    number = fresh(shared, "number")
    numbered = ours.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", node).orderBy("text")))
    one = numbered.where(F.col(number) == 1).select(*quoted(docs.columns))
    return kept.unionByName(one).unionByName(shared.where(F.col(node).isNull()).select(*quoted(docs.columns)))


def with_node(docs: DataFrame, name: str, width: int) -> DataFrame:
    """`docs` with the fingerprint of each row's set."""
    text = fresh(docs, "as_string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, node = _batch_sets(batch.column(batch.num_columns - 1), width)
            columns = [*batch.columns[:-1], pa.array(node, mask=np.array([not len(s) for s in of], bool))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], name])

    schema = StructType([*docs.schema.fields]).add(name, LongType())
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, schema)
