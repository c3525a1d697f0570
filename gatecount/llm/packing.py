"""Best-fit packing of token sequences by bin completion.

`pieces` cuts each document's ids into pieces of at most `capacity`. Only lengths matter for packing, and there are at
most `capacity` different ones, so the search runs on the histogram of lengths, whose size does not grow with the
corpus. `plan` starts from a best-fit-decreasing packing as the incumbent and then completes bins around the largest
length left: it enumerates the undominated fillings of the room beside it, tries them by waste, applies a filling as
often as the histogram allows, cuts a branch whose waste leaves no chance to beat the incumbent, and stops at the lower
bound (Martello and Toth's L2) or after `nodes` fillings, with the best packing found. `pack` then numbers the pieces
of each length (in salted groups, so that a frequent length is no single task) and places number k of a length where
the plan puts its k-th piece.

Defined cases: a null or empty text is the separator alone; equal lengths are placed in the order of salt, id and
piece; each row of a repeated id is packed; an empty table gives an empty plan.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gatecount.llm.common import Met, binaries, fresh, inside, joined, quoted, text_groups, written
from gatecount.llm.word_bpe import known_steps

CAPACITY = 2048
NODES = 6_000
FILLINGS = 24
#: Pieces of one length numbered together.
NUMBERED_AT_ONCE = 50_000
CACHE_ENTRIES = 1_000_000
#: A word of letters that stay single letters in lower case, and a run of signs.
PLAIN_CHUNK = r"^(?P<word>[a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]+)(?P<signs>[!-/:-@\[-`{-~]*)$"
WORDS_AT_ONCE = 20_000
TEXTS_AT_ONCE = 8_000_000

# ---------------------------------------------------------------- tokens


class WordTokenizer:
    """Ids of whole texts, white-space chunk by chunk: the tokenizer drops white space and never joins across it."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.quick = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.quick.encode_special_tokens = True
        # For words that are normal already and one pre-token each: the same merges without the steps before them.
        self.quick.normalizer = normalizers.Sequence([])
        self.quick.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = self.tokenizer.model.end_of_word_suffix
        ends = [i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        with open(path, encoding="utf-8") as file:
            self.by_word = len(ends) > 0 and known_steps(json.load(file))
        self.words, self.chunks = Met(CACHE_ENTRIES, 1), Met(CACHE_ENTRIES, 1)

    @property
    def known(self) -> pa.Array:
        """The chunks met so far; `spans` has the ids of each, `ids` those of all in one array, `used` how many."""
        return self.chunks.columns[0]

    @property
    def spans(self) -> pa.Array:
        return self.chunks.columns[1]

    @property
    def ids(self) -> np.ndarray:
        return inside(self.spans)[0].view("<u4")

    @property
    def used(self) -> int:
        return len(self.ids)

    def coded(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, little-endian unsigned 32-bit integers."""
        self.words.most = self.chunks.most = CACHE_ENTRIES
        # The tokenizer lowers case itself; lowering ASCII first lets spellings share an entry.
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = split.flatten().cast(pa.binary()).dictionary_encode()
        places = self.chunks.places(found.dictionary, self.learn)[np.asarray(found.indices)]
        return joined(self.spans, places, np.asarray(split.offsets))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.coded(pa.array([t.encode("utf-8", "replace") for t in texts], pa.string())).to_pylist()

    def learn(self, chunks: pa.Array) -> list[pa.Array]:
        """Ids of chunks. A word of Latin letters is one pre-token, and a run of signs after it another."""
        texts = chunks.cast(pa.string())
        parts = pc.extract_regex(texts, PLAIN_CHUNK)
        plain = np.asarray(parts.is_valid()) & self.by_word
        words, signs = parts.filter(pa.array(plain)).flatten()
        words, signed = pc.utf8_lower(words), np.asarray(pc.binary_length(signs)) > 0
        both = pa.concat_arrays([words, signs.filter(pa.array(signed))]).cast(pa.binary()).dictionary_encode()
        places = self.words.places(both.dictionary, self.learn_words)[np.asarray(both.indices)]
        n, ends = len(words), np.cumsum(np.append(0, 1 + signed))
        order = np.empty(len(places), np.int32)
        order[:n], order[n:] = ends[:-1], ends[:-1][signed] + 1
        ordered = np.empty(len(places), np.int32)
        ordered[order] = places
        ids = [joined(self.words.columns[1], ordered, ends), self.whole(self.tokenizer, texts.filter(pa.array(~plain)).to_pylist())]
        place = np.empty(len(chunks), np.int32)
        place[plain], place[~plain] = np.arange(n), np.arange(n, len(chunks))
        return [pa.concat_arrays(ids).take(pa.array(place))]

    @staticmethod
    def whole(tool, texts: list[str]) -> pa.Array:
        """Ids of texts, each by itself."""
        ids = [pa.array([], pa.binary())]
        for at in range(0, len(texts), WORDS_AT_ONCE):
            found = [e.ids for e in tool.encode_batch_fast(texts[at : at + WORDS_AT_ONCE], add_special_tokens=False)]
            data = np.array([*chain.from_iterable(found)], "<u4").tobytes()
            ids.append(binaries(data, np.cumsum([0, *(4 * len(e) for e in found)])))
        return pa.concat_arrays(ids)

    def learn_words(self, words: pa.Array) -> list[pa.Array]:
        """Ids of words without blanks, which are normal and one pre-token each."""
        ids = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words.slice(at, WORDS_AT_ONCE).cast(pa.string()).to_pylist()
            data = np.array(self.quick.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.is_end[data]) + 1
            if len(ends) == len(some) and ends[-1] == len(data):
                ids.append(binaries(data.tobytes(), np.append(0, ends) * 4))
            else:
                # Without a mark on the last token of each word, they are encoded one by one.
                ids.append(self.whole(self.quick, some))
        return [pa.concat_arrays(ids)]


_tokenizers: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, path: str, keep: list[str], capacity: int = CAPACITY, separator: int = 0, text: str = "text") -> DataFrame:
    """A row per piece: the columns `keep`, piece, start, length, ids (little-endian unsigned 32-bit integers).

    A document's ids end with `separator`. Columns of `keep` that clash with the new ones give way to them.
    """
    keep = [c for c in keep if c.lower() not in ("piece", "start", "length", "ids")]
    own = fresh(docs, "packed_text")
    kept = docs.select(*quoted(keep)).schema.fields
    end = np.array([separator], "<u4").tobytes()
    new = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()),
           ("length", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary())]
    names = [f.name for f in kept] + [n for n, _, _ in new]

    def cut(encoded: pa.Array) -> Iterator[tuple[int, int, int, int, bytes]]:
        for i, ids in enumerate(encoded.to_pylist()):
            ids += end
            for p, at in enumerate(range(0, len(ids), capacity * 4)):
                part = ids[at : at + capacity * 4]
                yield i, p, at // 4, len(part) // 4, part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        for batch in batches:
            first = 0
            for texts in text_groups(batch.column(0), TEXTS_AT_ONCE):
                rows = [*cut(_tokenizers[path].coded(texts))]
                of = pa.array([first + r[0] for r in rows])
                columns = [c.take(of) for c in batch.columns[1:]]
                columns += [pa.array([r[j + 1] for r in rows], kind) for j, (_, _, kind) in enumerate(new)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                first += len(texts)

    schema = T.StructType([*kept, *(T.StructField(n, kind) for n, kind, _ in new)])
    return docs.select(F.col(f"`{text}`").cast("string").alias(own), *quoted(keep)).mapInArrow(run, schema)


# ---------------------------------------------------------------- the search, on a histogram of lengths


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 over every threshold."""
    lengths = np.arange(capacity + 1)
    number, mass = np.cumsum(counts), np.cumsum(counts * lengths)
    half = capacity // 2
    best = -(-int(mass[-1]) // capacity)
    for t in range(0, half + 1):
        alone = int(number[-1] - number[capacity - t])
        paired = int(number[capacity - t] - number[half])
        room = paired * capacity - int(mass[capacity - t] - mass[half])
        rest = int(mass[half] - (mass[t - 1] if t else 0))
        best = max(best, alone + paired + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing, on counts: (copies, lengths in the bin)."""
    rooms: dict[int, list[list]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for room in sorted(r for r in rooms if r >= length):
            groups, rooms[room] = rooms[room], []
            for copies, bin_ in groups:
                each = room // length
                full = min(copies, left // each)
                over = left - full * each if full < copies else 0
                left -= full * each + over
                if full:
                    rooms.setdefault(room - each * length, []).append([full, bin_ + (length,) * each])
                if over:
                    rooms.setdefault(room - over * length, []).append([1, bin_ + (length,) * over])
                if (idle := copies - full - bool(over)) > 0:
                    rooms[room].append([idle, bin_])
            if not left:
                break
        each = capacity // length
        full, over = divmod(left, each)
        if full:
            rooms.setdefault(capacity - each * length, []).append([full, (length,) * each])
        if over:
            rooms.setdefault(capacity - over * length, []).append([1, (length,) * over])
    return [(copies, bin_) for groups in rooms.values() for copies, bin_ in groups if copies]


def dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether filling b dominates a: the lengths of a can be dealt to those of b, each getting no more than it holds."""
    rooms = list(b)
    for x in a:
        i = min((j for j, r in enumerate(rooms) if r >= x), key=rooms.__getitem__, default=None)
        if i is None:
            return False
        rooms[i] -= x
    return True


def fillings(room: int, counts: np.ndarray, below: list[int], spare: int) -> list[tuple[int, ...]]:
    """Undominated maximal fillings of `room` that waste at most `spare`, least waste first, FILLINGS at most.

    below[x]: the largest length of which there is one left and that is at most x, or 0.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    tries = 0

    def grow(room: int, last: int, taken: tuple[int, ...]) -> None:
        nonlocal tries
        x = below[min(room, last)]
        if not x:
            # Nothing fits that is not larger than the last one; maximal only if nothing larger fits either.
            if not below[room] or taken.count(below[room]) >= counts[below[room]]:
                found.append((room, taken))
            return
        while x and tries < 40 * FILLINGS and len(found) < 4 * FILLINGS:
            if taken.count(x) < counts[x]:
                tries += 1
                grow(room - x, x, (*taken, x))
                if found and found[-1][0] == 0:
                    return
            x = below[x - 1]

    one = below[room]
    if one == room:
        return [(one,)] if one else [()]
    x = one
    while x * 2 >= room and x:
        y = below[room - x]
        if x + y == room and y and (x != y or counts[x] > 1):
            found.append((0, (x, y)))
            break
        x = below[x - 1]
    if not found:
        grow(room, room, ())
    found = sorted({f for f in found if f[0] <= spare}, key=lambda f: (f[0], len(f[1]), [-x for x in f[1]]))[:FILLINGS]
    kept: list[tuple[int, ...]] = []
    for _, f in found:
        if not any(dominated(f, k) for k in kept):
            kept.append(f)
    return kept


def plan(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """(copies, lengths in the bin) for all of `counts` (at index length)."""
    counts = np.asarray(counts, np.int64).copy()
    total = int((counts * np.arange(capacity + 1)).sum())
    best = best_fit(counts, capacity)
    bins = sum(c for c, _ in best)
    least = lower_bound(counts, capacity)
    if bins <= least:
        return best

    def left_below(counts: np.ndarray) -> list[int]:
        return np.maximum.accumulate(np.where(counts > 0, np.arange(capacity + 1), 0)).tolist()

    below = left_below(counts)
    path: list[tuple[int, tuple[int, ...]]] = []
    waste, spent = 0, 0
    stack: list[tuple[int, list]] = []

    def options() -> list:
        largest = below[capacity]
        counts[largest] -= 1
        emptied = counts[largest] == 0
        under = left_below(counts) if emptied else below
        # The lengths beside the largest one are no larger than it.
        spare = (bins - 1) * capacity - total - waste
        found = [(largest, *f) for f in fillings(capacity - largest, counts, under, spare)]
        counts[largest] += 1
        return found[::-1]

    stack.append((len(path), options()))
    while stack and spent < nodes:
        depth, ways = stack[-1]
        while len(path) > depth:
            copies, bin_ = path.pop()
            for x in bin_:
                counts[x] += copies
            waste -= copies * (capacity - sum(bin_))
            below = left_below(counts)
        if not ways:
            stack.pop()
            continue
        bin_ = ways.pop()
        spent += 1
        need = Counter(bin_)
        copies = int(min(counts[x] // n for x, n in need.items()))
        loss = copies * (capacity - sum(bin_))
        if waste + loss > (bins - 1) * capacity - total:
            # Once is allowed where as often as possible is not.
            copies = 1
            loss = capacity - sum(bin_)
            if waste + loss > (bins - 1) * capacity - total:
                continue
        for x, n in need.items():
            counts[x] -= n * copies
        waste += loss
        path.append((copies, bin_))
        if any(counts[x] == 0 for x in need):
            below = left_below(counts)
        if not below[capacity]:
            best, bins = list(path), sum(c for c, _ in path)
            if bins <= least:
                break
            continue
        stack.append((len(path), options()))
    return best


# ---------------------------------------------------------------- placing


def placement(histogram: list[tuple[int, int]], capacity: int, nodes: int) -> dict[int, np.ndarray]:
    """For each length, rows (first number, copies of the bin, per bin, first sequence, offset), by first number."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    found: dict[int, list] = {}
    sequence = 0
    used: Counter = Counter()
    for copies, bin_ in plan(counts, capacity, nodes):
        offset = 0
        for length, each in Counter(bin_).items():
            found.setdefault(length, []).append((used[length], each, sequence, offset))
            used[length] += each * copies
            offset += each * length
        sequence += copies
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def pack(cut: DataFrame, keep: list[str], capacity: int = CAPACITY, nodes: int = NODES, id_col: str = "doc_id") -> DataFrame:
    """`cut` (with piece and length; read more than once: a written table) plus sequence_id and offset, columns `keep`."""
    spark = cut.sparkSession
    # At most `capacity` rows come to the driver, however large the corpus is.
    histogram = [(int(r[0]), int(r[1])) for r in cut.groupBy("length").count().collect()]
    places = spark.sparkContext.broadcast(placement(histogram, capacity, nodes))
    salts = max(16, -(-max((n for _, n in histogram), default=0) // NUMBERED_AT_ONCE))
    salt, at = fresh(cut, "salt"), fresh(cut, "number")
    salted = cut.withColumn(salt, F.pmod(F.xxhash64(f"`{id_col}`", "piece"), F.lit(salts)).cast("int"))
    before = fresh(cut, "before")
    sizes = (
        salted.groupBy("length", salt).count()
        .withColumn(before, F.sum("count").over(Window.partitionBy("length").orderBy(salt)) - F.col("count"))
        .drop("count")
    )
    line = Window.partitionBy("length", salt).orderBy(F.col(f"`{id_col}`"), "piece")
    numbered = (
        salted.withColumn(at, F.row_number().over(line))
        .join(sizes, ["length", salt])
        .select(*quoted(keep), F.col("length").alias("_length"), (F.col(at) + F.col(before) - 1).alias("_number"))
    )
    kept = cut.select(*quoted(keep)).schema.fields
    names = [f.name for f in kept] + ["sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = places.value
        for batch in batches:
            n = batch.num_columns
            length, number = (np.asarray(batch.column(i)) for i in (n - 2, n - 1))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for value, rows in zip(values.tolist(), np.split(order, starts[1:])):
                table = of[value]
                row = table[np.searchsorted(table[:, 0], number[rows], side="right") - 1]
                copy, inside = np.divmod(number[rows] - row[:, 0], row[:, 1])
                sequence[rows] = row[:, 2] + copy
                offset[rows] = row[:, 3] + inside * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offset)], names=names)

    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, path, ["doc_id"], capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(cut, "pieces"), ["doc_id", "piece", "start", "length", "ids_crc32"], capacity)
