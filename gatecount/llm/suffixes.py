"""Removal of repeated strings by a suffix sort whose comparisons use hashes.

A string of LENGTH bytes is covered if it also starts earlier: in a smaller id, or earlier in the same document. Every
byte of a covered string is removed. What is found is exactly the repeated suffixes of the corpus' suffix array with
LENGTH bytes or more in common, but no array of the whole corpus is built:

1. Every window of LENGTH bytes has an anchor: the smallest hash among its GRAM-byte strings, leftmost of equals. Equal
   windows have equal anchors at equal offsets, and neighbouring windows mostly share theirs, so a document is cut into
   runs of windows with one anchor, one row each. Runs that are equal as a whole (anchor and hash of the run's bytes)
   are settled at once: all but the first are covered. Repeats inside a batch are settled before anything is shuffled,
   so that a passage found in every document costs one row per batch.
2. Rows are dealt out by anchor and read in order. An anchor with one kind of run is settled; only runs whose anchor
   has several kinds go on, with their bytes.
3. Their suffixes are sorted by merging: two suffixes are compared by the longest extension they have in common, found
   by binary search over prefix polynomial hashes, and then by the next byte. Neighbours with LENGTH bytes in common
   are compared byte by byte (collision verification); should one differ, the batch is sorted by its bytes instead.
   Runs with a very frequent anchor are cut into their windows and dealt out by the windows' hashes instead, repeats
   in a batch settled first, so no anchor gathers an unbounded group.
4. Covered windows are merged to spans per document and cut out.

Defined cases: a null text has no bytes; shorter texts than LENGTH lose nothing; order is by (id, start), a null id
after all others, so equal starts in rows that share an id do not cover each other; columns besides id and text are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecount.llm.common import fresh, quoted, strings, written
from gatecount.llm.jaccard import mixed

LENGTH = 100
GRAM = 32
BUFFER = 1 << 20
#: Runs with the same anchor that one task sorts; beyond it they are dealt out by window.
FREQUENT = 4096
SEGMENTS_AT_ONCE = 8192
LAST = (1 << 63) - 1
STEPS = (64, 32, 16, 8, 4, 2, 1)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.cumprod(have)
    return have[:n]


class Hashed:
    """A byte string with prefix polynomial hashes: the hash of any part in constant time (modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data = data
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_INVERSE, n + 1)[:n], out=self.sums[1:])
        self.shift = powers(_BASE, n + 1)

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.shift[at]


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours, by running minima of blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts that lie one after the other, text i up to ends[i].

    first window, number of windows, offset of the anchor in the first window, anchor hash, hash of the run's bytes.
    """
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    hashed = Hashed(data)
    gram = mixed(hashed.of(np.arange(len(data) - GRAM + 1), GRAM))
    mask = np.uint64(BUFFER - 1)
    packed = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
    anchor = (window_minimum(packed, LENGTH - GRAM + 1) & mask).astype(np.int64)
    window = np.arange(len(anchor))
    text = np.searchsorted(ends, window, side="right")
    valid = window + LENGTH <= ends[text]
    window, anchor, text = window[valid], anchor[valid], text[valid]
    if not len(window):
        return none, none, none, none, none
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    at = np.flatnonzero(new)
    first, many = window[at], np.diff(np.append(at, len(window)))
    whole = mixed(hashed.of(first, many + (LENGTH - 1)) + many.astype(np.uint64) * np.uint64(_BASE))
    return first, many, anchor[at] - first, gram[anchor[at]].view(np.int64), whole.view(np.int64)


# `at` holds, from the top: start (31 bits), number of windows (7), offset of the anchor (7), variant of the text (18).
def packed_at(start, many, offset, variant):
    return (start << 32) | (many << 25) | (offset << 18) | variant


VARIANTS = 1 << 18


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return at >> 32, (at >> 25) & 127, (at >> 18) & 127, at & (VARIANTS - 1)


def ordered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc (the order of the id), variant (tells apart texts that share an id), text."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"),
        F.pmod(F.xxhash64(whole), F.lit(VARIANTS)).cast("long").alias("variant"),
        whole.alias("text"),
    )


def later(order: np.ndarray, doc: np.ndarray, start: np.ndarray, new: np.ndarray) -> np.ndarray:
    """In classes that begin where `new` is set (rows sorted by doc and start): who comes after the class' first."""
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc[order] != doc[order][head]) | (start[order] != start[order][head])


ROWS = "anchor long, segment long, doc long, at long"


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, variants = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        found: list[tuple[np.ndarray, ...]] = []
        parts: list[tuple[int, int, bytes]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if parts:
                ends = np.cumsum([len(d) for _, _, d in parts])
                first, many, offset, anchor, whole = runs(np.frombuffer(b"".join(d for _, _, d in parts), np.uint8), ends)
                of = np.searchsorted(ends, first, side="right")
                row = np.array([r for r, _, _ in parts])[of]
                shift = np.array([s - (e - len(d)) for (_, s, d), e in zip(parts, ends.tolist())])[of]
                found.append((anchor, whole, ids[row], packed_at(first + shift, many, offset, variants[row])))
            parts.clear()
            held = 0

        for row, text in enumerate(strings(batch.column(2))):
            data = text.encode("utf-8", "surrogatepass")
            for start in range(0, max(1, len(data) - LENGTH + 1), BUFFER // 2):
                part = data[start : start + BUFFER // 2 + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                if held + len(part) > BUFFER - 1:
                    flush()
                parts.append((row, start, part))
                held += len(part)
        flush()
        if not found:
            continue
        anchor, whole, doc, at = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((at, doc, anchor, whole))
        a, w = anchor[order], whole[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])))
        covered = later(order, doc, at >> 32, new)
        a = np.where(covered, mixed((doc[order] + at[order]).view(np.uint64)).view(np.int64), a)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(w, mask=covered), pa.array(doc[order]), pa.array(at[order])],
            names=["anchor", "segment", "doc", "at"],
        )


MARKS = "doc long, at long, anchor long, covered boolean"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by anchor, segment, doc, at. Held between batches: the last class' first row and, while its anchor has
    one kind of run only, that kind's first rows."""
    last = None  # anchor, segment, doc, start of the class at the end of the batch before
    several = False
    held: list[tuple[int, int, int]] = []

    def out(doc, at, anchor, covered) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(at), pa.array(anchor), pa.array(covered)], names=["doc", "at", "anchor", "covered"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        settled = np.asarray(batch.column(1).is_null().to_numpy(zero_copy_only=False))
        anchor, doc, at = (np.asarray(batch.column(i)) for i in (0, 2, 3))
        if settled.any():
            yield out(doc[settled], at[settled], anchor[settled], np.ones(int(settled.sum()), bool))
            segment = np.asarray(batch.column(1).filter(pa.array(~settled)))
            anchor, doc, at = anchor[~settled], doc[~settled], at[~settled]
        else:
            segment = np.asarray(batch.column(1))
        if not len(anchor):
            continue
        start = at >> 32
        goes_on = last is not None and anchor[0] == last[0]
        new_anchor = np.concatenate(([not goes_on], anchor[1:] != anchor[:-1]))
        new = new_anchor | np.concatenate(([not goes_on or segment[0] != last[1]], segment[1:] != segment[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        covered = (doc != np.where(head < 0, last[2] if last else 0, doc[head])) | (
            start != np.where(head < 0, last[3] if last else 0, start[head])
        )
        number = np.cumsum(new_anchor)  # 0: the anchor of the batch before
        kinds = np.bincount(number, weights=new, minlength=number[-1] + 1)
        if goes_on:
            kinds[0] += 1
        many = kinds > 1
        if goes_on and several:
            many[0] = True
        if held and (not goes_on or many[0]):
            if goes_on:
                d, p, n = (np.array(x) for x in zip(*held))
                yield out(d, p, n, np.zeros(len(d), bool))
            held = []
        ambiguous = ~covered & many[number]
        keep = covered | ambiguous
        yield out(doc[keep], at[keep], anchor[keep], covered[keep])
        end = int(number[-1])
        several = bool(many[end])
        if end or several:
            held = []
        if not several:
            waiting = np.flatnonzero(~covered & (number == end))
            seen = dict.fromkeys([*held, *zip(doc[waiting].tolist(), at[waiting].tolist(), anchor[waiting].tolist())])
            held = list(seen)
        h = int(head[-1])
        last = (anchor[-1], segment[-1], *((last[2], last[3]) if h < 0 else (doc[h], start[h])))


SEGMENTS = "bucket long, doc long, at long, bytes binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of ambiguous runs; those with a frequent anchor window by window, repeats in the batch settled (null)."""
    names = ["bucket", "doc", "at", "bytes"]
    for batch in batches:
        rows: list[tuple] = []
        frequent: list[tuple] = []
        for i, text in enumerate(strings(batch.column(2))):
            doc, variant = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            data = text.encode("utf-8", "surrogatepass")
            for run in batch.column(3)[i].as_py():
                at = run["at"]
                start, many = at >> 32, (at >> 25) & 127
                if not run["frequent"]:
                    rows.append((run["anchor"], doc, at, data[start : start + many + LENGTH - 1]))
                    continue
                for j in range(many):
                    frequent.append((data[start + j : start + j + LENGTH], doc, packed_at(start + j, 1, 0, variant)))
            if len(rows) + len(frequent) > 200_000:
                yield _segment_batch(rows, frequent, names)
                rows, frequent = [], []
        yield _segment_batch(rows, frequent, names)


def _segment_batch(rows: list[tuple], frequent: list[tuple], names: list[str]) -> pa.RecordBatch:
    import xxhash

    first: dict[bytes, tuple[int, int]] = {}
    for window, doc, at in frequent:
        place = (doc, at >> 32)
        if window not in first or place < first[window]:
            first[window] = place
    for window, doc, at in frequent:
        settled = (doc, at >> 32) != first[window]
        bucket = xxhash.xxh3_64_intdigest(window if not settled else doc.to_bytes(8, "little") + at.to_bytes(8, "little"))
        rows.append((bucket - (1 << 63), doc, at, None if settled else window))
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=names
    )


def common(text: Hashed, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length, up to LENGTH, that suffixes a and b have in common: binary search over hashes."""
    length = np.zeros(len(a), np.int64)
    for step in STEPS:
        fits = length + step <= LENGTH
        more = np.where(fits, step, 0)
        same = text.of(a + length, more) == text.of(b + length, more)
        length += np.where(same, more, 0)
    return length


def merge_sort(text: Hashed, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A stable order of suffixes inside groups (equal neighbours in `group`), by their first LENGTH bytes.

    All groups are merged side by side, runs of 1, 2, 4, ...: each suffix finds its place in the run beside its own by
    binary search.
    """
    n = len(suffix)
    order = np.arange(n)
    new = np.concatenate(([True], group[1:] != group[:-1])) if n else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(new), n))
    finish = begin + np.repeat(size, size)
    width, largest = 1, int(size.max(initial=0))
    while width < largest:
        place = np.arange(n)
        # Only groups with a second run take part.
        live = np.flatnonzero(finish - begin > width)
        inside = live - begin[live]
        pair = begin[live] + inside // (2 * width) * (2 * width)
        middle, end = np.minimum(pair + width, finish[live]), np.minimum(pair + 2 * width, finish[live])
        left = live < middle
        low, high = np.where(left, middle, pair), np.where(left, end, middle)
        from_ = low.copy()
        own = suffix[order[live]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            half = (low[open_] + high[open_]) // 2
            other = suffix[order[half]]
            length = common(text, own[open_], other)
            equal = length >= LENGTH
            stop = np.where(equal, 0, length)
            mine, theirs = text.data[own[open_] + stop], text.data[other + stop]
            # Left ones go before equals of the right run, right ones behind equals of the left run.
            below = np.where(equal, ~left[open_], theirs < mine)
            low[open_] = np.where(below, half + 1, low[open_])
            high[open_] = np.where(below, high[open_], half)
            open_ = open_[low[open_] < high[open_]]
        own_run = np.where(left, pair, middle)
        place[live] = pair + (live - own_run) + (low - from_)
        after = np.empty_like(order)
        after[place] = order
        order = after
        width *= 2
    return order


def covered_windows(bucket: np.ndarray, doc: np.ndarray, at: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """doc, at of the covered windows (runs of them) of segments."""
    start, many, offset, variant = unpacked(at)
    lengths = many + (LENGTH - 1)
    text = Hashed(np.frombuffer(b"".join(parts), np.uint8))
    begin = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(at)), many)
    step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    suffix, place = begin[row] + step, start[row] + step
    # Equal windows have their anchor at the same offset.
    _, bucket = np.unique(bucket, return_inverse=True)
    group = bucket[row] * 256 + (offset[row] - step + 128)
    sorted_ = np.lexsort((place, doc[row], group))
    suffix, place, row, group, step = suffix[sorted_], place[sorted_], row[sorted_], group[sorted_], step[sorted_]
    order = merge_sort(text, suffix, group)
    s, g = suffix[order], group[order]
    same = g[1:] == g[:-1]
    same[same] = common(text, s[1:][same], s[:-1][same]) >= LENGTH
    if len(s) and not _verified(text.data, s, np.flatnonzero(same)):
        whole = np.lib.stride_tricks.sliding_window_view(text.data, LENGTH)[suffix]
        kind = np.unique(np.ascontiguousarray(whole).view(f"V{LENGTH}").ravel(), return_inverse=True)[1]
        order = np.lexsort((np.arange(len(kind)), kind, group))
        g, k = group[order], kind[order]
        same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    new = np.concatenate(([True], ~same)) if len(s) else np.empty(0, bool)
    covered = later(order, doc[row], place, new)
    hit = order[covered]
    row, step = row[hit], step[hit]
    by = np.lexsort((step, row))
    row, step = row[by], step[by]
    begins = np.concatenate(([True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1))) if len(row) else np.empty(0, bool)
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(row)))
    row, step = row[first], step[first]
    return doc[row], packed_at(start[row] + step, count, 0, variant[row])


def _verified(data: np.ndarray, suffix: np.ndarray, pairs: np.ndarray) -> bool:
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    for at in range(0, len(pairs), 100_000):
        some = pairs[at : at + 100_000]
        if not (windows[suffix[some]] == windows[suffix[some + 1]]).all():
            return False
    return True


COVERED = "doc long, at long"


def _sorted_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments by bucket: whole buckets are gathered up to SEGMENTS_AT_ONCE and sorted together."""
    held: list[tuple] = []

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        bucket, doc, at = (np.array(x, np.int64) for x in list(zip(*rows))[:3])
        d, a = covered_windows(bucket, doc, at, [r[3] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a)], names=["doc", "at"])

    for batch in batches:
        settled = batch.column(3).is_null()
        yield batch.filter(settled).select(["doc", "at"])
        live = batch.filter(pa.array(~settled.to_numpy(zero_copy_only=False)))
        for row in zip(*(c.to_pylist() for c in live.columns)):
            if len(held) >= SEGMENTS_AT_ONCE and row[0] != held[-1][0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _spans(starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed spans [from, to) of one document, from its covered windows."""
    order = np.argsort(starts, kind="stable")
    low = starts[order]
    high = np.maximum.accumulate(low + counts[order] + (LENGTH - 1))
    new = np.concatenate(([True], low[1:] > high[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(low) - 1)
    return list(zip(low[first].tolist(), high[last].tolist()))


def covered(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, variant, runs: the covered windows (array of start and count) of each document that has any."""
    texts = ordered(docs, id_col, text)
    rows = texts.mapInArrow(_run_rows, ROWS).repartition("anchor").sortWithinPartitions("anchor", "segment", "doc", "at")
    marks = written(rows.mapInArrow(_marks, MARKS), "marks")
    ambiguous = marks.where("not covered")
    frequent = ambiguous.groupBy("anchor").count().where(F.col("count") > FREQUENT).select("anchor", F.lit(True).alias("frequent"))
    variant = F.col("at").bitwiseAND(F.lit(VARIANTS - 1)).alias("variant")
    wanted = (
        ambiguous.join(written(frequent, "frequent"), "anchor", "left")
        .groupBy("doc", variant)
        .agg(F.collect_set(F.struct("at", "anchor", F.coalesce("frequent", F.lit(False)).alias("frequent"))).alias("runs"))
    )
    segments = (
        texts.join(wanted, ["doc", "variant"])
        .select("doc", "variant", "text", "runs")
        .mapInArrow(_segments, SEGMENTS)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
    )
    more = segments.mapInArrow(_sorted_segments, COVERED)
    every = marks.where("covered").select("doc", "at").unionByName(more)
    start, count = F.shiftright("at", 32).alias("start"), F.shiftright("at", 25).bitwiseAND(F.lit(127)).alias("count")
    return every.groupBy("doc", variant).agg(F.collect_list(F.struct(start, count)).alias("runs"))


def _with_spans(docs: DataFrame, id_col: str, text: str, use: Callable, schema) -> DataFrame:
    texts = ordered(docs, id_col, text)
    joined = texts.join(covered(docs, id_col, text), ["doc", "variant"], "left").select("doc", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            starts, counts, ends = _run_arrays(batch.column(2))
            rows = []
            for i, t in enumerate(strings(batch.column(1))):
                a, b = ends[i], ends[i + 1]
                spans = _spans(starts[a:b], counts[a:b]) if b > a else []
                rows.append(use(None if ids[i] == LAST else ids[i], t.encode("utf-8", "surrogatepass"), spans))
            columns = list(zip(*rows)) or [()] * len(schema.names)
            arrays = [pa.array(c, kind) for c, kind in zip(columns, _arrow(schema))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(run, schema)


def _run_arrays(found: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and counts of all rows, and where each row's end."""
    flat = found.flatten()
    ends = np.concatenate(([0], np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    starts, counts = (np.asarray(flat.field(i)) for i in (0, 1))
    return starts, counts, ends


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    kinds = {T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
    return [kinds[f.dataType] for f in schema.fields]


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for low, high in spans:
        kept.append(data[at:low])
        at = high
    return b"".join([*kept, data[at:]])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is left of each document, in bytes."""
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept_sha256", T.StringType())]
    )

    def use(doc, data, spans):
        kept = _without(data, spans)
        return doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

    return _with_spans(docs, id_col, text, use, schema)


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters of which they hold only a part."""
    found = []
    for low, high in spans:
        while low < high and data[low] & 0xC0 == 0x80:
            low += 1
        while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
            high -= 1
        if low < high:
            found.append((low, high))
    return found


def rewritten(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with covered strings cut out of the texts, a character only as a whole. Null texts stay null."""
    doc, variant, runs = (fresh(docs, c) for c in ("order_of_id", "variant_of_text", "covered_runs"))
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.withColumn(doc, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))).withColumn(
        variant, F.pmod(F.xxhash64(whole), F.lit(VARIANTS)).cast("long")
    )
    found = covered(docs, id_col, text).toDF(doc, variant, runs)
    joined = keyed.join(found, [doc, variant], "left").select(runs, *quoted(docs.columns))
    names = docs.columns
    place = names.index(text) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, counts, ends = _run_arrays(batch.column(0))
            texts = []
            for i, t in enumerate(strings(batch.column(place))):
                a, b = ends[i], ends[i + 1]
                if b > a:
                    data = t.encode("utf-8", "surrogatepass")
                    spans = whole_characters(data, _spans(starts[a:b], counts[a:b]))
                    t = _without(data, spans).decode("utf-8", "surrogatepass")
                texts.append(t)
            new = pa.array(texts, pa.string(), mask=batch.column(place).is_null().to_numpy(zero_copy_only=False))
            columns = [new if i == place else c for i, c in enumerate(batch.columns)][1:]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields]))
