"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

Spark deals out the documents; each task splits its texts by the pre-tokenizer's pattern and hands the distinct pieces
it has not met yet to an in-process DuckDB. There a recursive query holds one row per token position, joins adjacent
positions with the merge table, contracts each piece's leftmost pair of minimum rank, and repeats on the pieces that
changed until none does. Ordered aggregation turns positions into id lists, and ids back into bytes. Where texts are
encoded and decoded at once, each distinct piece's ids are decoded once and texts are put together from both.

Nothing is shuffled. Memory is bounded: pieces go to DuckDB at most PIECES_AT_ONCE at a time, and what has been met is
kept in Arrow columns up to CACHE_ENTRIES. Pieces of more than LONG_PIECE bytes would need as many rounds as they have
tokens; they are contracted by the same rule with a heap.

Defined cases: a null text is empty; an empty text has no ids and decodes to nothing; each row of a repeated id is
encoded; ids that are not in the vocabulary fail.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecount.llm.common import Met, binaries, fresh, inside, joined, quoted, text_groups

PIECES_AT_ONCE = 50_000
CACHE_ENTRIES = 1_200_000
LONG_PIECE = 256
#: The pattern under which a single space between two other characters starts a piece (a fixed value).
SPACE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks after a space that are a word of Latin letters and a run of signs, perhaps with another such pair in the next
#: line, and no more: each part is a piece. What else there is goes through the pattern.
LATIN, SIGNS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+", r"[!-/:-@\[-`{-~]*"
PLAIN_CHUNK = rf"^(?P<a>{LATIN})(?P<b>{SIGNS})(?:(?P<c>\n)(?P<d>{LATIN})(?P<e>{SIGNS}))?$"
TEXT_AT_ONCE = 8_000_000
IDS_AT_ONCE = 4_000_000

#: Rows of `part` stay in the order of (piece, pos): one thread, probes and windows without an order of their own.
#: What comes out is compared with the bytes that went in, and ORDERED says the same with explicit orders.
ENCODE = """
WITH RECURSIVE part(step, piece, pos, id, next_id, merged) AS (
  SELECT 0, piece, pos, s.id, s.next_id, merged
  FROM start AS s LEFT JOIN merges AS m ON m.id = s.id AND m.next_id = s.next_id
  UNION ALL
  SELECT step + 1, piece, pos, a.id, a.next_id, m.merged
  FROM (
    SELECT step, piece, pos,
           CASE WHEN pos = spot THEN token ELSE id END AS id,
           CASE WHEN pos = spot THEN lead(next_id) OVER ({line})
                WHEN next_id >= 0 AND lead(pos) OVER ({line}) = spot THEN token
                ELSE next_id END AS next_id,
           lag(pos) OVER ({line}) = spot AND lag(piece) OVER ({line}) = piece AS eaten
    FROM part JOIN (
      SELECT piece, min(merged::BIGINT * 65536 + pos) AS key, key % 65536 AS spot, (key // 65536)::INTEGER AS token
      FROM part WHERE merged IS NOT NULL GROUP BY piece
    ) USING (piece)
  ) AS a
  LEFT JOIN merges AS m ON m.id = a.id AND m.next_id = a.next_id
  WHERE eaten IS NOT TRUE
),
done AS (SELECT piece, max(step) AS step FROM part GROUP BY piece)
SELECT piece, list(id ORDER BY pos) AS ids FROM part JOIN done USING (piece, step) GROUP BY piece ORDER BY piece
"""
ORDERED = "PARTITION BY piece ORDER BY pos"

DECODE = """
SELECT piece, string_agg(spelling, '' ORDER BY pos) AS spelling
FROM start JOIN vocabulary USING (id) GROUP BY piece ORDER BY piece
"""


class Codec:
    """One per Python worker: the tables in DuckDB and the pieces met so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.split = regex.compile(pattern).findall
        self.by_space = pattern == SPACE_PATTERN
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        merges = [
            (self.rank[t[:i]], self.rank[t[i:]], r)
            for t, r in self.rank.items()
            for i in range(1, len(t))
            if t[:i] in self.rank and t[i:] in self.rank
        ]
        left, right, merged = (np.array(x, np.int32) for x in zip(*merges))
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self.con.register("m", pa.table({"id": left, "next_id": right, "merged": merged}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        spellings = pa.table({"id": list(self.rank.values()), "spelling": [t.hex() for t in self.rank]})
        self.con.register("v", spellings)
        self.con.execute("CREATE TABLE vocabulary AS SELECT id::INTEGER AS id, spelling FROM v")
        self.pair = {(a, b): c for a, b, c in merges}
        # The vocabulary and the empty string, which has no ids.
        self.spellings = pa.array([b"", *self.rank], pa.binary())
        own = np.array([*self.rank.values()], "<u4")
        self.own_ids = binaries(own.tobytes(), np.append(0, np.arange(len(own) + 1) * 4))
        self.pieces, self.chunks = Met(CACHE_ENTRIES, 2), Met(CACHE_ENTRIES, 2)

    def _start(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        lengths = np.asarray(lengths, np.int64)
        piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        following = np.append(ids[1:], -1)
        following[np.cumsum(lengths) - 1] = -1
        columns = {"piece": piece, "pos": pos, "id": ids, "next_id": following}
        self.con.register("start", pa.table({c: v.astype(np.int32) for c, v in columns.items()}))

    def contracted(self, data: bytes) -> bytes:
        """The same rule for one long piece: a heap of pairs by rank, then place."""
        ids = [self.rank[bytes([b])] for b in data]
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            merged, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = merged, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (m := self.pair.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (m, a, ids[a], ids[b]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def short(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and spellings of pieces of up to LONG_PIECE bytes: the recursion, and what its ids decode to."""
        data, ends = inside(pieces)
        for line in ("", ORDERED):
            self._start(np.diff(ends), self.of_byte[data])
            found = self.con.sql(ENCODE.format(line=line)).to_arrow_table()["ids"].combine_chunks()
            ids = binaries(np.asarray(found.flatten()).astype("<u4").tobytes(), (np.asarray(found.offsets) - found.offsets[0].as_py()) * 4)
            spelled = self.spelled(ids)
            if spelled.equals(pieces):
                return ids, spelled
        raise ValueError("the ids of a piece do not spell it")

    def spelled(self, ids: pa.Array) -> pa.Array:
        """What ids, at least one each, decode to."""
        data, ends = inside(ids)
        self._start(np.diff(ends) // 4, data.view("<u4"))
        found = self.con.sql(DECODE).to_arrow_table()["spelling"].combine_chunks().cast(pa.string())
        found, ends = inside(found.cast(pa.binary()))
        return binaries(bytes.fromhex(found.tobytes().decode("ascii")), ends // 2)

    def learn(self, pieces: pa.Array) -> list[pa.Array]:
        """Ids and spellings of pieces. One that is in the vocabulary is itself."""
        own = pc.index_in(pieces, value_set=self.spellings)
        kind = np.where(np.asarray(pc.is_valid(own)), 0, np.where(np.asarray(pc.binary_length(pieces)) > LONG_PIECE, 2, 1))
        at = own.drop_null()
        ids, spelled = [self.own_ids.take(at)], [self.spellings.take(at)]
        rest = pieces.filter(pa.array(kind == 1))
        for first in range(0, len(rest), PIECES_AT_ONCE):
            coded, decoded = self.short(rest.slice(first, PIECES_AT_ONCE))
            ids.append(coded)
            spelled.append(decoded)
        if (kind == 2).any():
            ids.append(pa.array([self.contracted(p) for p in pieces.filter(pa.array(kind == 2)).to_pylist()], pa.binary()))
            spelled.append(self.spelled(ids[-1]))
        order = np.empty(len(kind), np.int32)
        order[np.argsort(kind, kind="stable")] = np.arange(len(kind))
        return [pa.concat_arrays(c).take(pa.array(order)) for c in (ids, spelled)]

    def put_together(self, pieces: pa.Array, ends: np.ndarray, order: np.ndarray | None = None) -> list[pa.Array]:
        """Ids and spellings of the pieces from each of `ends` to the next; `order` as an index of the pieces."""
        coded = pieces.dictionary_encode()
        places = self.pieces.places(coded.dictionary, self.learn)[np.asarray(coded.indices)]
        places = places if order is None else places[order]
        return [joined(c, places, ends) for c in self.pieces.columns[1:]]

    def by_pattern(self, texts: list[str]) -> list[pa.Array]:
        split = [self.split(t) for t in texts]
        ends = np.cumsum([0, *map(len, split)])
        return self.put_together(pa.array(chain.from_iterable(split), pa.string()).cast(pa.binary()), ends)

    def learn_chunks(self, chunks: pa.Array) -> list[pa.Array]:
        """Ids and spellings of chunks of text that follow a space. Null marks one at whose edge the space may belong
        to a run of blanks."""
        texts = chunks.cast(pa.string())
        parts = pc.extract_regex(texts, PLAIN_CHUNK)
        plain = np.asarray(parts.is_valid())
        a, *others = [c.cast(pa.binary()) for c in parts.filter(pa.array(plain)).flatten()]
        n = len(a)
        a = pc.binary_join_element_wise(pa.scalar(b" "), a, pa.scalar(b""))
        made = self.put_together(pa.concat_arrays([a, *others]), np.arange(n + 1) * 5, np.arange(5 * n).reshape(5, n).T.ravel())
        rest = texts.filter(pa.array(~plain)).to_pylist()
        whole = [bool(c) and not c[0].isspace() and not c[-1].isspace() for c in rest]
        found = self.by_pattern([" " + c for c, w in zip(rest, whole) if w])
        order, known = np.zeros(len(chunks), np.int32), plain.copy()
        known[~plain] = whole
        order[plain], order[known & ~plain] = np.arange(n), n + np.arange(sum(whole))
        return [pa.concat_arrays([m, f]).take(pa.array(order, mask=~known)) for m, f in zip(made, found)]

    def coded(self, texts: pa.Array) -> list[pa.Array]:
        """Ids of texts, and what they decode to. A space between two characters that are no blanks starts a piece:
        texts are cut there, and the chunks, which repeat, looked up whole. A text with other spaces is split by the
        pattern as it is."""
        if not self.by_space:
            return self.by_pattern(texts.to_pylist())
        split = pc.split_pattern(texts, " ")
        ends = np.asarray(split.offsets)
        chunks = split.flatten().cast(pa.binary())
        if not len(chunks):
            return [pa.array([], pa.binary())] * 2
        coded = chunks.dictionary_encode()
        places = self.chunks.places(coded.dictionary, self.learn_chunks)[np.asarray(coded.indices)]
        ids, spelled = self.chunks.columns[1:]
        odd = np.logical_or.reduceat(np.asarray(pc.is_null(ids))[places], ends[:-1])
        # The first chunk follows no space, so it is coded anew; of an odd text all is.
        heads = chunks.take(pa.array(ends[:-1])).cast(pa.string())
        firsts = self.by_pattern(pc.if_else(pa.array(odd), texts, heads).to_pylist())
        places[np.repeat(odd, np.diff(ends))] = len(ids) + len(texts)
        places[ends[:-1]] = len(ids) + np.arange(len(texts))
        nothing = pa.array([b""], pa.binary())
        return [joined(pa.concat_arrays([c, f, nothing]), places, ends) for c, f in zip((ids, spelled), firsts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.coded(pa.array(texts, pa.string()))[0].to_pylist()

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        found = iter(self.spelled(pa.array([data for data in encoded if data], pa.binary())).to_pylist()) if any(encoded) else iter(())
        return [next(found) if data else b"" for data in encoded]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _in_groups(values: Iterable, size) -> Iterator[list]:
    group, held = [], 0
    for v in values:
        group.append(v)
        held += size(v)
        if held >= IDS_AT_ONCE:
            yield group
            group, held = [], 0
    if group:
        yield group


def _mapped(df: DataFrame, source, keep: list[str], outs: list[str], groups) -> DataFrame:
    """Columns `keep` and binary columns `outs`. `groups`: Arrow column -> lists of Arrow columns, a group of rows at a time,
    so that a group's results are on their way before the next group is coded."""
    own = fresh(df, "coded")
    kept = df.select(*quoted(keep)).schema.fields
    names = [f.name for f in kept] + outs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for results in groups(batch.column(0)):
                n = len(results[0])
                columns = [c.slice(at, n) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, *results], names=names)
                at += n

    schema = T.StructType([*kept, *(T.StructField(o, T.BinaryType()) for o in outs)])
    return df.select(source.alias(own), *quoted(keep)).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", out: str = "ids") -> DataFrame:
    """The columns `keep` and `out`: the ids of the whole text, little-endian unsigned 32-bit integers."""

    def groups(column):
        for texts in text_groups(column, TEXT_AT_ONCE):
            yield codec(path, pattern).coded(texts)[:1]

    return _mapped(docs, F.col(f"`{text}`").cast("string"), keep, [out], groups)


def decode(encoded: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns `keep` and `out`: the bytes that `ids` (as `encode` gives them; null: none) spell."""

    def groups(column):
        tool = codec(path, pattern)
        for some in _in_groups((v.as_py() or b"" for v in column), len):
            yield [pa.array(tool.decode(some), pa.binary())]

    return _mapped(encoded, F.col(f"`{ids}`"), keep, [out], groups)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, ids and decoded: `decode` of `encode` in one Python worker, which decodes the ids of each
    distinct piece once."""

    def groups(column):
        for texts in text_groups(column, TEXT_AT_ONCE):
            yield codec(path, pattern).coded(texts)

    return _mapped(docs, F.col(f"`{text}`").cast("string"), keep, ["ids", "decoded"], groups)
