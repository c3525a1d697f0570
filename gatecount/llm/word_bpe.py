"""BPE over words, encoding and decoding, with a segment tree over the ranks of adjacent pairs.

Spark deals out the documents and nothing is shuffled. In a task, a text is normalised and cut into words as the
tokenizer file says, and each word is a row of tokens with a segment tree above it: leaf i holds (rank, i) of the pair
that starts at token i, an inner node the smaller of its two children. The root is then the leftmost pair of lowest
rank. Merging it changes three leaves (the pair, the one it swallowed, the one before it), whose paths to the root are
brought up to date in a logarithmic number of steps, until the root holds no pair. A word of m bytes takes m log m.

Words of up to SHORT bytes are merged side by side, one numpy row each, all at the same step; longer ones alone, each
with its tree in a list. Both are the same rule. White space is dropped and nothing joins across it, so chunks between
blanks, which repeat, are encoded once and looked up; what a worker has met is kept up to CACHE_ENTRIES chunks.

Defined cases: a null text is empty; an empty or blank text has no ids and decodes to nothing; texts of any length are
taken whole; each row of a repeated id is encoded; strings of the added tokens give those tokens, as the tokenizer
does by default; ids without a token are passed over in decoding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecount.llm.common import fresh, quoted, strings

SHORT = 64
CACHE_ENTRIES = 700_000
WORDS_AT_ONCE = 50_000
TEXT_AT_ONCE = 4_000_000
#: Letters before it have one small letter each and are in normal form.
FIRST_ODD_LETTER = "İ"
#: The steps before the merges for which chunks may be handled apart (fixed values of the public format).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL_STEPS = ["NFC", "Replace", "Lowercase"]
PLAIN_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def known_steps(content: dict) -> bool:
    """Whether a tokenizer file normalises and splits as the public format does, so that chunks may be handled apart."""
    splits, bytes_ = ((content["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}])[:2]
    steps = (content["normalizer"] or {}).get("normalizers") or []
    return (
        (splits.get("pattern"), splits.get("behavior"), splits.get("invert")) == ({"Regex": WORD_PATTERN}, "Removed", True)
        and (bytes_.get("type"), bytes_.get("add_prefix_space"), bytes_.get("use_regex")) == ("ByteLevel", False, False)
        and [s["type"] for s in steps] == NORMAL_STEPS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
    )


class Merges:
    """The merge table and the trees above rows of tokens."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain BPE file")
        self.vocabulary: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocabulary[b] for _, b in pairs], np.int64)
        self.merged = np.array([self.vocabulary[a + b] for a, b in pairs], np.int32)
        self.base = max(self.vocabulary.values()) + 2
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.none = len(pairs)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        letters = byte_letters()
        self.inner = np.array([self.vocabulary[c] for c in letters], np.int32)
        self.last = np.array([self.vocabulary[c + suffix] for c in letters], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; `none` where there is no merge. A token of -1 is no token."""
        wanted = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (right >= 0), self.ranks[at], self.none)

    def together(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most `width` bytes, one after the other, and how many each has."""
        n, size = len(words), np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        filled = np.arange(width + 1) < size[:, None]
        token = np.full((n, width + 1), -1, np.int32)
        token[filled] = self.inner[data]
        token[np.arange(n), size - 1] = self.last[data[np.cumsum(size) - 1]]
        # Column `width` stands for "no token" on either side.
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        after[np.arange(n), size - 1] = width
        after[:, width] = width
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        before[:, 0] = width
        void = self.none * width
        tree = np.full((n, 2 * width), void, np.int32)
        leaves = self.rank(token[:, :width].ravel(), token[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(leaves < self.none, leaves * width + np.arange(width), void)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        flat, tokens, nexts, befores = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
        rows = np.arange(n)
        while True:
            root = flat[rows * (2 * width) + 1]
            open_ = root < void
            rows, root = rows[open_], root[open_]
            if not len(rows):
                break
            i, line, trunk = root % width, rows * (width + 1), rows * (2 * width)
            j = nexts[line + i]
            k, h = nexts[line + j], befores[line + i]
            new = self.merged[root // width]
            tokens[line + i], tokens[line + j] = new, -1
            nexts[line + i] = k
            befores[line + k] = i
            ahead = self.rank(new, tokens[line + k])
            # The sentinel's own token stays -1, so that a first token has no pair before it.
            behind = self.rank(tokens[line + h], new)
            flat[trunk + width + i] = np.where(ahead < self.none, ahead * width + i, void)
            flat[trunk + width + j] = void
            has = (h < width) & (tokens[line + h] >= 0)
            flat[(trunk + width + h)[has]] = np.where(behind < self.none, behind * width + h, void)[has]
            trunks, node = np.concatenate((trunk, trunk, trunk[has])), np.concatenate((i, j, h[has])) + width
            while node[0] > 1:
                node >>= 1
                at = trunks + 2 * node
                flat[trunks + node] = np.minimum(flat[at], flat[at + 1])
        token = token[:, :width]
        return token[token >= 0], (token >= 0).sum(1)

    def alone(self, word: bytes) -> list[int]:
        """The same for one long word."""
        data = np.frombuffer(word, np.uint8)
        token = [*self.inner[data[:-1]].tolist(), int(self.last[data[-1]])]
        n, width = len(token), 1 << (len(token) - 1).bit_length()
        void = self.none * width
        rank_of, base, merged = self.rank_of.get, self.base, self.merged.tolist()
        tree = [void] * (2 * width)
        for i in range(n - 1):
            if (r := rank_of(token[i] * base + token[i + 1])) is not None:
                tree[width + i] = r * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(i: int, r: int | None) -> None:
            tree[width + i] = void if r is None else r * width + i
            k = (width + i) >> 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
                k >>= 1

        while (root := tree[1]) < void:
            r, i = divmod(root, width)
            j = after[i]
            k, h = after[j], before[i]
            token[i], token[j], after[i] = merged[r], -1, k
            put(j, None)
            if k < n:
                before[k] = i
            put(i, rank_of(token[i] * base + token[k]) if k < n else None)
            if h >= 0:
                put(h, rank_of(token[h] * base + token[i]))
        return [t for t in token if t >= 0]

    def encode(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit integers) of distinct, non-empty words."""
        classes: dict[int, list[bytes]] = {}
        found = {}
        for w in words:
            if len(w) > SHORT:
                found[w] = np.array(self.alone(w), "<u4").tobytes()
            else:
                classes.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(w)
        for width, listed in classes.items():
            for at in range(0, len(listed), WORDS_AT_ONCE):
                some = listed[at : at + WORDS_AT_ONCE]
                ids, sizes = self.together(some, width)
                buffer, ends = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
                found.update((w, buffer[a:b]) for w, a, b in zip(some, [0, *ends], ends))
        return found


class Codec:
    """One per Python worker: the merges, the file's own normaliser and word splitter, and the chunks met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.merges = Merges(content["model"])
        self.library = Tokenizer.from_file(path)
        added = content["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that stretch over their neighbours are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else lambda t: [t]
        self.spelling = {i: t for t, i in self.merges.vocabulary.items()} | {t["id"]: t["content"] for t in added}
        self.by_chunk = known_steps(content)
        self.byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.chunks: dict[bytes, bytes] = {}

    def words(self, text: str) -> list[bytes]:
        """Normalised and split by the library."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(text) if self.library.pre_tokenizer is not None else [(text, ())]
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in found if w]

    def learn(self, chunks: Iterable[bytes]) -> None:
        split = {}
        for chunk in chunks:
            core = chunk.rstrip(b".,")
            word = core.decode().lower()
            if word.isalpha() and max(word) < FIRST_ODD_LETTER:
                # A word of plain letters, perhaps with a run of stops, which is a word of its own.
                split[chunk] = [word.encode(), chunk[len(core) :]] if len(core) < len(chunk) else [word.encode()]
            elif chunk.isascii():
                split[chunk] = PLAIN_WORDS(chunk.lower())
            else:
                split[chunk] = self.words(chunk.decode())
        of = self.merges.encode({w for words in split.values() for w in words}).__getitem__
        self.chunks.update((chunk, b"".join(map(of, words))) for chunk, words in split.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit integers."""
        marked = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if marked:
            plain = dict(zip((i for i in range(len(texts)) if i not in set(marked)), self.encode([t for i, t in enumerate(texts) if i not in set(marked)])))
            for i in marked:
                parts = self.at_added(texts[i])
                found = iter(self.encode(parts[::2]))
                plain[i] = b"".join(self.added[p] if k % 2 else next(found) for k, p in enumerate(parts))
            return [plain[i] for i in range(len(texts))]
        if not self.by_chunk:
            split = [self.words(t) for t in texts]
            of = self.merges.encode({w for words in split for w in words}).__getitem__
            return [b"".join(map(of, words)) for words in split]
        # Small ASCII letters first, so that spellings share an entry; the learner lowers the others.
        cut = [t.encode("utf-8", "replace").lower().split() for t in texts]
        of = self.chunks.get
        found = [[*map(of, c)] for c in cut]
        holes = [i for i, ids in enumerate(found) if None in ids]
        if holes:
            missing = {c for i in holes for c, ids in zip(cut[i], found[i]) if ids is None}
            if len(self.chunks) + len(missing) > CACHE_ENTRIES:
                self.chunks.clear()
                missing, holes = set().union(*cut), range(len(cut))
            self.learn(missing)
            for i in holes:
                found[i] = map(self.chunks.__getitem__, cut[i])
        return [b"".join(ids) for ids in found]

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, put together by the file's decoder; without one, joined by spaces."""
        tokens = [t for t in map(self.spelling.get, ids) if t is not None]
        return " ".join(tokens) if self.library.decoder is None else self.library.decoder.decode(tokens)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= TEXT_AT_ONCE:
            yield group
            group, held = [], 0
    if group:
        yield group


def _lists(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def _spelled(tool: Codec, ids: pa.Array) -> Iterator[str]:
    """The texts of a column of id lists, a list at a time; null counts as empty."""
    ends, values = ids.offsets.to_pylist(), ids.values
    for a, b, held in zip(ends, ends[1:], ids.is_valid().to_pylist()):
        listed = values.slice(a, b - a if held else 0)
        yield tool.decode(np.asarray(listed).tolist() if not listed.null_count else listed.to_pylist())


def _mapped(df: DataFrame, source, keep: list[str], new: list[tuple], work) -> DataFrame:
    """Columns `keep` and the new ones (name, Spark type); `work`: Arrow column -> lists of Arrow columns, in groups of rows."""
    kept = df.select(*quoted(keep)).schema.fields
    names = [f.name for f in kept] + [n for n, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for made in work(batch.column(0)):
                n = len(made[0])
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in batch.columns[1:]), *made], names=names)
                at += n

    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in new)])
    return df.select(source.alias(fresh(df, "coded")), *quoted(keep)).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", out: str = "ids") -> DataFrame:
    """The columns `keep` and `out`: the ids of the whole text, an array of integers. A clashing column gives way."""

    def work(column):
        for texts in _grouped(strings(column)):
            yield [_lists(codec(path).encode(texts))]

    keep = [c for c in keep if c.lower() != out.lower()]
    return _mapped(docs, F.col(f"`{text}`").cast("string"), keep, [(out, T.ArrayType(T.IntegerType()))], work)


def decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns `keep` and `out`: the text that `ids` (an array; null: none) spell. A clashing column gives way."""

    def work(column):
        for texts in _grouped(_spelled(codec(path), column)):
            yield [pa.array(texts, pa.string())]

    keep = [c for c in keep if c.lower() != out.lower()]
    return _mapped(encoded, F.col(f"`{ids}`").cast("array<int>"), keep, [(out, T.StringType())], work)


def encode_and_decode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, ids and decoded: `decode` of `encode` in one Python worker."""

    def work(column):
        tool = codec(path)
        for texts in _grouped(strings(column)):
            ids = _lists(tool.encode(texts))
            yield [ids, pa.array(_spelled(tool, ids), pa.string())]

    keep = [c for c in keep if c.lower() not in ("ids", "decoded")]
    new = [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]
    return _mapped(docs, F.col(f"`{text}`").cast("string"), keep, new, work)
