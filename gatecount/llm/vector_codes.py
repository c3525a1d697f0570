"""Product codes for vectors: codebooks fitted by rounds of nearest-entry means, read off metric trees over the parts.

Vectors become integers (`floor(scale * x)`) and are cut into equal consecutive parts; each part position has its own
codebook. Every task turns its rows into blocks of at most BLOCK and grows one metric tree per block and part position
by the anchors hierarchy: about sqrt(n) anchors, each the point farthest from its anchor so far, steal the points that
are nearer to them (the triangle inequality spares most comparisons); the anchors' balls are joined middle-out into one
root, the pair with the smallest common ball first; inside an anchor the same is done again down to LEAF points. A ball
keeps centre, radius, the exact sum and the number of its points. The trees are written once to the shared folder.

A round passes the codebooks (a few kilobytes) to the trees. A ball inherits its parent's candidate entries and drops
each that is farther than the nearest one for every point the ball can hold; once a single entry is left the ball is
wholly owned and its cached sum and number are added, else its children go on with the shorter list. Leaves compare
points with the candidates in integers. Only sums and numbers per part position and entry leave a task, so that the
shuffle does not grow with the rows, and the driver holds the codebooks alone.

Bounds are floating point with slack, and what they cannot tell apart goes on to integers: results are exact.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are dropped; fewer rows than
entries give shorter codebooks; equal entries and ties go to the lower index; each row of a repeated id counts, and
among the first ids equal ones go by their vectors; null ids come last; null labels are one label; an empty table gives
an empty result. Vectors of different lengths, a length that the number of parts does not divide, and components beyond
2^26 after scaling (whose sums of squares might not fit a long) are errors.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecount.llm.common import fresh, quoted, written

BLOCK = 4096
LEAF = 64
LARGEST = 2**26
#: A label with more than this share of the rows is joined apart; there are at most as many as its inverse.
HOT_SHARE = 1 / 64

# ---------------------------------------------------------------- metric trees


class Tree:
    """Balls over points (integers, one row each). Node 0 is the root; a ball's points are rows low to high - 1."""

    FIELDS = ("points", "order", "low", "high", "left", "right", "center", "radius", "total")

    def __init__(self, *arrays: np.ndarray):
        for name, array in zip(self.FIELDS, arrays):
            setattr(self, name, array)

    def dump(self) -> bytes:
        buffer = io.BytesIO()
        for name in self.FIELDS:
            np.save(buffer, getattr(self, name), allow_pickle=False)
        return buffer.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        buffer = io.BytesIO(data)
        return cls(*(np.load(buffer, allow_pickle=False) for _ in cls.FIELDS))


def distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.sqrt(np.einsum("...i,...i->...", gap, gap))


def anchored(points: np.ndarray, wanted: int) -> np.ndarray:
    """The anchor of each point. Fewer than `wanted` where points are equal."""
    owner = np.zeros(len(points), np.int64)
    away = distances(points, points[0])
    pivots = [0]
    for anchor in range(1, wanted):
        pivot = int(away.argmax())
        if away[pivot] == 0:
            break
        between = distances(points[pivots], points[pivot])
        # A point nearer to its anchor than half way to the new one cannot be nearer to the new one.
        maybe = np.flatnonzero(2 * away > between[owner])
        new = distances(points[maybe], points[pivot])
        won = new < away[maybe]
        owner[maybe[won]], away[maybe[won]] = anchor, new[won]
        pivots.append(pivot)
    return owner


class Grower:
    def __init__(self, points: np.ndarray):
        self.exact, self.points = points, points.astype(np.float64)
        self.members, self.children, self.center, self.radius = [], [], [], []
        root = self.grow(np.arange(len(points)))
        # From the root down, so that a ball's points lie side by side.
        number, order, low, high = {}, [], [], []
        stack = [(root, False)]
        while stack:
            node, done = stack.pop()
            if done:
                high[number[node]] = len(order)
                continue
            number[node] = len(number)
            low.append(len(order))
            high.append(0)
            stack.append((node, True))
            if self.children[node]:
                stack += [(c, False) for c in reversed(self.children[node])]
            else:
                order.extend(self.members[node].tolist())
        listed = [*number]
        child = lambda side: np.array([number[self.children[v][side]] if self.children[v] else -1 for v in listed], np.int32)
        order, low, high = (np.array(x, np.int32) for x in (order, low, high))
        points = points[order]
        running = np.concatenate((np.zeros((1, points.shape[1]), np.int64), points.cumsum(0)))
        center, radius = np.array([self.center[v] for v in listed]), np.array([self.radius[v] for v in listed])
        self.tree = Tree(points.astype(np.int32), order, low, high, child(0), child(1), center, radius, running[high] - running[low])

    def ball(self, members: np.ndarray, children: tuple = ()) -> int:
        held = self.points[members]
        center = held.mean(0)
        self.members.append(members)
        self.children.append(children)
        self.center.append(center)
        self.radius.append(float(distances(held, center).max()))
        return len(self.members) - 1

    def grow(self, members: np.ndarray) -> int:
        if len(members) <= LEAF:
            return self.ball(members)
        owner = anchored(self.points[members], int(np.ceil(np.sqrt(len(members)))))
        if not owner.any():
            return self.ball(members)
        order = np.argsort(owner, kind="stable")
        groups = np.split(members[order], np.flatnonzero(np.diff(owner[order])) + 1)
        return self.joined([self.grow(g) for g in groups])

    def joined(self, balls: list[int]) -> int:
        """Middle-out: the two balls with the smallest ball around both become one, until one is left."""
        n = len(balls)
        center, radius = np.array([self.center[b] for b in balls]), np.array([self.radius[b] for b in balls])
        around = np.array([self.around(center, radius, i) for i in range(n)])
        np.fill_diagonal(around, np.inf)
        for _ in range(n - 1):
            i, j = divmod(int(around.argmin()), n)
            a, b = balls[i], balls[j]
            balls[i] = self.ball(np.concatenate((self.members[a], self.members[b])), (a, b))
            self.members[a] = self.members[a] if not self.children[a] else None
            self.members[b] = self.members[b] if not self.children[b] else None
            center[i], radius[i] = self.center[balls[i]], self.radius[balls[i]]
            gone = np.isinf(around[i])
            gone[j] = True
            around[i] = around[:, i] = np.where(gone, np.inf, self.around(center, radius, i))
            around[j] = around[:, j] = np.inf
        return balls[i] if n > 1 else balls[0]

    @staticmethod
    def around(center: np.ndarray, radius: np.ndarray, i: int) -> np.ndarray:
        return np.maximum(np.maximum(radius, radius[i]), (distances(center, center[i]) + radius + radius[i]) / 2)


def grown(points: np.ndarray) -> Tree:
    return Grower(points).tree


def owned(tree: Tree, book: np.ndarray) -> Iterator[tuple]:
    """Who owns what: ("balls", nodes, entries) of wholly owned balls and ("points", rows, entries) of leaves."""
    nodes, candidate = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    entries = book.astype(np.float64)
    while len(nodes):
        away = np.where(candidate, distances(entries[None], tree.center[nodes][:, None]), np.inf)
        radius = tree.radius[nodes][:, None]
        nearest = away.min(1, keepdims=True)
        slack = 1e-9 * (nearest + radius) + 1e-6
        candidate &= away <= nearest + 2 * radius + slack
        sure = candidate.sum(1) == 1
        if sure.any():
            yield "balls", nodes[sure], candidate[sure].argmax(1)
        leaf = ~sure & (tree.left[nodes] < 0)
        if leaf.any():
            low, size = tree.low[nodes[leaf]], (tree.high - tree.low)[nodes[leaf]]
            rows = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            gap = tree.points[rows].astype(np.int64)[:, None] - book[None]
            squares = np.where(np.repeat(candidate[leaf], size, 0), (gap * gap).sum(2), np.iinfo(np.int64).max)
            yield "points", rows, squares.argmin(1)
        inner = ~sure & ~leaf
        candidate = np.repeat(candidate[inner], 2, 0)
        nodes = np.column_stack((tree.left[nodes[inner]], tree.right[nodes[inner]])).ravel().astype(np.int64)


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the points of each entry."""
    sums, numbers = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    for kind, what, entries in owned(tree, book):
        if kind == "balls":
            np.add.at(sums, entries, tree.total[what])
            np.add.at(numbers, entries, (tree.high - tree.low)[what])
        else:
            np.add.at(sums, entries, tree.points[what].astype(np.int64))
            np.add.at(numbers, entries, 1)
    return sums, numbers


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each point, in the order in which the points came."""
    entry = np.zeros(len(tree.points), np.int64)
    for kind, what, entries in owned(tree, book):
        if kind == "balls":
            for node, e in zip(what.tolist(), entries.tolist()):
                entry[tree.low[node] : tree.high[node]] = e
        else:
            entry[what] = entries
    gap = tree.points.astype(np.int64) - book[entry]
    back = np.empty_like(entry)
    back[tree.order] = np.arange(len(entry))
    return entry[back], (gap * gap).sum(1)[back]


# ---------------------------------------------------------------- Spark


def integers(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    ends = np.asarray(vectors.offsets)
    if (np.diff(ends) != length).any():
        raise ValueError("vectors have different lengths")
    scaled = np.floor(scale * np.asarray(vectors.flatten(), np.float64))
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return scaled.astype(np.int64).reshape(-1, length)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    whole = F.col(f"`{vector}`")
    odd = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(whole.isNotNull() & (F.size(whole) > 0) & ~odd)


def planted(rows: DataFrame, keep: list[str], own: str, length: int, parts: int, scale: int) -> DataFrame:
    """A row per block: `rows` (the kept columns of its vectors) and `trees` (one per part position)."""
    kept = rows.select(*quoted(keep)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                trees = [grown(p).dump() for p in np.split(integers(block.column(0), length, scale), parts, 1)]
                held = pa.StructArray.from_arrays(block.columns[1:], names=[f"c{i}" for i in range(len(keep))])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.array([trees], pa.list_(pa.binary()))],
                    names=["rows", "trees"],
                )

    held = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept.fields)])
    schema = T.StructType([T.StructField("rows", T.ArrayType(held)), T.StructField("trees", T.ArrayType(T.BinaryType()))])
    return rows.select(F.col(own), *quoted(keep)).mapInArrow(run, schema)


def trees_of(column: pa.Array) -> Iterator[list[Tree]]:
    for row in column:
        yield [Tree.load(t.as_buffer()) for t in row.values]


def entry_totals(forest: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part position, entry) -> number of parts and sum, of the entries that are used."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, numbers = np.zeros((len(books), *books[0].shape), np.int64), np.zeros((len(books), len(books[0])), np.int64)
        for batch in batches:
            for trees in trees_of(batch.column(0)):
                for p, (tree, book) in enumerate(zip(trees, books)):
                    more, count = totals(tree, book)
                    sums[p] += more
                    numbers[p] += count
        part, entry = np.nonzero(numbers)
        found = [part, entry, numbers[part, entry], *(sums[part, entry, i] for i in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)

    names = ["part", "entry", "number", *(f"s{i}" for i in range(width))]
    partial = forest.select("trees").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    whole = partial.groupBy("part", "entry").agg(*[F.sum(n).alias(n) for n in names[2:]])
    return {(r["part"], r["entry"]): (r["number"], [r[n] for n in names[3:]]) for r in whole.collect()}


def fit(forest: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    for _ in range(rounds):
        found = entry_totals(forest, books)
        books = [b.copy() for b in books]
        for (part, entry), (number, sums) in found.items():
            books[part][entry] = [s // number for s in sums]
    return books


def coded(forest: DataFrame, books: list[np.ndarray], names: list[str]) -> DataFrame:
    """The kept columns, code and error of every vector."""
    held = forest.schema["rows"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in enumerate(trees_of(batch.column(1))):
                found = [assigned(tree, book) for tree, book in zip(trees, books)]
                codes = np.column_stack([e for e, _ in found]).astype(np.uint8)
                text = codes.tobytes().hex()
                step = 2 * len(books)
                listed = [text[a : a + step] for a in range(0, len(text), step)]
                error = sum(d for _, d in found)
                columns = batch.column(0)[i].values.flatten()
                yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, pa.string()), pa.array(error, pa.int64())], names=[*names, "code", "error"])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, held.fields)]
    return forest.mapInArrow(run, T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def spelled(books: list[np.ndarray]) -> str:
    """All entries' components by part position, entry and place."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def compressed(
    vectors: DataFrame, keep: list[str], id_column: str = "vec_id", vector: str = "embedding",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> tuple[DataFrame, list[np.ndarray]]:
    """The columns `keep`, code (two hex digits per part) and error (squared distance) of every usable vector, as a
    written table; and the codebooks. Columns of `keep` that clash with the new ones give way to them."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    keep = [c for c in keep if c.lower() not in ("code", "error")]
    own = fresh(vectors, "components")
    rows = usable(vectors, vector).withColumn(own, F.col(f"`{vector}`").cast("array<double>"))
    identity = F.col(f"`{id_column}`")
    first = [r[0] for r in rows.orderBy(identity.asc_nulls_last(), own).select(own).limit(entries).collect()]
    if not first:
        none = rows.select(*quoted(keep), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.limit(0), []
    length = len(first[0])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    seeds = integers(pa.array(first, pa.list_(pa.float64())), length, scale)
    books = [np.ascontiguousarray(b) for b in np.split(seeds, parts, 1)]
    forest = written(planted(rows, keep, own, length, parts, scale), "trees")
    books = fit(forest, books, rounds)
    return written(coded(forest, books, keep), "codes"), books


def with_sums(rows: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """`out`: `value` summed over the rows of equal label, nulls together. Labels are summed before they are joined back;
    the few that hold a large share of the rows are joined apart, so that none of them is one task's."""
    key, amount = F.col(f"`{label}`"), F.col(f"`{value}`")
    of, whole, n = (fresh(rows, name) for name in ("label_of", "label_sum", "label_rows"))
    sums = rows.groupBy(key.alias(of)).agg(F.sum(amount).alias(whole), F.count(F.lit(1)).alias(n))
    bar = rows.count() * HOT_SHARE
    same = key.eqNullSafe(F.col(of))
    hot, cold = sums.where(F.col(n) > bar), sums.where(F.col(n) <= bar)
    # At most 1 / HOT_SHARE rows.
    marked = rows.join(F.broadcast(hot), same, "left")
    columns = [*quoted(rows.columns), F.col(whole).alias(out)]
    small = marked.where(F.col(n).isNull()).select(*quoted(rows.columns)).join(cold, same)
    return marked.where(F.col(n).isNotNull()).select(*columns).unionByName(small.select(*columns))


def digest(books: Iterable[np.ndarray]) -> str:
    return hashlib.sha256(spelled([*books]).encode()).hexdigest()
