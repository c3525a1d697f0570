"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks by a hash of their id, queries into query blocks; every pair of blocks is one group of
one task. Inside a group each dimension is a list of the block's candidates sorted by that component. A query reads the
lists of its positive components from the top and those of its negative ones from the bottom, all to the same depth,
and never looks a candidate up in a list it has not come to. What has been read bounds every score: an unread component
is between the list's end and its frontier. Reading goes deeper, round by round, until the k-th best lower bound is
above what any candidate outside a short list can still reach; the short list's scores are then resolved. Bounds for
all queries of a group are two matrix products per round.

Scores are sums of integers and exact: in double precision while they stay below 2**53, in 64-bit integers below 2**63,
in unbounded integers beyond. A score among the best that does not fit a long is an error.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, as queries or
candidates; vectors of different length are compared only with their like; rows that share the query's id are not its
candidates, and a repeated id asks once, with its smallest vector; ties go to the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatecount.llm.common import written

BLOCK = 1024
QUERY_BLOCK = 4096
SCALE = 256.0
QUERIES_AT_ONCE = 512
#: Depths read, as shares of the lists.
DEPTHS = (0.05, 0.15, 0.3, 0.5, 0.75, 1.0)
#: Candidates of a query that may be left to resolve.
SHORT_LIST = 4


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def read_lists(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's components in list order, descending: sorted values, and the rank of each candidate in each list."""
    order = np.argsort(-block, axis=0, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(len(block))[:, None], axis=0)
    return np.take_along_axis(block, order, axis=0), ranks


def group_top(queries: np.ndarray, query_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of at least the k best of the block for each query, ties of the k-th included."""
    n = len(block)
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * block.shape[1]
    exact_float = big < 2**53
    slack = 0.0 if exact_float else big * 1e-12
    values, ranks = read_lists(block)
    out: list[tuple[int, int, int]] = []
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        some, some_ids = queries[at : at + QUERIES_AT_ONCE], query_ids[at : at + QUERIES_AT_ONCE]
        up, down = np.maximum(some, 0.0), np.minimum(some, 0.0)
        own = some_ids[:, None] == ids[None, :]
        waiting = np.arange(len(some))
        for share in DEPTHS if exact_float else (1.0,):
            depth = min(n, max(k + 1, int(np.ceil(share * n))))
            top, bottom = values[depth - 1], values[n - depth]
            from_top, from_bottom = ranks < depth, ranks >= n - depth
            # An unread component is at most the frontier and at least the list's last value, or the mirror of that.
            high = up[waiting] @ np.where(from_top, block, top).T + down[waiting] @ np.where(from_bottom, block, bottom).T
            low = up[waiting] @ np.where(from_top, block, values[-1]).T + down[waiting] @ np.where(from_bottom, block, values[0]).T
            high[own[waiting]] = -np.inf
            low[own[waiting]] = -np.inf
            kth = np.partition(low, n - k, axis=1)[:, n - k] if n >= k else np.full(len(waiting), -np.inf)
            left = (high >= kth[:, None] - slack) & ~own[waiting]
            done = (left.sum(axis=1) <= SHORT_LIST * k) | (depth == n)
            q, c = np.nonzero(left & done[:, None])
            if len(q):
                found = _scores(some[waiting[q]], block[c], big)
                out.extend(zip(some_ids[waiting[q]].tolist(), ids[c].tolist(), found.tolist()))
            waiting = waiting[~done]
            if not len(waiting):
                break
    return out


def _scores(a: np.ndarray, b: np.ndarray, big: float) -> np.ndarray:
    """Exact products of rows; `big` is above every score and partial sum."""
    if big < 2**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    if big < 2**62:
        return (a.astype(np.int64) * b.astype(np.int64)).sum(axis=1)
    found = [sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())]
    if any(not -(2**63) <= s < 2**63 for s in found):
        raise ValueError("a score does not fit a 64-bit integer")
    return np.array(found, np.int64)


def search(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` that `queries` selects, its k best other rows."""
    # Beyond 2**53 a double is whole as it is, and floor(), which gives a long, would saturate.
    whole = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    scaled = F.transform(F.col(f"`{vector}`"), lambda x: whole(x.cast("double") * SCALE))
    rows = written(
        vectors.where(usable(F.col(f"`{vector}`")) & F.col(f"`{id_col}`").isNotNull()).select(
            F.col(f"`{id_col}`").cast("long").alias("id"), scaled.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
        ),
        "vectors",
    )
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-rows.count() // BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    key = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "v", key("block", blocks).alias("b"), every(query_blocks).alias("q"))
    wanted = asked.select("id", "v", key("query", query_blocks).alias("q"), every(blocks).alias("b"))

    def run(asking: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        widths = block["v"].map(len) if len(block) else pd.Series([], dtype=int)
        for width, part in block.groupby(widths) if len(asking) else ():
            fit = asking[asking["v"].map(len) == width]
            if len(fit):
                found += group_top(
                    np.stack(fit["v"].to_list()), fit["id"].to_numpy(), np.stack(part["v"].to_list()), part["id"].to_numpy(), k
                )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    near = (
        wanted.groupBy("q", "b")
        .cogroup(candidates.groupBy("q", "b"))
        .applyInPandas(run, "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
