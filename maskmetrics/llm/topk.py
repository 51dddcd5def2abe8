"""Exact top-k by inner product, by no-random-access aggregation of sorted lists.

A vector's components are integers, floor(scale * x). A block of candidates has, for each dimension, its entries in the
order of their component. A query reads every dimension's list from the end where its products are largest, to one depth
after another, all lists alike and many queries at once. What has been read of a candidate, with the least that each list
holds, bounds its score from below; with the entry read last, from above. A query stops reading when at most `enough`
candidates have an upper bound that reaches its k-th best lower bound: no outsider, read or unread, can qualify then. Those
candidates are resolved to their final scores. All bounds are sums of integers and exact: doubles while they stay below 2^53,
Python's integers beyond, so no candidate is lost to rounding, and ties at the k-th place are all resolved.

Scale: every query meets every candidate by the task's terms; they meet in blocks, so the work grows with queries times rows.
Candidates are dealt into blocks of LEAST_BLOCK to `block` rows, queries into chunks of about `chunk`; each (chunk, block)
is a task of bounded memory, which gives k rows a query, and those are ranked in a second step. Nothing is broadcast or
collected but the row counts.

Cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without an id. Rows of
one id are one vector, the least of them; ids are bigints, or text that holds one. Vectors of different lengths meet in their
common dimensions. Ties go to the smaller id. With fewer than k candidates all are given; with none the query has no row.
Scores beyond a bigint are ranked by their true value within a block and given as the nearest bigint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

SCALE = 256
BLOCK = 32_768
LEAST_BLOCK = 4096
CHUNK = 16_384
K = 5
#: How far the lists are read before the bounds are looked at: shares of their length.
DEPTHS = (1 / 32, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)
_TILE = 1 << 20
_EXACT = float(1 << 53)
_MOST = (1 << 63) - 1


def quantised(vectors: pa.ChunkedArray | pa.Array, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale * x), as doubles; shorter vectors are filled up with 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _integers(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers, which have no limit."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


class SortedLists:
    """The lists of one block: for each dimension its rows by falling component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # rows by id: ties go to the smaller id
        self.ids, self.x = ids[order], x[order]
        n, d = x.shape
        falling = np.argsort(-self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, falling, 0)
        self.place = np.empty((n, d), np.int64)  # of each row in each list
        np.put_along_axis(self.place, falling, np.broadcast_to(np.arange(n)[:, None], (n, d)), 0)

    def _read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows for the lower bound, what all have, rows for the upper bound, what all have) with the lists read that far from both ends.

        The first half of each is for positive components of a query, which read from the top; the other half for negative ones.
        """
        n = len(self.x)
        from_top, from_bottom = self.place < depth, self.place >= n - depth
        top, bottom = self.sorted[0], self.sorted[-1]
        ends = np.concatenate((bottom, top)), np.concatenate((self.sorted[depth - 1], self.sorted[n - depth]))
        zero = self.x.dtype.type(0) if self.x.dtype != object else 0
        rows = [np.concatenate((np.where(from_top, self.x - e[: len(top)], zero), np.where(from_bottom, self.x - e[len(top) :], zero)), 1) for e in ends]
        return rows[0], ends[0], rows[1], ends[1]

    def top(self, own: np.ndarray, q: np.ndarray, k: int, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): for each query, by its place in q, the k best rows but those of its own id."""
        n, d = self.x.shape
        q = q[:, :d] if q.shape[1] >= d else np.concatenate((q, np.zeros((len(q), d - q.shape[1]))), 1)
        if n and len(q) and d and 8 * d * np.abs(self.x).max() * np.abs(q).max() >= _EXACT:
            if self.x.dtype != object:
                self.x, self.sorted = _integers(self.x), _integers(self.sorted)
            q = _integers(q)
        both = np.concatenate((np.maximum(q, 0), np.minimum(q, 0)), 1).T
        mine = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        out = [], [], []
        k = min(k, n)
        left = np.arange(len(q))
        tile = max(1, _TILE // max(n, 1))
        for depth in sorted({max(1, int(np.ceil(n * share))) for share in DEPTHS}) if n else ():
            if not len(left):
                break
            low, all_low, high, all_high = self._read(depth)
            waiting = []
            for a in range(0, len(left), tile):
                some = left[a : a + tile]
                lower, upper = (rows @ both[:, some] + same @ both[:, some] for rows, same in ((low, all_low), (high, all_high)))
                open_rows = np.ones(lower.shape, bool)
                for i, s in enumerate(some):
                    open_rows[mine[0][s] : mine[1][s], i] = False
                lower = np.where(open_rows, lower, -np.inf)
                kth = np.sort(lower, 0)[n - k] if lower.dtype == object else np.partition(lower, n - k, 0)[n - k]
                chosen = open_rows & (upper >= kth).astype(bool)
                done = (chosen.sum(0) <= enough) | (depth == n)
                for i in np.flatnonzero(done):
                    rows = np.flatnonzero(chosen[:, i])
                    scores = self.x[rows] @ q[some[i]]
                    best = np.argsort(-scores, kind="stable")[:k]
                    out[0].append(np.full(len(best), some[i]))
                    out[1].append(self.ids[rows[best]])
                    out[2].append(np.array([max(-_MOST - 1, min(_MOST, int(s))) for s in scores[best]], np.int64))
                waiting.append(some[~done])
            left = np.concatenate(waiting)
        return tuple(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)


def usable(vector: str, scale: int = SCALE) -> Column:
    x = F.col(vector)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * F.lit(float(scale))) < F.lit(float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK, least_block: int = LEAST_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best vectors of other ids."""

    def one_each(df: DataFrame) -> DataFrame:
        return df.where(usable(vector, scale) & F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).cast("bigint").alias("id")).agg(F.min(vector).alias("v"))

    n = vectors.where(F.col(vec_id).isNotNull()).select(vec_id).count()
    n_queries = queries.where(F.col(vec_id).isNotNull()).select(vec_id).count()
    blocks = max(1, -(-n // block), min(-(-n // least_block), 2 * partitions(vectors.sparkSession)))
    chunks = max(1, -(-n_queries // chunk))
    own = lambda name, count: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = one_each(vectors).withColumn("block", own("block", blocks)).withColumn("chunk", every(chunks))
    right = one_each(queries).withColumn("chunk", own("chunk", chunks)).withColumn("block", every(blocks))

    def meet(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if candidates.num_rows and asked.num_rows:
            lists, ids = SortedLists(candidates["id"].to_numpy(), quantised(candidates["v"], scale)), asked["id"].to_numpy()
            at, *rest = lists.top(ids, quantised(asked["v"], scale), k, max(8 * k, candidates.num_rows // 32))
            found = [ids[at], *rest]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    met = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
