"""Searches of a stated query set against all vectors, in blocks.

Queries travel in blocks of bounded size; for each block every task searches its own tiles of
vectors and keeps the best few of each query, and a window merges them. Two searches run in a
tile: exact inner products by pivot elimination, and cosine by a random-projection forest.

Defined cases: vectors that are null or hold null or non-finite components (and zero vectors,
for cosine) take no part; a query meets vectors of its own length only; ties go to the smaller
id; equal vectors each count; rows that repeat an id count each, but a query never meets its own
id; no rows or no queries give no rows; other columns do not matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm import scratch

#: Vectors of a tile, and queries and their bytes of a block: what a task and a broadcast hold at once.
TILE = 1 << 13
BLOCK, BLOCK_BYTES = 1 << 14, 32 << 20

#: (ids of the queries, queries, ids of a tile, tile, least scores that still count) to (positions of queries, vec_ids, scores)
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, "np.ndarray | None"], tuple[np.ndarray, np.ndarray, np.ndarray]]


def valid(table: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    limit = F.lit(float("inf"))
    return table.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)))


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector."""
    sizes = column.value_lengths().to_numpy()
    flat, ends = column.flatten().to_numpy(), np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[(ends[rows] - d)[:, None] + np.arange(d)].astype(np.float64)


def _best(k: int, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best k, by falling score, then by vec_id."""
    order = np.lexsort((vec, -score, query)) if score.dtype.kind == "f" else np.lexsort((vec, ~score, query))  # ~ cannot overflow
    query, vec, score = query[order], vec[order], score[order]
    begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    return query[rank < k], vec[rank < k], score[rank < k]


def search_blocks(table: DataFrame, queries: DataFrame, search: Search, k: int, score: str, *, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's best k by falling score, ties to smaller vec_id.

    One pass over the table for each block of queries; a block is bounded in rows and bytes. A task
    holds one tile and the best k so far of each of the block's queries.
    """
    spark = table.sparkSession
    scratch.ship(spark)
    n, values = queries.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    n_blocks = max(1, -(-n // block), -(-8 * (values or 0) // block_bytes))
    dealt = queries.select("vec_id", "embedding").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))

    def work(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        ids, by_length = sent.value
        best: tuple[np.ndarray, ...] | None = None
        for batch in _tiles(batches, tile):
            for rows, x in _matrix(batch.column(1)):
                if x.shape[1] not in by_length:
                    continue
                own, q = by_length[x.shape[1]]
                floor = np.full(len(ids), -np.inf)
                if best is not None:  # the k-th best of earlier tiles
                    full = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) == k)
                    floor[full] = best[2][np.searchsorted(best[0], full, side="right") - 1]
                at, v, s = search(ids[own], q, batch.column(0).to_numpy()[rows], x, floor[own])
                found = own[at], v, s
                best = _best(k, *(found if best is None else map(np.concatenate, zip(best, found, strict=True))))
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", "query_id", "vec_id", "score"])

    out: DataFrame | None = None
    vec = table.select("vec_id", "embedding")
    for i in range(n_blocks):
        got = dealt.filter(F.col("block") == i).select("vec_id", "embedding").toArrow()
        if not got.num_rows:
            continue
        ids = got["vec_id"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, {x.shape[1]: (rows, x) for rows, x in _matrix(got["embedding"].combine_chunks())}))
        part = vec.mapInArrow(lambda batches, sent=sent: work(batches, sent), f"query long, query_id long, vec_id long, score {score}")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        part = scratch.stash(part.select("query_id", "rank", "vec_id", "score"), "best")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score}") if out is None else out


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, tile):
            piece = batch.slice(lo, tile)
            held.append(piece)
            n += piece.num_rows
            if n >= tile:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _kept(found: list[tuple[np.ndarray, np.ndarray]], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(v) for v, _ in found], np.int64)
    join = lambda k, t: np.concatenate([f[k] for f in found] or [np.zeros(0, t)]).astype(t)
    return np.repeat(np.arange(len(found)), n), join(0, np.int64), join(1, kind)


# -- exact search by pivots -----------------------------------------------------------------


def _distances(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot, summed from differences, so that the error is relative to the distance."""
    return np.stack([np.sqrt(np.square(x - p).sum(axis=1)) for p in base], axis=1)


def pivot_search(k: int, scale: int = 1, pivots: int = 48, seed: int = 11) -> Search:
    """Largest inner products of floor(scale * x), exactly.

    With distances to many pivots, |d(q, p) - d(x, p)| bounds the distance of q and x from below
    for every p; the largest of them bounds the inner product (|q|^2 + |x|^2 - d^2) / 2 from
    above. Candidates are evaluated in the order of that bound, until it falls below the k-th
    best score found. A tile's pivot table is computed once for a block of queries. Bounds hold
    in spite of rounding: a distance is taken a share ``err`` smaller or larger than computed,
    whichever loosens the bound, so pivots of any norm are safe; what overflows bounds nothing.
    """

    def search(query_ids, q, ids, x, floor=None):
        order = np.argsort(ids, kind="stable")
        ids, x, q = ids[order], _whole(x[order], scale), _whole(q, scale)
        rng = np.random.default_rng(seed)
        base = x[rng.choice(len(x), min(pivots, len(x)), replace=False)]
        err = (x.shape[1] + 8) * 2.0**-51
        found = []
        with np.errstate(over="ignore", invalid="ignore"):
            square = np.square(x).sum(axis=1)
            table, own = _distances(x, base), _distances(q, base)
            less, more = np.ascontiguousarray((table * (1 - err)).T), np.ascontiguousarray((table * (1 + err)).T)
            for i in range(len(q)):
                low = np.zeros(len(x))
                for p in range(len(base)):
                    np.fmax(low, less[p] - own[i, p] * (1 + err), out=low)  # fmax passes over what is not a number
                    np.fmax(low, own[i, p] * (1 - err) - more[p], out=low)
                qq = float(np.square(q[i]).sum())
                bound = (qq + square - low * low * (1 - err)) / 2 + err * (qq + square) + 1
                bound[np.isnan(bound)] = np.inf
                bound = np.maximum(bound, -(2.0**63))
                may = ids != query_ids[i] if floor is None else (ids != query_ids[i]) & (bound >= floor[i])
                found.append(_in_order(bound, may, k, ids, x, q[i]))
        return _kept(found, np.int64)

    return search


def _in_order(bound: np.ndarray, may: np.ndarray, k: int, ids: np.ndarray, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vec_ids, scores) of the best k, evaluated in the order of their bounds until none left can be among them."""
    best_s, best_v, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 8 * k
    rest, pending = np.flatnonzero(may), np.zeros(0, np.int64)
    while len(rest) or len(pending):
        if not len(pending):  # the next best leave rest, so equal bounds are neither met twice nor passed over
            o = np.argpartition(-bound[rest], 4 * step) if 4 * step < len(rest) else np.arange(len(rest))
            pending, rest = rest[o[: 4 * step]], rest[o[4 * step :]]
            pending = pending[np.argsort(-bound[pending], kind="stable")]
        take, pending = pending[:step], pending[step:]
        if len(best_s) == k and bound[take[0]] < best_s[-1]:
            break
        s, v = np.concatenate((best_s, exact(x[take], q))), np.concatenate((best_v, ids[take]))
        o = np.lexsort((v, ~s))[:k]
        best_s, best_v = s[o], v[o]
        step = 2 * step
    return best_v, best_s


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in doubles; what overflows is the largest double."""
    return np.clip(np.floor(x * scale), -np.finfo(float).max, np.finfo(float).max)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued doubles; whole numbers of any size, held to 64 bits."""
    with np.errstate(over="ignore"):
        small = np.abs(x).max(axis=1, initial=0.0) * (float(np.abs(q).max(initial=0.0)) * max(1, len(q))) < 2.0**53
    if small.all():
        return (x @ q).astype(np.int64)
    out = np.empty(len(x), np.int64)
    out[small] = (x[small] @ q).astype(np.int64)
    own = [int(b) for b in q]
    for i in np.flatnonzero(~small).tolist():
        out[i] = max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(x[i].tolist(), own, strict=True))))
    return out


def top_products(table: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Exact largest inner products of floor(scale * x); queries are the rows whose vec_id every divides."""
    rows = valid(table, "embedding").filter("vec_id is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return search_blocks(rows, rows.filter(F.col("vec_id") % every == 0), pivot_search(k, scale), k, "long", block=block, tile=tile)


# -- approximate search by a forest ---------------------------------------------------------


class Tree:
    """Random-projection splits of a tile, at the median of each node's projections."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normal, self.cut, self.below, self.rows = [], [], [], []
        self._grow(x, np.arange(len(x)), leaf, rng)

    def _grow(self, x, rows, leaf, rng) -> int:
        me = len(self.normal)
        self.normal.append(None)
        self.cut.append(0.0)
        self.below.append((-1, -1))
        self.rows.append(rows)
        if len(rows) > leaf:
            i, j = rng.choice(len(rows), 2, replace=False)
            way = x[rows[i]] - x[rows[j]]
            size = np.linalg.norm(way)
            way = way / size if size > 0 else rng.standard_normal(x.shape[1])
            at = x[rows] @ way
            cut = float(np.median(at))
            left = at < cut
            if left.any() and not left.all():
                self.normal[me], self.cut[me], self.rows[me] = way, cut, None
                self.below[me] = (self._grow(x, rows[left], leaf, rng), self._grow(x, rows[~left], leaf, rng))
        return me


def forest_search(k: int, trees: int = 12, leaf: int = 48, reach: float = 0.07, together: int = 256, seed: int = 5, scored: list[float] | None = None) -> Search:
    """Largest cosines among the leaves that a shared priority queue reaches first.

    All trees' open branches wait in one queue by their margin, the distance of the query from the
    plane that parts it from the branch. What lies behind a plane is at least its margin away, so a
    margin of the k-th nearest distance found would end the search without loss; it ends at
    ``reach`` times that distance, which near neighbours on the far side seldom need. Rows of leaves
    are scored as they come, ``together`` at once, and the best are ranked by exact cosines. So tight
    groups end the search early, and where all is equally far most leaves are met. Equal vectors are
    one point of the forest, so copies neither fill leaves nor hide others. scored: takes each
    query's share of the points that were scored.
    """

    def search(query_ids, q, ids, x, floor=None):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        points, of = np.unique(x, axis=0, return_inverse=True)
        of = of.ravel()
        members = np.argsort(of, kind="stable")  # by point, then by id
        begin = np.searchsorted(of[members], np.arange(len(points) + 1))
        unit = _unit(points)
        rng = np.random.default_rng(seed)
        grown = [Tree(unit, leaf, rng) for _ in range(trees)]
        found = []
        for i in range(len(q)):
            near, s = _reached(grown, unit, _unit(q[i : i + 1])[0], k, reach, together, -1.0 if floor is None else max(-1.0, floor[i]))
            if scored is not None:
                scored.append(len(near) / len(points))
            top = near if len(near) <= k + 1 else near[s >= np.partition(s, -(k + 1))[-(k + 1)] - 1e-9]
            v = np.concatenate([ids[members[begin[p] : min(begin[p + 1], begin[p] + k + 1)]] for p in top])
            s = np.repeat(cosine(points[top], q[i]), np.minimum(begin[top + 1] - begin[top], k + 1))
            keep = v != query_ids[i]
            v, s = v[keep], s[keep]
            o = np.lexsort((v, -s))[:k]
            found.append((v[o], s[o]))
        return _kept(found, np.float64)

    return search


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _reached(grown: list[Tree], unit: np.ndarray, u: np.ndarray, k: int, reach: float, together: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(points of the leaves that the queue reaches, their cosines). floor: a k-th best cosine that is known."""
    seen = np.zeros(len(unit), bool)
    queue = [(0.0, t, 0) for t in range(len(grown))]
    far = math.sqrt(max(0.0, 2 - 2 * floor))
    best = np.zeros(0)
    fresh, near, scores = [], [], []
    n = 0
    while queue or fresh:
        if queue and queue[0][0] <= reach * far and n < together:
            margin, t, node = heapq.heappop(queue)
            tree = grown[t]
            while tree.normal[node] is not None:
                gap = float(u @ tree.normal[node]) - tree.cut[node]
                here, there = tree.below[node] if gap < 0 else tree.below[node][::-1]
                heapq.heappush(queue, (max(margin, abs(gap)), t, there))
                node = here
            rows = tree.rows[node]
            rows = rows[~seen[rows]]
            if len(rows):
                seen[rows] = True
                fresh.append(rows)
                n += len(rows)
            continue
        if not fresh:
            break
        rows = np.concatenate(fresh)
        s = unit[rows] @ u
        near.append(rows)
        scores.append(s)
        fresh, n = [], 0
        best = np.concatenate((best, s))
        if len(best) > k:  # one more than k, as the query's own point may be among them
            best = np.partition(best, len(best) - k - 1)[len(best) - k - 1 :]
            far = min(far, math.sqrt(max(0.0, 2 - 2 * float(best[0]))))
    return np.concatenate(near), np.concatenate(scores)


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision; each row is summed by itself, so a value never depends on its neighbours."""
    big, own = np.abs(x).max(axis=1), np.abs(q).max()
    x, q = x / big[:, None] if (big > 1e150).any() or (big < 1e-150).any() else x, q / own if own > 1e150 or own < 1e-150 else q
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def nearest(table: DataFrame, *, k: int = 5, every: int = 50, block: int = BLOCK, tile: int = TILE, trees: int = 12, reach: float = 0.07) -> DataFrame:
    """Approximate largest cosines; queries are the rows whose vec_id every divides."""
    rows = valid(table, "embedding").filter("vec_id is not null").filter(F.exists("embedding", lambda x: x != 0)).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return search_blocks(rows, rows.filter(F.col("vec_id") % every == 0), forest_search(k, trees, reach=reach), k, "double", block=block, tile=tile)
