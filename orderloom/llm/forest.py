"""Nearest neighbours by one forest of random-projection trees that all rows are routed to once.

The forest is grown on the driver, on a sample of at most ``SAMPLED`` distinct vectors (and
``SAMPLE_VALUES`` numbers); every row of the table is then routed to its leaf in each tree, and the
leaves are written once to the shared folder. A query walks the forest with one priority queue for
all trees: open branches wait by their margin, the distance of the query from the plane that parts
it from the branch, and leaves are taken until the margin exceeds ``reach`` times the distance of
the k-th nearest vector of the sample, which bounds that of the table. Queries go to the leaves
they chose, where rows are scored by exact cosines; those that reach the k-th score of the sample
go on (and the best k of a query's first leaf), and a window merges them.

Work follows the leaves that queries choose: where vectors lie in groups few of them, where all is
equally far most. Leaves grow with the table, as the sample does not: rows of a leaf are dealt to
parts of ``PART_ROWS``, its queries to parts of ``PART_QUERIES``, and each pair of parts is a task's
group, so neither a hot leaf nor a hot group of equal vectors meets in one task. What reaches the
driver is the sample and the numbers of rows and queries of each leaf.

Defined cases: as in ``vectors``: vectors that are null, zero or hold null or non-finite components
take no part; a query meets vectors of its own length only; ties go to the smaller id; equal
vectors each count; rows that repeat an id count each, but a query never meets its own id; no rows
or no queries give no rows; other columns do not matter. A length that the sample does not hold is
one leaf.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm import scratch, vectors

SAMPLED, SAMPLE_VALUES = 20_000, 1 << 22
PART_ROWS, PART_QUERIES = 1 << 13, 1 << 12
#: Up to so many rows of a leaf all their cosines are taken at once, so many products at a time.
FEW, AT_ONCE = 1 << 9, 1 << 21
_TREE = 1 << 24  # codes of leaves: tree * _TREE + node


class Forest:
    """Trees over unit vectors of one length. The sample's own rows and their ids stay for the first bound of a query's k-th score."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, trees: int, leaf: int, seed: int):
        self.sample, first = np.unique(sample, axis=0, return_index=True)
        self.ids = ids[first]
        rng = np.random.default_rng(seed)
        self.trees = [vectors.Tree(self.sample, leaf, rng) for _ in range(trees)]
        for t in self.trees:
            t.rows = []

    def route(self, unit: np.ndarray) -> np.ndarray:
        """(rows, trees): the code of each row's leaf."""
        out = np.empty((len(unit), len(self.trees)), np.int64)
        for k, t in enumerate(self.trees):
            waiting = [(0, np.arange(len(unit)))]
            while waiting:
                node, rows = waiting.pop()
                if t.normal[node] is None:
                    out[rows, k] = k * _TREE + node
                elif len(rows):
                    left = unit[rows] @ t.normal[node] < t.cut[node]
                    waiting += [(t.below[node][0], rows[left]), (t.below[node][1], rows[~left])]
        return out

    def chosen(self, u: np.ndarray, own: int, k: int, reach: float) -> tuple[list[int], float]:
        """(codes of the leaves that a query is sent to, nearest first; a score that its k-th best reaches)."""
        s = (self.sample @ u)[self.ids != own]
        kth = float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else -1.0
        limit = reach * math.sqrt(max(0.0, 2 - 2 * kth))
        queue, out = [(0.0, t, 0) for t in range(len(self.trees))], []
        while queue and (queue[0][0] <= limit or not queue[0][0]):
            margin, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            while tree.normal[node] is not None:
                gap = float(u @ tree.normal[node]) - tree.cut[node]
                here, there = tree.below[node] if gap < 0 else tree.below[node][::-1]
                heapq.heappush(queue, (max(margin, abs(gap)), t, there))
                node = here
            out.append(t * _TREE + node)
        return out, kth - 1e-9


def grow(rows: DataFrame, trees: int, leaf: int, seed: int) -> dict[int, Forest]:
    """A forest for each length of vector in the sample, which is drawn by a hash of the vectors."""
    n, values = rows.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    if not n:
        return {}
    most = max(1, min(SAMPLED, SAMPLE_VALUES * n // values))
    draw = F.pmod(F.xxhash64("embedding"), F.lit(1 << 31))
    some = rows.select("vec_id", "embedding", draw.alias("draw")).filter(F.col("draw") < int(min(1.0, 2.0 * most / n) * (1 << 31)))
    got = some.groupBy("embedding", "draw").agg(F.min("vec_id").alias("vec_id")).orderBy("draw").limit(most).select("vec_id", "embedding").toArrow()
    if not got.num_rows:  # few distinct vectors, none of which was drawn
        got = rows.select("vec_id", "embedding").limit(1).toArrow()
    ids = got["vec_id"].to_numpy()
    return {x.shape[1]: Forest(vectors._unit(x), ids[at], trees, leaf, seed) for at, x in vectors._matrix(got["embedding"].combine_chunks())}


def _coded(rows: DataFrame, sent, codes, schema: str) -> DataFrame:
    """rows with ``codes``, leaves of each vector, and ``floor``. codes: (forest, unit vectors, ids) to a list of codes and a floor for each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found: list[tuple[list[int], float]] = [([0], -2.0)] * part.num_rows
                ids = part.column(1).to_numpy()
                for at, x in vectors._matrix(part.column(2)):
                    if x.shape[1] in forests:
                        for i, own in zip(at.tolist(), codes(forests[x.shape[1]], vectors._unit(x), ids[at]), strict=True):
                            found[i] = own
                own, floor = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.list_(pa.int64())), pa.array(floor, pa.float64())], [*part.schema.names, "codes", "floor"])

    return rows.mapInArrow(work, schema)


def _met(k: int):
    """Rows and queries of a pair of parts of a leaf to each query's best k of them."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, rid = left["vec_id"].to_numpy(), left["rid"].to_numpy()
            asked, qid, floor = right["vec_id"].to_numpy(), right["rid"].to_numpy(), right["floor"].to_numpy()
            order = np.lexsort((rid, ids))
            ids, rid = ids[order], rid[order]
            x = next(vectors._matrix(left["embedding"].combine_chunks()))[1][order]
            q = next(vectors._matrix(right["embedding"].combine_chunks()))[1]
            if len(x) <= FEW:
                return told(_few(k, ids, rid, x, asked, qid, q, floor))
            points, of = np.unique(x, axis=0, return_inverse=True)
            of = of.ravel()
            members = np.argsort(of, kind="stable")  # by point, then by id
            begin = np.searchsorted(of[members], np.arange(len(points) + 1))
            unit, uq = vectors._unit(points), vectors._unit(q)
            for lo in range(0, len(q), 256):
                near = uq[lo : lo + 256] @ unit.T
                for i, s in enumerate(near, lo):
                    top = np.arange(len(s)) if len(s) <= k + 1 else np.flatnonzero(s >= np.partition(s, -(k + 1))[-(k + 1)] - 1e-9)
                    most = k + int((asked[i] == ids).sum())  # rows of its own id may stand before others
                    at = np.concatenate([members[begin[p] : min(begin[p + 1], begin[p] + most)] for p in top])
                    score = np.repeat(vectors.cosine(points[top], q[i]), np.minimum(begin[top + 1] - begin[top], most))
                    other = (ids[at] != asked[i]) & (score >= floor[i])
                    at, score = at[other], score[other]
                    o = np.lexsort((rid[at], ids[at], -score))[:k]
                    out.append((np.full(len(o), qid[i]), np.full(len(o), asked[i]), rid[at[o]], ids[at[o]], score[o]))
        return told(out)

    def told(out: list[tuple]) -> pa.Table:
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64)
        cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in enumerate(kinds)]
        return pa.table(dict(zip(("qid", "query_id", "rid", "vec_id", "score"), cols, strict=True)))

    return work


def _few(k: int, ids: np.ndarray, rid: np.ndarray, x: np.ndarray, asked: np.ndarray, qid: np.ndarray, q: np.ndarray, floor: np.ndarray) -> list[tuple]:
    """The best k of few rows, in the order of their ids, for many queries: all cosines at once."""
    out, step = [], max(1, AT_ONCE // x.size)
    scale = lambda v: v / np.abs(v).max(axis=1, keepdims=True) if (np.abs(v).max(axis=1) > 1e150).any() or (np.abs(v).max(axis=1) < 1e-150).any() else v
    x, q = scale(x), scale(q)
    length = np.sqrt((x * x).sum(axis=1))
    for lo in range(0, len(q), step):
        part = slice(lo, lo + step)
        score = (x[None] * q[part, None]).sum(axis=2) / (length[None] * np.sqrt((q[part] * q[part]).sum(axis=1))[:, None])
        score[(ids[None] == asked[part, None]) | (score < floor[part, None])] = -np.inf
        some = np.flatnonzero(score.max(axis=1) > -np.inf)
        top = np.argsort(-score[some], axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(score[some], top, axis=1).ravel()
        keep = value > -np.inf
        of, top = lo + np.repeat(some, min(k, len(x)))[keep], top.ravel()[keep]
        out.append((qid[of], asked[of], rid[top], ids[top], value[keep]))
    return out


def nearest(table: DataFrame, *, k: int = 5, every: int = 50, trees: int = 4, leaf: int = 24, reach: float = 0.13, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): approximate largest cosines; queries are the rows whose vec_id every divides."""
    spark = table.sparkSession
    scratch.ship(spark)
    leaf = max(leaf, 2 * (k + 2))
    rows = vectors.valid(table, "embedding").filter("vec_id is not null").filter(F.exists("embedding", lambda x: x != 0))
    rows = scratch.stash(rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")), "vectors")
    sent = spark.sparkContext.broadcast(grow(rows, trees, leaf, seed))  # of the sample's size at most
    schema = "rid long, vec_id long, embedding array<double>, codes array<long>, floor double"
    routed = scratch.stash(_coded(rows, sent, lambda f, u, ids: [(c, 0.0) for c in f.route(u).tolist()], schema), "routed")
    asked = rows.filter(F.col("vec_id") % every == 0)
    asked = scratch.stash(_coded(asked, sent, lambda f, u, ids: [f.chosen(v, i, k, reach) for v, i in zip(u, ids.tolist(), strict=True)], schema), "asked")
    sent.destroy()
    # the first leaf, of half of ``leaf`` rows or more, gives k rows in any case: what the sample holds may lie where no leaf was taken
    each = lambda d: d.select("rid", "vec_id", "embedding", "floor", F.size("embedding").alias("d"), F.posexplode("codes").alias("place", "code")).withColumn("floor", F.when(F.col("place") == 0, -2.0).otherwise(F.col("floor")))
    size = lambda d, n: d.select(F.size("embedding").alias("d"), F.explode("codes").alias("code")).groupBy("d", "code").agg(F.count("*").alias(n))
    parts = size(routed, "r").join(size(asked, "s"), ["d", "code"]).select("d", "code", F.ceil(F.col("r") / PART_ROWS).alias("rp"), F.ceil(F.col("s") / PART_QUERIES).alias("sp"))
    parts = scratch.stash(parts, "leaves")  # as many as the sample's forests have leaves
    deal = lambda d, own, other, to, across: (
        each(d).join(F.broadcast(parts), ["d", "code"]).withColumn(to, F.pmod(F.xxhash64("rid"), F.col(own))).withColumn(across, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("rp", "sp")
    )
    left, right = deal(routed, "rp", "sp", "a", "b"), deal(asked, "sp", "rp", "b", "a")
    key = ["d", "code", "a", "b"]
    order = ["rid", "vec_id", "embedding", *key]
    found = left.select(*order).groupBy(*key).cogroup(right.select(*order, "floor").groupBy(*key)).applyInArrow(_met(k), "qid long, query_id long, rid long, vec_id long, score double")
    once = found.groupBy("qid", "query_id", "rid", "vec_id").agg(F.max("score").alias("score"))  # several trees find one row
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
