"""Rank correlations of many score columns with one ranked value."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.lineage import ship

#: Rows whose scores a task sorts at once.
SLICE = 1 << 15


#: Whole numbers up to which doubles tell all apart.
EXACT = 1 << 53


def _planes(a: np.ndarray) -> bytes:
    """Bytes of sorted numbers, those of one place together, so that what is compressed is alike."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _numbers(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _sent(s: np.ndarray, v: np.ndarray, digits: int | None) -> bytes:
    """Sorted scores and their places, compressed; scores of so many digits as the whole numbers between one and the next."""
    steps = digits is not None and len(s) > 0 and max(abs(s[0]), abs(s[-1])) * 10.0**digits < EXACT
    told = np.diff(np.rint(s * 10.0**digits).astype(np.int64), prepend=np.int64(0)) if steps else s
    return struct.pack("<?I", steps, len(s)) + pa.Codec("zstd", compression_level=1).compress(_planes(told) + _planes(v), asbytes=True)


def _received(b: bytes, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    steps, n = struct.unpack_from("<?I", b)
    told = pa.Codec("zstd").decompress(b[5:], decompressed_size=n * 12, asbytes=True)
    s = np.cumsum(_numbers(told[: n * 8], np.int64)) / 10.0**digits if steps else _numbers(told[: n * 8], np.float64)
    return s, _numbers(told[n * 8 :], np.uint32)


def rank_correlations(df: DataFrame, by: str, place: str, scores: str, k: int, *, digits: int | None = None, part_rows: int = 1 << 20) -> DataFrame:
    """(by, _rule, rho): the correlation of average ranks of each of an array's k scores with a value's average ranks.

    place: the value's rank within its cohort, a multiple of a half. Missing scores (or such as are no
    number) take no rank; a missing place takes no part in sums. Tasks send sorted scores with their
    places, packed. digits: to which scores are compared, halves away from zero. A cohort of more than part_rows rows is dealt to ranges of scores, cut at
    quantiles of a sample; equal scores share a range, ranges give out sums of ranks inside them, and
    the rows of the ranges below are added to these at the end, so results do not depend on the cuts.
    df is read up to three times.
    """
    ship(df.sparkSession)
    kind = df.schema[by].dataType.simpleString()
    sizes = {r[0]: r[1] for r in df.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > part_rows).collect()}  # large cohorts only, so few
    cuts: dict = {}
    if sizes:
        share = min(1.0, 20_000 / min(sizes.values()))
        large = df.filter(F.col(by).isin([c for c in sizes if c is not None]) | (F.col(by).isNull() & F.lit(None in sizes)))
        most = -(-max(sizes.values()) // part_rows)
        long = large.sample(share, seed=7).select(by, F.posexplode(scores).alias("_rule", "_s")).filter("_s is not null and not isnan(_s)")
        for r in long.groupBy(by, "_rule").agg(F.percentile_approx("_s", [i / most for i in range(1, most)], 1000).alias("c")).collect():
            cuts[r[0], r[1]] = np.unique(np.array(r[2]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= SLICE:
                yield from packed(pa.Table.from_batches(held).combine_chunks())
                held, n = [], 0
        if n:
            yield from packed(pa.Table.from_batches(held).combine_chunks())

    def packed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        own = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        codes, names = own.indices.to_numpy(), own.dictionary
        halves = np.nan_to_num(t.column(1).combine_chunks().to_numpy(zero_copy_only=False) * 2).astype(np.uint32)
        x = t.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, k)
        if digits is not None:
            x = np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)
        for c in range(len(names)):
            at = np.flatnonzero(codes == c)
            mine, v, name = x[at], halves[at], names[c].as_py()
            rule, part, blobs = [], [], []
            for j in range(k):
                s = mine[:, j]
                order = np.argsort(s)[: len(s) - int(np.isnan(s).sum())]  # what is missing stands last
                s, w = s[order], v[order]
                edge = cuts.get((name, j), np.empty(0))
                ends = [0, *np.searchsorted(s, edge, side="right").tolist(), len(s)]
                for p, (lo, hi) in enumerate(zip(ends, ends[1:])):
                    if hi > lo or p == 0:
                        rule.append(j)
                        part.append(p)
                        blobs.append(_sent(s[lo:hi], w[lo:hi], digits))
            yield pa.RecordBatch.from_arrays([pa.repeat(names[c], len(rule)), pa.array(rule, pa.int32()), pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], [by, "_rule", "_part", "_blob"])

    def placed(t: pa.Table) -> pa.Table:
        told = [_received(b.as_py(), digits) for b in t.column("_blob")]
        s, v = np.concatenate([x for x, _ in told]), np.concatenate([x for _, x in told])
        order = np.argsort(s)
        s, v = s[order], v[order] / 2.0
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]]))
        count = np.diff(np.append(new, len(s)))
        r = np.repeat(new + (count + 1) / 2.0, count)
        there = v > 0
        r, v = r[there], v[there]
        sums = [len(s), len(r), r.sum(), (r * r).sum(), v.sum(), (v * v).sum(), (r * v).sum()]
        return pa.table([*(t.column(c).slice(0, 1) for c in (by, "_rule", "_part")), *(pa.array([float(x)]) for x in sums)], [by, "_rule", "_part", "m", "n", "r", "rr", "v", "vv", "rv"])

    names = ("m", "n", "r", "rr", "v", "vv", "rv")
    packed_rows = df.select(by, F.col(place).cast("double").alias("_v"), scores).mapInArrow(pack, f"`{by}` {kind}, _rule int, _part int, _blob binary")
    parts = packed_rows.groupBy(by, "_rule", "_part").applyInArrow(placed, f"`{by}` {kind}, _rule int, _part int, {', '.join(f'{c} double' for c in names)}")
    up = F.sum("m").over(Window.partitionBy(by, "_rule").orderBy("_part")) - F.col("m")
    b, n, r = F.col("b"), F.col("n"), F.col("r")
    whole = parts.withColumn("b", up).groupBy(by, "_rule").agg(F.sum("n").alias("n"), F.sum(r + b * n).alias("r"), F.sum(F.col("rr") + 2 * b * r + b * b * n).alias("rr"), F.sum("v").alias("v"), F.sum("vv").alias("vv"), F.sum(F.col("rv") + b * F.col("v")).alias("rv"))
    spread = lambda s, ss: F.col(ss) - F.try_divide(F.col(s) * F.col(s), n)
    # ranks that are not all alike differ by more than rounding does
    varies = (n > 0) & (spread("r", "rr") > 1e-12 * F.col("rr")) & (spread("v", "vv") > 1e-12 * F.col("vv"))
    rho = (F.col("rv") - F.try_divide(r * F.col("v"), n)) / F.sqrt(spread("r", "rr")) / F.sqrt(spread("v", "vv"))
    return whole.select(by, "_rule", F.when(varies, rho).alias("rho"))
