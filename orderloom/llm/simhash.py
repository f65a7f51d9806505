"""SimHash fingerprints and their components within a Hamming radius, compared in tiles.

Distinct fingerprints are dealt to tiles by population count, and each tile is one small file in
the shared folder. Two fingerprints within the radius have counts that differ by the radius at
most, so tile pairs beyond it are skipped; the others are listed as rows, and the task that holds
a row reads its two tiles and compares them whole, by exclusive-or and bit counts over blocks. A
fingerprint is thus written once, however many tiles it meets. Each pair of tiles emits a spanning
forest of its links, never all pairs of a group, and equal fingerprints are one node, so groups of
copies cost one row.

Defined cases: null and word-less texts have fingerprint zero and link like any other; repeated
rows link; a null doc_id is never the least of a component that has others; no rows give no rows;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import arrays, scratch
from orderloom.llm.components import components

SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, *, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text."""
    from xxhash import xxh64_intdigest

    own = text.lower().split()
    if not own:
        return 0
    n = max(1, len(own) - words + 1)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    first = np.append(0, ends[:-1] + 1)[:n].tolist()
    last = ends[min(words, len(own)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, SHINGLES_AT_ONCE):
        h = np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[lo : lo + SHINGLES_AT_ONCE], last[lo : lo + SHINGLES_AT_ONCE], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, words: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also, fp): the fingerprint of every whole text, as a signed long. also: columns that come along."""
    scratch.ship(docs.sparkSession)
    kept = ["doc_id", *also]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words=words) for _, _, raw in arrays.text_chunks(batch.column(0)) for t in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], [*kept, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select("text", *kept).mapInArrow(arrays.tidy(work), f"{kinds}, fp long")


def forest(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 1 << 8, columns: int = 1 << 10) -> list[tuple[int, int]]:
    """Links (a[i], b[j]) within the radius that span what they connect. Counts are equal within a and within b."""
    shift = int(np.bitwise_count(b[0])) - int(np.bitwise_count(a[0]))
    reach = [d for d in range(-radius, radius + 1) if abs(d) + abs(shift - d) <= radius]
    if not reach:
        return []
    # as a tile's counts are equal, the upper halves' counts tell how far the lower ones differ
    a, b = (x[np.argsort(np.bitwise_count(x >> np.uint64(32)), kind="stable")] for x in (a, b))
    ha, hb = (np.bitwise_count(x >> np.uint64(32)).astype(np.int16) for x in (a, b))
    nodes = np.unique(np.concatenate((a, b)))
    at_a, at_b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    label = np.arange(len(nodes))
    out = []
    for lo in range(0, len(a), rows):
        x = a[lo : lo + rows]
        start = int(np.searchsorted(hb, ha[lo] + reach[0], side="left"))
        stop = int(np.searchsorted(hb, ha[lo + len(x) - 1] + reach[-1], side="right"))
        for at in range(start, stop, columns):
            y = b[at : min(at + columns, stop)]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                there = at_b[at : at + len(y)][near[i]]
                others, first = np.unique(label[there], return_index=True)
                for other, j in zip(others.tolist(), first.tolist(), strict=True):
                    own = label[at_a[lo + i]]
                    if other != own:
                        label[label == other] = own
                        out.append((int(x[i]), int(nodes[there[j]])))
    return out


def _tiles(fps: DataFrame, tile: int) -> tuple[str, dict[int, int], dict[int, int], DataFrame | None]:
    """Write each tile's fingerprints as a file; (folder, fingerprints and tiles of each population count, tiles that have rows)."""
    spark = fps.sparkSession
    counted = fps.select("fp", F.bit_count("fp").cast("int").alias("ones"))
    sizes = {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    parts = {o: -(-n // tile) for o, n in sorted(sizes.items())}
    folder = scratch.fresh(spark, "tiles")
    if not parts:
        return folder, sizes, parts, None
    n_parts = F.element_at(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)), F.col("ones"))
    dealt = counted.withColumn("part", F.pmod(F.xxhash64("fp"), n_parts).cast("int"))

    def save(group: pa.Table) -> pa.Table:
        ones, part = group["ones"][0].as_py(), group["part"][0].as_py()
        scratch.save_file(f"{folder}/files", f"{ones}-{part}", np.sort(group["fp"].to_numpy()).tobytes())
        return pa.table({"ones": pa.array([ones], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([group.num_rows], pa.int64())})

    made = scratch.stash(dealt.groupBy("ones", "part").applyInArrow(save, "ones int, part int, n long"), "tile-sizes")
    return folder, sizes, parts, made


def near_links(fps: DataFrame, *, radius: int = 4, tile: int = 1 << 14) -> DataFrame:
    """(a, b): links that span all pairs of distinct fingerprints within the radius. fps: fp, distinct."""
    spark = fps.sparkSession
    scratch.ship(spark)
    folder, sizes, parts, made = _tiles(fps, tile)
    near = [(o, p, parts[o], parts[p]) for o in parts for p in parts if 0 <= p - o <= radius]  # counts of tiles, not tiles
    n_pairs = sum(m * (m + 1) // 2 if o == p else m * n for o, p, m, n in near)
    work_units = sum(sizes[o] * sizes[p] for o, p, _, _ in near) >> 28  # comparisons; so many take a second or less
    if not near:
        return spark.createDataFrame([], "a long, b long")
    tasks = min(n_pairs, max(2 * spark.sparkContext.defaultParallelism, min(work_units, 20_000)))
    rows = spark.createDataFrame(near, "o int, p int, m int, n int").select("o", "p", "n", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i")).repartition(max(1, tasks // 4))
    first = F.when(F.col("o") == F.col("p"), F.col("i")).otherwise(0)
    pairs = rows.select("o", "i", "p", F.explode(F.sequence(first, F.col("n") - 1)).alias("j"))
    if made.count() < sum(parts.values()):  # where tiles are small, the hash may leave some empty
        pairs = pairs.join(made.select(F.col("ones").alias("o"), F.col("part").alias("i")), ["o", "i"], "left_semi")
        pairs = pairs.join(made.select(F.col("ones").alias("p"), F.col("part").alias("j")), ["p", "j"], "left_semi")
    pairs = pairs.select("o", "i", "p", "j").repartition(tasks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def load(ones: int, part: int) -> np.ndarray:
            if (ones, part) not in held:
                if len(held) > 64:
                    held.clear()
                held[ones, part] = np.frombuffer(scratch.load_file(f"{folder}/files", f"{ones}-{part}"), np.uint64)
            return held[ones, part]

        for batch in batches:
            for o, i, p, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                links = forest(load(o, i), load(p, j), radius)
                flat = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])

    return pairs.mapInArrow(work, "a long, b long")


def _classes(fps: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fp, root, least): the component of each distinct fingerprint, and the least doc_id of its rows."""
    classes = scratch.stash(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(near_links(classes.select("fp"), radius=radius, tile=tile)).withColumnRenamed("node", "fp")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, *, words: int = 4, radius: int = 4, tile: int = 1 << 14) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links."""
    fps = scratch.stash(fingerprints(docs, words=words), "fingerprints")
    grouped = _classes(fps, radius, tile)
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def one_each(docs: DataFrame, *, words: int = 4, radius: int = 4, tile: int = 1 << 14) -> DataFrame:
    """One row of docs of each component: that of the least doc_id (null last); of rows that share it, the first stored."""
    row, of = scratch.unused(docs, "row", "of")
    rows, columns = scratch.numbered(docs, row), scratch.named(docs)
    fps = scratch.stash(fingerprints(rows.select("doc_id", "text", F.col(row).alias("row")), words=words, also=("row",)), "fingerprints")
    roots = _classes(fps, radius, tile).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    by_text = fps.groupBy("fp").agg(first.alias("first"))  # copies meet before they move
    stay = by_text.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(of))
    return rows.join(stay, F.col(row) == F.col(of), "left_semi").select(*columns)
