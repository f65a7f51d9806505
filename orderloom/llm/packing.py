"""Hierarchical residual packing of token sequences.

Every partition packs its pieces best-fit in order of falling length and emits the bins that
are nearly full. What is left, underfull bins with their members, travels as items to other
partitions, where best-fit runs again. Of two bins that are over half full neither takes the
other, so from then on only bins of up to half move, to ever fewer partitions, until one bin of
up to half is left: no two sequences could be joined but for that one. A partition holds about
``per_task`` items at most, and a bin ``capacity`` members, so no task grows with the input.

Defined cases: null texts are empty; an empty text is one separator token; longer documents
are cut into full pieces behind a first shorter one; equal lengths go by document and piece;
rows that share a doc_id are packed separately; no rows give no rows.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import arrays, scratch

MEMBER = "struct<doc_id:{k},piece:int,start:long,length:long,ids_crc32:long,offset:long>"


@functools.lru_cache(2)
def _pieces_of(path: str) -> tuple[arrays.PieceCache, str, int]:
    """A cache that asks the tokenizers library for the ids of new pre-tokens."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = next(((x.content, i) for i, x in t.get_added_tokens_decoder().items()), ("\0none\0", -1))

    def ask(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.int32, int(n.sum())), n

    return arrays.PieceCache(ask), *special


def pieces(docs: DataFrame, path: str, *, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a separator, cut to capacity."""
    scratch.ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache, special, special_id = _pieces_of(path)
        for batch in batches:
            for lo, _, texts in arrays.text_chunks(batch.column(1)):
                ids, counts = arrays.encode_texts(cache, [x.decode() for x in texts], special, special_id)
                raw = np.insert(ids, np.cumsum(counts), separator).astype("<u4").tobytes()
                rows: list[tuple[int, int, int, int, int]] = []
                at = 0
                for i, n in enumerate((counts + 1).tolist()):
                    start, piece = 0, 0
                    while start < n:
                        size = (n - start) % capacity or capacity if not start else capacity
                        a = 4 * (at + start)
                        rows.append((lo + i, piece, start, size, zlib.crc32(raw[a : a + 4 * size])))
                        start += size
                        piece += 1
                    at += n
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(arrays.tidy(work), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item; items in order of falling size, each into the fullest bin that takes it.

    Free space goes in whole tokens, so bins stand in one stack per free space and the sorted
    list of spaces in use has capacity entries at most.
    """
    stacks: dict[int, list[int]] = {}
    spaces: list[int] = []
    out = [0] * len(sizes)
    made = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(spaces, sizes[i])
        if at == len(spaces):
            b, free = made, capacity
            made += 1
        else:
            free = spaces[at]
            b = stacks[free].pop()
            if not stacks[free]:
                spaces.pop(at)
        out[i] = b
        if left := free - sizes[i]:
            if not stacks.setdefault(left, []):
                insort(spaces, left)
            stacks[left].append(b)
    return out


def pack(items: DataFrame, *, capacity: int = 2048, slack: int = 2, per_task: int = 60_000) -> DataFrame:
    """Give every piece a sequence_id and an offset. slack: free tokens of a bin that counts as full."""
    spark = items.sparkSession
    scratch.ship(spark)
    kind = items.schema["doc_id"].dataType.simpleString()
    schema = f"fill long, members array<{MEMBER.format(k=kind)}>, full boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 2 * per_task:
                yield from round_(held)
                held, n = [], 0
        if n:
            yield from round_(held)

    def round_(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        lists = t["members"].combine_chunks()
        fill, count = t["fill"].to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        member = lists.flatten()
        begin = np.cumsum(count) - count
        first = member.take(pa.array(begin))
        order = pa.Table.from_arrays([pa.array(-fill), first.field(0), first.field(1), first.field(2)], ["f", "d", "p", "s"])
        import pyarrow.compute as pc

        order = pc.sort_indices(order, [("f", "ascending"), ("d", "ascending"), ("p", "ascending"), ("s", "ascending")]).to_numpy()
        fill, count, begin = fill[order], count[order], begin[order]
        bins = np.array(best_fit(fill.tolist(), capacity))
        by = np.argsort(bins, kind="stable")
        fill, count, begin, bins = fill[by], count[by], begin[by], bins[by]
        new = np.append(True, bins[1:] != bins[:-1])
        before = np.cumsum(fill) - fill
        before = before - before[np.flatnonzero(new)][np.cumsum(new) - 1]
        taken = member.take(pa.array(arrays.ragged(begin, count)))
        fields = [taken.field(i) for i in range(6)]
        fields[5] = pa.array(fields[5].to_numpy() + np.repeat(before, count))
        heads = np.flatnonzero(new)
        fills, counts = np.add.reduceat(fill, heads), np.add.reduceat(count, heads)
        struct = pa.StructArray.from_arrays(fields, fields=list(lists.type.value_type))
        for lo in range(0, len(heads), 20_000):
            hi = min(lo + 20_000, len(heads))
            a, b = int(counts[:lo].sum()), int(counts[:hi].sum())
            made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts[lo:hi])), pa.int32()), struct.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array(fills[lo:hi]), made, pa.array(fills[lo:hi] >= capacity - slack)], ["fill", "members", "full"])

    one = F.struct(*(F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), F.lit(0).cast("long").alias("offset"))
    bins = items.select(F.col("length").alias("fill"), F.array(one).alias("members"))
    deal = lambda bins, n: scratch.stash(bins.repartition(max(1, -(-n // per_task))).mapInArrow(arrays.tidy(work), schema), "pack")
    half = F.col("fill") * 2 <= capacity
    n = bins.count()
    made = deal(bins, n)
    done = made
    if n > per_task:
        done = made.filter("full")
        left = made.filter("not full").select("fill", "members")
        made = deal(left, left.count())  # bins of different partitions meet
        had = n + 1
        while 1 < (n := made.filter(half).count()) < had:
            had, done = n, done.unionByName(made.filter(~half))
            made = deal(made.filter(half).select("fill", "members"), n)
        done = done.unionByName(made)
    numbered = done.select(F.monotonically_increasing_id().alias("sequence_id"), "members")  # before members become rows
    return numbered.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048) -> DataFrame:
    """Tokenize, cut and pack: one row per piece."""
    return pack(scratch.stash(pieces(docs, path, capacity=capacity), "pieces"), capacity=capacity)
