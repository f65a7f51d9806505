"""The clustered layout against a plain version, and its files."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from orderloom.llm import layout, scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, z string, position int, file string, row long, at string, part int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 2, "f", 3, "a", 4) for i, t, lang, s in rows], SCHEMA)


def plain(rows, file_rows, least=lambda x: (x is not None, x)):
    """(doc_id, z, position, file, touched, matching, bounds) of every row, by definition."""
    n = len(rows)
    values = [(None if s is None else s.encode(), None if lang is None else lang.encode(), -1 if t is None else len(t.encode()), None if i is None else zlib.crc32(str(i).encode()) % 365) for i, t, lang, s in rows]
    cells = []
    for k in range(4):
        own = [least(v[k]) for v in values]
        cells.append([8 * sum(y < x for y in own) // n for x in own])
    cells = list(zip(*cells, strict=True))
    z_of = lambda c: sum((c[k] >> b & 1) << 4 * b + k for b in range(3) for k in range(4))
    order = sorted(range(n), key=lambda r: (z_of(cells[r]), least(rows[r][0])))
    held = defaultdict(list)
    for p, r in enumerate(order):
        held[p // file_rows].append(cells[r])
    box = {f: [(min(x), max(x)) for x in zip(*cs, strict=True)] for f, cs in held.items()}
    reach = (0, 0, 1, 1)
    out = []
    for p, r in enumerate(order):
        c, f = cells[r], p // file_rows
        touch = sum(all(lo - d <= x <= hi + d for x, d, (lo, hi) in zip(c, reach, b, strict=True)) for b in box.values())
        match = sum(any(all(abs(x - y) <= d for x, y, d in zip(c, o, reach, strict=True)) for o in cs) for cs in held.values())
        out.append((rows[r][0], z_of(c), p, f, touch, match, ",".join(f"{lo},{hi}" for lo, hi in box[f])))
    return out


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    hot = ("hot", "en")
    out = []
    for i in range(n):
        source, lang = hot if rnd.random() < 0.35 else (rnd.choice([None, "", "a", "é", "z\x00", "Ü", "a'b", "s7", "s10"]), rnd.choice([None, "en", "de", "fr"]))
        out.append((i, rnd.choice([None, "", "x" * rnd.randint(0, 50), "é" * rnd.randint(0, 9), "long " * 4000 if rnd.random() < 0.02 else "w"]), lang, source))
    return out


@pytest.mark.parametrize("file_rows", [7, 2000])
def test_layout_is_that_of_the_plain_version(spark, file_rows):
    rows = rows_of(331)
    got = layout.report(docs_of(spark, rows).repartition(5), file_rows=file_rows).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows, file_rows))


def test_repeated_rows_and_null_ids(spark):
    rows = [(3, "aa", "en", "s")] * 6 + [(None, None, None, None)] * 5 + [(-4, "b", "de", None), (10**12, "", None, "t")]
    got = layout.report(docs_of(spark, rows).repartition(4), file_rows=3).collect()
    assert Counter(map(tuple, got)) == Counter(plain(rows, 3))


def test_one_row_and_none(spark):
    assert [tuple(r) for r in layout.report(docs_of(spark, [(1, "a", "en", "s")])).collect()] == [(1, 0, 0, 0, 1, 1, "0,0,0,0,0,0,0,0")]
    assert layout.report(docs_of(spark, [])).count() == 0


def test_files_are_read_by_their_boxes(spark):
    rows = rows_of(300, seed=5)
    docs = docs_of(spark, rows)
    folder = scratch.fresh(spark, "layout")
    manifest = {r["file"]: r for r in layout.write(docs, folder, file_rows=20).collect()}
    assert len(manifest) == 15 and all(r["rows"] == 20 for r in manifest.values())
    whole = layout.read(spark, folder)
    assert whole.columns == docs.columns and Counter(map(tuple, whole.collect())) == Counter(map(tuple, docs.collect()))
    some = layout.read(spark, folder, source=(2, 3), length=(0, 1))
    want = [r for r in manifest.values() if r["source_lo"] <= 3 and r["source_hi"] >= 2 and r["length_lo"] <= 1]
    assert some.count() == 20 * len(want) < 300


def test_numbers_of_cells_match_counts_over_boxes(spark):
    boxes = spark.createDataFrame([(0, 0, 3, 1, 1, 0, 7, 2, 2), (1, 2, 2, 0, 7, 5, 6, 7, 7), (2, 7, 7, 7, 7, 7, 7, 0, 0)], "file long, " + ", ".join(f"{c}_{k} long" for c in layout.DIMENSIONS for k in ("lo", "hi")))
    grid = layout.touched(boxes)
    assert grid.shape == (8,) * 4
    assert (grid[3, 1, 4, 3], grid[3, 1, 4, 4], grid[2, 1, 4, 6], grid[2, 1, 3, 6], grid[7, 7, 6, 1], grid[7, 7, 5, 1], grid[2, 1, 7, 1]) == (1, 0, 1, 0, 1, 0, 1)
