"""Repeated rows, null ids, clashing names, many matches, and files that are lost or too many."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import bpe, packing, queries, scratch, secrets, simhash, token_counts, vectors, warc

PATH = queries.vocabulary_path()


def pages_of(spark, n=5):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i}</p>" * 50) for i in range(n)], "page_id long, url string, html string")


def test_a_stray_archive_is_not_read(spark):
    folder = scratch.fresh(spark, "warc")
    made = warc.write(pages_of(spark).coalesce(1), folder).collect()
    (Path(folder) / "archives" / "part-99999-00000-x.warc.zst").write_bytes((Path(folder) / "archives" / made[0]["archive"]).read_bytes())
    assert warc.read(spark, folder).count() == 5


def test_a_lost_archive_and_a_lost_record_raise(spark):
    folder = scratch.fresh(spark, "warc")
    path = Path(folder) / "archives" / warc.write(pages_of(spark).coalesce(1), folder).collect()[0]["archive"]
    records = [warc.record(i, "u", b"x", warc.digest(b"x"), None, "response") for i in range(4)]
    path.write_bytes(warc.archive(records, None))
    with pytest.raises(Exception, match="4 records, 5 in the manifest"):
        warc.read(spark, folder).collect()
    path.unlink()
    with pytest.raises(Exception, match="not in the folder"):
        warc.read(spark, folder).collect()


def test_one_response_for_equal_pages_of_one_id(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (2, "v", "a"), (2, "v", "a"), (None, "u", "b"), (None, "u", "b"), (7, "u", "c"), (7, "u", "d")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    sha1 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 1, sha1("a"), "revisit", 2), *[(2, 1, sha1("a"), "revisit", 2)] * 2, (2, 1, sha1("a"), "response", None)]
    want += [(None, 1, sha1("b"), "revisit", None), (None, 1, sha1("b"), "response", None), (7, 1, sha1("c"), "response", None), (7, 1, sha1("d"), "response", None)]
    assert Counter(map(tuple, got)) == Counter(want)


ROWS = [(3, "see password=hunter22 now"), (3, "see password=hunter22 now"), (3, "nothing"), (None, "api_key: ABCDEFGH"), (None, None), (None, "fine"), (3, "see password=hunter22 now")]


def test_redaction_keeps_every_row(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, source string")
    docs = docs.withColumn("of", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("row", F.lit(2)).withColumn("a.b", F.lit(3))
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    mask = {"see password=hunter22 now": "see [SECRET] now", "api_key: ABCDEFGH": "[SECRET]"}
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((i, mask.get(t, t)) for i, t in ROWS)
    assert Counter((r["doc_id"], r["text"]) for r in secrets.redact(docs, most_sent=0).collect()) == Counter((i, mask.get(t, t)) for i, t in ROWS)


def test_positions_among_many_matches(spark):
    rnd = random.Random(3)
    text = " ".join(rnd.choice(["token=abcdef", "token:é", "é" * rnd.randint(1, 5), "secret = zzzzzzz", "0123456789abcdef" * 2, "AKIA" + "Z" * 17]) for _ in range(9000))
    docs = spark.createDataFrame([(1, text, "s"), (2, text * 2, "s"), (3, "token=abcdef", "s")], "doc_id long, text string, source string")
    began = time.time()
    got = {r["doc_id"]: r["base_sha256"] for r in secrets.report(secrets.scan(docs)).collect()}
    assert time.time() - began < 60
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in ((1, text), (2, text * 2), (3, "token=abcdef")):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans = sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        assert got[i] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def near_groups(rows, radius=4):
    """Groups of row numbers, by plain flooding."""
    fp = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    left, groups = set(range(len(rows))), []
    while left:
        group = edge = {left.pop()}
        while edge:
            edge = {b for b in left if any((fp[a] ^ fp[b]).bit_count() <= radius for a in edge)}
            left -= edge
            group = group | edge
        groups.append(group)
    return fp, groups


def some_rows():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60))) for _ in range(60)]
    rows = [(rnd.choice([*range(25), None]), rnd.choice(base)) for _ in range(200)]
    return rows + [(None, None), (None, ""), (4, None), (99, " "), *[(5, base[0])] * 40, *[(None, "alone in null")] * 3]


def test_one_row_of_each_component_stays(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("of", F.lit(2)).withColumn("fp", F.lit(3)).withColumn("first", F.lit(4)).repartition(5)
    kept = simhash.one_each(docs, tile=4)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    _, groups = near_groups(rows)
    least = lambda g: min(g, key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    assert Counter(i for i, _ in got) == Counter(rows[least(g)][0] for g in groups)
    own = [next(k for k, g in enumerate(groups) if any(rows[n] == r for n in g)) for r in got]
    assert len(set(own)) == len(groups) == len(got)


@pytest.mark.parametrize("tile", [1, 2, 16])
def test_components_of_repeated_rows_in_tiny_tiles(spark, tile):
    rows = some_rows()
    fp, groups = near_groups(rows)
    want = Counter()
    for g in groups:
        least = min((rows[n][0] for n in g if rows[n][0] is not None), default=None)
        want.update((rows[n][0], fp[n], least) for n in g)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == want


def test_links_of_many_tiles_need_no_list_on_the_driver(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base[:200] ^ np.uint64(0b1011)]))
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), tile=2).collect()
    found = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in links}
    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= 4]:
            assert frozenset((int(x), int(y))) in found or any(int(x) in f for f in found)
    assert len(found) >= 200 and all((a ^ b).bit_count() <= 4 for a, b in map(tuple, found))


def test_repeated_rows_and_null_ids_count_alike(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (1, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    for made in (bpe.digests(docs, PATH), token_counts.count_tokens(docs, PATH)):
        got = Counter(r["doc_id"] for r in made.collect())
        assert got == Counter(i for i, _ in rows)
        assert len({r["n_tokens"] for r in made.collect() if r["n_tokens"]}) == 2
    pieces = packing.pack_documents(docs, PATH, capacity=8).collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter(i for i, _ in rows) and sum(r["length"] for r in pieces) == 3 * 4 + 1 + 2


def test_packing_leaves_one_bin_of_up_to_half(spark):
    for lengths in ("id * 37 % 90 + 1", "id % 3 * 60 + 130", "id * 13 % 255 + 1"):
        items = spark.range(4000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", f"{lengths} AS length", "7L AS ids_crc32")
        fill = Counter()
        for r in packing.pack(items, capacity=256, per_task=150).collect():
            fill[r["sequence_id"]] += r["length"]
        assert max(fill.values()) <= 256 and sum(v <= 128 for v in fill.values()) <= 1


def test_pipeline_of_no_rows_and_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("some", [(1, "a b", "en", "s", 3)] * 3 + [(None, "password=hunter22", "en", "s", 17)] * 2 + [(1, "c " * 30, None, None, None), (None, None, None, None, None)])):
        d = tmp_path / name
        spark.createDataFrame(rows, kind).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(d)).collect()
        assert Counter(r["doc_id"] for r in got) == (Counter({1: 2, None: 2}) if rows else Counter())


def test_stages_take_clashing_names(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["of", "spans", "packed", "row", "key", "key_", "first", "last", "fp", "root", "least", "rid", "base", "added", "y", "toxic", "quality", "fold", "score", "draw", "c0", "hash", "members", "fill", "full", "m", "at", "a.b"]
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", "s", 9), (2, f"{text} token=abcdefgh", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns and made.count() >= 1, name
        assert all(r[n] == n for r in made.select(*(f"`{n}`" for n in names)).collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 2


def test_ties_of_nearest(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 300, 3)] + [(1, [0.0, 1.0]), (2, [2.0, 0.0])]
    got = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=50, tile=16).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [0, 150]
    assert [v for _, v, _ in sorted(by[0])] == [2, 3, 6, 9, 12] and [v for _, v, _ in sorted(by[150])] == [0, 2, 3, 6, 9]
    assert all(s == 1.0 for q in by.values() for *_, s in q)
