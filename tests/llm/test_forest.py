"""The routed forest: recall on even and grouped vectors, ties, copies, odd rows, small parts."""

from __future__ import annotations

import numpy as np
import pytest

from orderloom.llm import forest, vectors

SCHEMA = "vec_id long, embedding array<double>, rid string, codes int, a int, draw long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "r", 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)


def asked(df, **how):
    out = {}
    for r in forest.nearest(df, **how).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def brute(rows, q, k=5):
    own = dict(rows)[q]
    s = [(-round(float(np.dot(own, v) / np.linalg.norm(own) / np.linalg.norm(v)), 12), i) for i, v in rows if i != q and len(v) == len(own)]
    return [i for _, i in sorted(s)[:k]]


@pytest.mark.parametrize(("grouped", "most"), [(False, 0.85), (True, 0.2)])
def test_recall_and_what_is_met(spark, grouped, most, monkeypatch):
    monkeypatch.setattr(forest, "PART_ROWS", 16)
    monkeypatch.setattr(forest, "PART_QUERIES", 2)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2500, 32))
    if grouped:
        x += 4 * rng.standard_normal((25, 32))[rng.integers(0, 25, len(x))]
    rows = list(enumerate(x))
    got = asked(frame(spark, rows))
    hit = 0
    for q in range(0, 2500, 50):
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(float(x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])), abs=1e-12) for _, i, s in got[q])
        hit += len({i for _, i, _ in got[q]} & set(brute(rows, q)))
    assert len(got) == 50 and hit >= 0.9 * 250
    unit = vectors._unit(x)
    grown = forest.Forest(unit, np.arange(len(unit)), 4, 24, 5)
    routed = grown.route(unit)
    share = np.mean([np.isin(routed, grown.chosen(u, i, 5, 0.13)[0]).any(axis=1).mean() for i, u in enumerate(unit[:50])])
    assert share <= most


def test_a_row_is_in_the_leaves_that_its_own_query_takes():
    unit = vectors._unit(np.random.default_rng(1).standard_normal((400, 8)))
    grown = forest.Forest(unit[:300], np.arange(300), 3, 16, 2)
    for u, codes in zip(unit, grown.route(unit).tolist(), strict=True):
        assert set(codes) <= set(grown.chosen(u, -1, 5, 1e-9)[0])


def test_leaves_of_few_and_of_many_rows_say_the_same():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (700, 3)).astype(float)
    x[(x == 0).all(axis=1)] = 1.0
    ids, q = rng.integers(0, 400, 700), rng.integers(-2, 3, (40, 3)) + 0.5
    lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    left = pa.table({"rid": np.arange(700), "vec_id": ids, "embedding": lists(x)})
    right = pa.table({"rid": np.arange(40), "vec_id": np.arange(40), "embedding": lists(q), "floor": np.where(np.arange(40) % 2, 0.9, -2.0)})
    some = left.slice(0, 500)
    few = forest._met(5)(some, right).to_pydict()
    try:
        forest.FEW, held = 0, forest.FEW
        many = forest._met(5)(some, right).to_pydict()
    finally:
        forest.FEW = held
    rows = lambda d: sorted(zip(*(np.round(d[c], 12).tolist() for c in ("qid", "query_id", "rid", "vec_id", "score")), strict=True))
    assert rows(few) == rows(many) and len(few["qid"]) > 100 and min(s for s, i in zip(few["score"], few["qid"], strict=True) if i % 2) >= 0.9


@pytest.mark.parametrize("part", [7, 1 << 13])
def test_ties_copies_and_odd_rows(spark, part, monkeypatch):
    monkeypatch.setattr(forest, "PART_ROWS", part)
    rows = [(i, [1.0, 0.0]) for i in range(0, 300, 3)] + [(1, [0.0, 1.0]), (2, [2.0, 0.0]), (50, [3.0, 4.0]), (100, [1.0, 1.0, 1.0]), (101, [1.0, 1.0, 0.9]), (103, [1.0])]
    odd = [(400, None), (450, []), (500, [0.0, 0.0]), (550, [None, 1.0]), (600, [float("nan"), 1.0]), (650, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    got = asked(frame(spark, rows + odd))
    assert sorted(got) == [0, 50, 100, 150]
    assert [i for _, i, _ in got[0]] == [2, 3, 6, 9, 12] and [i for _, i, _ in got[150]] == [0, 2, 3, 6, 9] and all(s == 1.0 for *_, s in got[0] + got[150])
    assert [(i, round(s, 9)) for _, i, s in got[50]] == [(1, 0.8), (0, 0.6), (2, 0.6), (3, 0.6), (6, 0.6)]
    assert [i for _, i, _ in got[100]] == [101]


def test_repeated_ids_count_each_and_never_meet_themselves(spark):
    rows = [(50, [1.0, 0.0])] * 7 + [(3, [1.0, 0.1])] * 2 + [(4, [0.0, 1.0])]
    found = forest.nearest(frame(spark, rows)).collect()
    assert len(found) == 7 * 3 and {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == {(50, 1, 3), (50, 2, 3), (50, 3, 4)}


def test_no_rows_and_no_queries(spark):
    assert forest.nearest(frame(spark, [])).count() == 0
    assert forest.nearest(frame(spark, [(1, [1.0]), (2, [2.0])])).count() == 0


def test_scales_of_vectors_do_not_matter(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)) * 10.0 ** rng.integers(-150, 150, (300, 1))
    rows = list(enumerate(x))
    scaled = [(i, v / np.abs(v).max()) for i, v in rows]
    got = asked(frame(spark, rows), reach=9.0)  # every leaf
    assert all([i for _, i, _ in got[q]] == brute(scaled, q) for q in range(0, 300, 50))
