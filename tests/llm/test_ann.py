"""Neighbours and scores against brute force: without clusters, in inverted lists, of mixed lengths, with ties."""

from __future__ import annotations

import numpy as np
import pytest

from tallyforge.llm import ann

RNG = np.random.default_rng(41)


def _brute(rows, queries, k):
    out = {}
    for qid, q in queries:
        scored = sorted((-float((np.array(v) * np.array(q)).sum()), i) for i, v in rows if i != qid and len(v) == len(q))
        out[qid] = [(i, -s) for s, i in scored[:k]]
    return out


def _got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def _rows(x):
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_without_clusters_all_is_searched(spark, kind):
    rows = _rows(RNG.standard_normal((1500, 16)).astype(np.float32))
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got, want = _got(ann.nearest(table, table.where("vec_id % 20 = 0"), 20, vectors_per_block=300, queries_per_block=30, vectors_per_list=100)), _brute(rows, rows[::20], 20)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.99
    for q, found in got.items():
        own = dict(rows)
        assert all(s == pytest.approx(float((np.array(own[i]) * np.array(own[q])).sum()), rel=1e-12) for i, s in found)


def test_clusters_are_searched_in_lists(spark):
    centres = RNG.standard_normal((40, 24)) * 4
    x = (centres[RNG.integers(0, 40, 4000)] + RNG.standard_normal((4000, 24)) * 0.6).astype(np.float32)
    rows = _rows(x)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    lists = ann.learn_lists(ann.usable(table), ann.usable(table.where("vec_id % 20 = 0")), 4000, 200, 20, 40)
    assert lists.probes <= ann.MOST_PROBED * 40
    asked = {i for i, _ in rows if i % 20 == 0 or i % 50 == 0}
    got, want = _got(ann.nearest(table, table.where("vec_id % 20 = 0 OR vec_id % 50 = 0"), 20, vectors_per_list=100)), _brute(rows, [rows[i] for i in sorted(asked)], 20)
    for step in (20, 50):
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want if q % step == 0]) >= 0.95
    full = _got(ann.nearest(table, table.where("vec_id % 20 = 0"), 20, vectors_per_list=100, exact=True))
    assert np.mean([len({i for i, _ in full[q]} & {i for i, _ in want[q]}) / 20 for q in full]) >= 0.99


def test_ragged_odd_and_repeated_vectors(spark):
    good = [(i, [float(c) for c in RNG.standard_normal(8)]) for i in range(100)]
    odd = [(100, [1.0] * 9), (101, None), (102, []), (103, [0.0] * 8), (104, [float("nan")] * 8), (105, [None] * 8), (106, [float("inf")] * 8), (None, [1.0] * 8), (107, [1.0] * 9)]
    table = spark.createDataFrame([(i, v, 1) for i, v in good + odd], "vec_id long, embedding array<double>, v int")
    got, want = _got(ann.nearest(table, table.where("vec_id % 20 = 0"), 20)), _brute(good, good[::20], 20)
    want[100] = [(107, 9.0)]
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<double>")
    assert [i for i, _ in _got(ann.nearest(same, same.where("vec_id = 40"), 20))[40]] == list(range(20))
    assert ann.nearest(table.limit(0), table).count() == 0 == ann.nearest(table, table.limit(0)).count()
