"""Repeated queries and vectors of other lengths take nothing from a query's neighbours."""

from __future__ import annotations

import numpy as np

from tallyforge.llm import ann


def test_repeated_queries_and_lengths(spark):
    x = np.random.default_rng(6).standard_normal((60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0] * 30), (901, [2.0] * 30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([rows[3], rows[3], (3, rows[4][1]), rows[5], rows[60]], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(vectors, queries, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))

    def want(q, own):
        s = x @ x[q]
        s[own] = -np.inf
        return list(enumerate(np.argsort(-s)[:20].tolist(), 1))

    assert sorted(got[5]) == want(5, 5) and got[900] == [(1, 901)]
    assert sorted(got[3]) == sorted(want(3, 3) + want(4, 3))
