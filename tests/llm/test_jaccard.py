"""One row of each group stays by its own text, codes that chance makes equal hide no link, hashes don't cancel out."""

from __future__ import annotations

import numpy as np
import pytest

from tallyforge.llm import jaccard_join
from tallyforge.llm.common import range_hashes

A, B, C = ("one two three four five six seven eight", "alpha beta gamma delta epsilon zeta eta theta", "red green blue white black pink grey brown")


def test_rows_of_one_id_are_decided_by_their_texts(spark):
    rows = [(1, A, 7), (2, A, 8), (2, B, 9), (3, B, 1), (4, C, 2), (4, C, 3), (5, None, 4), (5, "", 5), (5, None, 4), (None, A, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(map(tuple, jaccard_join.keep_one_of_each(docs).collect()), key=str)
    # (2, A) is a copy of 1, (2, B) is the first of its group, of (4, C) one stays; empty texts and no id stay
    assert sorted((d, t) for d, t, _ in got if d is not None and t) == [(1, A), (2, B), (4, C)]
    assert len(got) == 7 and jaccard_join.keep_one_of_each(docs).columns == docs.columns
    assert jaccard_join.keep_one_of_each(docs.limit(0)).count() == 0


def test_equal_codes_hide_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "code_of", lambda node, n: None if node is None else n)  # all sets of a size have one
    rng, texts = np.random.default_rng(2), []
    for _ in range(12):
        words = [f"w{i}" for i in rng.integers(0, 400, 40)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: i - i % 3 for i in range(len(texts))}


@pytest.mark.parametrize("n", [64, 400, 2048])
def test_hashes_of_thue_morse_words_differ(n):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    data = np.frombuffer((word + word.translate(str.maketrans("ab", "ba"))).encode(), np.uint8)
    h = range_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1] and range_hashes(data[3:], np.array([n - 3]), np.array([2 * n - 3]))[0] == h[1]
