"""The automaton's scores against probabilities from counted n-grams, in plain Python."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import backoff_lm as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


class Brute:
    """The model of some texts (lists of tokens, the last one None) with counts in dictionaries."""

    def __init__(self, texts):
        self.one, self.two, self.three = (Counter(g for t in texts for g in zip(*[t[i:] for i in range(k)], strict=False)) for k in (1, 2, 3))
        self.n, self.v = sum(self.one.values()), len(self.one)
        n1, n2 = (sum(c == k for w, c in self.one.items() if w != (None,)) for k in (1, 2))
        self.discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
        self.left = {}
        for k, grams, contexts in ((2, self.two, self.one), (3, self.three, self.two)):
            n, new = Counter(), Counter()
            for g, c in grams.items():
                if contexts[g[:-1]] > 1:
                    n[self.kind(contexts[g[:-1]] - 1)] += c
                    new[self.kind(contexts[g[:-1]] - 1)] += c == 1
            self.left[k] = lambda c, n=n, new=new: (new[self.kind(c)] + 0.5) / (n[self.kind(c)] + 1)

    @staticmethod
    def kind(c):
        return min(lm.CLASSES - 1, math.floor(math.log2(c) * lm.FINE + 1e-9))

    def p(self, g):
        if len(g) == 1:
            return (self.one[g] - self.discount if self.one[g] else self.discount * self.v) / self.n
        context, c = (self.one if len(g) == 2 else self.two)[g[:-1]], (self.two if len(g) == 2 else self.three)[g]
        if not context:
            return self.p(g[1:])
        left = self.left[len(g)](context)
        return (1 - left) * c / context + left * self.p(g[1:])

    def score(self, t):
        return sum(math.log10(self.p(tuple(t[max(0, i - 2) : i + 1]))) for i in range(len(t)))


def _held_to_brute_force(spark, texts, **sizes):
    got = {r["doc_id"]: r for r in lm.train_and_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **sizes).collect()}
    tokens = {d: [*WORD.findall(_lower(t)), None] for d, t in enumerate(texts)}
    model = Brute([t for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 10])
    assert len(got) == len(texts)
    for d, t in tokens.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum((w,) in model.one for w in t), model.n)
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.one[w,] + 0.1) / (model.n + 0.1 * (model.v + 1))) for w in t))
        assert r["score"] == pytest.approx(model.score(t))
    return model, got


@pytest.mark.parametrize("sizes", [{}, {"unit_bytes": 200, "shard_bytes": 300}, {"unit_bytes": 1, "shard_bytes": 4000}], ids=["one", "many", "single"])
def test_scores_follow_counts(spark, sizes):
    rng = np.random.default_rng(3)
    words = ["a", "b", "The", "cat", "sat", "é", "x1"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(60)] + [None, "", "  \n", "only once here", "zz " * 3000]
    _held_to_brute_force(spark, texts, **sizes)


def test_ngrams_of_rare_words(spark):
    rng = np.random.default_rng(5)
    common, passage = [f"c{i}" for i in range(600)], [f"rare{i}" for i in range(9)]
    texts = [" ".join([*rng.choice(common, 60), *(passage if i % 9 == 1 else []), f"once{i}"]) for i in range(80)]
    model, got = _held_to_brute_force(spark, texts, unit_bytes=2000, shard_bytes=2000)
    assert len(model.one) > 512 and model.three["rare3", "rare4", "rare5"] > 1
    # each n-gram counts, those that occur once too
    assert all(got[d]["score"] > got[d]["base_score"] for d in range(80) if not got[d]["held_out"])


def test_probabilities_of_a_state_sum_to_one(spark):
    texts = ["a b a c a b", "b b a", "c a b b"] * 3
    tokens = [[*t.split(), None] for t in texts]
    model = Brute(tokens)
    for context in ((), ("a",), ("a", "b"), ("c", "a"), ("zz", "a"), ("a", "zz")):
        # the unknown type takes what the known ones leave
        assert sum(model.p((*context, *w)) for w in [*model.one, ("unknown",)]) == pytest.approx(1)
    training = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b zz a"), (2, None), (3, "zz")], "doc_id long, text string")
    for r in lm.score(asked, training).collect():
        assert r["score"] == pytest.approx(model.score({1: ["a", "b", "zz", "a", None], 2: [None], 3: ["zz", None]}[r["doc_id"]]))


def test_long_text_in_a_word_or_many(spark):
    texts = ["x" * 1_200_000, "y z " * 400_000, "y z"] * 2
    got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in lm.train_and_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [n for _, n, _ in got] == [2, 800_001, 3] * 2
    assert got[0][2] == pytest.approx(got[3][2]) and got[1][2] == pytest.approx(got[4][2])


def test_empty_table_repeats_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.train_and_score(none).count() == 0
    alone = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).first()
    assert (alone["n_tokens"], alone["n_known"], alone["train_tokens"], alone["score"]) == (3, 0, 0, 0.0)
    twice = spark.createDataFrame([(1, "a a b", 0.0, 1), (1, "a a b", 1.0, 2), (None, None, 2.0, 3)], "doc_id long, text string, score double, unit int")
    got = lm.train_and_score(twice).collect()
    assert len(got) == 3 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_totals_do_not_depend_on_units(spark):
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    assert (np.cumsum(lm._from_planes(lm._planes(np.diff(keys, prepend=np.uint64(0))), np.uint64)) == keys).all()
    assert (lm._from_planes(lm._planes(np.arange(70000, dtype=np.uint32)), np.uint32) == np.arange(70000)).all()
