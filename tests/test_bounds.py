"""Bounds of a window's scores: never below the scores, and close enough that few pairs are scored."""

import random

import numpy as np
import pandas as pd

from tallyforge.functions import similarity
from tallyforge.operators import blocking, nearby


def _window(n: int, m: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """n invoices and m payments of others, as candidates are made of them."""
    draw = random.Random(17)
    left = pd.DataFrame([(f"R{k}", 100 + k % 45, f"1NV{draw.randrange(9_000_000):08}", f"CUSTOMER {draw.randrange(15_000):09}", draw.randrange(10_000, 50_000_000)) for k in range(n)], columns=["record_id", "day", "key", "name", "total"])
    paid = [(f"T{k}", 100 + k % 45, f"1NV{draw.randrange(9_000_000):08}", draw.randrange(15_000), draw.randrange(10_000, 50_000_000)) for k in range(m)]
    rows = [(t, day, ref, f"{ref} PAYMENTT0CUST0MER{party:09}{ref}", f"PAYMENT TO CUSTOMER {party:09} {ref[1:3]} {ref[3:]}", amount) if k % 9 else (t, day, "CASH7", "CASH7 CASHW1THDRAWAL", "CASH WITHDRAWAL", amount) for k, (t, day, ref, party, amount) in enumerate(paid)]
    right = pd.DataFrame(rows, columns=["other_id", "day", "ref", "body", "said", "paid"]).sort_values("day", kind="stable", ignore_index=True)
    return left, right


def test_few_pairs_of_a_crowded_window_are_scored():
    n, m, most = 40, 6000, 25
    left, right = _window(n, m)
    score = blocking._Indirect(right)
    lo, hi = np.zeros(n, dtype=np.int64), np.full(n, m)
    sizes, rows, got = nearby._reaching(score, score.bounds(left), left, np.arange(n), lo, hi, most, "score")
    assert sizes.sum() < n * m / 6
    every = score.pairs(left, np.repeat(np.arange(n), m), np.tile(np.arange(m), n))["score"].reshape(n, m)
    for k, (own, scores) in enumerate(zip(np.split(rows, np.cumsum(sizes)[:-1]), np.split(got["score"], np.cumsum(sizes)[:-1]), strict=True)):
        best = lambda at, s: sorted(zip((-s[~np.isnan(s)]).tolist(), at[~np.isnan(s)].tolist(), strict=True))[:most]
        assert best(own, scores) == best(np.arange(m), every[k])


def test_bounds_of_odd_rows_hold(monkeypatch):
    monkeypatch.setattr(blocking, "LEAST_BOUNDED", 1)
    draw = random.Random(5)
    number, party = lambda: draw.choice(["", "1NV00%02d" % draw.randint(0, 60), "1NV00%02d" % draw.randint(0, 60), "7", "ÄRGER", "X" * 70]), lambda: draw.choice(["ACME ONE", "ACME TWO", "ZETA", ""])
    for _ in range(5):
        left = pd.DataFrame([(f"R{k}", draw.randint(0, 80), number(), party(), draw.randint(0, 90_000)) for k in range(60)], columns=["record_id", "day", "key", "name", "total"])
        rows = [(f"T{k}", draw.randint(0, 80), ref := draw.choice([number(), "1NV0012ANDM0RE"]), f"{ref} {draw.choice(['', number() + 'T0', '1NV' + '9' * 600])}", draw.choice(["", f"TO {party()} 12"]), draw.randint(0, 90_000)) for k in range(90)]
        right = pd.DataFrame(rows, columns=["other_id", "day", "ref", "body", "said", "paid"])
        score = blocking._Indirect(right)
        bound, bounded = score.bounds(left), 0
        for i in range(60):
            most = bound.of(i, 0, 90)
            if most is None:
                continue
            made = score.pairs(left.iloc[[i]], np.zeros(90, dtype=np.int64), np.arange(90))["score"]
            bounded, real = bounded + 1, ~np.isnan(made)
            assert np.all(most[real] >= made[real] - nearby.SLACK)
            for least in (0.3, 0.5, 0.7):
                at = np.flatnonzero(most > least)
                closer = bound.closer(np.full(len(at), i), at, most[at], np.full(len(at), least))
                assert np.all(closer[real[at]] >= made[at][real[at]] - nearby.SLACK)
        assert bounded


def test_words_scored_once_for_many_texts():
    draw = random.Random(7)
    rows = [" ".join(draw.choice(["PAY", "TO", "ACME", "ZETA", "A1", "B22", "C", ""]) for _ in range(draw.randint(0, 5))) for _ in range(300)]
    sets, at = similarity.WordSets(rows), np.arange(0, 300, 3)
    for text in ["ACME A1", "ZETA", "", "PAY TO NOBODY", "B22 C ACME ZETA"]:
        assert sets.scores_of([text], [at], plain=True).tolist() == [similarity.token_set_ratio(text, rows[k]) for k in at]
