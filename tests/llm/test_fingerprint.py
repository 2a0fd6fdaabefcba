"""Grades, features, digests and likeness against naive ones; the query against the definition of edited texts."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import fingerprint as fp
from tallyforge.llm.common import mix

RNG = np.random.default_rng(11)
WORDS = ["alpha", "of", "the", "river", "é", "zeta77", "Lorem", "x", "(quote)", "mountain", "again"]


def _text(n):
    return " ".join(RNG.choice(WORDS, max(1, n)).tolist())[:n] if n else ""


def _bytes(t):
    return np.frombuffer((t or "").encode(), np.uint8)


def _windows(t):
    b = (t or "").encode()
    b = b.ljust(fp.WINDOW, b"\0") if b else b
    return [b[i : i + fp.WINDOW] for i in range(len(b) - fp.WINDOW + 1)] if b else []


def _grade(w):
    total = sum(int(fp._F[c]) for c in Counter(w).values())
    return (int(fp._F[fp.WINDOW]) - total) * fp.GRADES // int(fp._F[fp.WINDOW])


def _key(w, ranks):
    h = np.array([0x51ED270B], np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, fp.WINDOW, 16):
            a, b = (np.array([int.from_bytes(w[at + k : at + k + 8], "little")], np.uint64) for k in (0, 8))
            h = mix((h ^ a) * np.uint64(0x9E3779B97F4A7C15) + b)
    return int(ranks[_grade(w)]) << 54 | int(h[0]) >> 10


def _features(t, ranks):
    keys = [_key(w, ranks) for w in _windows(t)]
    if not keys:
        return []
    run = min(fp.RUN, max(1, len(keys) // fp.RUNS))
    least = [min(keys[i : i + run]) for i in range(len(keys) - run + 1)]
    stretches = []
    for k in least:
        if stretches and stretches[-1][0] == k:
            stretches[-1][1] += 1
        else:
            stretches.append([k, 1])
    need = min(max(1, run // fp.POINTS), max(n for _, n in stretches))
    return list(dict.fromkeys(int(mix(np.array([k], np.uint64))[0]) for k, n in stretches if n >= need))


def _digest(t, ranks):
    f, chain = _features(t, ranks), []
    for low in range(0, len(f), fp.PER_FILTER):
        bits = {(h >> 11 * i) & (fp.BITS - 1) for h in f[low : low + fp.PER_FILTER] for i in range(fp.HASHES)}
        chain.append(bits)
    return chain


def _likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    best = []
    for x in a:
        each = []
        for y in b:
            most, chance = min(len(x), len(y)), len(x) * len(y) / fp.BITS
            floor = chance + fp.CHANCE * (most - chance)
            each.append(min(1, max(0, (len(x & y) - floor) / max(most - floor, 1e-9))) * math.sqrt(most / max(len(x), len(y))))
        best.append(max(each))
    return sum(v * len(x) for v, x in zip(best, a, strict=True)) / sum(map(len, a))


def _ranks(texts):
    counts = Counter(_grade(w) for t in texts for w in _windows(t))
    order = sorted(range(fp.GRADES + 1), key=lambda g: (counts.get(g) or math.inf, g))
    ranks = np.empty(fp.GRADES + 1, np.int32)
    ranks[order] = np.arange(fp.GRADES + 1)
    return ranks


def test_grades_do_not_depend_on_the_place():
    t = _bytes(_text(900))
    assert fp.entropy_grades(t).tolist() == [_grade(t[i : i + fp.WINDOW].tobytes()) for i in range(len(t) - fp.WINDOW + 1)]
    assert fp.entropy_grades(t[137:]).tolist() == fp.entropy_grades(t)[137:].tolist()


@pytest.mark.parametrize("n", [0, 1, 7, 15, 16, 17, 33, 60, 255, 256, 700, 9000])
def test_digest_is_the_naive_one(n):
    t = _text(n)
    ranks = _ranks([t, _text(400)])
    got = np.unpackbits(fp.fingerprint(_bytes(t), ranks), axis=1)
    assert [set(np.flatnonzero(row).tolist()) for row in got] == _digest(t, ranks)


@pytest.mark.parametrize(("a", "b"), [(255, 256), (256, 257), (31, 32), (500, 520), (1000, 1024)])
def test_no_length_changes_the_method(a, b):
    """The digests of a text and of one that is a little longer are near each other at every length."""
    near = []
    for _ in range(20):
        t = _text(b)
        ranks = _ranks([t])
        near.append(fp.likeness(fp.fingerprint(_bytes(t[:a]), ranks), fp.fingerprint(_bytes(t), ranks)))
    assert np.mean(near) > (0.85 if a > 100 else 0.0)


@pytest.mark.parametrize("rows_per_range", [3, 1000])
def test_query_against_brute_force(spark, rows_per_range):
    texts = {i: _text(int(n)) for i, n in enumerate([0, 3, 15, 16, 17, 31, 70, 90, 128, 200, 255, 256, 300, 800, 3000, 3000, 12000])}
    texts[15] = texts[14]
    texts[17] = None
    got = {r["doc_id"]: r for r in fp.edited_likeness(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), rows_per_range).collect()}
    ranks = _ranks(texts.values())
    order = sorted(texts, reverse=True)
    for d, following in zip(order, order[1:] + order[:1], strict=True):
        own, other = texts[d] or "", texts[following] or ""
        edited = own[: len(own) - len(own) // 3] + other[: len(own) // 3]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        digests = [_digest(t, ranks) for t in (own, edited, other)]
        assert r["near_edited"] == pytest.approx(_likeness(digests[0], digests[1])) and r["near_next"] == pytest.approx(_likeness(digests[0], digests[2]))
        for name, digest in (("fingerprint", digests[0]), ("edited_fingerprint", digests[1])):
            n, _, packed = r[name].partition(":")
            bits = np.unpackbits(np.frombuffer(__import__("base64").b64decode(packed), np.uint8)).reshape(int(n), fp.BITS)
            assert [set(np.flatnonzero(row).tolist()) for row in bits] == digest
    assert got[14]["fingerprint"] == got[15]["fingerprint"] and len(got) == len(texts)


def test_near_and_unrelated_texts_are_apart():
    texts = [" ".join(f"w{RNG.integers(4000)}" for _ in range(n)) for n in (15, 40, 120, 600, 3000) for _ in range(8)]
    ranks = _ranks(texts[:16])
    edits, apart = [], []
    for t, other in zip(texts, texts[1:] + texts[:1], strict=True):
        cut = len(t) // 3
        a = fp.fingerprint(_bytes(t), ranks)
        edits.append(fp.likeness(a, fp.fingerprint(_bytes(t[: len(t) - cut] + other[:cut]), ranks)))
        apart.append(fp.likeness(a, fp.fingerprint(_bytes(other), ranks)))
    assert min(edits) > 0.15 and max(apart) < 0.05


def test_empty_table_and_long_text(spark):
    assert fp.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "tau sigma " * 150_000
    rows = fp.edited_likeness(spark.createDataFrame([(1, long, 1), (2, long, 2), (2, "a", 3)], "doc_id long, text string, part int")).collect()
    assert len(rows) == 3 and len({r["fingerprint"] for r in rows}) == 2
