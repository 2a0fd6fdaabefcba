"""Base spans against a naive search, and a planted corpus whose further identifiers only contexts give away."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from tallyforge.llm import pii

RNG = np.random.default_rng(31)
WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "consetetur", "the", "and", "sadipscing", "elitr"]


def _prose(n):
    return " ".join(RNG.choice(WORDS, n))


def _luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed([int(c) for c in d]))) % 10 == 0


def _naive(text):
    """Base spans: Python's leftmost matches, tried at each place in turn, without possessive quantifiers."""
    strict = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, pattern) in enumerate(strict.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((rank, *m.span()))
    return sorted(out)


def _named(spans):
    return ",".join(f"{pii.KINDS[r]}:{a}:{b}" for r, a, b in spans)


def test_base_spans_are_the_naive_ones(spark):
    pieces = ["a.b@c.de", "@", ".", "x_1%@d-e.f.g", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.255", "1.2.3.4.5", "300.1.1.1", "+1 (017) 555-7713", "+44.", "+5 5", " ", "é", "1234567890123456789012", "-", "00001.2.3.4", "\n", "word"]
    texts = ["".join(RNG.choice(pieces, RNG.integers(1, 12))) for _ in range(600)] + [None, "", "1.2.3.4 " * 1500]
    got = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = _naive(t)
        assert got[i]["base_sha256"] == hashlib.sha256(_named(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(r == j for r, _, _ in want) for j in range(4)]
        assert set(filter(None, _named(want).split(","))) <= set(got[i]["spans"].split(","))


def _digits(n):
    return "".join(RNG.choice(list("0123456789"), n))


#: Contexts, a seed's form in them, and the form of further identifiers that no strict pattern matches.
PLANTED = [
    (3, "please ring me at {} any time", lambda: f"+1 ({_digits(3)}) 555-{_digits(4)}", lambda: f"020 {_digits(4)} {_digits(4)}"),
    (3, "phone={}; next", lambda: f"+49 {_digits(9)}", lambda: f"555-{_digits(3)}-{_digits(4)}"),
    (3, '"tel":"{}", "x": 1', lambda: f"+33 {_digits(9)}", lambda: f"({_digits(3)}) {_digits(3)}-{_digits(4)}"),
    (0, "write to {} for help", lambda: f"m{_digits(4)}@mail.example.org", lambda: f"m{_digits(4)}@localhost"),
    (1, "server address {} is down", lambda: f"10.{RNG.integers(255)}.{RNG.integers(255)}.7", lambda: f"fe80:{_digits(4)}:{_digits(3)}::1".replace("fe80", "2001")),
    (2, "paid with card {} today", lambda: "4111 1111 1111 1111", lambda: f"{_digits(4)} {_digits(4)} {_digits(4)}"),
]
DECOYS = ["in the year {} it rained", "order {} was shipped", "version 2.{}.1 is out", "chapter {} ends"]


@pytest.fixture(scope="module")
def planted():
    rows, cards = [], iter(_card() for _ in range(1000))
    for rank, context, seed, more in PLANTED:
        rows += [(f"{_prose(6)} {context.format(next(cards) if rank == 2 else seed())} {_prose(5)}", None, rank) for _ in range(25)]
        for _ in range(10):
            value = more()
            rows.append((f"{_prose(6)} {context.format(value)} {_prose(5)}", value, rank))
    rows += [(f"{_prose(6)} {d.format(_digits(8))} {_prose(5)}", None, None) for d in DECOYS for _ in range(15)]
    return rows


def _card():
    while True:
        d = "4" + _digits(15)
        if _luhn(d):
            return f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}"


def test_planted_identifiers(spark, planted):
    # a discovered one is marked where nothing else gives it away, too
    texts = [t for t, _, _ in planted] + [f"{_prose(3)} {v} {_prose(2)}" for _, v, _ in planted if v]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    hit = extra = asked = 0
    for i, (_, value, rank) in enumerate(planted):
        base = {(s["rank"], s["start"], s["end"]) for s in got[i]["base"]}
        added = [s for s in got[i]["spans"] if (s["rank"], s["start"], s["end"]) not in base]
        asked += value is not None
        hit += any(s["value"] == value and s["rank"] == rank for s in added)
        extra += sum(s["value"] != value for s in added)
    elsewhere = sum(any(s["value"] == v for s in got[len(planted) + i]["spans"]) for i, (_, v, _) in enumerate(x for x in planted if x[1]))
    assert hit >= 0.95 * asked and extra <= 0.02 * asked and elsewhere >= 0.95 * asked, (hit, extra, elsewhere, asked)
    assert pii.induced(pii._found(docs)).count() >= len(PLANTED)
    for r, t in zip(sorted(pii.redact(docs).collect()), texts, strict=True):
        out, at = "", 0
        for s in sorted(got[r["doc_id"]]["spans"], key=lambda s: (s["start"], s["end"], s["rank"])):
            if s["start"] >= at:
                out += t[at : s["start"]] + f"[{pii.KINDS[s['rank']].upper()}]"
            at = max(at, s["end"])
        assert r["text"] == out + t[at:]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"1.2.3.{i % 250}" for i in range(30_000))
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in r["base"] if s["rank"] == 1] == [m.span() for m in re.finditer(r"\S+", text)]


def test_clashing_columns_and_empty_table(spark):
    rows = [(1, "a.b@c.de", "k", 5, "s"), (2, None, "k", 5, "s"), (2, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, row int, __base string")
    got = pii.redact(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([(1, "[EMAIL]", "k", 5, "s"), *rows[1:]], key=str)
    assert pii.redact(docs.limit(0)).count() == 0 == pii.find_personal_data(docs.limit(0)).count()
