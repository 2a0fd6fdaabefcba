"""Sequences under three limits at once, where each of them binds; odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tallyforge.llm import packing

public = pytest.importorskip("public_tokenizers")
RNG = np.random.default_rng(53)
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH), open(PATH, encoding="utf-8").read()


def _packed(spark, tokenizer, rows, schema="doc_id long, text string, prompt_tokens long", **limits):
    """Rows of pieces by sequence, held to what must be true of any packing; and each sequence's tokens, segments and loss."""
    pieces = packing.pack(spark.createDataFrame(rows, schema).repartition(2), tokenizer[1], **limits).collect()
    ids = {r[0]: np.array([*tokenizer[0].encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    prompts = {r[0]: (r[2] or 0) if len(r) > 2 and "prompt_tokens" in schema else 0 for r in rows}
    seen = {d: np.zeros(len(x), int) for d, x in ids.items()}
    sequences: dict[int, list] = {}
    for r in pieces:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert all((x == 1).all() for x in seen.values())
    used = []
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        used.append((at, len(rs), sum(max(0, r["start"] + r["length"] - max(r["start"], prompts[r["doc_id"]])) for r in rs)))
    return used


def _text(n):
    return " ".join(RNG.choice(["alpha", "river", "the", "zeta", "of"], n))


def test_tokens_bind(spark, tokenizer):
    used = _packed(spark, tokenizer, [(i, _text(int(RNG.integers(5, 200))), None) for i in range(200)], tokens=256, segments=64, loss=256)
    assert all(t <= 256 and s <= 64 for t, s, _ in used)
    # padding is only where a partition ends, in sequences of powers of two
    assert all(t == 256 or t & (t - 1) == 0 for t, _, _ in used)


def test_segments_bind(spark, tokenizer):
    used = _packed(spark, tokenizer, [(i, _text(3), None) for i in range(400)], tokens=256, segments=8, loss=256)
    assert max(s for _, s, _ in used) == 8 and sum(s == 8 for _, s, _ in used) >= 40 and all(t < 256 for t, _, _ in used)


def test_loss_binds(spark, tokenizer):
    """Of documents with and without prompts, a sequence takes both kinds, as neither limit alone is met by one kind."""
    rows = [(i, _text(60), 0 if i % 2 else 50) for i in range(300)]
    used = _packed(spark, tokenizer, rows, tokens=512, segments=64, loss=256)
    assert all(t <= 512 and loss <= 256 for t, _, loss in used)
    least = max(sum(t for t, _, _ in used) / 512, sum(loss for _, _, loss in used) / 256)
    assert least == sum(loss for _, _, loss in used) / 256 and len(used) <= 1.15 * least
    assert sum(t == 512 and loss == 256 for t, _, loss in used) >= len(used) / 4


def test_all_three_limits(spark, tokenizer):
    rows = [(i, _text(int(RNG.integers(1, 120))), int(RNG.integers(0, 200))) for i in range(300)]
    assert all(t <= 300 and s <= 6 and loss <= 150 for t, s, loss in _packed(spark, tokenizer, rows, tokens=300, segments=6, loss=150))


def test_odd_rows(spark, tokenizer):
    rows = [(1, None, 3), (2, "", 4), (3, "x" * 30_000, 5), (4, _text(20_000), 6), (5, "a b", 7)]
    used = _packed(spark, tokenizer, rows, "doc_id long, text string, sequence_id long")
    assert max(t for t, _, _ in used) == 4096
    twice = spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string")
    assert sum(r["length"] for r in packing.pack(twice, tokenizer[1]).collect()) == 3 * (len(tokenizer[0].encode("a b", add_special_tokens=False).ids) + 1)
    assert packing.pack(twice.limit(0), tokenizer[1]).count() == 0
