"""Each operator on rows with nulls in every column, repeats, an empty text, and columns named like its own."""

from __future__ import annotations

import pytest

from tallyforge.llm import ann, backoff_lm, fingerprint, gam, jaccard_join, langid, mixing, packing, pii, secrets

CLASH = ("key", "size", "n", "score", "spans", "fingerprint", "component_id", "copies", "held_out", "words", "target")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "some text with mail a.b@c.de and more words", "en", "s"), (1, None, None, None), (2, "", "en", None), (3, "same words said again and again here", "en", "s"), (3, "same words said again and again here", "en", "s"), (4, "andere worte stehen hier in dem text", "de", ""), (5, "same words said again and again here", None, "s"), (6, "x " * 3000, "de", "t")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], schema)


@pytest.mark.parametrize("operator", [pii.find_personal_data, fingerprint.edited_likeness, mixing.mix_copies, jaccard_join.jaccard_components, secrets.find_secrets], ids=lambda f: f.__name__)
def test_a_row_for_each(odd, operator):
    assert len(operator(odd).collect()) == 8


def test_stages_keep_columns(odd):
    for stage in (pii.redact, mixing.mix, jaccard_join.keep_one_of_each):
        out = stage(odd)
        assert out.columns == odd.columns and len(out.collect()) > 0


def test_models(spark, odd):
    assert len(langid.identify(odd, ["▁", "▁a", "a", "e", "s", "w", "o", "r", "d", "t", "x"]).collect()) == 8
    labels = spark.createDataFrame([(k, k % 2) for k in range(7)] + [(None, 1), (3, None)], "doc_id long, quality int")
    assert len(gam.train_and_score(odd, labels).collect()) == 8
    assert len(backoff_lm.train_and_score(odd).collect()) == 8


def test_packing_and_neighbours(spark, odd):
    public = pytest.importorskip("public_tokenizers")
    pieces = packing.pack(odd, open(public.path("word_bpe_49k.json"), encoding="utf-8").read()).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 2) == 1
    twice = [r for r in pieces if r["doc_id"] == 3]
    assert sum(r["length"] for r in twice) == 2 * twice[0]["doc_tokens"]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (3, [None, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
