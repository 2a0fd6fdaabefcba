"""The corpus pipeline, stage by stage, against plain Python, and as a whole."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"aa": ["ka", "lo", "mi", "ra", "to", "ne", "su"], "bb": ["schr", "ung", "ein", "ver", "icht", "zw", "öh"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(90):
        lang = "aa" if k % 2 else "bb"
        text = " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(int(rng.integers(30, 120))))
        rows.append((k, text, lang, f"s{k % 3}" if k % 7 else None, len(text)))
    for k in range(90, 100):  # near copies: one word of one document changed
        words = rows[k - 90][1].split()
        words[-1] = "other"
        rows.append((k, " ".join(words), rows[k - 90][2], "s1", 1))
    rows += [(k, rows[20][1], rows[20][2], "s2", 1) for k in range(100, 104)]
    rows += [(104, None, "aa", "s0", 0), (105, "", "aa", None, 0), (106, "1234 5678 !!", "bb", "s0", 12)]
    rows.append((107, rows[31][1][::-1].replace("ot", "to") + " mail a.b@c.de or 10.0.0.1 now", "aa", "s0", 1))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def shingles(text):
    w = WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = before, [r.asDict() for r in docs.collect()]
        assert name == "packing" or docs.columns == columns

    before, after = kept["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {104, 105, 106}

    before, after = kept["jaccard_join"]
    sets, root = {r["doc_id"]: shingles(r["text"]) for r in before}, {r["doc_id"]: r["doc_id"] for r in before}
    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {d: new if r == old else r for d, r in root.items()}
    assert {r["doc_id"] for r in after} == set(root.values()) and len(after) < len(before)

    before, after = kept["pii"]
    texts = {r["doc_id"]: r["text"] for r in after}
    assert len(after) == len(before) and "[EMAIL]" in texts[107] and "[IP]" in texts[107] and "a.b@c.de" not in texts[107]
    assert all(texts[r["doc_id"]] == r["text"] for r in before if r["doc_id"] != 107)

    before, after = kept["mixing"]
    taken, text_of = Counter(r["doc_id"] for r in after), {r["doc_id"]: r["text"] for r in before}
    assert set(taken) <= set(text_of) and max(taken.values()) <= 3 and all(r["text"] == text_of[r["doc_id"]] for r in after)

    before, after = kept["packing"]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    ids = {d: np.array([*model.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in {r["doc_id"]: r["text"] for r in before}.items()}
    assert sum(r["length"] for r in after) == sum(len(ids[r["doc_id"]]) for r in before)
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in after)
    ends: dict[int, int] = {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096

    whole = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in whole) == Counter((r["doc_id"], r["start"], r["length"]) for r in after)
