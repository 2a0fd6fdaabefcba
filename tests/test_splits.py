"""Books made from a seed have the errors they say, and the evaluation of a split finds most of them."""

from __future__ import annotations

import json

import pytest

from tallyforge.plans import evaluation
from tallyforge.sources import generator


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("splits"))
    evaluation.write_splits(spark, path, {"test_a": 21}, 1600)
    return path


def test_counts_and_sameness(spark):
    made, again = generator.generate(spark, 21, 1600), generator.generate(spark, 21, 1600)
    assert {r["error_type"]: r["count"] for r in made["injected_errors"].groupBy("error_type").count().collect()} == generator.ERRORS and sum(generator.ERRORS.values()) == 463
    assert {r["challenge_type"]: r["count"] for r in made["match_challenges"].groupBy("challenge_type").count().collect()} == {"bulk": 14, "split": 25, "open": 40}
    assert made["invoices"].count() == 1630 and made["vendor_master"].count() == 35
    assert sorted(made["invoices"].collect()) == sorted(again["invoices"].collect()) != sorted(generator.generate(spark, 22, 1600)["invoices"].collect())


def test_answers_stay_apart(spark, root):
    raw = evaluation.load_split(spark, root)
    assert set(raw) == set(evaluation.TABLES) and not any(c.startswith("linked_") for df in raw.values() for c in df.columns)
    with pytest.raises(ValueError):
        evaluation.load_split(spark, root, "other")
    assert evaluation.load_split(spark, root, "test_a", "truth", ("links",))["links"].count() > 1000


def test_evaluation(spark, root, tmp_path):
    got = evaluation.run_evaluation(spark, root, str(tmp_path / "results"), ("test_a",))["datasets"]["test_a"]
    assert json.loads("".join(r[0] for r in spark.read.option("wholetext", True).text(str(tmp_path / "results")).collect()))["datasets"]["test_a"]["counts"] == got["counts"]
    assert got["counts"]["errors"] == 463 and got["issue_detection"]["recall"] > 0.9
    assert got["matching"]["model"]["recall"] > 0.95 and got["matching"]["model"]["recall"] > got["matching"]["naive_exact"]["recall"]
    assert got["many_to_many"]["tp"] >= 25 and got["matching"]["naive_exact"]["precision"] > 0.98
