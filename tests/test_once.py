"""What is worked out once, or at the same time, where it was worked out again and again."""

from __future__ import annotations

import threading
from datetime import date
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from tallyforge import catalog
from tallyforge.operators import blocking, pair_model


def test_labelling_joins_the_features_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    features = spark.createDataFrame([(f"R{k}", f"T{k}", float(k)) for k in range(20)], "record_id string, txn_id string, x double").withColumn("x", counted.asNondeterministic()("x"))
    inv = spark.createDataFrame([(f"R{k}", f"Vendor {k}") for k in range(20)], "record_id string, vendor string")
    links = spark.createDataFrame([(f"R{k}", f"T{k}") for k in range(9)], "record_id string, txn_id string")
    rows = pair_model.label_pairs(features, links, inv)
    assert sorted((r["record_id"], r["label"]) for r in rows.collect()) == sorted((f"R{k}", int(k < 9)) for k in range(20))
    assert rows.agg(F.sum("x")).first()[0] == 190 and seen.value == 20


def test_folds_are_fitted_at_the_same_time(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(12)], "x int, fold int")
    met = threading.Barrier(3)

    def fit(part):
        met.wait(30)
        return part.agg(F.sum("x")).first()[0]

    got = pair_model.out_of_fold(rows, fit, lambda model, part: part.withColumn("model", F.lit(model)))
    assert {(r["fold"], r["model"]) for r in got.collect()} == {(0, 48), (1, 44), (2, 40)}


def test_direct_pairs_are_sought_for_payments_without_a_match(spark, monkeypatch):
    inv = spark.createDataFrame([(f"R{k}", f"INV-{k:03}", "Acme", date(2026, 1, 1), Decimal(100), "purchase", "G", Decimal(18)) for k in range(4)], "record_id string, invoice_no string, vendor string, inv_date date, total decimal(18,2), document_type string, gstin string, tax decimal(18,2)")
    pay = spark.createDataFrame([(f"T{k}", date(2026, 1, 2), Decimal(100 + 50 * (k > 1)), f"for INV-{k:03}", "") for k in range(3)] + [("T9", date(2026, 1, 2), Decimal(7), "cash", "")], "txn_id string, pay_date date, amount decimal(18,2), narration string, reference string")
    led = spark.createDataFrame([], "entry_id string, account string, led_date date, debit decimal(18,2), credit decimal(18,2), reference string")
    fil = spark.createDataFrame([], "filing_id string, invoice_no string, supplier_name string, tax_amount decimal(18,2), filed boolean, supplier_gstin string")
    asked, plain = [], blocking.reference_pairs
    monkeypatch.setattr(blocking, "reference_pairs", lambda i, p, between="": asked.append({r["txn_id"] for r in p.select("txn_id").collect()}) or plain(i, p, between))
    matched = spark.createDataFrame([("R0", "T0"), ("R1", "T1")], "record_id string, txn_id string")
    found = catalog._missing(SimpleNamespace(inv=inv, pay=pay, led=led, fil=fil), matched)
    assert asked == [{"T2", "T9"}]
    assert [r["record_id"] for r in found.where("issue_type = 'payment_without_invoice'").collect()] == ["T9"]
