"""Facts of the reconciliation operators on small fixtures."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import similarity, text
from tallyforge.operators import detect, evaluate, liability, matching, review
from tallyforge.sources import ingest


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_scalars(spark):
    assert one(spark, text.norm_identifier(F.lit(" inv-O1-42 "))) == "1NV0142"
    assert one(spark, text.norm_vendor(F.lit("ACME Pvt. Limited"))) == "ACME"
    assert one(spark, text.norm_identifier(F.lit(None).cast("string"))) == ""
    digit = one(spark, text.check_digit(F.lit("27ABCDE1234F1Z")))
    assert one(spark, text.gstin_valid(F.lit("27ABCDE1234F1Z" + digit)))
    assert not one(spark, text.gstin_valid(F.lit("27ABCDE1234F1Z" + ("A" if digit != "A" else "B"))))
    assert not one(spark, text.gstin_valid(F.lit("27ABCDE1234F1Z" + digit + "0")))
    assert one(spark, text.state_from_gstin(F.lit("27ABCDE1234F1Z" + digit))) == "Maharashtra"
    assert one(spark, text.money(F.lit("₹1,000.50"))) == Decimal("1000.50")


def test_similarity_against_plain_subsequences():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert similarity.lcs_length(a, b) == lcs(a, b)
    assert similarity.ratio("", "") == 100 and similarity.token_set_ratio("a b", "b a c") == 100 and similarity.token_set_ratio("", "a") == 0
    assert similarity.partial_ratio("inv1", "pay inv1 now") == 100


def test_subset_sum_and_mutual_best(spark):
    assert matching.subset_sum([6000, 4000, 1700], 10000, 2, 3) == [0, 1]
    assert matching.subset_sum([5, 5], 11, 2, 3) is None
    rng = random.Random(2)
    edges = sorted({(f"i{rng.randint(0, 9)}", f"p{rng.randint(0, 9)}") for _ in range(40)})
    rows = [(i, p, rng.randint(60, 99) / 100) for i, p in edges]
    want, a, b = set(), set(), set()
    for i, p, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if i not in a and p not in b:
            want.add((i, p))
            a.add(i)
            b.add(p)
    got = matching.mutual_best(spark.createDataFrame(rows, "record_id string, txn_id string, confidence double"))
    assert {(r["record_id"], r["txn_id"]) for r in got.collect()} == want


def test_duplicates_and_tax(spark):
    schema = "record_id string, invoice_no string, document_type string, inv_date date, vendor string, party_state string, hsn string, taxable_value decimal(18,2), tax_rate_pct decimal(5,2), tax decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), igst decimal(18,2), total decimal(18,2), gstin string"
    digit = one(spark, text.check_digit(F.lit("27ABCDE1234F1Z")))
    m = lambda x: Decimal(x)
    base = lambda r, n, d, c, s, i: (r, n, "purchase", d, "Acme", "Maharashtra", "9999", m("100.00"), m("18.00"), m("18.00"), m(c), m(s), m(i), m("118.00"), "27ABCDE1234F1Z" + digit)
    inv = spark.createDataFrame([base("R1", "INV-001", date(2026, 1, 1), "9.00", "9.00", "0.00"), base("R2", "INV-001A", date(2026, 1, 3), "0.00", "0.00", "18.00")], schema)
    rates = spark.createDataFrame([("9999", m("18.00"), date(2017, 7, 1), None, 1)], "hsn string, rate decimal(5,2), valid_from date, valid_to date, pos int")
    dup = detect.duplicate_invoices(inv).collect()
    assert [(r["issue_type"], r["impact"]) for r in dup] == [("duplicate_near", m("118.00"))]
    assert [(r["issue_type"], r["record_id"]) for r in detect.tax_issues(inv, rates, "Maharashtra").collect()] == [("wrong_tax_split", "R2")]


def test_interest_and_review(spark):
    due = spark.createDataFrame([(Decimal("10000.00"), date(2026, 1, 1), date(2026, 1, 31))], "amount decimal(18,2), from_date date, to_date date")
    r = liability.interest_and_penalty(due).first()
    assert (r["days"], r["interest"]) == (30, Decimal("147.95"))
    log = spark.createDataFrame([], review.SCHEMA)
    log = log.unionByName(review.detected(log, spark.createDataFrame([("A",)], "issue_id string"), "2026-01-01"))
    with pytest.raises(ValueError):
        review.transition(log, "A", "Resolved", "me", "2026-01-02")
    log = review.transition(log, "A", "Investigating", "me", "2026-01-02")
    log = review.comment(log, "A", "seen", "me", "2026-01-03")
    assert review.latest(log).first()["status"] == "Investigating"
    assert [r["action"] for r in review.audit(log, "A").collect()] == ["Comment", "Investigating", "Detected"]


def test_ingest_and_scoring(spark):
    assert ingest.table_type(["Invoice Number", "Invoice Date", "Vendor", "Supplier GSTIN", "Invoice Total"]) == "invoices"
    raw = spark.createDataFrame([("inv-O1", "2026-01-01", "Example Ltd", "1,000")], ["Invoice Number", "Invoice Date", "Vendor", "Taxable Amount"])
    got = ingest.standardize(raw, "invoices", ingest.suggest_mapping(raw.columns, "invoices")).first()
    assert (got["invoice_no"], got["vendor_customer_name"], got["taxable_value"], got["record_id"]) == ("1NV01", "EXAMPLE", Decimal("1000.00"), "UPINV000001")
    with pytest.raises(ValueError):
        ingest.assert_safe({"x": spark.createDataFrame([(1,)], ["linked_payment_id"])})
    issues = spark.createDataFrame([("1", "short_payment", ["INV1"]), ("2", "short_payment", ["INV1"])], "issue_id string, issue_type string, record_ids array<string>")
    truth = spark.createDataFrame([("amount_mismatch_small", ["INV1"])], "label string, record_ids array<string>")
    r = evaluate.score_issues(issues, truth, {"amount_mismatch_small": ["short_payment", "overpayment"]}).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 0)


def test_import_without_text_operators():
    import __spark_entry__ as entry

    assert "q_missing_payment_by_period" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
