"""Withheld tax, the full reconciliation behind what is missing, the review store, numbering, ratios, families and streams."""

from __future__ import annotations

import random
from collections import deque
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import similarity
from tallyforge.operators import detect, lineage, matching, review
from tallyforge.sources import ingest
from tallyforge.streaming import events

INV = "record_id string, invoice_no string, document_type string, inv_date date, vendor string, gstin string, total decimal(18,2), tax decimal(18,2)"
PAY = "txn_id string, pay_date date, amount decimal(18,2), tds_withheld decimal(18,2), narration string, reference string"


@pytest.fixture(scope="module")
def books(spark):
    day = date(1996, 5, 1)
    inv = [(f"INVREC{i}", f"INV-00{i}", "purchase", day, f"{v} Pvt Ltd", "", Decimal(t), Decimal(0)) for i, v, t in ((1, "Acme", 100), (2, "Beta", 100), (3, "Gamma", 100), (4, "Gamma", 200), (5, "Delta", 70), (6, "Omega", 55))]
    pay = [
        ("T1", day, Decimal(90), Decimal(10), "Acme", "INV-001"), ("T2", day, Decimal(60), Decimal(0), "PART Beta INV-002", "INV-002"), ("T3", day, Decimal(35), Decimal(5), "PART Beta INV-002", "INV-002"),
        ("T4", day, Decimal(300), Decimal(0), "BULK Gamma INV-003 INV-004", "BULK1"), ("T5", day, Decimal(70), None, "Payment to Delta INV-005", ""), ("T9", day, Decimal(999), None, "Cash withdrawal", "CASH"),
    ]
    return spark.createDataFrame(inv, INV), spark.createDataFrame(pay, PAY)


def test_withheld_tax_counts(spark, books):
    inv, pay = books
    assert [tuple(r)[:2] for r in matching.exact_matches(inv, pay).collect()] == [("INVREC1", "T1")] == [tuple(r) for r in matching.baseline_matches(inv, pay).collect()]
    direct = spark.createDataFrame([("INVREC1", "T1"), ("INVREC2", "T2"), ("INVREC2", "T3")], "record_id string, txn_id string")
    assert detect.payment_amounts(inv, pay, direct).count() == 0
    assert {r["issue_type"] for r in detect.payment_amounts(inv, pay.withColumn("tds_withheld", F.lit(0)), direct).collect()} == {"short_payment"}


def test_missing_after_all_tiers(spark, books):
    inv, pay = books
    tiers = {r["tier"]: (sorted(r["record_ids"]), sorted(r["txn_ids"])) for r in matching.reconcile(inv, pay).collect()}
    assert tiers == {"exact": (["INVREC1"], ["T1"]), "split": (["INVREC2"], ["T2", "T3"]), "bulk": (["INVREC3", "INVREC4"], ["T4"]), "fuzzy": (["INVREC5"], ["T5"])}
    matched = matching.accepted(matching.reconcile(inv, pay))
    led = spark.createDataFrame([], "entry_id string, account string, led_date date, debit decimal(18,2), credit decimal(18,2), reference string")
    fil = spark.createDataFrame([], "filing_id string, invoice_no string, supplier_name string, supplier_gstin string, tax_amount decimal(18,2), filed boolean")
    direct = spark.createDataFrame([], "record_id string, txn_id string")
    found = {(r["issue_type"], r["record_id"]) for r in detect.missing(inv, pay, led, fil, matched, direct).collect()}
    assert {x for x in found if x[0] in ("missing_payment", "payment_without_invoice")} == {("missing_payment", "INVREC6"), ("payment_without_invoice", "T9")}
    assert not any(k == "missing_payment" for k, _ in {(r["issue_type"], 0) for r in detect.missing(inv, pay, led, fil, matched, direct, "1996-04-30").collect()})


def test_duplicates_without_a_tax_id_are_of_one_vendor(spark, books):
    inv, _ = books
    twice = inv.unionByName(inv.where("record_id IN ('INVREC1', 'INVREC2')").withColumn("record_id", F.concat("record_id", F.lit("X"))))
    assert {(r["record_id"], r["other_id"]) for r in detect.duplicate_invoices(twice).collect()} == {("INVREC1", "INVREC1X"), ("INVREC2", "INVREC2X")}


def test_first_detector_wins(spark, books):
    inv, _ = books
    a = detect._issue(inv.where("record_id = 'INVREC1'"), "missing_payment", "record_id", None, None, None, F.lit(1), severity=F.lit("Low"))
    b = detect._issue(inv.where("record_id = 'INVREC1'"), "missing_payment", "record_id", None, None, None, F.lit(2), severity=F.lit("High"))
    for first, second, want in ((a, b, 1), (b, a, 2)):
        rows = detect.finish(first.withColumn("detector", F.lit(0)).unionByName(second.withColumn("detector", F.lit(1)))).collect()
        assert [int(r["impact"]) for r in rows] == [want]


def test_payloads_come_back(spark, books):
    inv, _ = books
    issues = detect.finish(detect._issue(inv, "invalid_gstin", "record_id", None, F.lit('a "quoted" value'), F.lit(None).cast("string"), "total"))
    back = {r["issue_id"]: r for r in detect.from_payloads(detect.payloads(issues)).collect()}
    for r in issues.collect():
        got = back[r["issue_id"]]
        assert got["record_ids"] == [r["record_id"]] and got["rupee_impact"] == r["impact"] and got["evidence"] == {"expected": 'a "quoted" value'} and got["confidence"] == 0.95
    said = detect.explanations(issues).first()["explanation"]
    assert "flagged as invalid gstin" in said and "observed value is not available" in said and said.endswith(detect.FIXES["invalid_gstin"])


def test_review_store(spark, tmp_path):
    issues = spark.createDataFrame([("ISS-1",), ("ISS-2",)], "issue_id string")
    store = review.Store(spark, str(tmp_path / "log"))
    assert store.log().count() == 0
    store.open(issues, "2024-01-01 00:00:00")
    store.open(issues, "2024-01-02 00:00:00")  # known ones keep their status
    store.move("ISS-1", "Investigating", "ann", "2024-01-03 00:00:00")
    store.move("ISS-1", "Explained", "ann", "2024-01-04 00:00:00", "late invoice")
    store.note("ISS-1", " seen ", "bob", "2024-01-05 00:00:00")
    store.verdict("ISS-1", "accept", "bob", "2024-01-06 00:00:00")
    again = review.Store(spark, str(tmp_path / "log")).log()
    assert [r["action"] for r in review.audit(again, "ISS-1").collect()] == ["Feedback: accept", "Comment", "Explained", "Investigating", "Detected"]
    assert {r["issue_id"]: r["status"] for r in review.latest(again).collect()} == {"ISS-1": "Explained", "ISS-2": "Open"}
    assert [r["note"] for r in review.comments(again).collect()] == ["seen"] and [r["verdict"] for r in review.verdicts(again).collect()] == ["accept"]
    with pytest.raises(ValueError):
        store.move("ISS-2", "Resolved", "ann", "2024-01-07 00:00:00")


def test_inbox_and_pages(spark):
    rows = [(f"I{i:03}", "a" if i % 2 else "b", ("High", "Medium", "Low", "Other")[i % 4], "Open", Decimal(i), "Acme [x]" if i == 7 else "B.c") for i in range(60)]
    cases = spark.createDataFrame(rows, "issue_id string, issue_type string, severity string, status string, impact decimal(18,2), vendor string")
    assert [r["issue_id"] for r in review.inbox(cases, "ACME [X]").collect()] == ["I007"]
    got = [r["issue_id"] for k in (1, 2, 3) for r in review.page(review.inbox(cases, severities=["High", "Low", "Other"], types=["b"]), k, 10).collect()]
    want = sorted((r for r in rows if r[2] != "Medium" and r[1] == "b"), key=lambda r: (("High", "Medium", "Low", "Other").index(r[2]), -r[4], r[0]))
    assert got == [r[0] for r in want]


def test_numbers_follow_the_order(spark):
    rows = [(random.Random(i).randint(0, 10_000), i) for i in range(500)]
    got = ingest.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"]).orderBy("record_id").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows) and [r["record_id"] for r in got] == list(range(1, 501))


def test_components_against_a_search(spark):
    rng = random.Random(4)
    pairs = {(f"a{rng.randint(0, 60)}", f"b{rng.randint(0, 60)}") for _ in range(70)} | {(f"a{i}", f"b{i + 1}") for i in range(100, 160)} | {(f"a{i}", f"b{i}") for i in range(100, 161)}
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    part: dict = {}
    for start in sorted(near):
        if start not in part:
            part[start], todo = start, deque([start])
            while todo:
                for x in near[todo.popleft()] - part.keys():
                    part[x] = start
                    todo.append(x)
    got = {r["b"]: r["part"] for r in lineage.components(spark.createDataFrame(sorted(pairs), "a string, b string"), "a", "b").collect()}
    assert got.keys() == {b for _, b in pairs}
    for x in got:
        assert {y for y in got if got[y] == got[x]} == {y for y in got if part[y] == part[x]}


def test_weighted_ratio_and_header_mapping():
    assert similarity.weighted_ratio("Invoice Number", "Invoice Number") == 100 and similarity.weighted_ratio("", "a") == 0
    assert similarity.weighted_ratio("number invoice", "invoice number") == pytest.approx(95)
    assert similarity.weighted_ratio("total", "the total of the invoice") == pytest.approx(90)
    assert similarity.weighted_ratio("TOTAL", "total") == 0  # case counts
    assert ingest.suggest_mapping(["Unrelated", "invoice_no"], "invoices")["invoice_no"] == "invoice_no"


def test_stream_runs_to_its_end(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, "2024-01-0%d" % (i % 3 + 1), "x", float(i)) for i in range(k * 10, k * 10 + 10)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_folder(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
    got = {str(r["start"])[:10]: (r["n"], r["total"]) for r in events.run_to_end(events.windowed_sums(stream, late=None), "complete").collect()}
    assert got == {f"2024-01-0{d + 1}": (10, float(sum(i for i in range(30) if i % 3 == d))) for d in range(3)}
    assert events.run_to_end(events.first_seen(stream.select("event_id", "ts"), late="3 days")).count() == 30
