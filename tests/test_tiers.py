"""Candidates, tiers, filings, outliers, the trained model, reports, archives and streams, against plain Python."""

from __future__ import annotations

import io
import random
import zipfile
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import similarity
from tallyforge.operators import blocking, detect, evaluate, isolation, matching, pair_model
from tallyforge.sources import ingest, reports
from tallyforge.streaming import events

INV = "record_id string, invoice_no string, inv_date date, vendor string, total decimal(18,2), document_type string, gstin string"
PAY = "txn_id string, pay_date date, amount decimal(18,2), narration string, reference string"


def invoice(record, number, total, vendor="Acme", day=date(2026, 1, 1)):
    return record, number, day, vendor, None if total is None else Decimal(total), "purchase", "27ABCDE1234F1Z0"


def test_windows_and_references(spark):
    rng = random.Random(3)
    inv = [(f"R{k}", f"INV-{k:03d}", date(2026, 1, 1) + timedelta(rng.randint(0, 200))) for k in range(40)] + [("R99", "INV-1", None)]
    pay = [(f"T{k}", None if k == 7 else date(2026, 1, 1) + timedelta(rng.randint(0, 200)), rng.choice(["", f"inv {k:03d}", "INV"]), f"for INV-{k % 40:03d}, thanks" if k % 3 else None) for k in range(60)]
    i, p = spark.createDataFrame(inv, "record_id string, invoice_no string, inv_date date"), spark.createDataFrame(pay, "txn_id string, pay_date date, reference string, narration string")
    want = {(r, t) for r, _, d in inv for t, x, _, _ in pay if d and x and abs((d - x).days) <= 45}
    assert {tuple(r) for r in blocking.window_pairs(i, p).collect()} == want
    counts = {r: sum(a == r for a, _ in want) for r, _ in want}
    assert {r["record_id"]: r["n"] for r in blocking.window_counts(i, p).collect()} == counts

    def norm(x):
        return "".join(c for c in (x or "").upper() if c.isalnum()).translate(str.maketrans("OI", "01"))

    for between in ("", " "):
        held = {(r, t) for r, n, _ in inv for t, _, ref, said in pay if norm(n) in norm(ref) + between + norm(said)}
        assert {tuple(r) for r in blocking.reference_pairs(i, p, between).collect()} == held


def test_reconcile_four_by_four(spark):
    inv = spark.createDataFrame([invoice("INVREC1", "INV-001", "100", "Acme"), invoice("INVREC2", "INV-002", "100", "Beta"), invoice("INVREC3", "INV-003", "100"), invoice("INVREC4", "INV-004", "200")], INV)
    d = date(2026, 1, 5)
    pay = spark.createDataFrame([("T1", d, Decimal(100), "Acme", "INV-001"), ("T2", d, Decimal(60), "Beta part", "INV-002"), ("T3", d, Decimal(40), "Beta part", "INV-002"), ("T4", d, Decimal(300), "Acme INV-003 INV-004", "BULK1")], PAY)
    got = matching.reconcile(inv, pay)
    assert {(r["tier"], tuple(r["record_ids"]), tuple(r["txn_ids"])) for r in got.collect()} == {("exact", ("INVREC1",), ("T1",)), ("split", ("INVREC2",), ("T2", "T3")), ("bulk", ("INVREC3", "INVREC4"), ("T4",))}
    assert matching.unmatched(inv.select("record_id"), got, "record_ids").count() == matching.unmatched(pay.select("txn_id"), got, "txn_ids").count() == 0
    truth = got.where("tier <> 'exact'").select("record_ids", "txn_ids")
    assert evaluate.group_accuracy(got, truth).first()["exact_group_accuracy"] == 1
    assert matching.reconcile(inv.limit(0), pay.limit(0)).count() == 0


def test_candidates_keep_best_and_direct(spark):
    inv = spark.createDataFrame([invoice("R1", "INV-001", "100"), invoice("R2", None, None, None)], INV)
    d = date(2026, 1, 3)
    pay = spark.createDataFrame([("A", d, Decimal(100), "Acme", ""), ("B", d, Decimal(90), "Acme", None), ("C", date(2027, 1, 1), Decimal(5), "note INV-001", None), ("D", d, Decimal(100), "Zulu", "9999999")], PAY)
    got = {(r["record_id"], r["txn_id"], r["direct"]) for r in blocking.candidates(inv, pay, 1).collect()}
    assert got == {("R1", "A", False), ("R1", "C", True)}
    row = blocking.features(spark.createDataFrame([("R2", "B"), ("R1", "A")], "record_id string, txn_id string"), inv, pay).orderBy("txn_id").collect()
    assert row[0]["vendor_name_similarity"] == 1 and row[0]["amount_abs_diff"] == 0 and row[1]["invoice_id_edit_distance"] == 999 and row[1]["amount_abs_diff"] == 90


def test_best_filings_against_all_pairs(spark):
    rng = random.Random(5)
    names, ids = ["Alpha Steel", "Alpha Steel Ltd", "Beta Foods", "Gamma"], ["27AAAAA0000A1Z5", "27BBBBB0000B1Z5"]
    inv = [(f"R{k:02d}", f"INV-{k % 20:03d}", "purchase", date(2026, 1, 1) + timedelta(rng.randint(0, 20)), rng.choice(names), Decimal(rng.randint(1, 5) * 100), Decimal(18), rng.choice(ids)) for k in range(30)]
    fil = [(f"F{k:02d}", rng.choice(inv)[1], rng.choice(inv)[3], rng.choice(names), Decimal(rng.randint(1, 5) * 100), Decimal(rng.choice([18, 30])), "2026-01", rng.choice(ids)) for k in range(25)]
    fil += [(f"G{k:02d}", r[1], r[3], r[4], r[5], Decimal(18), "2026-01", r[7]) for k, r in enumerate(inv[:8])]
    i = spark.createDataFrame(inv, "record_id string, invoice_no string, document_type string, inv_date date, vendor string, taxable_value decimal(18,2), tax decimal(18,2), gstin string")
    f = spark.createDataFrame(fil, "filing_id string, invoice_no string, invoice_date date, supplier_name string, taxable_value decimal(18,2), tax_amount decimal(18,2), filing_period string, supplier_gstin string")

    def norm(x):
        return x.upper().replace("-", "").translate(str.maketrans("OI", "01"))

    def name(x):
        return x.upper().removesuffix(" LTD")

    want = {}
    for r in inv:
        best = None
        for g in fil:
            gap = abs((r[3] - g[2]).days)
            a, b, same = similarity.ratio(norm(r[1]), norm(g[1])), similarity.token_set_ratio(name(r[4]), name(g[3])), r[7] == g[7]
            if gap <= 5 and (same or b >= 65 or a >= 70):
                score = 1.5 * a + b + max(0.0, 100 - 100 * abs(float(r[5] - g[4])) / float(r[5])) + 100 * same - 5 * gap
                if best is None or (-round(score, 9), g[0]) < best:
                    best = (-round(score, 9), g[0])
        if best:
            want[r[0]] = best[1]
    assert {r["record_id"]: r["filing_id"] for r in detect.best_filings(i, f).collect()} == want
    pairs = [(next(r for r in inv if r[0] == a), next(g for g in fil if g[0] == b)) for a, b in want.items()]
    plain = {"gstr2b_tax_mismatch": sum(r[6] != g[5] for r, g in pairs), "wrong_tax_period": 0, "invoice_id_mismatch": sum(r[1] != g[1] for r, g in pairs), "supplier_gstin_mismatch": sum(r[7] != g[7] for r, g in pairs), "vendor_name_mismatch": sum(similarity.token_set_ratio(name(r[4]), name(g[3])) < 75 for r, g in pairs)}
    assert plain["gstr2b_tax_mismatch"] and plain["invoice_id_mismatch"] and plain["vendor_name_mismatch"]
    kinds = [r["issue_type"] for r in detect.fuzzy_filings(i, f).collect()]
    assert {k: kinds.count(k) for k in plain} == plain


def test_isolation_table_equals_trees(spark):
    rng = np.random.default_rng(1)
    trees = [isolation.grow(rng.normal(size=64), rng, 6) for _ in range(20)]
    edges, lengths = isolation.merge(trees)
    for x in rng.normal(size=200) * 2:
        plain = np.mean([[p for s, p in t if x > s][-1] for t in trees])
        assert abs(lengths[np.searchsorted(edges, x, side="left")] - plain) < 1e-9
    rows = spark.createDataFrame([(f"R{k}", float(v)) for k, v in enumerate(np.abs(rng.normal(1000, 50, 300)))] + [("odd", 9e7), ("none", None)], "record_id string, total double")
    found = {r[0] for r in isolation.outliers(rows, "record_id", "total").collect()}
    assert "odd" in found and "none" in found and len(found) <= 7
    assert isolation.outliers(rows.limit(10), "record_id", "total").count() == isolation.outliers(rows.limit(0), "record_id", "total").count() == 0


def test_pair_model(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for k in range(240):
        good = k % 2
        rows.append((f"R{k}", f"T{k}", *[float(x) for x in (0.9 * good + rng.random() / 10, good, 0 if good else 9, good, 0.6 + 0.3 * good, rng.random() * 9, rng.random() * 0.1 if good else 0.5, rng.randint(0, 40), good, 1, 0, 0, 0)]))
    features = spark.createDataFrame(rows, "record_id string, txn_id string, " + ", ".join(f"{f} double" for f in blocking.FEATURES))
    inv = spark.createDataFrame([(f"R{k}", f"Vendor {k % 24}") for k in range(240)], "record_id string, vendor string")
    links = spark.createDataFrame([("R1|R3", "T1"), ("R3", "T3"), *[(f"R{k}", f"T{k}") for k in range(5, 240, 2)]], "record_id string, txn_id string")
    labelled = pair_model.label_pairs(features, links, inv, folds=3)
    assert labelled.where("label = 1").count() == 120
    model = pair_model.train(labelled, rounds=3)
    scored = pair_model.apply(model)(labelled)
    assert pair_model.metrics(scored)["recall_at_auto"] == pair_model.metrics(scored)["precision_at_auto"] == 1
    assert pair_model.metrics(pair_model.baseline(labelled))["pr_auc"] > 0.99
    assert pair_model.load(str(tmp_path / "none")) is None
    pair_model.save(model, str(tmp_path / "kept"), pair_model.metrics(scored))
    again = pair_model.apply(pair_model.load(str(tmp_path / "kept")))(labelled)
    assert again.join(scored.select("record_id", F.col("confidence").alias("c")), "record_id").where("abs(confidence - c) > 1e-9").isEmpty()
    with pytest.raises(ValueError):
        pair_model.label_pairs(features, links.limit(0), inv)


def test_scores_by_family(spark):
    issues = spark.createDataFrame([("1", "short_payment", ["A"]), ("2", "overpayment", ["A", "B"]), ("3", "invalid_gstin", ["C"]), ("4", "unknown_tax_rate", ["D"]), ("5", "missing_supplier_filing", ["E"])], "issue_id string, issue_type string, record_ids array<string>")
    truth = spark.createDataFrame([("amount_mismatch_small", ["A"]), ("amount_mismatch_large", ["B"]), ("invalid_gstin", ["X"]), ("supplier_not_filed", ["E"])], "label string, record_ids array<string>")
    got = {r["family"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.score_issues(issues, truth).collect()}
    assert got == {"payment_amount": (2, 0, 0), "invalid_gstin": (0, 1, 1), "other:unknown_tax_rate": (0, 1, 0), "supplier_not_filed": (1, 0, 0)}


def test_workbook_pdf_and_archives(spark, tmp_path):
    df = spark.createDataFrame([("a<b & c", 1.5, None), ("é", None, "x")], "name string, n double, note string")
    (tmp_path / "book.xlsx").write_bytes(reports.workbook({"Issues": df, "Liability": df.limit(0)}))
    assert [tuple(r) for r in reports.read_workbook(spark, str(tmp_path / "book.xlsx")).collect()] == [("a<b & c", "1.5", None), ("é", None, "x")]
    made = reports.pdf([f"line ({k})" for k in range(70)])
    assert made.startswith(b"%PDF") and made.count(b"/Type /Page ") == 2
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/invoices.csv", "﻿a,b\n1,é\n".encode())
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("ledger.csv", "a\n\xe9\n".encode("cp1252"))
    (tmp_path / "all.zip").write_bytes(outer.getvalue())
    found = ingest.zip_members(spark, str(tmp_path / "all.zip"), ["invoices.csv", "ledger.csv"])
    assert ingest.member_table(spark, found["invoices.csv"]).first().asDict() == {"a": "1", "b": "é"} and ingest.decode(found["ledger.csv"]) == "a\né\n"
    with pytest.raises(ValueError):
        ingest.zip_members(spark, str(tmp_path / "all.zip"), ["gone.csv"])
    assert not any(map(ingest.safe_member, ("/a", "../a", "a/../b", "c:x", "a\\b"))) and ingest.safe_member("a/b..csv")


def test_split_writer_and_lint(spark, tmp_path):
    bank = spark.createDataFrame([("T1", "R1")], "txn_id string, linked_invoice_record_id string")
    ingest.write_split({"bank_transactions": bank}, {}, str(tmp_path), {"clean": bank}, train=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "raw/bank_transactions")).columns == ["txn_id"] and not (tmp_path / "reference").exists()
    assert spark.read.option("header", True).csv(str(tmp_path / "truth/links")).first().asDict() == {"source_id": "T1", "invoice_record_id": "R1", "source_table": "bank_transactions"}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/bank.csv").write_text("txn_id,Error_Type\n1,x\n")
    (tmp_path / "bad/links.csv").write_text("a\n1\n")
    assert ingest.lint(spark, str(tmp_path / "bad")) == {"bank.csv": ["Error_Type"], "links.csv": ["links"]}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 01:00:00", "a", 1.0), (2, "2024-01-01 05:00:00", "a", 2.0), (2, "2024-01-01 05:00:00", "a", 2.0), (3, "2024-01-09 00:00:00", "a", 4.0)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_sums(events.first_seen(events.read_folder(spark, str(tmp_path / "in"), rows.schema)), None)
    q = stream.writeStream.format("memory").queryName("sums").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r["n"], r["total"]) for r in spark.table("sums").collect()] == [(2, 3.0)]
