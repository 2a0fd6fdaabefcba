"""The best pairs of a window, scored in cells, against scores made pair by pair."""

import random
import time
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tallyforge.functions import similarity
from tallyforge.operators import blocking, detect

INVOICE, PAYMENT = "record_id string, invoice_no string, vendor string, inv_date date, total decimal(18,2), document_type string", "txn_id string, pay_date date, amount decimal(18,2), tds_withheld decimal(18,2), narration string, reference string"


def test_many_pairs_at_once_as_one_by_one():
    draw = random.Random(3)
    word = lambda most, letters="AB01 é": "".join(draw.choice(letters) for _ in range(draw.randint(0, most)))
    pairs = [(word(12), word(40)) for _ in range(400)] + [(word(90), word(90)) for _ in range(60)] + [(word(4), word(700)) for _ in range(5)] + [("", ""), ("A", ""), ("A\0B", "\0")]
    for one, many in ((similarity.ratio, similarity.ratios), (similarity.partial_ratio, similarity.partial_ratios), (similarity.token_set_ratio, similarity.token_set_ratios)):
        assert many(pairs).tolist() == [one(*p) for p in pairs]
    rows = [word(12, "AB ") for _ in range(60)]
    sets = similarity.WordSets(rows)
    for text in [word(9, "ABC ") for _ in range(40)]:
        assert sets.scores(text, 7, 55).tolist() == [similarity.token_set_ratio(text, r) for r in rows[7:55]]


def _scores(inv: list[tuple], pay: list[tuple], most: int) -> dict:
    """Candidates by the definition, pair by pair."""
    norm = lambda x: "".join(c for c in (x or "").upper() if c.isalnum()).translate(str.maketrans("OI", "01"))
    words = lambda x: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (x or "").upper()).split())
    out = {}
    for record, number, vendor, day, total, _ in inv:
        own = []
        for txn, paid, amount, tds, told, reference in pay:
            key, ref, said, name = norm(number), norm(reference), words(told), words(vendor)
            body, gap = f"{ref} {norm(told)}", abs((paid - day).days) if day and paid else 9999
            direct = key != "" and key in body
            if day is None or not (direct or gap <= 45):
                continue
            alike = 1.0 if direct else 0.0 if not key else max(similarity.partial_ratio(key, body) / 100, similarity.ratio(key, ref) / 100 if ref else 0.0)
            named = 0.0 if direct or not name or not said else similarity.token_set_ratio(name, said) / 100
            if named * 100 >= 55 or alike >= 0.88:
                share = float(abs(abs(total or 0) - abs(amount or 0) - abs(tds or 0))) / max(float(abs(total or 0)), 1.0)
                own.append((-(0.45 * alike + 0.35 * named + 0.15 / (1 + share) + 0.05 * max(0.0, 1 - gap / 45)), txn, direct))
        own.sort()
        out |= {(record, t): (-s, d) for k, (s, t, d) in enumerate(own) if k < most or d}
    return out


def test_candidates_of_odd_rows(spark):
    draw = random.Random(5)
    day = lambda: draw.choice([None] + [date(2026, 1, 1) + timedelta(draw.randint(0, 200)) for _ in range(12)])
    number, party = lambda: draw.choice(["", None, "INV-%04d" % draw.randint(0, 60), "7", "Ärger-%d" % draw.randint(0, 3), "X" * 70]), lambda: draw.choice(["Acme One", "Acme Two", "Zeta", "", None])
    money = lambda: draw.choice([None, Decimal(draw.randint(-900, 900)) / 4])
    inv = [(f"R{k:03}", number(), party(), day(), money(), "purchase") for k in range(60)]
    pay = [(f"T{k:03}", day(), money(), draw.choice([None, Decimal(5)]), draw.choice(["", None, f"to {party()} {number()}", "INV 0" + "9" * 600]), draw.choice([number(), f"INV-00{draw.randint(0, 99)}-and-more"])) for k in range(90)]
    got = blocking.candidates(spark.createDataFrame(inv, INVOICE), spark.createDataFrame(pay, PAYMENT), 4).collect()
    want = _scores(inv, pay, 4)
    assert len(got) == len(want) and {(r["record_id"], r["txn_id"]): (r["score"], r["direct"]) for r in got} == want


def test_candidates_of_a_crowded_window_are_soon_found(spark):
    """4 million pairs of one week, of which each invoice keeps 25: no pair is made for the others."""
    n, began = 2000, time.time()
    rows = spark.range(n).withColumn("day", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 7).cast("int")))
    inv = rows.select(F.format_string("R%06d", "id").alias("record_id"), F.format_string("INV-%08d", F.col("id") * 7919).alias("invoice_no"), F.format_string("Customer#%09d", "id").alias("vendor"), F.col("day").alias("inv_date"), (F.col("id") * 3 + 900).cast("decimal(18,2)").alias("total"), F.lit("purchase").alias("document_type"))
    pay = rows.select(F.format_string("T%06d", "id").alias("txn_id"), F.col("day").alias("pay_date"), (F.col("id") * 5 + 800).cast("decimal(18,2)").alias("amount"), F.format_string("Payment to Customer#%09d INV-%08d", F.col("id") + 100_000, F.col("id") * 104_729 + 1).alias("narration"), F.lit("").alias("reference"))
    got = blocking.candidates(inv, pay).where("NOT direct").groupBy("record_id").count().toPandas()
    assert time.time() - began < 60
    assert len(got) == n and np.all(got["count"] == 25)


def test_filings_of_a_crowded_day_are_soon_found(spark):
    """9 million pairs of one day, none of which agrees in everything."""
    n, began = 3000, time.time()
    number = lambda prefix, c: F.format_string(f"{prefix}%08d", c)
    rows = spark.range(n).withColumns({"inv_date": F.lit("2026-01-01").cast("date"), "tax": F.lit(18).cast("decimal(18,2)"), "taxable_value": (F.col("id") + 100).cast("decimal(18,2)")})
    inv = rows.select(number("R", F.col("id")).alias("record_id"), number("INV-", F.col("id") * 7919).alias("invoice_no"), number("G", F.col("id")).alias("gstin"), number("Customer#", F.col("id")).alias("vendor"), F.lit("purchase").alias("document_type"), "inv_date", "tax", "taxable_value")
    fil = rows.select(number("F", F.col("id")).alias("filing_id"), number("INV-", F.col("id") * 7919).alias("invoice_no"), number("H", F.col("id")).alias("supplier_gstin"), number("Customer#", F.col("id")).alias("supplier_name"), F.col("inv_date").alias("invoice_date"), F.col("tax").alias("tax_amount"), "taxable_value", F.lit(True).alias("filed"), F.lit("2026-01").alias("filing_period"))
    got = detect.fuzzy_filings(inv, fil).toPandas()
    assert time.time() - began < 60
    assert len(got) == n and set(got["issue_type"]) == {"supplier_gstin_mismatch"} and np.all(got["record_id"].str[1:] == got["other_id"].str[1:])


def test_features_take_the_likenesses_of_the_window(spark):
    draw = random.Random(11)
    number, party = lambda: draw.choice(["", None, "INV-%04d" % draw.randint(0, 60), "7", "X" * 70]), lambda: draw.choice(["Acme One Ltd", "Acme Two", "Zeta", "", None])
    day = lambda: date(2026, 1, 1) + timedelta(draw.randint(0, 90))
    inv = spark.createDataFrame([(f"R{k:03}", number(), party(), day(), Decimal(draw.randint(1, 900)), "purchase") for k in range(40)], INVOICE)
    pay = spark.createDataFrame([(f"T{k:03}", day(), Decimal(draw.randint(1, 900)), None, draw.choice(["", None, f"to {party()} {number()}"]), draw.choice([None, "", number(), f"INV-00{draw.randint(0, 99)}-and-more"])) for k in range(50)], PAYMENT)
    scored = blocking.scored_candidates(inv, pay, 4).localCheckpoint()
    known, plain = (sorted(map(tuple, blocking.features(p, inv, pay).collect())) for p in (scored, scored.select("record_id", "txn_id")))
    assert known == plain and scored.where("NOT direct AND told IS NOT NULL").count() > 40 and not scored.where("direct").isEmpty()
