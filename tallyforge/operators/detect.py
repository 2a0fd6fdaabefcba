"""Typed discrepancies. Each detector gives rows of COLUMNS; finish() adds ids, and severity and confidence where they are null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.functions.similarity import WORD, Texts, WordSets, lcs_of_masks, ratio_udf, ratios
from tallyforge.operators import isolation
from tallyforge.operators.lineage import checkpointed
from tallyforge.operators.matching import paid
from tallyforge.operators.nearby import best_nearby, day_number
from tallyforge.plans.domain import HOME_STATE

TOLERANCE = 1
#: Items later than this may still be open.
OPEN_AFTER = "1998-06-30"
COLUMNS = ["issue_type", "record_id", "other_id", "expected", "actual", "impact", "vendor", "severity", "confidence"]
HIGH = ("short_payment", "overpayment", "ledger_amount_mismatch", "gstr2b_tax_mismatch", "supplier_gstin_mismatch", "duplicate_exact", "duplicate_near", "duplicate_payment", "missing_payment", "missing_supplier_filing", "missing_ledger_entry", "supplier_not_filed", "in_gstr2b_not_in_books", "wrong_tax_rate", "miscalculated_tax", "wrong_tax_split", "invoice_total_mismatch", "invalid_gstin")


def _issue(df: DataFrame, kind, record: str, other: str | None = None, expected=None, actual=None, impact=None, vendor: str = "vendor", severity: Column | None = None, confidence: Column | None = None) -> DataFrame:
    text_of = lambda c: (F.lit(None) if c is None else c if isinstance(c, Column) else F.col(c)).cast("string")
    cents = F.lit(0) if impact is None else impact if isinstance(impact, Column) else F.col(impact)
    return df.select((kind if isinstance(kind, Column) else F.lit(kind)).alias("issue_type"), F.col(record).alias("record_id"), (F.col(other) if other else F.lit(None).cast("string")).alias("other_id"), text_of(expected).alias("expected"), text_of(actual).alias("actual"), cents.cast("decimal(18,2)").alias("impact"), F.col(vendor).alias("vendor"), (F.lit(None) if severity is None else severity).cast("string").alias("severity"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"))


def keyed(inv: DataFrame) -> DataFrame:
    return inv.withColumns({"key": text.norm_identifier(F.col("invoice_no")), "tax_id": text.norm_tax_id(F.col("gstin"))})


def effective_rates(inv: DataFrame, rates: DataFrame) -> DataFrame:
    """inv with the rate in force on the invoice's date for its HSN (leading zeros dropped); the first of several, null if none."""
    r = rates.select(text.hsn_key(F.col("hsn")).alias("r_hsn"), "rate", "valid_from", F.coalesce("valid_to", F.lit("2100-01-01").cast("date")).alias("valid_to"), "pos")
    hit = inv.join(F.broadcast(r) if rates.count() <= 100_000 else r, (text.hsn_key(F.col("hsn")) == F.col("r_hsn")) & F.col("inv_date").between(F.col("valid_from"), F.col("valid_to")))
    first = hit.groupBy("record_id").agg(F.min_by("rate", "pos").alias("rate"))
    return inv.join(first, "record_id", "left")


def payment_amounts(inv: DataFrame, pay: DataFrame, direct: DataFrame) -> DataFrame:
    """Payments before the invoice; and short and over-payment by the largest group of payments of one reference, withheld tax included."""
    p = pay.select("txn_id", "pay_date", paid(pay).alias("settled"), text.norm_identifier(F.col("reference")).alias("ref"))
    met = direct.join(inv.select("record_id", "inv_date", "total", "vendor"), "record_id").join(p, "txn_id")
    early = _issue(met.where("pay_date < inv_date"), "payment_before_invoice", "record_id", "txn_id", "inv_date", "pay_date")
    groups = met.where("NOT contains(ref, 'BULK')").groupBy("record_id", "ref", "total", "vendor").agg(F.sum("settled").alias("paid"), F.count("*").alias("n"))
    best = groups.withColumn("rn", F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("n").desc(), "ref"))).where("rn = 1")
    gap = F.col("total") - F.col("paid")
    off = _issue(best.where(F.abs(gap) > TOLERANCE), F.when(gap > 0, "short_payment").otherwise("overpayment"), "record_id", None, "total", "paid", F.abs(gap))
    return early.unionByName(off)


def ledger_mismatches(inv: DataFrame, led: DataFrame) -> DataFrame:
    """Amount and date differences to the likeliest ledger entry: of the same reference, or else of the same amount.

    An entry of the same amount counts if its reference is like the invoice's number (a ratio of 65) or its date
    within three days; of several the one whose ratio less the days apart is largest.
    """
    e = led.select("entry_id", "led_date", (F.abs("debit") + F.abs("credit")).alias("booked"), text.norm_identifier(F.col("reference")).alias("ref"), F.col("reference").alias("raw"))
    i = keyed(inv).select("record_id", "invoice_no", "key", "inv_date", "total", "vendor")
    by_ref = i.where("key <> ''").join(e, F.col("key") == F.col("ref"))
    rest = i.join(by_ref.select("record_id").distinct(), "record_id", "left_anti")
    gap = text.day_gap(F.col("led_date"), F.col("inv_date"))
    like = F.when((F.col("key") == "") | (F.col("ref") == ""), 0.0).otherwise(ratio_udf("key", "ref"))
    by_money = rest.join(e, F.col("total") == F.col("booked")).withColumn("like", like).where((F.col("like") >= 65) | (gap <= 3))
    both = by_ref.withColumns({"like": F.lit(100.0), "by_ref": F.lit(1)}).unionByName(by_money.withColumn("by_ref", F.lit(0)))
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy("record_id").orderBy((F.col("like") - gap).desc(), "entry_id"))).where("rn = 1")
    return _issue(best.where("by_ref = 0"), "invoice_id_mismatch", "record_id", "entry_id", "invoice_no", "raw").unionByName(_issue(best.where(F.abs(F.col("total") - F.col("booked")) > TOLERANCE), "ledger_amount_mismatch", "record_id", "entry_id", "total", "booked", F.abs(F.col("total") - F.col("booked")))).unionByName(_issue(best.where(gap > 1), "ledger_date_gap", "record_id", "entry_id", "inv_date", "led_date"))


def filing_mismatches(inv: DataFrame, fil: DataFrame) -> DataFrame:
    """Tax and period differences between a purchase and the filing of its number and tax id."""
    f = fil.select("filing_id", "tax_amount", "filing_period", text.norm_identifier(F.col("invoice_no")).alias("key"), text.norm_tax_id(F.col("supplier_gstin")).alias("tax_id"))
    both = keyed(inv).where("document_type = 'purchase'").join(f, ["key", "tax_id"])
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy("record_id").orderBy("filing_id"))).where("rn = 1")
    period = F.date_format("inv_date", "yyyy-MM")
    off = F.abs(F.col("tax") - F.col("tax_amount"))
    return _issue(best.where(off > TOLERANCE), "gstr2b_tax_mismatch", "record_id", "filing_id", "tax", "tax_amount", off).unionByName(_issue(best.where(period != F.col("filing_period")), "wrong_tax_period", "record_id", "filing_id", period, "filing_period"))


def best_filings(inv: DataFrame, fil: DataFrame, days: int = 5) -> DataFrame:
    """Each dated purchase with the filing most like it within so many days: of its tax id, a like vendor or a like number.

    A filing of the same day that agrees in number, tax id, vendor and taxable value has the highest score there
    is, so an equi-join settles such purchases; only the others are compared with all filings of their days, in cells
    that give the best of each and make no row for the rest.
    """
    i = keyed(inv).where("lower(coalesce(document_type, 'purchase')) = 'purchase' AND inv_date IS NOT NULL").select("record_id", "invoice_no", "key", "tax_id", "inv_date", "tax", "taxable_value", "vendor", text.norm_vendor(F.col("vendor")).alias("name"))
    f = fil.where("invoice_date IS NOT NULL").select("filing_id", F.col("invoice_no").alias("filed_no"), "invoice_date", "tax_amount", "filing_period", "supplier_name", text.norm_identifier(F.col("invoice_no")).alias("f_key"), text.norm_tax_id(F.col("supplier_gstin")).alias("f_tax_id"), F.col("taxable_value").alias("f_taxable"), text.norm_vendor(F.col("supplier_name")).alias("f_name"))
    same = (F.col("key") == F.col("f_key")) & (F.col("tax_id") == F.col("f_tax_id")) & (F.col("name") == F.col("f_name")) & (F.col("taxable_value") == F.col("f_taxable")) & (F.col("inv_date") == F.col("invoice_date"))
    settled = i.where("key <> '' AND name <> ''").join(f, same).withColumns({"id_score": F.lit(100.0), "name_score": F.lit(100.0), "score": F.lit(450.0)})
    rest = checkpointed(i.join(settled.select("record_id").distinct(), "record_id", "left_anti"))
    money = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    left = rest.select("record_id", day_number("inv_date").alias("day"), "key", "tax_id", "name", money("taxable_value").alias("taxable"))
    right = f.select(F.col("filing_id").alias("other_id"), day_number("invoice_date").alias("day"), "f_key", "f_tax_id", "f_name", money("f_taxable").alias("f_taxable"))
    near = checkpointed(best_nearby(left, right, days, 1, _filed_alike, ("score", "id_score", "name_score")))
    near = rest.join(near.withColumnRenamed("other_id", "filing_id"), "record_id").join(f, "filing_id")
    best = settled.unionByName(near.select(*settled.columns))
    return best.withColumn("rn", F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("score").desc(), "filing_id"))).where("rn = 1").drop("rn")


def _filed_alike(r: pd.DataFrame):
    """For best_nearby: the likeness of a purchase to filings, NaN where neither tax id nor vendor nor number is alike."""
    keys = r["f_key"].tolist()
    day, tax_id, taxable, key, name = r["day"].to_numpy(), r["f_tax_id"].to_numpy(dtype=object), r["f_taxable"].to_numpy(), Texts(keys), WordSets(r["f_name"].tolist())

    def score(row, lo: int, hi: int) -> dict[str, np.ndarray]:
        n, ids, names = len(row.key), np.zeros(hi - lo), name.scores(row.name, lo, hi)
        if n > WORD or "\0" in row.key:
            ids = np.where(key.lengths[lo:hi] > 0, ratios([(row.key, k) for k in keys[lo:hi]]), 0.0)
        elif n:
            ids = 200.0 * lcs_of_masks(key.masks(row.key, slice(lo, hi)), n) / (n + key.lengths[lo:hi])
            if len(odd := np.flatnonzero(key.odd[lo:hi])):
                ids[odd] = ratios([(row.key, keys[lo + k]) for k in odd])
        same = tax_id[lo:hi] == row.tax_id
        amount = np.maximum(0.0, 100 - 100 * np.abs(row.taxable - taxable[lo:hi]) / max(abs(row.taxable), 1.0))
        made = 1.5 * ids + names + amount + np.where(same, 100, 0) - 5 * np.abs(day[lo:hi] - row.day)
        return {"score": np.where(same | (names >= 65) | (ids >= 70), made, np.nan), "id_score": ids, "name_score": names}

    return score


def fuzzy_filings(inv: DataFrame, fil: DataFrame, days: int = 5) -> DataFrame:
    """Differences of tax, period, number, vendor and tax id between a purchase and the filing most like it: one pass, an array of what differs, exploded."""
    period, off = F.date_format("inv_date", "yyyy-MM"), F.abs(F.coalesce("tax", F.lit(0)) - F.coalesce("tax_amount", F.lit(0)))
    row = lambda when, kind, expected, got, impact=None: F.when(when, F.struct(F.lit(kind).alias("kind"), expected.cast("string").alias("expected"), got.cast("string").alias("actual"), (F.lit(0) if impact is None else impact).cast("decimal(18,2)").alias("impact")))
    found = F.array_compact(F.array(
        row(off > TOLERANCE, "gstr2b_tax_mismatch", F.col("tax"), F.col("tax_amount"), off), row(~period.eqNullSafe(F.col("filing_period")), "wrong_tax_period", period, F.col("filing_period")),
        row(text.norm_tax_id(F.col("invoice_no")) != text.norm_tax_id(F.col("filed_no")), "invoice_id_mismatch", F.col("invoice_no"), F.col("filed_no")), row(F.col("name_score") < 75, "vendor_name_mismatch", F.col("vendor"), F.col("supplier_name")),
        row(F.col("tax_id") != F.col("f_tax_id"), "supplier_gstin_mismatch", F.col("tax_id"), F.col("f_tax_id"), F.col("tax")),
    ))
    each = best_filings(inv, fil, days).select("record_id", "filing_id", "vendor", F.explode(found).alias("x"))
    return _issue(each.select("record_id", "filing_id", "vendor", "x.*"), F.col("kind"), "record_id", "filing_id", "expected", "actual", "impact")


def duplicate_invoices(inv: DataFrame, days: int = 3, least: float = 75.0) -> DataFrame:
    """Pairs of one tax id, or without one of one vendor, whose totals differ by at most 1.00: exact by number, near by date and likeness.

    Totals meet in buckets of 1.00 and their neighbours, so that a vendor's invoices aren't all paired.
    """
    party = F.coalesce(F.nullif("tax_id", F.lit("")), F.concat(F.lit("v:"), text.norm_vendor(F.col("vendor"))))
    k = keyed(inv).withColumn("tax_id", party).select("record_id", "key", "tax_id", "inv_date", "total", "vendor", F.floor("total").cast("long").alias("bucket"))
    a = k.withColumn("bucket", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])))
    b = k.select(*[F.col(c).alias(f"o_{c}") for c in k.columns])
    pairs = a.join(b, (a.tax_id == b.o_tax_id) & (a.bucket == b.o_bucket)).where((F.col("record_id") < F.col("o_record_id")) & (F.abs(F.col("total") - F.col("o_total")) <= TOLERANCE))
    impact = F.least("total", "o_total")
    exact = _issue(pairs.where("key = o_key"), "duplicate_exact", "record_id", "o_record_id", None, None, impact)
    close = pairs.where((F.col("key") != F.col("o_key")) & (F.abs(F.date_diff("inv_date", "o_inv_date")) <= days)).where(ratio_udf("key", "o_key") >= least)
    return exact.unionByName(_issue(close, "duplicate_near", "record_id", "o_record_id", None, None, impact))


def duplicate_payments(pay: DataFrame, days: int = 10) -> DataFrame:
    """Pairs of payments of one reference, amount and sign, at most so many days apart, that are no part payments."""
    p = pay.select("txn_id", "pay_date", "amount", text.norm_identifier(F.col("reference")).alias("ref"), F.col("narration").alias("vendor")).where("ref <> '' AND NOT contains(ref, 'PART')")
    q = p.select(F.col("txn_id").alias("o_id"), F.col("pay_date").alias("o_date"), "amount", "ref")
    return _issue(p.join(q, ["ref", "amount"]).where((F.col("txn_id") < F.col("o_id")) & (F.abs(F.date_diff("pay_date", "o_date")) <= days)), "duplicate_payment", "txn_id", "o_id", None, None, F.abs("amount"))


def missing(inv: DataFrame, pay: DataFrame, led: DataFrame, fil: DataFrame, matched: DataFrame, direct: DataFrame, open_after: str = OPEN_AFTER) -> DataFrame:
    """Anti-joins between books, bank, ledger and filings. matched: accepted (record_id, txn_id)."""
    i = keyed(inv)
    unpaid = i.where((F.col("inv_date").isNull()) | (F.col("inv_date") <= F.lit(open_after).cast("date"))).join(matched.select("record_id").distinct(), "record_id", "left_anti")
    f = fil.select("filing_id", "invoice_no", "supplier_name", "tax_amount", "filed", text.norm_identifier(F.col("invoice_no")).alias("key"), text.norm_tax_id(F.col("supplier_gstin")).alias("tax_id"))
    unfiled = i.where("document_type = 'purchase'").join(f.select("key", "tax_id"), ["key", "tax_id"], "left_anti")
    e = led.select("entry_id", "account", "led_date", (F.abs("debit") + F.abs("credit")).alias("booked"), text.norm_identifier(F.col("reference")).alias("key"))
    unbooked = i.where("key <> ''").join(e.select("key"), "key", "left_anti")
    # no entry of about the amount within three days: amounts meet in buckets of 1.00, days one by one
    spots = e.select(F.floor("booked").cast("long").alias("bucket"), F.col("led_date").alias("day"), "booked")
    looks = unbooked.select("record_id", "total", "inv_date", F.explode(F.array(*[F.floor("total").cast("long") + d for d in (-1, 0, 1)])).alias("bucket")).withColumn("day", F.explode(F.expr("transform(sequence(-3, 3), d -> date_add(inv_date, d))")))
    near = looks.join(spots, ["bucket", "day"]).where(F.abs(F.col("total") - F.col("booked")) <= TOLERANCE).select("record_id")
    unbooked = unbooked.join(near, "record_id", "left_anti")
    stray = pay.join(matched.select("txn_id"), "txn_id", "left_anti").join(direct.select("txn_id"), "txn_id", "left_anti").withColumn("size", F.abs("amount"))
    sourceless = e.join(i.where("key <> ''").select("key").distinct(), "key", "left_anti")
    first = i.groupBy("key", "tax_id").agg(F.min_by(F.struct("record_id", "vendor", "tax"), "record_id").alias("x"))
    late = f.where("NOT filed").join(first, ["key", "tax_id"]).select("filing_id", "x.record_id", "x.vendor", "x.tax")
    extra = f.join(i.select("key", "tax_id"), ["key", "tax_id"], "left_anti")
    parts = [
        _issue(unpaid, "missing_payment", "record_id", None, None, None, "total"), _issue(unfiled, "missing_supplier_filing", "record_id", None, None, None, "tax"),
        _issue(unbooked, "missing_ledger_entry", "record_id", None, None, None, "total"), _issue(stray, "payment_without_invoice", "txn_id", None, None, "reference", "size", "narration"),
        _issue(sourceless, "ledger_without_source", "entry_id", None, None, "key", "booked", "account"), _issue(late, "supplier_not_filed", "record_id", "filing_id", None, None, "tax"),
        _issue(extra, "in_gstr2b_not_in_books", "filing_id", None, None, None, "tax_amount", "supplier_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tax_issues(inv: DataFrame, rates: DataFrame, home_state: str = HOME_STATE) -> DataFrame:
    """Rates, arithmetic, split, totals and tax ids of each invoice: one pass, an array of what is wrong, exploded."""
    r = effective_rates(inv, rates)
    actual = F.col("cgst") + F.col("sgst") + F.col("igst")
    at = lambda rate: F.round(F.col("taxable_value") * rate * F.lit("0.01").cast("decimal(3,2)"), 2).cast("decimal(18,2)")
    half = F.round(actual * F.lit("0.5").cast("decimal(2,1)"), 2).cast("decimal(18,2)")
    inside = F.coalesce(F.col("party_state") == home_state, F.lit(False))
    split = F.greatest(F.abs(F.col("cgst") - F.when(inside, actual - half).otherwise(0)), F.abs(F.col("sgst") - F.when(inside, half).otherwise(0)), F.abs(F.col("igst") - F.when(inside, 0).otherwise(actual)))
    row = lambda when, kind, expected, got, impact: F.when(when, F.struct(F.lit(kind).alias("kind"), expected.cast("string").alias("expected"), got.cast("string").alias("actual"), impact.cast("decimal(18,2)").alias("impact")))
    known = F.col("rate").isNotNull()
    found = F.array_compact(F.array(
        row(~known, "unknown_tax_rate", F.lit("rate"), F.col("hsn"), F.lit(0)), row(known & (F.col("tax_rate_pct") != F.col("rate")), "wrong_tax_rate", F.col("rate"), F.col("tax_rate_pct"), F.abs(at(F.col("rate")) - actual)),
        row(known & (F.abs(actual - at(F.col("tax_rate_pct"))) > TOLERANCE), "miscalculated_tax", at(F.col("tax_rate_pct")), actual, F.abs(actual - at(F.col("tax_rate_pct")))), row(split > TOLERANCE, "wrong_tax_split", F.lit("split"), F.col("party_state"), split),
        row(F.abs(F.col("total") - F.col("taxable_value") - actual) > TOLERANCE, "invoice_total_mismatch", F.col("taxable_value") + actual, F.col("total"), F.abs(F.col("total") - F.col("taxable_value") - actual)), row(~text.gstin_valid(F.col("gstin")), "invalid_gstin", F.lit("valid"), F.col("gstin"), actual),
    ))
    each = r.select("record_id", "vendor", F.explode(found).alias("x"))
    return each.select(F.col("x.kind").alias("issue_type"), "record_id", F.lit(None).cast("string").alias("other_id"), F.col("x.expected").alias("expected"), F.col("x.actual").alias("actual"), F.col("x.impact").alias("impact"), "vendor", F.lit(None).cast("string").alias("severity"), F.lit(None).cast("double").alias("confidence"))


def vendor_anomalies(inv: DataFrame) -> DataFrame:
    """Per invoice: the median of its vendor (by normalised name), robust z of log1p(total), round rate, count in the vendor's week.

    Statistics are aggregated by vendor and joined back, so that no vendor's invoices have to fit into one task.
    """
    x = inv.select("record_id", text.norm_vendor(F.col("vendor")).alias("vendor"), "inv_date", "is_new_vendor", F.abs(F.coalesce(F.col("total").cast("double"), F.lit(0.0))).alias("t")).withColumns({"lg": F.log1p("t"), "round": ((F.col("t") >= 10000) & (F.col("t") % 1000 == 0)).cast("int"), "week": F.date_trunc("WEEK", "inv_date").cast("date")})
    stats = x.groupBy("vendor").agg(F.median("lg").alias("med"), F.median("t").alias("vendor_median"), F.avg("round").alias("round_rate"))
    weeks = x.where("week IS NOT NULL").groupBy("vendor", "week").agg(F.count("*").alias("week_count"))
    x = x.join(stats, "vendor").join(weeks, ["vendor", "week"], "left").withColumn("away", F.abs(F.col("lg") - F.col("med")))
    x = x.join(x.groupBy("vendor").agg(F.median("away").alias("mad")), "vendor")
    return x.withColumn("robust_z", F.when(F.col("mad") == 0, 0.0).otherwise(0.6745 * (F.col("lg") - F.col("med")) / F.col("mad")))


def anomaly_issues(inv: DataFrame, delays: DataFrame | None = None, forest: bool = True) -> DataFrame:
    """One issue for each unusual invoice, of the first kind that holds; delays: (record_id, delay); forest: whether to grow one.

    A spike is an outlier of the isolation forest, a robust z of 4 or more, or a vendor whose first digits break
    Benford's law; severity and confidence rise with a z of 6 and with Benford's law.
    """
    a = vendor_anomalies(inv)
    a = a.join(delays, "record_id", "left") if delays is not None else a.withColumn("delay", F.lit(None).cast("int"))
    odd = benford(a, "vendor", "t").where("p < 0.01 AND effect >= 0.10").select("vendor", F.lit(True).alias("odd_digits"))
    rare = isolation.outliers(inv, "record_id", "total") if forest else inv.select("record_id").limit(0)
    a = a.join(odd, "vendor", "left").join(rare.withColumn("rare", F.lit(True)), "record_id", "left").na.fill(False, ["odd_digits", "rare"])
    z = F.abs("robust_z")
    kind = (
        F.when((F.col("t") >= 95_000) & (F.col("t") < 100_000), "anomaly_approval_threshold").when((F.col("round") == 1) & (F.col("round_rate") < 0.10), "anomaly_round_number").when(F.col("is_new_vendor") & (F.col("t") >= 500_000), "new_vendor_huge_invoice")
        .when((z >= 4) | F.col("rare") | F.col("odd_digits"), "anomaly_unusual_spike").when((F.col("week_count") >= 4) | (F.coalesce("delay", F.lit(0)) > 43), "anomaly_behavioral")
    )
    severity = F.when((z >= 6) | F.col("odd_digits"), "High").otherwise("Medium")
    return _issue(a.withColumn("kind", kind).where("kind IS NOT NULL"), F.col("kind"), "record_id", None, F.round("vendor_median", 2), F.round("t", 2), F.abs(F.col("t") - F.col("vendor_median")), "vendor", severity, F.when(F.col("odd_digits"), 0.85).otherwise(0.75))


def benford(amounts: DataFrame, group: str, amount: str, least: int = 300) -> DataFrame:
    """Per group of at least so many amounts: chi-square of first digits against Benford's law, p value (8 degrees) and effect."""
    d = amounts.withColumn("d", text.first_digit(F.col(amount))).where(F.col("d").between(1, 9))
    counts = d.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(F.col("d") == k).alias(f"d{k}") for k in range(1, 10)]).where(F.col("n") >= least)
    share = lambda k: F.log10(F.lit(1 + 1 / k)) * F.col("n")
    chi = sum(((F.col(f"d{k}") - share(k)) ** 2 / share(k) for k in range(2, 10)), (F.col("d1") - share(1)) ** 2 / share(1))
    h = F.col("chi2") / 2
    return counts.withColumn("chi2", chi).select(group, "n", "chi2", (F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)).alias("p"), (F.col("chi2") / F.col("n")).alias("effect"))


def payment_delays(inv: DataFrame, pay: DataFrame) -> DataFrame:
    """(record_id, delay): days from the last invoice of a key to its last payment that isn't before it."""
    i = keyed(inv).where("key <> ''").groupBy("key").agg(F.max_by(F.struct("record_id", "inv_date"), "record_id").alias("x")).select("key", "x.record_id", "x.inv_date")
    p = pay.select("txn_id", "pay_date", text.norm_identifier(F.col("reference")).alias("key"))
    both = i.join(p, "key").withColumn("delay", F.date_diff("pay_date", "inv_date")).where("delay >= 0")
    return both.groupBy("record_id").agg(F.max_by("delay", "txn_id").alias("delay"))


# What each kind of issue asks for.
FIXES = {
    "payment_before_invoice": "Verify the invoice and bank dates, then correct the source record or payment reference.",
    "short_payment": "Confirm withholding or recover the payment difference.",
    "overpayment": "Confirm withholding or recover the payment difference.",
    "invoice_id_mismatch": "Verify the source invoice number and correct the ledger reference.",
    "ledger_amount_mismatch": "Reconcile the ledger posting to the source invoice.",
    "ledger_date_gap": "Confirm the posting period and update the ledger date if required.",
    "gstr2b_tax_mismatch": "Ask the supplier to correct the filed tax amount or investigate the invoice.",
    "wrong_tax_period": "Verify the return period and request correction if the filing period is wrong.",
    "vendor_name_mismatch": "Confirm the supplier legal name and standardize the vendor master.",
    "supplier_gstin_mismatch": "Confirm the supplier GSTIN and assess the related ITC before claiming it.",
    "duplicate_exact": "Confirm the original document and reverse or merge the duplicate posting.",
    "duplicate_near": "Confirm the original document and reverse or merge the duplicate posting.",
    "duplicate_payment": "Confirm both bank entries and reverse any duplicate settlement posting.",
    "missing_payment": "Check the bank statement and confirm whether the invoice remains outstanding.",
    "missing_supplier_filing": "Confirm filing status with the supplier before claiming input tax credit.",
    "missing_ledger_entry": "Post or locate the missing accounts payable/receivable entry.",
    "payment_without_invoice": "Investigate the counterparty and attach the payment to its supporting document.",
    "ledger_without_source": "Locate the originating invoice or correct the ledger reference.",
    "supplier_not_filed": "Follow up with the supplier and defer the related ITC until it is eligible.",
    "in_gstr2b_not_in_books": "Confirm the purchase and record it if valid, or dispute the supplier filing.",
    "unknown_tax_rate": "Confirm the applicable HSN rate and maintain the effective-dated rate master.",
    "wrong_tax_rate": "Correct the tax rate using the effective-dated HSN master and recalculate tax.",
    "miscalculated_tax": "Recalculate tax on the taxable value and correct the invoice or books.",
    "wrong_tax_split": "Recompute whether the supply is intra-state or inter-state, then correct the tax components.",
    "invoice_total_mismatch": "Correct the invoice total so it equals taxable value plus GST.",
    "invalid_gstin": "Verify the supplier GSTIN against official records before claiming ITC.",
}
OTHER_FIX = "Review source documents, approval history and payment timing before posting."


def suggested_fix(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FIXES.items() for x in kv]), kind), F.lit(OTHER_FIX))


def explanations(issues: DataFrame) -> DataFrame:
    """(issue_id, explanation): what is wrong and what to do, from an issue's own fields only."""
    words = F.regexp_replace("issue_type", "_", " ")
    said = F.format_string(
        "%s: this case is flagged as %s. The expected value is %s; the observed value is %s. The deterministic impact estimate is Rs %s. Recommended action: %s",
        F.coalesce(F.nullif("vendor", F.lit("")), F.lit("Unknown")), words, *[F.coalesce(F.nullif(c, F.lit("")), F.lit("not available")) for c in ("expected", "actual")], F.format_number("impact", 2), suggested_fix(F.col("issue_type")),
    )
    return issues.select("issue_id", said.alias("explanation"))


def payloads(issues: DataFrame) -> DataFrame:
    """(issue_id, payload): an issue as one JSON text, its evidence a map of the values compared."""
    evidence = F.map_filter(F.create_map(F.lit("expected"), F.col("expected"), F.lit("actual"), F.col("actual")), lambda k, v: v.isNotNull())
    fields = F.struct("issue_id", "issue_type", "severity", F.coalesce("vendor", F.lit("Unknown")).alias("vendor"), F.array_compact(F.array("record_id", "other_id")).alias("record_ids"), F.col("impact").cast("string").alias("rupee_impact"), F.format_string("%.2f", "confidence").alias("confidence"), evidence.alias("evidence"), suggested_fix(F.col("issue_type")).alias("suggested_fix"))
    return issues.select("issue_id", F.to_json(fields).alias("payload"))


PAYLOAD = "issue_id string, issue_type string, severity string, vendor string, record_ids array<string>, rupee_impact string, confidence string, evidence map<string,string>, suggested_fix string"


def from_payloads(stored: DataFrame) -> DataFrame:
    """The issues of payloads() read again, amounts as decimals and confidence as a double."""
    x = stored.select(F.from_json("payload", PAYLOAD).alias("x")).select("x.*")
    return x.withColumns({"rupee_impact": F.col("rupee_impact").cast("decimal(18,2)"), "confidence": F.col("confidence").cast("double")})


def anomaly_cases(issues: DataFrame) -> DataFrame:
    """The issues of unusual invoices."""
    return issues.where("startswith(issue_type, 'anomaly') OR issue_type = 'new_vendor_huge_invoice'")


def finish(issues: DataFrame) -> DataFrame:
    """Issues with id, severity, confidence and status, the most severe first.

    Of equal ids the first in the order of detectors stays: that of the least `detector`, where there is such a column, and
    then of the least of its other values, so that reruns agree.
    """
    kinds = F.col("issue_type")
    out = issues.withColumns({
        "issue_id": text.issue_id(kinds, F.array_compact(F.array("record_id", "other_id")), F.coalesce("expected", F.lit("")), F.coalesce("actual", F.lit(""))),
        "severity": F.coalesce("severity", F.when(kinds.isin(*HIGH), "High").when(kinds == "vendor_name_mismatch", "Low").otherwise("Medium")),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.when(kinds == "duplicate_exact", 0.98).when(kinds == "duplicate_near", 0.88).when(kinds == "duplicate_payment", 0.92).when(kinds == "missing_payment", 0.85).when(kinds == "vendor_name_mismatch", 0.80).otherwise(0.95)))),
        "status": F.lit("Open"),
    })
    kept = [c for c in out.columns if c not in ("issue_id", "detector")]
    first = F.min(F.struct(*(["detector"] if "detector" in out.columns else []), *kept)).alias("x")
    once = out.groupBy("issue_id").agg(first).select("issue_id", *[F.col(f"x.{c}").alias(c) for c in kept])
    return once.orderBy(F.when(F.col("severity") == "High", 1).when(F.col("severity") == "Medium", 2).otherwise(3), "issue_type", "issue_id")
