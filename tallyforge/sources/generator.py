"""Books made from a seed, with known errors and matching challenges: the fixture that detectors are scored against.

All draws are hashes of the seed, the row's number and what is drawn, so a seed gives the same books anywhere. Rows are
put in an order by such a hash; the first of them get the errors of ERRORS, one each, the next ones are paid together or
in parts. Sizes are those of a fixture: the order is one window over the invoices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import text

START, DAYS, OPEN_AFTER = "2025-04-01", 548, "2026-08-25"
HOME = "Maharashtra"
# How many errors of each type a seed has.
ERRORS = {
    "miscalculated_tax": 25, "wrong_tax_rate": 18, "wrong_tax_split": 15, "rounding_diff": 12, "amount_mismatch_small": 12,
    "amount_mismatch_large": 15, "date_shift": 15, "anomaly_approval_threshold": 15, "anomaly_round_number": 15, "anomaly_unusual_spike": 15,
    "new_vendor_huge_invoice": 15, "invalid_gstin": 15, "vendor_name_variant": 18, "invoice_id_variant": 16, "duplicate_exact": 15,
    "duplicate_near": 15, "missing_payment": 15, "short_payment_tds": 18, "bank_amount_mismatch": 12, "payment_before_invoice": 12,
    "duplicate_payment": 12, "payment_without_invoice": 12, "missing_ledger_entry": 20, "ledger_date_gap": 15, "ledger_without_source": 12,
    "supplier_not_filed": 45, "gstr2b_tax_mismatch": 15, "wrong_tax_period": 12, "in_gstr2b_not_in_books": 12,
}
# Payments of several invoices (of three each), invoices paid in two parts, invoices still open.
BULK, SPLIT, OPEN = 14, 25, 40
STATES = (HOME, "Karnataka", "Gujarat", "Delhi", "Telangana")
#: Errors of purchases only.
_OF_PURCHASES = ("supplier_not_filed", "gstr2b_tax_mismatch", "wrong_tax_period", "in_gstr2b_not_in_books", "invalid_gstin")
_MONEY = "decimal(18,2)"


def _draw(seed: int, what: str, n: int, key: str = "i") -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col(key)), F.lit(n)).cast("int")


def vendors(spark: SparkSession, seed: int, n: int = 35) -> DataFrame:
    """(party_id, party_name, GSTIN, state, is_new_vendor) and the number v; the last two are new."""
    codes = {v: k for k, v in text.STATES.items()}
    v = spark.range(n).select(F.col("id").cast("int").alias("v"))
    v = v.withColumn("state", F.element_at(F.array(*map(F.lit, STATES)), _draw(seed, "state", len(STATES), "v") + 1))
    head = F.concat(F.element_at(F.create_map(*[F.lit(x) for s in STATES for x in (s, codes[s])]), F.col("state")), F.lit("ABCDE"), F.lpad(F.col("v").cast("string"), 4, "0"), F.lit("F1Z"))
    names = F.concat(F.translate(F.concat(F.lit("Party"), F.lpad(F.col("v").cast("string"), 2, "0")), "0123456789", "ABCDEFGHIK"), F.lit(" Industries "), F.when(F.col("v") % 2 == 0, "Limited").otherwise("Pvt Ltd"))
    return v.select("v", F.concat(F.lit("PARTY"), F.lpad(F.col("v").cast("string"), 3, "0")).alias("party_id"), names.alias("party_name"), F.concat(head, text.check_digit(head)).alias("GSTIN"), "state", (F.col("v") >= n - 2).alias("is_new_vendor"))


def tax_rates(spark: SparkSession) -> DataFrame:
    rows = [(str(h), r, "2017-07-01", None, f"goods {h}") for h, r in ((1001, "5.00"), (2002, "12.00"), (3003, "18.00"), (4004, "28.00"))]
    df = spark.createDataFrame(rows, "HSN string, standard_tax_rate_pct string, valid_from string, valid_to string, description string")
    return df.withColumns({"standard_tax_rate_pct": F.col("standard_tax_rate_pct").cast("decimal(5,2)"), "valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})


def _plan(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """(i, document_type, err, bulk, split): each invoice's number, kind and part in the fixture."""
    i = spark.range(n).select(F.col("id").alias("i")).withColumn("document_type", F.when(_draw(seed, "kind", 10) < 7, "purchase").otherwise("sales"))
    order = Window.partitionBy("document_type").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), F.col("i")), "i")
    i = i.withColumn("at", F.row_number().over(order) - 1)
    err, at = F.lit(None).cast("string"), {"purchase": 0, "sales": 0}
    for name, count in ERRORS.items():
        kind = "purchase" if name in _OF_PURCHASES or len(name) % 2 else "sales"
        err = F.when((F.col("document_type") == kind) & F.col("at").between(at[kind], at[kind] + count - 1), name).otherwise(err)
        at[kind] += count
    first, bought = at["purchase"], F.col("document_type") == "purchase"
    bulk = F.when(bought & F.col("at").between(first, first + 3 * BULK - 1), F.floor((F.col("at") - first) / 3).cast("int"))
    return i.withColumns({"err": err, "bulk": bulk, "split": bought & F.col("at").between(first + 3 * BULK, first + 3 * BULK + SPLIT - 1), "open": bought & F.col("at").between(first + 3 * BULK + SPLIT, first + 3 * BULK + SPLIT + OPEN - 1)})


def _clean(spark: SparkSession, seed: int, n: int) -> DataFrame:
    rates = F.element_at(F.create_map(*[F.lit(x) for k, v in ((1001, "5.00"), (2002, "12.00"), (3003, "18.00"), (4004, "28.00")) for x in (str(k), v)]), F.col("HSN")).cast("decimal(5,2)")
    rows = _plan(spark, seed, n).withColumns({"v": _draw(seed, "vendor", 33), "HSN": F.element_at(F.array(*[F.lit(x) for x in ("1001", "2002", "3003", "4004")]), _draw(seed, "hsn", 4) + 1)}).join(F.broadcast(vendors(spark, seed)), "v")
    day = F.when(F.col("open"), F.date_add(F.lit(OPEN_AFTER).cast("date"), _draw(seed, "day", 30) + 1)).otherwise(F.date_add(F.lit(START).cast("date"), _draw(seed, "day", DAYS - 45)))
    # all of a bulk payment's invoices are of one vendor and month
    rows = rows.withColumns({"taxable_value": ((_draw(seed, "amount", 8_000_000) + 500_000) / 100).cast(_MONEY), "tax_rate_pct": rates, "date": F.when(F.col("bulk").isNotNull(), F.date_add(F.lit("2025-06-01").cast("date"), F.col("bulk") * 5)).otherwise(day)})
    tax = F.round(F.col("taxable_value") * F.col("tax_rate_pct") * F.lit("0.01").cast("decimal(3,2)"), 2).cast(_MONEY)
    half, home = F.round(F.col("tax") * F.lit("0.5").cast("decimal(2,1)"), 2).cast(_MONEY), F.col("state") == HOME
    zero = F.lit(0).cast(_MONEY)
    rows = rows.withColumn("tax", tax).withColumns({"CGST": F.when(home, F.col("tax") - half).otherwise(zero).cast(_MONEY), "SGST": F.when(home, half).otherwise(zero).cast(_MONEY), "IGST": F.when(home, zero).otherwise(F.col("tax")).cast(_MONEY)})
    return rows.withColumns({"record_id": F.concat(F.lit("INVREC"), F.lpad(F.col("i").cast("string"), 6, "0")), "invoice_no": F.concat(F.lit("INV-"), F.lpad(F.col("i").cast("string"), 6, "0")), "total": (F.col("taxable_value") + F.col("tax")).cast(_MONEY)})


_INVOICE = ["record_id", "invoice_no", "document_type", "date", "vendor_customer_name", "GSTIN", "party_id", "party_state", "HSN", "taxable_value", "tax_rate_pct", "CGST", "SGST", "IGST", "total", "is_new_vendor"]


def _invoices(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col({"vendor_customer_name": "party_name", "party_state": "state"}.get(c, c)).alias(c) for c in _INVOICE])


def generate(spark: SparkSession, seed: int, invoices: int = 3000) -> dict[str, DataFrame]:
    """Tables by name: the books with errors, `injected_errors` and `match_challenges`, and the clean invoices and filings.

    Bank, ledger and filings say in linked_invoice_record_id which invoice they belong to; `ingest.strip_answers` drops it.
    """
    clean = _clean(spark, seed, invoices)
    is_ = lambda *names: F.col("err").isin(*names)
    up = lambda c, x: (F.col(c) + x).cast(_MONEY)
    clean = clean.withColumns({"true_name": F.col("party_name"), "true_date": F.col("date")})
    dirty = clean.withColumns({
        "CGST": F.when(is_("wrong_tax_split"), F.when(F.col("CGST") > 0, 0).otherwise(F.col("tax"))).otherwise(F.col("CGST")).cast(_MONEY), "IGST": F.when(is_("wrong_tax_split"), F.when(F.col("CGST") > 0, F.col("tax") - F.col("SGST")).otherwise(0)).when(is_("miscalculated_tax"), up("IGST", 250)).otherwise(F.col("IGST")).cast(_MONEY),
        "tax_rate_pct": F.when(is_("wrong_tax_rate"), F.col("tax_rate_pct") + 3).otherwise(F.col("tax_rate_pct")).cast("decimal(5,2)"),
        "total": F.when(is_("miscalculated_tax"), up("total", 250)).when(is_("rounding_diff"), up("total", F.lit("1.40").cast(_MONEY))).when(is_("amount_mismatch_small"), up("total", 40)).when(is_("amount_mismatch_large"), up("total", 9000)).otherwise(F.col("total")).cast(_MONEY),
        "date": F.when(is_("date_shift"), F.date_add("date", 9)).otherwise(F.col("date")), "GSTIN": F.when(is_("invalid_gstin"), F.concat(F.substring("GSTIN", 1, 14), F.lit("#"))).otherwise(F.col("GSTIN")),
        "party_name": F.when(is_("vendor_name_variant"), F.concat(F.substring("party_name", 1, 5), F.lit(" Trading"))).otherwise(F.col("party_name")),
        "is_new_vendor": F.col("is_new_vendor") | is_("new_vendor_huge_invoice"),
    })
    odd = F.when(is_("anomaly_approval_threshold"), 97_500).when(is_("anomaly_round_number"), 40_000).when(is_("anomaly_unusual_spike"), 4_000_000).when(is_("new_vendor_huge_invoice"), 700_000).cast(_MONEY)
    scale = lambda c: F.when(odd.isNotNull(), F.round(odd * F.col(c) / (F.col("taxable_value") + F.col("tax")), 2)).otherwise(F.col(c)).cast(_MONEY)
    dirty = dirty.select(*[c for c in dirty.columns if c not in ("CGST", "SGST", "IGST", "taxable_value", "total")], *[scale(c).alias(c) for c in ("CGST", "SGST", "IGST", "taxable_value")], F.when(odd.isNotNull(), odd).otherwise(F.col("total")).cast(_MONEY).alias("total"))
    again = dirty.where(is_("duplicate_exact", "duplicate_near")).withColumns({"record_id": F.concat("record_id", F.lit("D")), "invoice_no": F.when(is_("duplicate_near"), F.concat("invoice_no", F.lit("A"))).otherwise(F.col("invoice_no")), "date": F.when(is_("duplicate_near"), F.date_add("date", 2)).otherwise(F.col("date"))})
    books = dirty.unionByName(again)

    paid = dirty.where(~F.col("open") & F.col("bulk").isNull() & F.coalesce(~is_("missing_payment"), F.lit(True)))
    held = F.when(is_("short_payment_tds"), F.round(F.col("taxable_value") * F.lit("0.02").cast("decimal(3,2)"), 2)).otherwise(0).cast(_MONEY)
    sent = F.when(is_("bank_amount_mismatch"), F.col("total") + 777).when(is_("short_payment_tds"), F.col("total") - 2 * held).otherwise(F.col("total")).cast(_MONEY)
    when = F.when(is_("payment_before_invoice"), F.date_sub("date", 6)).otherwise(F.date_add("date", _draw(seed, "pay", 30) + 1))
    part = F.explode(F.when(F.col("split"), F.array(F.lit(1), F.lit(2))).when(is_("duplicate_payment"), F.array(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(0))))
    told = F.concat(F.when(F.col("split"), "PART ").otherwise(""), F.lit("Payment to "), F.col("party_name"), F.lit(" "), F.col("invoice_no"))
    bank = paid.withColumns({"held": held, "sent": sent, "when": when}).withColumn("part", part)
    cut = F.when(F.col("part") == 1, F.round(F.col("sent") * F.lit("0.6").cast("decimal(2,1)"), 2)).when(F.col("part") == 2, F.col("sent") - F.round(F.col("sent") * F.lit("0.6").cast("decimal(2,1)"), 2)).otherwise(F.col("sent")).cast(_MONEY)
    bank = bank.select(F.concat(F.lit("TXN"), F.lpad(F.col("i").cast("string"), 6, "0"), F.lit("-"), F.col("part")).alias("txn_id"), F.date_add("when", F.when(F.col("part") == 3, 2).otherwise(0)).alias("date"), cut.alias("amount"), told.alias("narration"), F.col("invoice_no").alias("reference"), F.col("held").alias("tds_withheld"), F.col("record_id").alias("linked_invoice_record_id"))
    bulk = dirty.where("bulk IS NOT NULL").groupBy("bulk").agg(F.sum("total").cast(_MONEY).alias("amount"), F.max("date").alias("date"), F.array_sort(F.collect_list("invoice_no")).alias("numbers"), F.array_sort(F.collect_list("record_id")).alias("records"))
    bulk_pay = bulk.select(F.concat(F.lit("TXNBULK"), F.col("bulk")).alias("txn_id"), F.date_add("date", 3).alias("date"), "amount", F.concat(F.lit("BULK "), F.array_join("numbers", " ")).alias("narration"), F.concat(F.lit("BULK"), F.col("bulk")).alias("reference"), F.lit(0).cast(_MONEY).alias("tds_withheld"), F.array_join("records", "|").alias("linked_invoice_record_id"))
    stray = dirty.where(is_("payment_without_invoice")).select(F.concat(F.lit("TXNX"), F.col("i")).alias("txn_id"), "date", F.col("total").alias("amount"), F.lit("Cash withdrawal").alias("narration"), F.concat(F.lit("CASH"), F.col("i")).alias("reference"), F.lit(0).cast(_MONEY).alias("tds_withheld"), F.lit(None).cast("string").alias("linked_invoice_record_id"))

    entry = F.concat(F.lit("LED"), F.lpad(F.col("i").cast("string"), 6, "0"))
    ledger = dirty.where(F.coalesce(~is_("missing_ledger_entry"), F.lit(True))).select(entry.alias("entry_id"), F.date_add("true_date", F.when(is_("ledger_date_gap"), 6).otherwise(0)).alias("date"), F.lit("Purchases").alias("account"), F.col("total").alias("debit"), F.lit(0).cast(_MONEY).alias("credit"), F.concat("invoice_no", F.when(is_("invoice_id_variant"), "/B").otherwise("")).alias("reference"), F.col("record_id").alias("linked_invoice_record_id"))
    sourceless = dirty.where(is_("ledger_without_source")).select(F.concat(F.lit("LEDX"), F.col("i")).alias("entry_id"), "date", F.lit("Journal").alias("account"), F.lit(f"{9_000_000 + seed}.00").cast(_MONEY).alias("debit"), F.lit(0).cast(_MONEY).alias("credit"), F.concat(F.lit("JV"), F.col("i")).alias("reference"), F.lit(None).cast("string").alias("linked_invoice_record_id"))

    def filings(rows: DataFrame, errors: bool) -> DataFrame:
        on = lambda name: F.coalesce(is_(name), F.lit(False)) & F.lit(errors)
        month = F.date_format(F.when(on("wrong_tax_period"), F.add_months("true_date", 1)).otherwise(F.col("true_date")), "yyyy-MM")
        own = rows.where("document_type = 'purchase'")
        return own.select(F.concat(F.lit("FIL"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("filing_id"), F.col("GSTIN").alias("supplier_GSTIN"), F.col("true_name").alias("supplier_name"), "invoice_no", F.col("true_date").alias("invoice_date"), "taxable_value", F.when(on("gstr2b_tax_mismatch"), F.col("tax") + 300).otherwise(F.col("tax")).cast(_MONEY).alias("tax_amount"), (~on("supplier_not_filed")).alias("appears_in_supplier_filing"), month.alias("filing_period"), F.col("record_id").alias("linked_invoice_record_id"))

    extra = filings(clean.where(is_("in_gstr2b_not_in_books")), True).withColumns({"filing_id": F.concat("filing_id", F.lit("X")), "invoice_no": F.concat(F.lit("EXT"), F.col("filing_id")), "linked_invoice_record_id": F.lit(None).cast("string")})
    truth = books.where("err IS NOT NULL AND (err NOT IN ('duplicate_exact', 'duplicate_near') OR endswith(record_id, 'D'))")
    # errors that are rows of another table are known by that row
    rows = {"duplicate_payment": ("bank_transactions", F.concat(F.lit("TXN"), F.lpad(F.col("i").cast("string"), 6, "0"), F.lit("-3"))), "payment_without_invoice": ("bank_transactions", F.concat(F.lit("TXNX"), F.col("i"))), "ledger_without_source": ("ledger", F.concat(F.lit("LEDX"), F.col("i"))), "in_gstr2b_not_in_books": ("supplier_filings", F.concat(F.lit("FIL"), F.lpad(F.col("i").cast("string"), 6, "0"), F.lit("X")))}
    where, row = F.lit("invoices"), F.col("record_id")
    for name, (table, key) in rows.items():
        where, row = F.when(is_(name), table).otherwise(where), F.when(is_(name), key).otherwise(row)
    truth = truth.select(row.alias("record_id"), F.col("err").alias("error_type"), where.alias("table_name"), row.alias("row_id"), F.lit("").alias("details"))
    kinds = {"split": dirty.where("split").select("record_id"), "open": dirty.where("open").select("record_id"), "bulk": bulk.select(F.array_join("records", "|").alias("record_id"))}
    challenges = None
    for name, df in kinds.items():
        own = df.select("record_id", F.lit(name).alias("challenge_type"), F.lit("invoices").alias("table_name"), F.col("record_id").alias("row_id"), F.lit("").alias("details"))
        challenges = own if challenges is None else challenges.unionByName(own)
    return {
        "invoices": _invoices(books), "bank_transactions": bank.unionByName(bulk_pay).unionByName(stray), "ledger": ledger.unionByName(sourceless), "supplier_filings": filings(dirty, True).unionByName(extra), "tax_rates": tax_rates(spark),
        "vendor_master": vendors(spark, seed).drop("v"), "injected_errors": truth, "match_challenges": challenges, "invoices_clean": _invoices(clean), "supplier_filings_clean": filings(clean, False),
    }
