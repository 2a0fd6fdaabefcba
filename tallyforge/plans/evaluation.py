"""Evaluation of the whole reconciliation on named splits: what was found against what is known."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import blocking, detect, evaluate, liability, matching
from tallyforge.sources import generator, ingest

#: Named splits and their folders below a root.
SPLITS = {"validation": "splits/validation/seed-14", "test_a": "evaluation/test_a", "test_b": "evaluation/test_b"}
TRAINING_SEEDS = (11, 12, 13)
TABLES = ("invoices", "bank_transactions", "ledger", "supplier_filings", "tax_rates")
#: A table's columns under the names that the operators use; the types of what isn't text.
_NAMES = {
    "invoices": {"date": "inv_date", "vendor_customer_name": "vendor", "GSTIN": "gstin", "HSN": "hsn", "CGST": "cgst", "SGST": "sgst", "IGST": "igst"}, "bank_transactions": {"date": "pay_date"}, "ledger": {"date": "led_date"},
    "supplier_filings": {"supplier_GSTIN": "supplier_gstin", "appears_in_supplier_filing": "filed"}, "tax_rates": {"HSN": "hsn", "standard_tax_rate_pct": "rate"},
}
_MONEY = ("taxable_value", "cgst", "sgst", "igst", "total", "amount", "tds_withheld", "debit", "credit", "tax_amount")
_TYPES = {c: "decimal(18,2)" for c in _MONEY} | {c: "date" for c in ("inv_date", "pay_date", "led_date", "invoice_date", "valid_from", "valid_to")} | {"filed": "boolean", "is_new_vendor": "boolean", "tax_rate_pct": "decimal(5,2)", "rate": "decimal(5,2)"}


def load_split(spark: SparkSession, root: str, split: str = "test_a", part: str = "raw", tables: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of a named split, as text; another name is an error, and so is a raw table that holds answers."""
    if split not in SPLITS:
        raise ValueError(f"a split is one of {', '.join(SPLITS)}")
    read = lambda name: spark.read.option("header", True).csv(f"{root}/{SPLITS[split]}/{part}/{name}")
    found = {name: read(name) for name in tables}
    if part == "raw":
        ingest.assert_safe(found)
    return found


def for_operators(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with the names and types that the operators take; invoices get their whole tax, rates their order."""
    out = {}
    for name, df in tables.items():
        df = df.select(*[F.col(c).alias(_NAMES.get(name, {}).get(c, c)) for c in df.columns])
        df = df.withColumns({c: F.col(c).cast(_TYPES[c]) for c in df.columns if c in _TYPES})
        if name.startswith("invoices"):
            df = df.withColumn("tax", (F.col("cgst") + F.col("sgst") + F.col("igst")).cast("decimal(18,2)"))
        if name == "tax_rates":
            df = df.withColumn("pos", F.monotonically_increasing_id())
        out[name] = df
    return out


def run_reconciliation(tables: dict[str, DataFrame], home_state: str = generator.HOME, open_after: str = generator.OPEN_AFTER) -> dict[str, DataFrame]:
    """matches, issues and liability of the five tables (in the operators' names), which must hold no answers."""
    ingest.assert_safe(tables)
    inv, pay, led, fil, rates = (matching.cut(tables[t]) for t in TABLES)
    matches = matching.cut(matching.reconcile(inv, pay))
    direct = matching.cut(blocking.reference_pairs(inv, pay))
    parts = [
        detect.payment_amounts(inv, pay, direct), detect.ledger_mismatches(inv, led), detect.filing_mismatches(inv, fil), detect.fuzzy_filings(inv, fil), detect.duplicate_invoices(inv), detect.duplicate_payments(pay),
        detect.missing(inv, pay, led, fil, matching.accepted(matches), direct, open_after), detect.tax_issues(inv, rates, home_state), detect.anomaly_issues(inv, detect.payment_delays(inv, pay)),
    ]
    issues = matching.cut(detect.finish(reduce(DataFrame.unionByName, [p.withColumn("detector", F.lit(i)) for i, p in enumerate(parts)])))
    return {"matches": matches, "issues": issues, "liability": liability.monthly_liability(inv, fil)}


def evaluate_split(tables: dict[str, DataFrame], truth: dict[str, DataFrame], clean: dict[str, DataFrame]) -> dict:
    """What the reconciliation of tables is worth: truth holds injected_errors, match_challenges and links, clean the invoices and filings without errors.

    The answers are read after all inference. Results are small: counts, shares and one row for each family.
    """
    found = run_reconciliation(tables)
    one = lambda df: df.first().asDict()
    links = truth["links"].where("source_table = 'bank_transactions' AND invoice_record_id IS NOT NULL")
    pairs = links.select(F.explode(F.split("invoice_record_id", r"\|")).alias("record_id"), F.col("source_id").alias("txn_id"))
    issues = found["issues"].withColumn("record_ids", F.array_compact(F.array("record_id", "other_id")))
    labels = truth["injected_errors"].select(F.col("error_type").alias("label"), F.split("record_id", r"\|").alias("record_ids"))
    families = matching.cut(evaluate.score_issues(issues, labels))
    total = families.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    accepted = matching.cut(matching.accepted(found["matches"]))
    odd = labels.where("startswith(label, 'anomaly') OR label = 'new_vendor_huge_invoice'").select(F.explode("record_ids").alias("record_id"))
    groups = truth["match_challenges"].where("challenge_type IN ('split', 'bulk')").select(F.split("record_id", r"\|").alias("record_ids"))
    groups = groups.withColumn("group", F.array_join(F.array_sort("record_ids"), "|")).select("group", F.explode("record_ids").alias("record_id"))
    groups = groups.join(pairs, "record_id").groupBy("group").agg(F.collect_set("record_id").alias("record_ids"), F.collect_set("txn_id").alias("txn_ids"))
    cleaned = liability.monthly_liability(clean["invoices"], clean["supplier_filings"])
    return {
        "issue_detection": one(total.select("tp", "fp", "fn", *evaluate._prf(F.col("tp"), F.col("fp"), F.col("fn")))) | {"families": [r.asDict() for r in families.orderBy("family").collect()], "weakest": [r["family"] for r in evaluate.weakest(families).collect()]},
        "matching": {"model": one(evaluate.pair_metrics(accepted, pairs)), "naive_exact": one(evaluate.pair_metrics(matching.baseline_matches(tables["invoices"], tables["bank_transactions"]), pairs))},
        "many_to_many": one(evaluate.group_accuracy(found["matches"], groups)),
        "anomaly_precision_at_k": one(evaluate.precision_at(detect.anomaly_cases(found["issues"]), odd, max(1, odd.count()))),
        "liability_error": {k: str(v) for k, v in one(evaluate.liability_error(found["liability"], cleaned)).items()},
        "counts": {"invoices": tables["invoices"].count(), "payments": tables["bank_transactions"].count(), "errors": labels.count(), "issues": issues.count()},
    }


def write_splits(spark: SparkSession, root: str, seeds: dict[str, int], invoices: int = 3000) -> None:
    """Generate each named split from its seed and write it with its answers apart, as `load_split` reads it."""
    for split, seed in seeds.items():
        made = generator.generate(spark, seed, invoices)
        tables = {t: made[t] for t in (*TABLES, "vendor_master")}
        ingest.write_split(tables, {t: made[t] for t in ("injected_errors", "match_challenges")}, f"{root}/{SPLITS[split]}", {t: made[t] for t in ("invoices_clean", "supplier_filings_clean")}, seed=seed)


def run_evaluation(spark: SparkSession, root: str, path: str, splits: tuple[str, ...] = tuple(SPLITS)) -> dict:
    """evaluate_split of each named split below root; the results are written to path as JSON, too."""
    results = {"protocol": {"training_seeds": list(TRAINING_SEEDS), "validation": ["validation"], "held_out": ["test_a", "test_b"]}, "datasets": {}}
    for split in splits:
        tables = for_operators(load_split(spark, root, split))
        truth = load_split(spark, root, split, "truth", ("injected_errors", "match_challenges", "links"))
        clean = for_operators({t: df for t, df in zip(("invoices", "supplier_filings"), load_split(spark, root, split, "reference", ("invoices_clean", "supplier_filings_clean")).values(), strict=True)})
        results["datasets"][split] = evaluate_split(tables, truth, clean)
    body = json.dumps(results, indent=2, default=str)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return results
