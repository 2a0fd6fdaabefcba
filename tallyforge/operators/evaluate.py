"""Precision and recall of matches and issues against known truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.lineage import components
from tallyforge.operators.matching import cut


# Families of injected errors, each with its labels and the issue types that answer them.
FAMILIES = {
    "payment_amount": (("amount_mismatch_large", "amount_mismatch_small", "bank_amount_mismatch", "rounding_diff", "short_payment_tds"), ("short_payment", "overpayment", "ledger_amount_mismatch", "invoice_total_mismatch")),
    "anomaly": (("anomaly_approval_threshold", "anomaly_round_number", "anomaly_unusual_spike", "new_vendor_huge_invoice"), ("anomaly_approval_threshold", "anomaly_round_number", "anomaly_unusual_spike", "new_vendor_huge_invoice", "anomaly_behavioral")),
    "date_and_period": (("date_shift", "ledger_date_gap", "wrong_tax_period", "payment_before_invoice"), ("ledger_date_gap", "wrong_tax_period", "payment_before_invoice")),
    "invoice_duplicates": (("duplicate_exact", "duplicate_near"), ("duplicate_exact", "duplicate_near")),
    "invoice_identifier": (("invoice_id_variant",), ("invoice_id_mismatch",)),
    "vendor_name": (("vendor_name_variant",), ("vendor_name_mismatch",)),
    "supplier_not_filed": (("supplier_not_filed",), ("supplier_not_filed", "missing_supplier_filing")),
    "duplicate_payment": (("duplicate_payment",), ("duplicate_payment",)),
    "gstr2b_tax_mismatch": (("gstr2b_tax_mismatch",), ("gstr2b_tax_mismatch",)),
    "in_gstr2b_not_in_books": (("in_gstr2b_not_in_books",), ("in_gstr2b_not_in_books",)),
    "invalid_gstin": (("invalid_gstin",), ("invalid_gstin",)),
    "ledger_without_source": (("ledger_without_source",), ("ledger_without_source",)),
    "miscalculated_tax": (("miscalculated_tax",), ("miscalculated_tax",)),
    "missing_ledger_entry": (("missing_ledger_entry",), ("missing_ledger_entry",)),
    "missing_payment": (("missing_payment",), ("missing_payment",)),
    "payment_without_invoice": (("payment_without_invoice",), ("payment_without_invoice",)),
    "wrong_tax_rate": (("wrong_tax_rate",), ("wrong_tax_rate",)),
    "wrong_tax_split": (("wrong_tax_split",), ("wrong_tax_split",)),
}


def weakest(scores: DataFrame, most: int = 5) -> DataFrame:
    """The families of the lowest f1, then recall, then name."""
    return scores.orderBy("f1", "recall", "family").limit(most)


def group_accuracy(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """One row over groups (record_ids, txn_ids): tp, fp, fn and the share of true groups that matches have exactly."""
    group = lambda df: df.select(F.array_join(F.array_sort("record_ids"), "|").alias("record_id"), F.array_join(F.array_sort("txn_ids"), "|").alias("txn_id"))
    m = pair_metrics(group(matches.where("tier IN ('split', 'bulk') AND confidence >= 0.60")), group(truth))
    return m.withColumn("exact_group_accuracy", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0)))


def liability_error(found: DataFrame, clean: DataFrame, column: str = "net_after") -> DataFrame:
    """One row: the amounts of two monthly liabilities, their absolute difference, and its share (null where the clean one is 0)."""
    one = lambda df, name: df.agg(F.coalesce(F.sum(column), F.lit(0)).cast("decimal(28,2)").alias(name)).withColumn("one", F.lit(1))
    both = one(found, "found").join(one(clean, "clean"), "one").drop("one").withColumn("error", F.abs(F.col("found") - F.col("clean")))
    return both.withColumn("share", F.round(F.try_divide(F.col("error").cast("double"), F.abs("clean").cast("double")), 6))


def _prf(tp, fp, fn) -> list:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def pair_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of distinct (record_id, txn_id)."""
    keys = ["record_id", "txn_id"]
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(truth.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full")
    counts = both.agg(F.count_if(F.expr("f = 1 AND t = 1")).alias("tp"), F.count_if(F.expr("f = 1 AND t IS NULL")).alias("fp"), F.count_if(F.expr("f IS NULL AND t = 1")).alias("fn"))
    return counts.select("tp", "fp", "fn", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_curve(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(cut, tp, fp, fn, ...) for the cuts 0.60 to 0.99: one histogram of confidences, then sums from each cut on."""
    keys = ["record_id", "txn_id"]
    marked = scored.join(truth.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "left").withColumn("step", F.floor(F.col("confidence") * 100 + 1e-9).cast("int"))
    hist = marked.where("step >= 60").groupBy(F.least("step", F.lit(99)).alias("step")).agg(F.count("t").alias("hit"), F.count("*").alias("n"))
    total = truth.select(*keys).distinct().count()
    cuts = hist.select("hit", "n", F.explode(F.sequence(F.lit(60), F.col("step"))).alias("cut")).groupBy("cut").agg(F.sum("hit").alias("tp"), F.sum(F.col("n") - F.col("hit")).alias("fp"))
    every = scored.sparkSession.range(60, 100).select(F.col("id").cast("int").alias("cut")).join(cuts, "cut", "left").na.fill(0).withColumn("fn", F.lit(total) - F.col("tp"))
    return every.select((F.col("cut") / 100).alias("cut"), "tp", "fp", "fn", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def score_issues(issues: DataFrame, truth: DataFrame, families: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = FAMILIES) -> DataFrame:
    """(family, tp, fp, fn, precision, recall, f1).

    issues (issue_id, issue_type, record_ids), truth (label, record_ids); families: by name, labels and the issue types
    that answer them. Labels in order take one unused issue that touches their records, of the same type first; issues
    that are left are false, as are those whose type answers no label.
    """
    spark = issues.sparkSession
    lookup = spark.createDataFrame([(t, name) for name, (_, types) in families.items() for t in types], "issue_type string, family string")
    labels = spark.createDataFrame([(k, name) for name, (own, _) in families.items() for k in own], "label string, family string")
    a = issues.join(F.broadcast(lookup), "issue_type", "left").select(F.coalesce("family", F.concat(F.lit("other:"), "issue_type")).alias("family"), F.col("issue_type").alias("name"), "record_ids", F.lit(0).alias("truth"))
    b = truth.join(F.broadcast(labels), "label", "left").select(F.coalesce("family", F.concat(F.lit("other:"), "label")).alias("family"), F.col("label").alias("name"), "record_ids", F.lit(1).alias("truth"))

    # what labels take depends only on issues that share records with them, so components are settled on their own;
    # those of one kind, or of one label and one issue, are counted without Python
    rows = cut(a.unionByName(b).withColumn("uid", F.monotonically_increasing_id()))
    ends = rows.select("uid", F.explode("record_ids").alias("id"), "family").select("uid", F.concat_ws("|", "family", "id").alias("node"))
    rows = rows.join(components(ends, "node", "uid"), "uid", "left").withColumn("part", F.coalesce("part", F.concat(F.lit("alone|"), "uid")))
    groups = rows.groupBy("family", "part").agg(F.sum("truth").alias("labels"), F.sum(1 - F.col("truth")).alias("issues"))
    plain = F.expr("labels = 0 OR issues = 0 OR labels = 1 AND issues = 1")
    one = F.least(F.col("labels"), F.col("issues"))
    easy = groups.where(plain).select("family", one.alias("tp"), (F.col("issues") - one).alias("fp"), (F.col("labels") - one).alias("fn"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        open_ = sorted((n, sorted(r)) for n, r, t in zip(rows["name"], rows["record_ids"], rows["truth"], strict=True) if not t)
        tp = fn = 0
        for name, ids in sorted((n, sorted(r)) for n, r, t in zip(rows["name"], rows["record_ids"], rows["truth"], strict=True) if t):
            fits = [k for k, (_, own) in enumerate(open_) if set(own) & set(ids)]
            fits.sort(key=lambda k: open_[k][0] != name)
            if fits:
                open_.pop(fits[0])
                tp += 1
            else:
                fn += 1
        return pd.DataFrame([(rows["family"].iloc[0], tp, len(open_), fn)], columns=["family", "tp", "fp", "fn"])

    hard = rows.join(groups.where(~plain).select("family", "part"), ["family", "part"], "left_semi")
    settled = hard.groupBy("family", "part").applyInPandas(run, "family string, tp long, fp long, fn long")
    counts = easy.unionByName(settled).groupBy("family").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return counts.select("family", "tp", "fp", "fn", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def precision_at(issues: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: share of the k issues of most confidence and impact whose record is labelled."""
    top = issues.orderBy(F.col("confidence").desc(), F.col("impact").desc(), "issue_id").limit(k)
    hit = top.join(truth.select("record_id").distinct().withColumn("t", F.lit(1)), "record_id", "left")
    return hit.agg(F.count("t").alias("hits"), F.coalesce(F.try_divide(F.count("t").cast("double"), F.count("*")), F.lit(0.0)).alias("precision"))
