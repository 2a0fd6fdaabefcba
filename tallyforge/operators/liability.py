"""Credit at risk, monthly liability, interest, and vendors' risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators.detect import keyed

#: Issue kinds that put a purchase's credit at risk, and points by severity.
ITC_ISSUES = ("missing_supplier_filing", "supplier_not_filed", "gstr2b_tax_mismatch", "invalid_gstin", "supplier_gstin_mismatch", "wrong_tax_rate", "miscalculated_tax", "wrong_tax_split")
POINTS = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}


def itc_risk(inv: DataFrame, fil: DataFrame, issues: DataFrame | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """(record_id, tax, reasons, at_risk) of purchases; a resolved issue (record_id, issue_type) lifts its reason."""
    f = fil.select("filed", "tax_amount", text.norm_identifier(F.col("invoice_no")).alias("key"), text.norm_tax_id(F.col("supplier_gstin")).alias("tax_id"))
    own = keyed(inv).where(F.lower(F.coalesce("document_type", F.lit("purchase"))) == "purchase")
    joined = own.join(f, ["key", "tax_id"], "left").groupBy("record_id", "tax", "gstin", "inv_date").agg(F.count("filed").alias("n"), F.bool_or("filed").alias("any_filed"), F.bool_or(F.abs(F.col("tax") - F.col("tax_amount")) > 1).alias("off"))
    reasons = F.array_compact(F.array(F.when(F.col("n") == 0, "missing_supplier_filing"), F.when((F.col("n") > 0) & ~F.col("any_filed"), "supplier_not_filed"), F.when(~text.gstin_valid(F.col("gstin")), "invalid_gstin"), F.when(F.coalesce("off", F.lit(False)), "gstr2b_tax_mismatch")))
    out = joined.withColumn("reasons", reasons)
    if issues is not None:
        more = issues.where(F.col("issue_type").isin(*ITC_ISSUES)).groupBy("record_id").agg(F.collect_set("issue_type").alias("more"))
        out = out.join(more, "record_id", "left").withColumn("reasons", F.array_union("reasons", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    if resolved is not None:
        done = resolved.groupBy("record_id").agg(F.collect_set("issue_type").alias("done"))
        out = out.join(done, "record_id", "left").withColumn("reasons", F.array_except("reasons", F.coalesce("done", F.array().cast("array<string>")))).drop("done")
    return out.select("record_id", "inv_date", "tax", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), (F.size("reasons") > 0).alias("at_risk"))


def tax_with_overrides(overrides: dict[str, float] | None) -> Column:
    """An invoice's tax, or for HSNs with another rate the tax at that rate."""
    out = F.col("tax")
    for hsn, rate in (overrides or {}).items():
        out = F.when(text.hsn_key(F.col("hsn")) == hsn.lstrip("0"), F.round(F.col("taxable_value") * F.lit(str(rate)).cast("decimal(5,2)") * F.lit("0.01").cast("decimal(3,2)"), 2).cast("decimal(18,2)")).otherwise(out)
    return out


def monthly_liability(inv: DataFrame, fil: DataFrame, issues: DataFrame | None = None, resolved: DataFrame | None = None, overrides: dict[str, float] | None = None) -> DataFrame:
    """Per period: output tax, booked, eligible and risky credit, and the net before and after. Undated rows are left out."""
    risk = itc_risk(inv, fil, issues, resolved).select("record_id", "at_risk")
    rows = inv.where("inv_date IS NOT NULL").withColumns({"x": tax_with_overrides(overrides), "period": F.date_format("inv_date", "yyyy-MM")}).join(risk, "record_id", "left")
    bought = F.lower(F.coalesce("document_type", F.lit("purchase"))) == "purchase"
    total = lambda when: F.sum(F.when(when, F.col("x")).otherwise(0)).cast("decimal(18,2)")
    sums = rows.groupBy("period").agg(total(~bought).alias("output_tax"), total(bought).alias("itc_booked"), total(bought & ~F.col("at_risk")).alias("itc_eligible"), total(bought & F.col("at_risk")).alias("itc_at_risk"))
    return sums.withColumns({"net_before": (F.col("output_tax") - F.col("itc_booked")).cast("decimal(18,2)"), "net_after": (F.col("output_tax") - F.col("itc_eligible")).cast("decimal(18,2)")})


MEASURES = ("output_tax", "itc_booked", "itc_eligible", "itc_at_risk", "net_before", "net_after")


def liability_totals(monthly: DataFrame) -> DataFrame:
    """The months and, with a null period, their total, in one pass."""
    return monthly.rollup("period").agg(*[F.sum(m).cast("decimal(18,2)").alias(m) for m in MEASURES])


def interest_and_penalty(due: DataFrame, rules: list[tuple[str, str | None, float, float]] = (("2017-07-01", None, 18.0, 0.0),)) -> DataFrame:
    """due (amount, from_date, to_date) with days, interest and penalty by the first rule in force on from_date.

    A rule is (valid from, valid to, percent a year, penalty percent). A span that runs backwards is an error.
    """
    rate, fine = F.lit(None).cast("decimal(7,2)"), F.lit(None).cast("decimal(7,2)")
    for start, end, r, p in reversed(list(rules)):
        holds = (F.col("from_date") >= F.lit(start).cast("date")) & (F.col("from_date") <= F.lit(end or "9999-12-31").cast("date"))
        rate, fine = F.when(holds, F.lit(str(r)).cast("decimal(7,2)")).otherwise(rate), F.when(holds, F.lit(str(p)).cast("decimal(7,2)")).otherwise(fine)
    days = F.date_diff("to_date", "from_date")
    checked = F.when(days < 0, F.raise_error(F.lit("to_date is before from_date"))).when(rate.isNull(), F.raise_error(F.lit("no rule is in force on from_date"))).otherwise(days)
    return due.withColumns({"days": checked.cast("int"), "interest": F.round(F.col("amount") * rate * days / 36500, 2).cast("decimal(18,2)"), "penalty": F.round(F.col("amount") * fine / 100, 2).cast("decimal(18,2)")})


def vendor_risk(inv: DataFrame, issues: DataFrame) -> DataFrame:
    """Per vendor: invoices, purchase exposure, issues and their points, and a score of 0 to 100, the riskiest first.

    issues: (issue_id, severity, record_id, other_id); an issue counts for each vendor that it touches.
    """
    touched = issues.select("issue_id", "severity", F.explode(F.array_compact(F.array("record_id", "other_id"))).alias("record_id"))
    hits = touched.join(inv.select("record_id", "vendor"), "record_id").select("vendor", "issue_id", "severity").distinct()
    points = F.lit(0)
    for severity, n in POINTS.items():
        points = F.when(F.col("severity") == severity, n).otherwise(points)
    scored = hits.groupBy("vendor").agg(F.count("*").alias("issues"), F.sum(points).cast("long").alias("points"))
    base = inv.groupBy("vendor").agg(F.count("*").alias("invoices"), F.sum(F.when(F.col("document_type") == "purchase", F.col("total")).otherwise(0)).cast("decimal(18,2)").alias("exposure"))
    out = base.join(scored, "vendor", "left").na.fill(0, ["issues", "points"])
    risk = F.least(F.lit(100), F.bround(100 * F.col("points").cast("decimal(18,4)") / F.greatest(3 * F.col("invoices"), F.lit(1)), 1)).cast("double")
    return out.withColumn("risk_score", risk).orderBy(F.col("risk_score").desc(), F.col("exposure").desc(), "vendor")
