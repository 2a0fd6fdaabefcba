"""All queries of the reconciliation engine over the domain views, and DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import blocking, detect, evaluate, isolation, liability, matching, pair_model, review
from tallyforge.plans.domain import HOME_STATE, Domain, with_clause
from tallyforge.sources import ingest
from tallyforge.streaming import events

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

#: DuckDB forms of the scalar functions.
_TAX_ID = r"regexp_replace(upper(coalesce({}, '')), '[^\p{{L}}\p{{N}}]', '', 'g')"
_KEY = f"translate({_TAX_ID}, 'OI', '01')"
_NAME = r"trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(upper(coalesce({}, '')), '&', ' AND '), '[^A-Z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')), '(^| )((LTD|LIMITED|PVT|PRIVATE|LLP|PLC|INC)( |$))+$', ''))"
_B36 = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_SUM = f"list_sum(list_transform(range(1, 15), lambda i: ((instr({_B36}, substr(g, i, 1)) - 1) * (2 - i % 2)) // 36 + ((instr({_B36}, substr(g, i, 1)) - 1) * (2 - i % 2)) % 36))"
_VALID = f"(regexp_full_match(g, '[0-9A-Z]{{13}}Z[0-9A-Z]') AND substr(g, 15, 1) = substr({_B36}, CAST((36 - {_SUM} % 36) % 36 + 1 AS INT), 1))"


def key(c: str) -> str:
    return _KEY.format(c)


def tax_id(c: str) -> str:
    return _TAX_ID.format(c)


def _add(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query over the domain; sql may use the views named, and its own CTEs after a leading comma."""

    def put(f: Callable[[Domain], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir, shared=len(views) != 1))
        if sql is not None:
            ctes = with_clause(*views)
            if sql.lstrip().startswith(","):
                _SQL[name] = f"WITH {ctes}{sql}"
            else:
                _SQL[name] = f"WITH {ctes} {sql}" if ctes else sql
        return f

    return put


def _likeness(a: str, b: str) -> str:
    """DuckDB's form of the ratio: twice the longest common subsequence over both lengths, row by row of its table."""
    cell = f"greatest(r[i], r[i - 1] + CASE WHEN unicode(substr({b}, CAST(i - 1 AS INT), 1)) = c[1] THEN 1 ELSE 0 END)"
    row = f"list_transform(range(1, length({b}) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN i = 1 THEN 0 ELSE {cell} END)))"
    rows = f"list_reduce(list_transform(string_split({a}, ''), lambda c: [CAST(unicode(c) AS BIGINT)]), lambda r, c: {row}, list_transform(range(0, length({b}) + 1), lambda j: CAST(0 AS BIGINT)))"
    return f"(CASE WHEN {a} = {b} THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 200.0 * list_max({rows}) / (length({a}) + length({b})) END)"


def _words_alike(n: str, p: str, q: str) -> str:
    """DuckDB's form of the ratio of two sets of words: what they share (its length n), and each side's rest, as sorted text."""
    la, lb = f"({n} + CASE WHEN {n} > 0 THEN 1 ELSE 0 END + length({p}))", f"({n} + CASE WHEN {n} > 0 THEN 1 ELSE 0 END + length({q}))"
    indel = f"(length({p}) + length({q}) - {_likeness(p, q)} * (length({p}) + length({q})) / 100.0)"
    return f"greatest(100.0 * (1 - {indel} / ({la} + {lb})), CASE WHEN {n} > 0 THEN greatest(200.0 * {n} / ({n} + {la}), 200.0 * {n} / ({n} + {lb})) ELSE 0 END)"


def _word_sets(a: str, b: str, columns: str = "*") -> str:
    """SELECT columns, and of two texts' sets of words the length of what is shared and each side's rest."""
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    rest = lambda u, v: f"array_to_string(list_sort(list_filter({u}, lambda e: NOT list_contains({v}, e))), ' ')"
    return f"SELECT {columns}, length(array_to_string(list_sort(list_filter({x}, lambda e: list_contains({y}, e))), ' ')) AS w, {rest(x, y)} AS wp, {rest(y, x)} AS wq"


def _table(d: Domain, name: str) -> DataFrame:
    return d.spark.read.parquet(f"{d.sf_dir}/{name}.parquet")


# --- scalars -----------------------------------------------------------------
@_add("norm_identifier", f"SELECT record_id, {key('invoice_no')} AS norm FROM inv", ("inv",))
def _(d):
    return d.inv.select("record_id", text.norm_identifier(F.col("invoice_no")).alias("norm"))


@_add("norm_vendor", f"SELECT record_id, {_NAME.format('vendor')} AS norm FROM inv", ("inv",))
def _(d):
    return d.inv.select("record_id", text.norm_vendor(F.col("vendor")).alias("norm"))


@_add("gstin_check", f", t AS (SELECT record_id, {tax_id('gstin')} AS g FROM inv) SELECT record_id, {_VALID} AS valid FROM t", ("inv",))
def _(d):
    return d.inv.select("record_id", text.gstin_valid(F.col("gstin")).alias("valid"))


_STATES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.STATES.items())


@_add("state_from_gstin", f", t AS (SELECT record_id, {tax_id('gstin')} AS g FROM inv) SELECT record_id, CASE WHEN length(g) = 15 THEN CASE substr(g, 1, 2) {_STATES} END END AS state FROM t", ("inv",))
def _(d):
    return d.inv.select("record_id", text.state_from_gstin(F.col("gstin")).alias("state"))


@_add("first_digit", "SELECT o_orderkey, CAST(substr(format('{:.11e}', o_totalprice), 1, 1) AS INT) AS d FROM orders WHERE o_totalprice >= 0.1")
def _(d):
    return _table(d, "orders").where("o_totalprice >= 0.1").select("o_orderkey", text.first_digit(F.col("o_totalprice")).alias("d"))


@_add("identifier_edits", f"SELECT record_id, CAST(levenshtein({key('invoice_no')}, {key('reference')}) AS INT) AS edits FROM inv JOIN pay USING (k)", ("inv", "pay"))
def _(d):
    return d.inv.join(d.pay, "k").select("record_id", F.levenshtein(text.norm_identifier(F.col("invoice_no")), text.norm_identifier(F.col("reference"))).alias("edits"))


@_add("money_text", "SELECT k, TRY_CAST(translate(CASE WHEN k % 5 = 0 THEN 'n/a' ELSE '₹' || substr(CAST(total AS VARCHAR), 1, 3) || ',' || substr(CAST(total AS VARCHAR), 4) END, ',₹', '') AS DECIMAL(18,2)) AS m FROM inv", ("inv",))
def _(d):
    shown = F.concat(F.lit("₹"), F.substring(F.col("total").cast("string"), 1, 3), F.lit(","), F.substring(F.col("total").cast("string"), 4, 40))
    return d.inv.select("k", text.money(F.when(F.col("k") % 5 == 0, "n/a").otherwise(shown)).alias("m"))


# --- the first slice ---------------------------------------------------------
@_add("q_missing_payment_by_period", f", p AS (SELECT DISTINCT {key('reference')} AS x FROM pay) SELECT strftime(inv_date, '%Y-%m') AS period, count(*) AS n, CAST(sum(total) AS DECIMAL(28,2)) AS amount FROM inv WHERE {key('invoice_no')} NOT IN (SELECT x FROM p) AND inv_date <= DATE '{detect.OPEN_AFTER}' GROUP BY 1", ("inv", "pay"))
def _(d):
    paid = d.pay.select(text.norm_identifier(F.col("reference")).alias("key")).distinct()
    open_ = detect.keyed(d.inv).where(F.col("inv_date") <= F.lit(detect.OPEN_AFTER).cast("date")).join(paid, "key", "left_anti")
    return open_.groupBy(F.date_format("inv_date", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"), F.sum("total").cast("decimal(28,2)").alias("amount"))


# --- liability ---------------------------------------------------------------
_RISK = f""", f AS (SELECT filed, tax_amount, {key('invoice_no')} AS key, {tax_id('supplier_gstin')} AS g FROM fil),
i AS (SELECT *, {key('invoice_no')} AS key, {tax_id('gstin')} AS g FROM inv),
r AS (SELECT i.record_id, any_value(i.inv_date) AS inv_date, any_value(i.tax) AS tax, any_value(i.g) AS g, count(f.filed) AS n, bool_or(f.filed) AS any_filed, coalesce(bool_or(abs(i.tax - f.tax_amount) > 1), FALSE) AS off
  FROM i LEFT JOIN f ON i.key = f.key AND i.g = f.g WHERE document_type = 'purchase' GROUP BY i.record_id),
risk AS (SELECT record_id, inv_date, tax, array_to_string(list_sort(list_filter([CASE WHEN n = 0 THEN 'missing_supplier_filing' END, CASE WHEN n > 0 AND NOT any_filed THEN 'supplier_not_filed' END,
  CASE WHEN NOT {_VALID} THEN 'invalid_gstin' END, CASE WHEN off THEN 'gstr2b_tax_mismatch' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM r)"""


@_add("itc_risk", _RISK + " SELECT record_id, inv_date, tax, reasons, reasons <> '' AS at_risk FROM risk", ("inv", "fil"))
def _(d):
    return liability.itc_risk(d.inv, d.fil)


def _monthly(tax: str) -> str:
    return _RISK + f""", m AS (SELECT strftime(i.inv_date, '%Y-%m') AS period, document_type, {tax} AS x, coalesce(reasons <> '', FALSE) AS at_risk FROM i LEFT JOIN risk USING (record_id)),
s AS (SELECT period, sum(CASE WHEN document_type <> 'purchase' THEN x ELSE 0 END) AS o, sum(CASE WHEN document_type = 'purchase' THEN x ELSE 0 END) AS b, sum(CASE WHEN document_type = 'purchase' AND NOT at_risk THEN x ELSE 0 END) AS e,
  sum(CASE WHEN document_type = 'purchase' AND at_risk THEN x ELSE 0 END) AS r FROM m GROUP BY period)"""


_COLUMNS = ", ".join(f"CAST({x} AS DECIMAL(18,2)) AS {n}" for x, n in (("o", "output_tax"), ("b", "itc_booked"), ("e", "itc_eligible"), ("r", "itc_at_risk"), ("o - b", "net_before"), ("o - e", "net_after")))


@_add("monthly_liability", _monthly("i.tax") + f" SELECT period, {_COLUMNS} FROM s", ("inv", "fil"))
def _(d):
    return liability.monthly_liability(d.inv, d.fil)


@_add("monthly_liability_rollup", _monthly("i.tax") + f", z AS (SELECT period, sum(o) AS o, sum(b) AS b, sum(e) AS e, sum(r) AS r FROM s GROUP BY ROLLUP (period)) SELECT period, {_COLUMNS} FROM z", ("inv", "fil"))
def _(d):
    return liability.liability_totals(liability.monthly_liability(d.inv, d.fil))


@_add("what_if_rate", _monthly("CASE WHEN ltrim(hsn, '0') = '3' THEN CAST(round(taxable_value * CAST(5 AS DECIMAL(5,2)) * 0.01, 2) AS DECIMAL(18,2)) ELSE i.tax END") + f" SELECT period, {_COLUMNS} FROM s", ("inv", "fil"))
def _(d):
    return liability.monthly_liability(d.inv, d.fil, overrides={"3": 5.0})


@_add("liability_unpivot", _monthly("i.tax") + ", w AS (SELECT period, CAST(o AS DECIMAL(18,2)) AS output_tax, CAST(e AS DECIMAL(18,2)) AS itc_eligible, CAST(r AS DECIMAL(18,2)) AS itc_at_risk FROM s) SELECT period, measure, amount FROM w UNPIVOT (amount FOR measure IN (output_tax, itc_eligible, itc_at_risk))", ("inv", "fil"))
def _(d):
    return liability.monthly_liability(d.inv, d.fil).unpivot(["period"], ["output_tax", "itc_eligible", "itc_at_risk"], "measure", "amount")


@_add("interest_penalty", "SELECT k, CAST(datediff('day', inv_date, inv_date + CAST(k % 90 AS INT)) AS INT) AS days, CAST(round(tax * CAST(18 AS DECIMAL(7,2)) * CAST(k % 90 AS INT) * CAST(1 AS DECIMAL(18,0)) / 36500, 2) AS DECIMAL(18,2)) AS interest FROM inv WHERE tax > 0", ("inv",))
def _(d):
    due = d.inv.where("tax > 0").select("k", F.col("tax").alias("amount"), F.col("inv_date").alias("from_date"), F.expr("date_add(inv_date, cast(k % 90 as int))").alias("to_date"))
    return liability.interest_and_penalty(due, [("1990-01-01", None, 18.0, 0.0)]).select("k", "days", "interest")


_RATE = ", r AS (SELECT i.record_id, arg_min(r.rate, r.pos) AS rate FROM inv i JOIN rates r ON ltrim(i.hsn, '0') = ltrim(r.hsn, '0') AND i.inv_date BETWEEN r.valid_from AND coalesce(r.valid_to, DATE '2100-01-01') GROUP BY i.record_id)"


@_add("effective_rate", _RATE + " SELECT inv.record_id, r.rate FROM inv LEFT JOIN r USING (record_id)", ("inv", "rates"))
def _(d):
    return detect.effective_rates(d.inv, d.rates).select("record_id", "rate")


# --- detectors ---------------------------------------------------------------
_SHORT = "issue_type", "record_id", "other_id", "impact"


def _issues(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("issue_type").isin(*kinds)).select(*_SHORT)


_TAX = _RATE + f""", t AS (SELECT inv.*, {tax_id('gstin')} AS g, rate, cgst + sgst + igst AS a, CAST(round((cgst + sgst + igst) * 0.5, 2) AS DECIMAL(18,2)) AS h, coalesce(party_state = '{HOME_STATE}', FALSE) AS home FROM inv LEFT JOIN r USING (record_id))"""
_AT = "CAST(round(taxable_value * {} * 0.01, 2) AS DECIMAL(18,2))"
_SPLIT = "greatest(abs(cgst - CASE WHEN home THEN a - h ELSE 0 END), abs(sgst - CASE WHEN home THEN h ELSE 0 END), abs(igst - CASE WHEN home THEN 0 ELSE a END))"
for _kind, _when, _impact in (
    ("unknown_tax_rate", "rate IS NULL", "0"), ("wrong_tax_rate", "tax_rate_pct <> rate", f"abs({_AT.format('rate')} - a)"), ("miscalculated_tax", f"rate IS NOT NULL AND abs(a - {_AT.format('tax_rate_pct')}) > 1", f"abs(a - {_AT.format('tax_rate_pct')})"),
    ("wrong_tax_split", f"{_SPLIT} > 1", _SPLIT), ("invoice_total_mismatch", "abs(total - taxable_value - a) > 1", "abs(total - taxable_value - a)"), ("invalid_gstin", f"NOT {_VALID}", "a"),
):
    _add(_kind, _TAX + f" SELECT '{_kind}' AS issue_type, record_id, CAST(NULL AS VARCHAR) AS other_id, CAST({_impact} AS DECIMAL(18,2)) AS impact FROM t WHERE {_when}", ("inv", "rates"))(lambda d, k=_kind: _issues(detect.tax_issues(d.inv, d.rates), k))

_DIRECT = f""", ik AS (SELECT *, {key('invoice_no')} AS key, {tax_id('gstin')} AS g FROM inv), pt AS (SELECT *, {key("concat_ws(' ', reference, narration)")} AS body, {key('reference')} AS ref FROM pay),
cuts AS (SELECT DISTINCT txn_id, substr(body, CAST(i AS INT), 11) AS key FROM pt, range(1, 80) AS s(i) WHERE i <= length(body) - 10),
direct AS (SELECT DISTINCT record_id, txn_id FROM ik JOIN cuts USING (key))"""
_EXACT = _DIRECT + """, pairs AS (SELECT ik.key, record_id, txn_id FROM ik JOIN pt ON ik.key = pt.ref AND ik.key <> '' AND abs(abs(total) - abs(amount) - tds_withheld) <= 1),
shape AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS m, count(*) OVER (PARTITION BY txn_id) AS takers FROM pairs),
matched AS (SELECT record_id, txn_id FROM shape WHERE m = 1 AND takers = 1)"""


def _direct(d: Domain) -> DataFrame:
    return blocking.reference_pairs(d.inv, d.pay)


@_add("candidate_reference", _DIRECT + " SELECT record_id, txn_id FROM direct", ("inv", "pay"))
def _(d):
    return _direct(d)


def _left(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Invoices and payments that exact matching leaves."""
    m = matching.cut(matching.exact_matches(d.inv, d.pay).select("record_id", "txn_id"))
    return d.inv.join(m, "record_id", "left_anti"), d.pay.join(m, "txn_id", "left_anti")


@_add("candidate_window", _EXACT + " SELECT record_id, txn_id FROM inv JOIN pay ON pay_date BETWEEN inv_date - 45 AND inv_date + 45 WHERE record_id NOT IN (SELECT record_id FROM matched) AND txn_id NOT IN (SELECT txn_id FROM matched)", ("inv", "pay"))
def _(d):
    return blocking.window_pairs(*_left(d))


@_add("candidate_window_counts", " SELECT record_id, count(*) AS n FROM inv JOIN pay ON pay_date BETWEEN inv_date - 45 AND inv_date + 45 GROUP BY record_id", ("inv", "pay"))
def _(d):
    return blocking.window_counts(d.inv, d.pay)


@_add("baseline_match", _DIRECT + f""", c AS (SELECT ik.key, record_id, txn_id, abs(abs(total) - abs(amount) - tds_withheld) AS gap FROM ik JOIN pt ON ik.key = pt.ref AND ik.key <> '' AND abs(abs(total) - abs(amount) - tds_withheld) <= 1),
g AS (SELECT key, list({{'r': record_id, 't': txn_id}} ORDER BY record_id, gap, txn_id) AS l FROM c GROUP BY key),
w AS (SELECT unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: y.r), x[1].r) OR list_contains(list_transform(a, lambda y: y.t), x[1].t) THEN a ELSE list_concat(a, x) END)) AS p FROM g)
SELECT p.r AS record_id, p.t AS txn_id FROM w""", ("inv", "pay"))
def _(d):
    return matching.baseline_matches(d.inv, d.pay)


_PARTY = "CAST(regexp_extract({}, 'Customer#([0-9]+)', 1) AS BIGINT)"
_SCORED = f""", i AS (SELECT record_id, k, inv_date, total, {_PARTY.format('vendor')} AS party FROM inv), p AS (SELECT txn_id, k AS pk, pay_date, amount, {_PARTY.format('narration')} AS party FROM pay WHERE contains(narration, 'Customer#')),
c AS (SELECT record_id, txn_id, CAST(abs(total - amount) AS DOUBLE) AS gap, k = pk AS direct FROM i JOIN p USING (party) WHERE abs(datediff('day', inv_date, pay_date)) <= 45)"""


@_add("topk_candidates", _SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY -gap DESC, txn_id) AS n FROM c) SELECT record_id, txn_id, direct FROM r WHERE n <= 25 OR direct", ("inv", "pay"))
def _(d):
    party = lambda c: F.regexp_extract(c, "Customer#([0-9]+)", 1)
    i, p = d.inv.withColumn("party", party("vendor")), d.pay.where("contains(narration, 'Customer#')").select("txn_id", "amount", "pay_date", F.col("k").alias("pk"), party("narration").alias("party"))
    c = i.join(p, "party").where("abs(date_diff(inv_date, pay_date)) <= 45").select("record_id", "txn_id", (-F.abs(F.col("total") - F.col("amount")).cast("double")).alias("score"), (F.col("k") == F.col("pk")).alias("direct"))
    return blocking.top_candidates(c).select("record_id", "txn_id", "direct")


@_add("candidate_pairs")
def _(d):
    return blocking.candidates(*map(matching.cut, _left(d))).select("record_id", "txn_id", F.round("score", 6).alias("score"), "direct")


_FEATURE_ROWS = _DIRECT + f""", a AS (SELECT record_id, txn_id, ik.key, ref, ref || ' ' || {key('narration')} AS told, {_NAME.format('vendor')} AS name, {_NAME.format('narration')} AS said, inv_date, pay_date, document_type, abs(total) AS total, amount, tds_withheld AS tds FROM direct JOIN ik USING (record_id) JOIN pt USING (txn_id)),
b AS ({_word_sets('name', 'said')}, abs(total - abs(amount) - tds) AS gap FROM a)"""
_FEATURES = f"""SELECT record_id, txn_id, CASE WHEN contains(told, key) THEN 1.0 END AS invoice_id_similarity, round({_likeness('key', 'ref')} / 100, 9) AS reference_similarity, CAST(CASE WHEN key = '' OR ref = '' THEN 999 ELSE levenshtein(key, ref) END AS DOUBLE) AS invoice_id_edit_distance,
  CAST(key <> '' AND key = ref AS DOUBLE) AS normalized_id_equal, round(CASE WHEN name = '' OR said = '' THEN 0 WHEN wp = '' THEN 100 ELSE {_words_alike('w', 'wp', 'wq')} END / 100, 9) AS vendor_name_similarity, CAST(gap AS DOUBLE) AS amount_abs_diff, round(CAST(gap AS DOUBLE) / greatest(CAST(total AS DOUBLE), 1.0), 9) AS amount_relative_diff,
  CAST(abs(datediff('day', inv_date, pay_date)) AS DOUBLE) AS date_gap_days, CAST(key <> '' AND contains(told, key) AS DOUBLE) AS reference_contains_invoice, CAST((document_type = 'purchase' AND amount >= 0) OR (document_type <> 'purchase' AND amount <= 0) AS DOUBLE) AS direction_matches, CAST(tds AS DOUBLE) AS tds_amount, 0.0 AS same_gstin, 0.0 AS gstin_comparable FROM b"""


@_add("pair_features", _FEATURE_ROWS + " " + _FEATURES, ("inv", "pay"))
def _(d):
    direct = blocking.reference_pairs(d.inv, d.pay)
    return blocking.features(direct, d.inv, d.pay).select("record_id", "txn_id", *[F.round(f, 9).alias(f) for f in blocking.FEATURES])


@_add("exact_match", _EXACT + " SELECT record_id, txn_id FROM matched", ("inv", "pay"))
def _(d):
    return matching.exact_matches(d.inv, d.pay).select("record_id", "txn_id")


@_add("payment_before_invoice", _DIRECT + " SELECT 'payment_before_invoice' AS issue_type, record_id, txn_id AS other_id, CAST(0 AS DECIMAL(18,2)) AS impact FROM direct JOIN ik USING (record_id) JOIN pt USING (txn_id) WHERE pay_date < inv_date", ("inv", "pay"))
def _(d):
    return _issues(detect.payment_amounts(d.inv, d.pay, _direct(d)), "payment_before_invoice")


@_add("short_and_over_payment", _DIRECT + """, g AS (SELECT record_id, ref, total, sum(abs(amount) + tds_withheld) AS paid, count(*) AS n FROM direct JOIN ik USING (record_id) JOIN pt USING (txn_id) WHERE NOT contains(ref, 'BULK') GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, ref) AS rn FROM g)
SELECT CASE WHEN total > paid THEN 'short_payment' ELSE 'overpayment' END AS issue_type, record_id, CAST(NULL AS VARCHAR) AS other_id, CAST(abs(total - paid) AS DECIMAL(18,2)) AS impact FROM b WHERE rn = 1 AND abs(total - paid) > 1""", ("inv", "pay"))
def _(d):
    return _issues(detect.payment_amounts(d.inv, d.pay, _direct(d)), "short_payment", "overpayment")


_LEDGER = f""", i AS (SELECT *, {key('invoice_no')} AS key FROM inv), e AS (SELECT entry_id, led_date, abs(debit) + abs(credit) AS booked, {key('reference')} AS ref FROM led),
a AS (SELECT i.record_id, i.total, i.inv_date, e.*, 1 AS by_ref FROM i JOIN e ON i.key = e.ref AND i.key <> ''),
m AS (SELECT i.record_id, i.total, i.inv_date, e.*, 0 AS by_ref, i.key FROM i JOIN e ON i.total = e.booked WHERE i.record_id NOT IN (SELECT record_id FROM a)),
b AS (SELECT *, 100.0 AS likeness FROM a UNION ALL SELECT * EXCLUDE (key), """ + _likeness("key", "ref") + """ AS likeness FROM m),
best AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY likeness - abs(datediff('day', inv_date, led_date)) DESC, entry_id) AS rn FROM b WHERE likeness >= 65 OR abs(datediff('day', inv_date, led_date)) <= 3)"""
for _kind, _when, _impact in (("ledger_amount_mismatch", "abs(total - booked) > 1", "abs(total - booked)"), ("ledger_date_gap", "abs(datediff('day', inv_date, led_date)) > 1", "0"), ("invoice_id_mismatch", "by_ref = 0", "0")):
    _add(_kind, _LEDGER + f" SELECT '{_kind}' AS issue_type, record_id, entry_id AS other_id, CAST({_impact} AS DECIMAL(18,2)) AS impact FROM best WHERE rn = 1 AND {_when}", ("inv", "led"))(lambda d, k=_kind: _issues(detect.ledger_mismatches(d.inv, d.led), k))

_FILED = f""", f AS (SELECT filing_id, tax_amount, filing_period, {key('invoice_no')} AS key, {tax_id('supplier_gstin')} AS g FROM fil), i AS (SELECT *, {key('invoice_no')} AS key, {tax_id('gstin')} AS g FROM inv WHERE document_type = 'purchase'),
best AS (SELECT i.record_id, i.tax, i.inv_date, f.*, row_number() OVER (PARTITION BY i.record_id ORDER BY filing_id) AS rn FROM i JOIN f ON i.key = f.key AND i.g = f.g)"""
for _kind, _when, _impact in (("gstr2b_tax_mismatch", "abs(tax - tax_amount) > 1", "abs(tax - tax_amount)"), ("wrong_tax_period", "strftime(inv_date, '%Y-%m') <> filing_period", "0")):
    _add(_kind, _FILED + f" SELECT '{_kind}' AS issue_type, record_id, filing_id AS other_id, CAST({_impact} AS DECIMAL(18,2)) AS impact FROM best WHERE rn = 1 AND {_when}", ("inv", "fil"))(lambda d, k=_kind: _issues(detect.filing_mismatches(d.inv, d.fil), k))


_FUZZY = f""", i AS (SELECT record_id, invoice_no, {key('invoice_no')} AS key, {tax_id('gstin')} AS g, inv_date, tax, taxable_value, vendor, {_NAME.format('vendor')} AS name FROM inv WHERE document_type = 'purchase'),
f AS (SELECT filing_id, invoice_no AS filed_no, invoice_date, tax_amount, filing_period, supplier_name, {key('invoice_no')} AS fk, {tax_id('supplier_gstin')} AS fg, taxable_value AS ft, {_NAME.format('supplier_name')} AS fname FROM fil),
same AS (SELECT i.*, f.*, 100.0 AS ids, 100.0 AS names, 450.0 AS score FROM i JOIN f ON key = fk AND g = fg AND name = fname AND taxable_value = ft AND inv_date = invoice_date WHERE key <> '' AND name <> ''),
near AS ({_word_sets('name', 'fname')} FROM i JOIN f ON abs(datediff('day', inv_date, invoice_date)) <= 5 WHERE record_id NOT IN (SELECT record_id FROM same)),
liked AS (SELECT *, {_likeness('key', 'fk')} AS ids, CASE WHEN name = '' OR fname = '' THEN 0 WHEN wp = '' OR wq = '' THEN 100 ELSE {_words_alike('w', 'wp', 'wq')} END AS names FROM near),
scored AS (SELECT * EXCLUDE (w, wp, wq), 1.5 * ids + names + greatest(0, 100 - 100 * abs(CAST(taxable_value AS DOUBLE) - CAST(ft AS DOUBLE)) / greatest(abs(CAST(taxable_value AS DOUBLE)), 1)) + CASE WHEN g = fg THEN 100 ELSE 0 END - 5 * abs(datediff('day', inv_date, invoice_date)) AS score FROM liked WHERE g = fg OR names >= 65 OR ids >= 70),
best AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, filing_id) AS rn FROM (SELECT * FROM same UNION ALL BY NAME SELECT * FROM scored)), one AS (SELECT * FROM best WHERE rn = 1)
""" + " UNION ALL ".join(f"SELECT '{k}' AS issue_type, record_id, filing_id AS other_id, CAST({impact} AS DECIMAL(18,2)) AS impact FROM one WHERE {when}" for k, when, impact in (
    ("gstr2b_tax_mismatch", "abs(tax - tax_amount) > 1", "abs(tax - tax_amount)"), ("wrong_tax_period", "strftime(inv_date, '%Y-%m') <> filing_period", "0"), ("invoice_id_mismatch", f"{tax_id('invoice_no')} <> {tax_id('filed_no')}", "0"), ("vendor_name_mismatch", "names < 75", "0"), ("supplier_gstin_mismatch", "g <> fg", "tax"),
))


@_add("fuzzy_filing", _FUZZY, ("inv", "fil"))
def _(d):
    return _issues(detect.fuzzy_filings(d.inv, d.fil), "gstr2b_tax_mismatch", "wrong_tax_period", "invoice_id_mismatch", "vendor_name_mismatch", "supplier_gstin_mismatch")


def _missing(d: Domain, matched: DataFrame | None = None, direct: DataFrame | None = None) -> DataFrame:
    """What is missing; matched: by default exact matches alone, as SQL can say them."""
    if matched is None:
        matched = matching.exact_matches(d.inv, d.pay)
    if direct is None:  # of matched payments nothing is asked
        direct = blocking.reference_pairs(d.inv, d.pay.join(matched.select("txn_id"), "txn_id", "left_anti"))
    return detect.missing(d.inv, d.pay, d.led, d.fil, matched, direct)


def _accepted(d: Domain) -> DataFrame:
    """(record_id, txn_id) of all tiers' matches of 0.60 or more."""
    return matching.cut(matching.accepted(matching.reconcile(d.inv, d.pay)))


@_add("missing_after_reconcile")
def _(d):
    return _issues(_missing(d, _accepted(d)), "missing_payment", "payment_without_invoice")


@_add("three_way_after_reconcile")
def _(d):
    return matching.three_way(d.inv, d.led, d.fil, _accepted(d))


_E = f", e AS (SELECT entry_id, account, led_date, abs(debit) + abs(credit) AS booked, {key('reference')} AS key FROM led)"
_F = f", f AS (SELECT *, {key('invoice_no')} AS key, {tax_id('supplier_gstin')} AS g FROM fil)"
for _kind, _from, _record, _other, _impact in (
    ("missing_payment", f"FROM ik WHERE inv_date <= DATE '{detect.OPEN_AFTER}' AND record_id NOT IN (SELECT record_id FROM matched)", "record_id", None, "total"),
    ("missing_supplier_filing", "FROM ik WHERE document_type = 'purchase' AND NOT EXISTS (FROM f WHERE f.key = ik.key AND f.g = ik.g)", "record_id", None, "tax"),
    ("missing_ledger_entry", "FROM ik WHERE key <> '' AND NOT EXISTS (FROM e WHERE e.key = ik.key) AND NOT EXISTS (FROM e WHERE abs(ik.total - booked) <= 1 AND abs(datediff('day', inv_date, led_date)) <= 3)", "record_id", None, "total"),
    ("payment_without_invoice", "FROM pay WHERE txn_id NOT IN (SELECT txn_id FROM matched) AND txn_id NOT IN (SELECT txn_id FROM direct)", "txn_id", None, "abs(amount)"),
    ("ledger_without_source", "FROM e WHERE key NOT IN (SELECT key FROM ik WHERE key <> '')", "entry_id", None, "booked"),
    ("supplier_not_filed", "FROM f JOIN (SELECT key, g, min(record_id) AS record_id, arg_min(tax, record_id) AS tax FROM ik GROUP BY key, g) x USING (key, g) WHERE NOT filed", "x.record_id", "filing_id", "x.tax"),
    ("in_gstr2b_not_in_books", "FROM f WHERE NOT EXISTS (FROM ik WHERE f.key = ik.key AND f.g = ik.g)", "filing_id", None, "tax_amount"),
):
    _add(_kind, _EXACT + _E + _F + f" SELECT '{_kind}' AS issue_type, {_record} AS record_id, {_other or 'CAST(NULL AS VARCHAR)'} AS other_id, CAST({_impact} AS DECIMAL(18,2)) AS impact {_from}", ("inv", "pay", "led", "fil"))(lambda d, k=_kind: _issues(_missing(d), k))

_DUP = f", t AS (SELECT *, {key('invoice_no')} AS key, {tax_id('gstin')} AS g FROM twice)"


@_add("duplicate_exact", _DUP + " SELECT 'duplicate_exact' AS issue_type, a.record_id, b.record_id AS other_id, CAST(least(a.total, b.total) AS DECIMAL(18,2)) AS impact FROM t a JOIN t b ON a.g = b.g AND a.key = b.key AND a.record_id < b.record_id AND abs(a.total - b.total) <= 1", ("twice",))
def _(d):
    return _issues(detect.duplicate_invoices(d.twice), "duplicate_exact")


@_add("duplicate_near", _DUP + f", p AS (SELECT a.record_id, b.record_id AS other_id, a.key AS x, b.key AS y, CAST(least(a.total, b.total) AS DECIMAL(18,2)) AS impact FROM t a JOIN t b ON a.g = b.g AND a.key <> b.key AND a.record_id < b.record_id AND abs(a.total - b.total) <= 1 AND abs(datediff('day', a.inv_date, b.inv_date)) <= 3) SELECT 'duplicate_near' AS issue_type, record_id, other_id, impact FROM p WHERE {_likeness('x', 'y')} >= 75", ("twice",))
def _(d):
    return _issues(detect.duplicate_invoices(d.twice), "duplicate_near")


@_add("duplicate_payment", f", t AS (SELECT *, {key('reference')} AS ref FROM pay) SELECT 'duplicate_payment' AS issue_type, a.txn_id AS record_id, b.txn_id AS other_id, CAST(abs(a.amount) AS DECIMAL(18,2)) AS impact FROM t a JOIN t b ON a.ref = b.ref AND a.ref <> '' AND NOT contains(a.ref, 'PART') AND a.amount = b.amount AND a.txn_id < b.txn_id AND abs(datediff('day', a.pay_date, b.pay_date)) <= 10", ("pay",))
def _(d):
    return _issues(detect.duplicate_payments(d.pay), "duplicate_payment")


@_add("lineitem_key_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(d):
    return _table(d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


# --- anomalies ---------------------------------------------------------------
_ANOM = f""", x AS (SELECT record_id, {_NAME.format('vendor')} AS vendor, CAST(total AS DOUBLE) AS t, ln(1 + CAST(total AS DOUBLE)) AS lg, CASE WHEN total >= 10000 AND total % 1000 = 0 THEN 1 ELSE 0 END AS rd, CAST(date_trunc('week', inv_date) AS DATE) AS week FROM inv),
v AS (SELECT vendor, median(lg) AS med, avg(rd) AS rr FROM x GROUP BY vendor), m AS (SELECT x.vendor, median(abs(lg - med)) AS mad FROM x JOIN v USING (vendor) GROUP BY x.vendor)"""


@_add("robust_z", _ANOM + " SELECT record_id, round(CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (lg - med) / mad END, 6) AS z FROM x JOIN v USING (vendor) JOIN m USING (vendor)", ("inv",))
def _(d):
    return detect.vendor_anomalies(d.inv).select("record_id", F.round("robust_z", 6).alias("z"))


@_add("round_rate", _ANOM + " SELECT vendor, round(rr, 9) AS rate FROM v", ("inv",))
def _(d):
    return detect.vendor_anomalies(d.inv).groupBy("vendor").agg(F.round(F.max("round_rate"), 9).alias("rate"))


@_add("weekly_burst", _ANOM + " SELECT record_id, count(*) OVER (PARTITION BY vendor, week) AS n FROM x", ("inv",))
def _(d):
    return detect.vendor_anomalies(d.inv).select("record_id", F.col("week_count").alias("n"))


_SHARES = ", ".join(f"sum(CASE WHEN d = {k} THEN 1 ELSE 0 END) AS d{k}" for k in range(1, 10))
_CHI = " + ".join(f"(d{k} - n * log10(1 + 1.0 / {k})) ** 2 / (n * log10(1 + 1.0 / {k}))" for k in range(1, 10))


@_add("benford", f"WITH a AS (SELECT l_suppkey, CAST(substr(format('{{:.11e}}', l_extendedprice), 1, 1) AS INT) AS d FROM lineitem WHERE l_extendedprice >= 0.1), c AS (SELECT l_suppkey, count(*) AS n, {_SHARES} FROM a WHERE d BETWEEN 1 AND 9 GROUP BY 1), x AS (SELECT l_suppkey, n, {_CHI} AS chi FROM c WHERE n >= 300) SELECT l_suppkey, n, round(chi, 5) AS chi2, round(exp(-chi / 2) * (1 + chi / 2 + chi * chi / 8 + chi * chi * chi / 48), 9) AS p FROM x")
def _(d):
    return detect.benford(_table(d, "lineitem"), "l_suppkey", "l_extendedprice").select("l_suppkey", "n", F.round("chi2", 5).alias("chi2"), F.round("p", 9).alias("p"))


@_add("payment_delay", f", i AS (SELECT {key('invoice_no')} AS key, max(record_id) AS record_id, arg_max(inv_date, record_id) AS inv_date FROM inv GROUP BY 1), p AS (SELECT txn_id, pay_date, {key('reference')} AS key FROM pay) SELECT record_id, CAST(arg_max(datediff('day', inv_date, pay_date), txn_id) AS INT) AS delay FROM i JOIN p USING (key) WHERE key <> '' AND pay_date >= inv_date GROUP BY record_id", ("inv", "pay"))
def _(d):
    return detect.payment_delays(d.inv, d.pay)


_KINDS = ("anomaly_approval_threshold", "anomaly_round_number", "new_vendor_huge_invoice", "anomaly_unusual_spike", "anomaly_behavioral")


@_add("anomaly_rules", _ANOM + f""", l AS (SELECT {key('invoice_no')} AS key, max(record_id) AS record_id, arg_max(inv_date, record_id) AS inv_date FROM inv GROUP BY 1), p AS (SELECT txn_id, pay_date, {key('reference')} AS key FROM pay),
d AS (SELECT record_id, arg_max(datediff('day', inv_date, pay_date), txn_id) AS delay FROM l JOIN p USING (key) WHERE key <> '' AND pay_date >= inv_date GROUP BY record_id),
b AS (SELECT vendor FROM (SELECT vendor, n, {{chi}} AS chi FROM (SELECT vendor, count(*) AS n, {{shares}} FROM (SELECT vendor, CAST(substr(format('{{{{:.11e}}}}', t), 1, 1) AS INT) AS d FROM x WHERE t >= 0.1) GROUP BY vendor) WHERE n >= 300) WHERE exp(-chi / 2) * (1 + chi / 2 + chi * chi / 8 + chi * chi * chi / 48) < 0.01 AND chi / n >= 0.10),
z AS (SELECT x.*, v.rr, CASE WHEN mad = 0 THEN 0 ELSE 0.6745 * (lg - med) / mad END AS z, count(*) OVER (PARTITION BY x.vendor, week) AS n, delay, is_new_vendor, x.vendor IN (SELECT vendor FROM b) AS odd
  FROM x JOIN v USING (vendor) JOIN m USING (vendor) LEFT JOIN d USING (record_id) JOIN (SELECT record_id, is_new_vendor FROM inv) USING (record_id)),
k AS (SELECT *, CASE WHEN t >= 95000 AND t < 100000 THEN 'anomaly_approval_threshold' WHEN rd = 1 AND rr < 0.10 THEN 'anomaly_round_number' WHEN is_new_vendor AND t >= 500000 THEN 'new_vendor_huge_invoice' WHEN abs(z) >= 4 OR odd THEN 'anomaly_unusual_spike' WHEN n >= 4 OR coalesce(delay, 0) > 43 THEN 'anomaly_behavioral' END AS kind FROM z)
SELECT kind AS issue_type, record_id, vendor, CASE WHEN abs(z) >= 6 OR odd THEN 'High' ELSE 'Medium' END AS severity FROM k WHERE kind IS NOT NULL""".replace("{chi}", _CHI).replace("{shares}", _SHARES).replace("{{", "{").replace("}}", "}"), ("inv", "pay"))
def _(d):
    found = detect.anomaly_cases(detect.anomaly_issues(d.inv, detect.payment_delays(d.inv, d.pay), forest=False))
    return found.select("issue_type", "record_id", "vendor", "severity")


@_add("anomaly_issues")
def _(d):
    return _issues(detect.anomaly_issues(d.inv, detect.payment_delays(d.inv, d.pay)), *_KINDS)


# --- tiers -------------------------------------------------------------------
@_add("isolation_outliers")
def _(d):
    return isolation.outliers(d.inv, "record_id", "total")


#: Payments name one number each, so that the greedy matching is done number by number.
_GREEDY = _FEATURE_ROWS + f""", ft AS ({_FEATURES}), c AS (SELECT key, record_id, txn_id, round(0.30 * invoice_id_similarity + 0.22 * vendor_name_similarity + 0.18 * reference_similarity + 0.18 * CAST(amount_relative_diff <= 0.01 AS DOUBLE) + 0.12 * CAST(date_gap_days <= 45 AS DOUBLE), 6) AS conf FROM ft JOIN ik USING (record_id)),
g AS (SELECT key, list({{'r': record_id, 't': txn_id, 'c': conf}} ORDER BY conf DESC, record_id, txn_id) AS l FROM c WHERE conf >= 0.60 GROUP BY key),
w AS (SELECT unnest(list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: y.r), x[1].r) OR list_contains(list_transform(a, lambda y: y.t), x[1].t) THEN a ELSE list_concat(a, x) END)) AS p FROM g)
SELECT p.r AS record_id, p.t AS txn_id, CASE WHEN p.c >= 0.9 THEN 'auto' ELSE 'review' END AS band FROM w"""


@_add("fuzzy_match", _GREEDY, ("inv", "pay"))
def _(d):
    return matching.fuzzy_matches(blocking.features(_direct(d), d.inv, d.pay).withColumn("confidence", F.round(blocking.confidence(), 6))).select("record_id", "txn_id", "band")


def _parts(d: Domain) -> DataFrame:
    """Every invoice's payment in two parts."""
    both = d.inv.select("invoice_no", "vendor", "record_id", "total", "inv_date", F.explode(F.array(F.lit(1), F.lit(2))).alias("h"))
    return both.select(F.concat_ws("-", "record_id", "h").alias("txn_id"), F.when(F.col("h") == 1, F.col("total") - 100).otherwise(100).cast("decimal(18,2)").alias("amount"), F.col("inv_date").alias("pay_date"), F.concat_ws(" ", F.lit("PART"), "vendor").alias("narration"), F.col("invoice_no").alias("reference"), "record_id")


@_add("split_match", " SELECT record_id, record_id || '-1|' || record_id || '-2' AS members FROM inv WHERE total > 100", ("inv",))
def _(d):
    pay = _parts(d)
    scored = blocking.features(pay.select("record_id", "txn_id"), d.inv, pay.drop("record_id"))
    return matching.split_matches(scored, d.inv, pay.drop("record_id")).select("record_id", F.array_join("members", "|").alias("members"))


@_add("bulk_match", ", g AS (SELECT 'BULK' || CAST(CAST(floor(k / 3) AS BIGINT) AS VARCHAR) AS txn_id, record_id FROM inv) SELECT txn_id, string_agg(record_id, '|' ORDER BY record_id) AS members FROM g GROUP BY txn_id HAVING count(*) > 1", ("inv",))
def _(d):
    i = d.inv.withColumn("txn_id", F.concat(F.lit("BULK"), F.floor(F.col("k") / 3)))
    pay = i.groupBy("txn_id").agg(F.sum("total").cast("decimal(18,2)").alias("amount"), F.max("inv_date").alias("pay_date"), F.concat_ws(" ", F.lit("BULK"), F.array_join(F.array_sort(F.collect_list("invoice_no")), " ")).alias("narration"), F.max("txn_id").alias("reference"))
    scored = blocking.features(i.select("record_id", "txn_id"), d.inv, pay)
    return matching.bulk_matches(scored, d.inv, pay).select("txn_id", F.array_join("members", "|").alias("members"))


@_add("reconcile")
def _(d):
    m = matching.reconcile(d.inv, d.pay)
    return m.select("tier", F.array_join(F.array_sort("record_ids"), "|").alias("record_ids"), F.array_join(F.array_sort("txn_ids"), "|").alias("txn_ids"), F.round("confidence", 6).alias("confidence"), "band")


def _labelled(d: Domain) -> DataFrame:
    """Candidate pairs of what exact matching leaves, with features, labelled by the keys that belong together."""
    m = matching.cut(matching.exact_matches(d.inv, d.pay).select("record_id", "txn_id"))
    i, p = matching.cut(d.inv.join(m, "record_id", "left_anti")), matching.cut(d.pay.join(m, "txn_id", "left_anti"))
    truth = i.select("record_id", "k").join(p.where("NOT startswith(txn_id, 'TXO')").select("txn_id", "k"), "k")
    return pair_model.label_pairs(blocking.features(blocking.scored_candidates(i, p), i, p), truth, i, folds=3)


@_add("pair_model_baseline")
def _(d):
    return pair_model.baseline(_labelled(d)).select("record_id", "txn_id", "label", F.round("confidence", 4).alias("confidence"))


@_add("pair_model_scores")
def _(d):
    rows = _labelled(d)
    return pair_model.apply(pair_model.train(rows, rounds=10))(rows).select("record_id", "txn_id", "label", F.round("confidence", 4).alias("confidence"))


@_add("three_way", _EXACT + f""", e AS (SELECT entry_id, abs(debit) + abs(credit) AS booked, {key('reference')} AS key FROM led), own AS (SELECT * FROM ik WHERE record_id IN (SELECT record_id FROM matched)),
l AS (SELECT record_id, entry_id, count(*) OVER (PARTITION BY entry_id) AS n FROM own JOIN e ON own.key = e.key AND own.key <> '' AND abs(total - booked) <= 1),
f AS (SELECT filing_id, {key('invoice_no')} AS key, {tax_id('supplier_gstin')} AS g FROM fil WHERE filed), w AS (SELECT record_id, filing_id, count(*) OVER (PARTITION BY filing_id) AS n FROM own JOIN f ON own.key = f.key AND own.g = f.g)
SELECT record_id, a.entry_id, b.filing_id FROM own LEFT JOIN (SELECT record_id, max(entry_id) AS entry_id FROM l WHERE n = 1 GROUP BY 1) a USING (record_id) LEFT JOIN (SELECT record_id, max(filing_id) AS filing_id FROM w WHERE n = 1 GROUP BY 1) b USING (record_id)""", ("inv", "pay", "led", "fil"))
def _(d):
    return matching.three_way(d.inv, d.led, d.fil, matching.exact_matches(d.inv, d.pay))


# --- all issues, risk, reports, review, evaluation ---------------------------
def _all(d: Domain) -> DataFrame:
    inv, pay, direct = d.inv, d.pay, matching.cut(_direct(d))
    parts = [
        detect.payment_amounts(inv, pay, direct), detect.ledger_mismatches(inv, d.led), detect.filing_mismatches(inv, d.fil), detect.fuzzy_filings(inv, d.fil), detect.duplicate_invoices(inv), detect.duplicate_payments(pay),
        _missing(d, _accepted(d), direct), detect.tax_issues(inv, d.rates), detect.anomaly_issues(inv, detect.payment_delays(inv, pay)),
    ]
    return detect.finish(reduce(DataFrame.unionByName, [p.withColumn("detector", F.lit(i)) for i, p in enumerate(parts)]))


@_add("issue_pipeline")
def _(d):
    return _all(d).select("issue_id", "issue_type", "severity", "record_id", "other_id", "impact", "confidence", "status")


_TAXED = _TAX + ", k AS (" + " UNION ALL ".join(f"SELECT '{n}' AS kind, record_id, vendor FROM t WHERE {w}" for n, w in (("unknown_tax_rate", "rate IS NULL"), ("wrong_tax_rate", "tax_rate_pct <> rate"), ("miscalculated_tax", f"rate IS NOT NULL AND abs(a - {_AT.format('tax_rate_pct')}) > 1"), ("wrong_tax_split", f"{_SPLIT} > 1"), ("invoice_total_mismatch", "abs(total - taxable_value - a) > 1"), ("invalid_gstin", f"NOT {_VALID}"))) + ")"


#: The tax issues with ids, severity and all fields, as SQL.
_EXPECTED = {
    "unknown_tax_rate": ("'rate'", "hsn"), "wrong_tax_rate": ("CAST(rate AS VARCHAR)", "CAST(tax_rate_pct AS VARCHAR)"), "miscalculated_tax": (f"CAST({_AT.format('tax_rate_pct')} AS VARCHAR)", "CAST(a AS VARCHAR)"),
    "wrong_tax_split": ("'split'", "party_state"), "invoice_total_mismatch": ("CAST(taxable_value + a AS VARCHAR)", "CAST(total AS VARCHAR)"), "invalid_gstin": ("'valid'", "gstin"),
}
_TAX_WHEN = {
    "unknown_tax_rate": ("rate IS NULL", "0"), "wrong_tax_rate": ("tax_rate_pct <> rate", f"abs({_AT.format('rate')} - a)"), "miscalculated_tax": (f"rate IS NOT NULL AND abs(a - {_AT.format('tax_rate_pct')}) > 1", f"abs(a - {_AT.format('tax_rate_pct')})"),
    "wrong_tax_split": (f"{_SPLIT} > 1", _SPLIT), "invoice_total_mismatch": ("abs(total - taxable_value - a) > 1", "abs(total - taxable_value - a)"), "invalid_gstin": (f"NOT {_VALID}", "a"),
}
_FULL = _TAX + ", q AS (" + " UNION ALL ".join(f"SELECT '{k}' AS issue_type, record_id, vendor, {_EXPECTED[k][0]} AS expected, {_EXPECTED[k][1]} AS actual, CAST({impact} AS DECIMAL(18,2)) AS impact FROM t WHERE {when}" for k, (when, impact) in _TAX_WHEN.items()) + """),
issues AS (SELECT 'ISS-' || upper(substr(sha1(concat_ws('|', issue_type, record_id, coalesce(expected, ''), coalesce(actual, ''))), 1, 12)) AS issue_id, *, CASE WHEN issue_type = 'unknown_tax_rate' THEN 'Medium' ELSE 'High' END AS severity, 0.95 AS confidence, 'Open' AS status FROM q)"""
_FIX = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detect.FIXES.items() if k in _EXPECTED)


def _taxed(d: Domain) -> DataFrame:
    return detect.finish(detect.tax_issues(d.inv, d.rates))


@_add("tax_issues", _FULL + " SELECT issue_id, issue_type, record_id, vendor, expected, actual, impact, severity, CAST(confidence AS DOUBLE) AS confidence, status FROM issues", ("inv", "rates"))
def _(d):
    return _taxed(d).select("issue_id", "issue_type", "record_id", "vendor", "expected", "actual", "impact", "severity", "confidence", "status")


@_add("issue_explanations", _FULL + f""" SELECT issue_id, vendor || ': this case is flagged as ' || replace(issue_type, '_', ' ') || '. The expected value is ' || expected || '; the observed value is ' || actual || '. The deterministic impact estimate is Rs ' || format('{{:,.2f}}', CAST(impact AS DOUBLE)) || '. Recommended action: ' || CASE issue_type {_FIX} END AS explanation FROM issues""", ("inv", "rates"))
def _(d):
    return detect.explanations(_taxed(d))


@_add("issue_payloads", _FULL + f""" SELECT issue_id, '{{"issue_id":"' || issue_id || '","issue_type":"' || issue_type || '","severity":"' || severity || '","vendor":"' || vendor || '","record_ids":["' || record_id || '"],"rupee_impact":"' || CAST(impact AS VARCHAR) || '","confidence":"0.95","evidence":{{"expected":"' || expected || '","actual":"' || actual || '"}},"suggested_fix":"' || CASE issue_type {_FIX} END || '"}}' AS payload FROM issues""", ("inv", "rates"))
def _(d):
    return detect.payloads(_taxed(d))


@_add("issue_evidence", _FULL + " SELECT issue_id, record_id, impact AS rupee_impact, unnest(['expected', 'actual']) AS field, unnest([expected, actual]) AS value FROM issues", ("inv", "rates"))
def _(d):
    x = detect.from_payloads(detect.payloads(_taxed(d)))
    return x.select("issue_id", F.element_at("record_ids", 1).alias("record_id"), "rupee_impact", F.explode("evidence").alias("field", "value"))


@_add("vendor_risk", _TAXED + """, p AS (SELECT vendor, count(*) AS issues, CAST(sum(CASE WHEN kind = 'unknown_tax_rate' THEN 2 ELSE 3 END) AS BIGINT) AS points FROM k GROUP BY vendor),
b AS (SELECT vendor, count(*) AS invoices, CAST(sum(CASE WHEN document_type = 'purchase' THEN total ELSE 0 END) AS DECIMAL(18,2)) AS exposure FROM inv GROUP BY vendor)
SELECT vendor, invoices, exposure, coalesce(issues, 0) AS issues, coalesce(points, 0) AS points FROM b LEFT JOIN p USING (vendor)""", ("inv", "rates"))
def _(d):
    return liability.vendor_risk(d.inv, detect.finish(detect.tax_issues(d.inv, d.rates))).drop("risk_score")


@_add("vendor_risk_score", _TAXED + """, p AS (SELECT vendor, count(*) AS issues, CAST(sum(CASE WHEN kind = 'unknown_tax_rate' THEN 2 ELSE 3 END) AS BIGINT) AS points FROM k GROUP BY vendor),
b AS (SELECT vendor, count(*) AS invoices, CAST(sum(CASE WHEN document_type = 'purchase' THEN total ELSE 0 END) AS DECIMAL(18,2)) AS exposure FROM inv GROUP BY vendor),
z AS (SELECT vendor, invoices, exposure, coalesce(issues, 0) AS issues, coalesce(points, 0) AS points, 1000 * coalesce(points, 0) AS up, 3 * invoices AS down FROM b LEFT JOIN p USING (vendor))
SELECT vendor, invoices, exposure, issues, points, least(100.0, CAST(up // down + CASE WHEN 2 * (up % down) > down OR (2 * (up % down) = down AND (up // down) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10) AS risk_score FROM z""", ("inv", "rates"))
def _(d):
    return liability.vendor_risk(d.inv, detect.finish(detect.tax_issues(d.inv, d.rates)))


@_add("issue_counts", _TAXED + " SELECT kind AS issue_type, count(*) AS n, count(DISTINCT record_id) AS records FROM k GROUP BY kind", ("inv", "rates"))
def _(d):
    return detect.tax_issues(d.inv, d.rates).groupBy("issue_type").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("records"))


@_add("flow_counts", _EXACT + _E + _F + " SELECT (SELECT count(*) FROM inv) AS invoices, (SELECT count(*) FROM pay) AS payments, (SELECT count(*) FROM matched) AS matched, greatest((SELECT count(*) FROM inv) - (SELECT count(*) FROM matched), 0) AS unmatched_invoices, greatest((SELECT count(*) FROM pay) - (SELECT count(*) FROM matched), 0) AS unmatched_payments", ("inv", "pay", "led", "fil"))
def _(d):
    m = matching.exact_matches(d.inv, d.pay)
    i, p, n = (x.agg(F.count("*").alias(c)) for x, c in ((d.inv, "invoices"), (d.pay, "payments"), (m, "matched")))
    one = i.withColumn("one", F.lit(1)).join(p.withColumn("one", F.lit(1)), "one").join(n.withColumn("one", F.lit(1)), "one").drop("one")
    return one.withColumns({"unmatched_invoices": F.greatest(F.col("invoices") - F.col("matched"), F.lit(0)), "unmatched_payments": F.greatest(F.col("payments") - F.col("matched"), F.lit(0))})


_INBOX = _FULL + """, hit AS (SELECT * FROM issues WHERE severity IN ('High', 'Medium') AND issue_type IN ('wrong_tax_rate', 'invalid_gstin', 'unknown_tax_rate') AND status IN ('Open')
  AND (contains(lower(issue_id), '0001') OR contains(issue_type, '0001') OR contains(lower(record_id), '0001') OR contains(lower(vendor), '0001') OR contains(lower(expected), '0001') OR contains(lower(actual), '0001') OR contains(CAST(impact AS VARCHAR), '0001') OR contains(lower(severity), '0001')))"""
_SHOWN = ["issue_id", "issue_type", "severity", "status", "record_id", "vendor", "impact"]


def _inbox(d: Domain) -> DataFrame:
    return review.inbox(_taxed(d), "0001", ["High", "Medium"], ["wrong_tax_rate", "invalid_gstin", "unknown_tax_rate"], ["Open"])


@_add("case_inbox", _INBOX + f" SELECT {', '.join(_SHOWN)} FROM hit", ("inv", "rates"))
def _(d):
    return _inbox(d).select(*_SHOWN)


@_add("case_page", _INBOX + f" SELECT {', '.join(_SHOWN)} FROM hit ORDER BY CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, impact DESC, issue_id LIMIT 25 OFFSET 25", ("inv", "rates"))
def _(d):
    return review.page(_inbox(d), 2, 25).select(*_SHOWN)


@_add("case_records", _TAXED + ", ids AS (SELECT DISTINCT record_id FROM k WHERE kind = 'invalid_gstin'), own AS (SELECT k FROM inv WHERE record_id IN (SELECT record_id FROM ids)) SELECT 'invoices' AS source, record_id AS id, total AS amount, inv_date AS day FROM inv WHERE k IN (SELECT k FROM own) UNION ALL SELECT 'bank_transactions', txn_id, amount, pay_date FROM pay WHERE k IN (SELECT k FROM own) UNION ALL SELECT 'ledger', entry_id, CAST(debit + credit AS DECIMAL(18,2)), led_date FROM led WHERE k IN (SELECT k FROM own) UNION ALL SELECT 'supplier_filings', filing_id, tax_amount, invoice_date FROM fil WHERE k IN (SELECT k FROM own)", ("inv", "pay", "led", "fil", "rates"))
def _(d):
    ids = detect.tax_issues(d.inv, d.rates).where("issue_type = 'invalid_gstin'").select("record_id")
    own = d.inv.join(ids, "record_id", "left_semi").select("k")
    of = lambda df, c: df.join(own, "k", "left_semi").select(F.col(c).alias("id"))
    case = of(d.inv, "record_id").unionByName(of(d.pay, "txn_id")).unionByName(of(d.led, "entry_id")).unionByName(of(d.fil, "filing_id"))
    tables = {
        "invoices": d.inv.select(F.col("record_id").alias("id"), F.col("total").alias("amount"), F.col("inv_date").alias("day")), "bank_transactions": d.pay.select(F.col("txn_id").alias("id"), "amount", F.col("pay_date").alias("day")),
        "ledger": d.led.select(F.col("entry_id").alias("id"), (F.col("debit") + F.col("credit")).cast("decimal(18,2)").alias("amount"), F.col("led_date").alias("day")), "supplier_filings": d.fil.select(F.col("filing_id").alias("id"), F.col("tax_amount").alias("amount"), F.col("invoice_date").alias("day")),
        "tax_rates": d.rates.select(F.col("hsn").alias("id"), F.col("rate").cast("decimal(18,2)").alias("amount"), F.col("valid_from").alias("day")),
    }
    return review.drill_down(tables, case)


@_add("vendor_cases", _FULL + " SELECT issue_id, record_id, vendor FROM issues WHERE vendor IN (SELECT vendor FROM inv GROUP BY vendor ORDER BY sum(total) DESC, vendor LIMIT 10)", ("inv", "rates"))
def _(d):
    top = d.inv.groupBy("vendor").agg(F.sum("total").alias("amount")).orderBy(F.col("amount").desc(), "vendor").limit(10).select("vendor")
    return _taxed(d).join(F.broadcast(top), "vendor", "left_semi").select("issue_id", "record_id", "vendor")


@_add("narration_rewrite", r" SELECT txn_id, regexp_replace(narration, 'INV-([0-9]+)', 'INV-\1', 'g') AS narration FROM pay", ("pay",))
def _(d):
    return d.pay.select("txn_id", ingest.rewritten(F.col("narration")).alias("narration"))


@_add("group_sizes", " SELECT n AS size, count(*) AS groups FROM (SELECT vendor, inv_date, count(*) AS n FROM inv GROUP BY vendor, inv_date) GROUP BY n", ("inv",))
def _(d):
    return d.inv.groupBy("vendor", "inv_date").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@_add("top_vendors", ", b AS (SELECT vendor, CAST(sum(total) AS DECIMAL(28,2)) AS amount FROM inv GROUP BY vendor) SELECT * FROM b ORDER BY amount DESC, vendor LIMIT 10", ("inv",))
def _(d):
    return d.inv.groupBy("vendor").agg(F.sum("total").cast("decimal(28,2)").alias("amount")).orderBy(F.col("amount").desc(), "vendor").limit(10)


@_add("median_rate", " SELECT document_type, median(CAST(tax_rate_pct AS DOUBLE)) AS rate, median(CAST(total AS DOUBLE)) AS total FROM inv GROUP BY document_type", ("inv",))
def _(d):
    return d.inv.groupBy("document_type").agg(F.median(F.col("tax_rate_pct").cast("double")).alias("rate"), F.median(F.col("total").cast("double")).alias("total"))


@_add("data_profile", " SELECT count(*) AS rows, min(inv_date) AS first, max(inv_date) AS last, count(DISTINCT vendor) AS distinct_vendor, count(DISTINCT gstin) AS distinct_gstin, bool_or(regexp_matches(invoice_no, '^inv ')) AS odd_numbers FROM inv", ("inv",))
def _(d):
    return ingest.profile(d.inv, "inv_date", ["vendor", "gstin"], {"odd_numbers": ("invoice_no", "^inv ")})


_RAW = {"invoice_no": "invoice_no", "GSTIN": "gstin", "vendor_customer_name": "vendor"}


@_add("standardize_changes", f", s AS (SELECT record_id, invoice_no AS b1, {key('invoice_no')} AS a1, gstin AS b2, upper(trim(gstin)) AS a2, vendor AS b3, {_NAME.format('vendor')} AS a3 FROM inv) SELECT record_id AS key, c AS \"column\", b AS before, a AS after FROM (SELECT record_id, 'invoice_no' AS c, b1 AS b, a1 AS a FROM s UNION ALL SELECT record_id, 'GSTIN', b2, a2 FROM s UNION ALL SELECT record_id, 'vendor_customer_name', b3, a3 FROM s) WHERE b IS DISTINCT FROM a", ("inv",))
def _(d):
    return ingest.change_log(ingest.standardize(d.inv, "invoices", {"record_id": "record_id"} | _RAW), "record_id")


@_add("validation_report", f", t AS (SELECT *, {tax_id('gstin')} AS g FROM inv) SELECT count(*) AS rows, '' AS missing_columns, CAST(count_if(inv_date IS NULL) AS BIGINT) AS invalid_dates, CAST(count_if(NOT {_VALID}) AS BIGINT) AS invalid_gstin, count(*) > 0 AS ready FROM t", ("inv",))
def _(d):
    return ingest.validation_report(d.inv, ["record_id", "total"], ["inv_date"], "gstin")


def _log(d: Domain) -> DataFrame:
    """A review log: each invoice is a case, moved on by its key; some skip the step of investigating."""
    steps = F.array(F.lit("Open"), F.lit("Investigating"), F.lit("Explained"), F.lit("Resolved"))
    rows = d.inv.select("k", F.posexplode(F.slice(steps, F.lit(1), (F.col("k") % 4 + 1).cast("int")))).where("k % 11 <> 0 OR pos <> 1")
    return rows.select((F.col("k") * 10 + F.col("pos")).alias("seq"), F.concat(F.lit("C"), F.col("k")).alias("issue_id"), F.lit("a").alias("actor"), F.col("col").alias("action"), F.col("col").alias("status"), F.lit(None).cast("string").alias("note"), F.lit("2024-01-01").cast("timestamp").alias("at"))


@_add("case_status", " SELECT concat('C', CAST(k AS VARCHAR)) AS issue_id, CASE WHEN k % 4 = 0 OR k % 4 = 1 AND k % 11 = 0 THEN 'Open' WHEN k % 4 = 1 THEN 'Investigating' WHEN k % 4 = 2 THEN 'Explained' ELSE 'Resolved' END AS status FROM inv", ("inv",))
def _(d):
    return review.latest(_log(d)).select("issue_id", "status")


@_add("illegal_steps", " SELECT concat('C', CAST(k AS VARCHAR)) AS issue_id, k * 10 + 2 AS seq FROM inv WHERE k % 11 = 0 AND k % 4 >= 2", ("inv",))
def _(d):
    return review.illegal_steps(_log(d)).select("issue_id", "seq")


@_add("pair_metrics", _EXACT + ", t AS (SELECT record_id, txn_id FROM inv JOIN pay USING (k) WHERE starts_with(txn_id, 'TXN')), j AS (SELECT m.record_id AS a, t.record_id AS b FROM matched m FULL JOIN t ON m.record_id = t.record_id AND m.txn_id = t.txn_id), c AS (SELECT count_if(a IS NOT NULL AND b IS NOT NULL) AS tp, count_if(b IS NULL) AS fp, count_if(a IS NULL) AS fn FROM j) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c", ("inv", "pay"))
def _(d):
    truth = d.inv.select("record_id", "k").join(d.pay.where("startswith(txn_id, 'TXN')").select("txn_id", "k"), "k")
    return evaluate.pair_metrics(matching.exact_matches(d.inv, d.pay), truth).drop("f1")


@_add("threshold_curve", """, t AS (SELECT record_id, txn_id, k % 40 / 100.0 + 0.6 AS confidence FROM inv JOIN pay USING (k) WHERE starts_with(txn_id, 'TXN')), c AS (SELECT CAST(range AS INT) AS c FROM range(60, 100)),
n AS (SELECT c, CAST(count(confidence) AS BIGINT) AS tp FROM c LEFT JOIN t ON floor(confidence * 100 + 1e-9) >= c GROUP BY c)
SELECT c / 100 AS cut, tp, CAST(0 AS BIGINT) AS fp, (SELECT count(*) FROM t) - tp AS fn, CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END AS precision, tp / (SELECT count(*) FROM t) AS recall, round(2 * (tp / (SELECT count(*) FROM t)) / (1 + tp / (SELECT count(*) FROM t)), 9) AS f1 FROM n""", ("inv", "pay"))
def _(d):
    truth = d.inv.select("record_id", "k").join(d.pay.where("startswith(txn_id, 'TXN')").select("txn_id", "k"), "k")
    scored = truth.select("record_id", "txn_id", (F.col("k") % 40 / 100 + 0.6).alias("confidence"))
    return evaluate.threshold_curve(scored, truth).withColumn("f1", F.round("f1", 9))


#: Errors that the views inject, by the key's residues: label and where it holds.
_INJECTED = {"miscalculated_tax": "k % 79 = 0", "rounding_diff": "k % 71 = 0", "wrong_tax_split": "k % 73 = 0", "invalid_gstin": "k % 97 = 0", "wrong_tax_rate": "k % 83 = 0"}


_FAMILY = {"miscalculated_tax": "miscalculated_tax", "rounding_diff": "payment_amount", "wrong_tax_split": "wrong_tax_split", "invalid_gstin": "invalid_gstin", "wrong_tax_rate": "wrong_tax_rate"}
_SCORES = _TAXED + ", a AS (SELECT CASE kind WHEN 'invoice_total_mismatch' THEN 'payment_amount' ELSE kind END AS family, record_id, 0 AS truth FROM k WHERE kind <> 'unknown_tax_rate' UNION ALL " + " UNION ALL ".join(f"SELECT '{_FAMILY[n]}', record_id, 1 FROM inv WHERE {w}" for n, w in _INJECTED.items()) + """),
g AS (SELECT family, record_id, sum(truth) AS l, sum(1 - truth) AS i FROM a GROUP BY family, record_id), f AS (SELECT family, CAST(sum(least(l, i)) AS BIGINT) AS tp, CAST(sum(i - least(l, i)) AS BIGINT) AS fp, CAST(sum(l - least(l, i)) AS BIGINT) AS fn FROM g GROUP BY family)
SELECT family, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM f"""


@_add("issue_scores", _SCORES, ("inv", "rates"))
def _(d):
    issues = detect.finish(detect.tax_issues(d.inv, d.rates)).where("issue_type <> 'unknown_tax_rate'").withColumn("record_ids", F.array("record_id"))
    labels = F.array_compact(F.array(*[F.when(F.expr(w), n) for n, w in _INJECTED.items()]))
    truth = d.inv.select(F.explode(labels).alias("label"), F.array("record_id").alias("record_ids"))
    return evaluate.score_issues(issues, truth).select("family", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@_add("weakest_families", _SCORES + " ORDER BY f1, recall, family LIMIT 5", ("inv", "rates"))
def _(d):
    return evaluate.weakest(_QUERIES["issue_scores"](d.spark, d.sf_dir))


@_add("precision_at_k", _FULL + " , top AS (SELECT record_id FROM issues ORDER BY confidence DESC, impact DESC, issue_id LIMIT 60) SELECT CAST(count_if(k % 97 = 0) AS BIGINT) AS hits, count_if(k % 97 = 0) / count(*) AS precision FROM top JOIN inv USING (record_id)", ("inv", "rates"))
def _(d):
    return evaluate.precision_at(_taxed(d), d.inv.where("k % 97 = 0").select("record_id"), 60)


@_add("group_accuracy", " SELECT CAST(count_if(total > 100) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(count_if(total <= 100) AS BIGINT) AS fn, 1.0 AS precision, count_if(total > 100) / count(*) AS recall, round(2 * (count_if(total > 100) / count(*)) / (1 + count_if(total > 100) / count(*)), 9) AS f1, count_if(total > 100) / count(*) AS exact_group_accuracy FROM inv", ("inv",))
def _(d):
    pay = _parts(d)
    scored = blocking.features(pay.select("record_id", "txn_id"), d.inv, pay.drop("record_id"))
    found = matching.split_matches(scored, d.inv, pay.drop("record_id")).select(F.lit("split").alias("tier"), F.array("record_id").alias("record_ids"), F.col("members").alias("txn_ids"), F.lit(0.97).alias("confidence"))
    return evaluate.group_accuracy(found, pay.groupBy("record_id").agg(F.collect_list("txn_id").alias("txn_ids")).select(F.array("record_id").alias("record_ids"), "txn_ids")).withColumn("f1", F.round("f1", 9))


_CLEANED = _monthly("i.tax").replace("FROM inv)", "FROM inv2)").replace("FROM fil)", "FROM fil2)").lstrip(", ")
_NET = _monthly("i.tax") + f""", inv2 AS (SELECT * REPLACE (CAST(tax - CASE WHEN k % 79 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS tax) FROM inv),
fil2 AS (SELECT * REPLACE (CAST(tax_amount - CASE WHEN k % 127 = 0 THEN 40 ELSE 0 END - CASE WHEN k % 79 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS tax_amount, TRUE AS filed) FROM fil),
n AS (SELECT CAST((SELECT sum(o - e) FROM s) AS DECIMAL(28,2)) AS found, CAST((WITH {_CLEANED} SELECT sum(o - e) FROM s) AS DECIMAL(28,2)) AS clean)"""


@_add("liability_error", _NET + " SELECT found, clean, CAST(abs(found - clean) AS DECIMAL(28,2)) AS error, round(CAST(abs(found - clean) AS DOUBLE) / abs(CAST(clean AS DOUBLE)), 6) AS share FROM n", ("inv", "fil"))
def _(d):
    clean = lambda c: (F.col(c) - F.when(F.col("k") % 79 == 0, 5).otherwise(0)).cast("decimal(18,2)")
    off = F.when(F.col("k") % 127 == 0, 40).otherwise(0) + F.when(F.col("k") % 79 == 0, 5).otherwise(0)
    books, filed = d.inv.withColumn("tax", clean("tax")), d.fil.withColumns({"tax_amount": (F.col("tax_amount") - off).cast("decimal(18,2)"), "filed": F.lit(True)})
    return evaluate.liability_error(liability.monthly_liability(d.inv, d.fil), liability.monthly_liability(books, filed)).withColumn("error", F.col("error").cast("decimal(28,2)"))


@_add("windowed_events", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(d):
    return events.run_to_end(events.windowed_sums(events.read_table(d.spark, d.sf_dir, "events"), late=None), "complete").select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


#: Questions by keyword, the first that is named, and the query that answers it.
QUESTIONS = (("liability", "monthly_liability"), ("itc", "itc_risk"), ("vendor", "vendor_risk_score"), ("issue", "issue_pipeline"))


def answer(spark: SparkSession, sf_dir: str, question: str) -> DataFrame:
    """The query that a question's keyword names; other questions are refused."""
    words = question.lower()
    for keyword, name in QUESTIONS:
        if keyword in words:
            return _QUERIES[name](spark, sf_dir)
    raise ValueError("ask about liability, ITC, vendors or issues")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
