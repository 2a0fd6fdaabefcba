"""The reconciliation tables as views over orders, customers and nations, in SQL that two engines read alike.

Errors are injected by the order key's residues, so that every detector has something to find.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyforge.operators.lineage import checkpointed

HOME_STATE = "NATION_5"

_D = "CAST({} AS DECIMAL(18,2))"
_RATE = "CAST(CASE WHEN o_orderkey % 83 = 0 THEN 12 ELSE 18 END AS DECIMAL(5,2))"
_TAXABLE = "CAST(CASE WHEN o_orderkey % 43 = 0 THEN round(o_totalprice, -3) ELSE o_totalprice END AS DECIMAL(18,2))"

INV_BASE = f"""
SELECT o_orderkey AS k, c_custkey AS ck, n_nationkey AS nk,
  concat('INVREC', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS record_id,
  CASE WHEN o_orderkey % 211 = 5 THEN concat('inv ', lpad(CAST(o_orderkey - 1 AS STRING), 8, '0')) ELSE concat('INV-', lpad(CAST(o_orderkey AS STRING), 8, '0')) END AS invoice_no,
  CASE WHEN o_orderstatus = 'F' THEN 'sales' ELSE 'purchase' END AS document_type,
  CAST(o_orderdate AS DATE) AS inv_date,
  CASE WHEN o_orderkey % 3 = 0 THEN concat(c_name, ' Pvt. Ltd') ELSE c_name END AS vendor, n_name AS party_state,
  CAST(CAST(o_orderkey % 7 AS INT) AS STRING) AS hsn, {_TAXABLE} AS taxable_value, {_RATE} AS tax_rate_pct,
  CAST(round({_TAXABLE} * {_RATE} * 0.01, 2) + CASE WHEN o_orderkey % 79 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS tax,
  CAST(floor((n_nationkey + 1) / 10) AS INT) AS d1, CAST((n_nationkey + 1) % 10 AS INT) AS d2, CAST(c_custkey % 10000 AS INT) AS cd,
  o_orderkey % 53 = 0 AS is_new_vendor
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

INV = f"""
SELECT k, ck, record_id, invoice_no, document_type, inv_date, vendor, party_state, hsn, taxable_value, tax_rate_pct, tax,
  concat(lpad(CAST(nk + 1 AS STRING), 2, '0'), 'ABCDE', lpad(CAST(cd AS STRING), 4, '0'), 'F1Z', CASE WHEN k % 97 = 0 THEN '#' ELSE
    substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((36 - (d1 + 2 * d2 + 150 + 2 * floor(cd / 1000) + floor((cd % 1000) / 100) + 2 * floor((cd % 100) / 10) + cd % 10) % 36) % 36 + 1 AS INT), 1) END) AS gstin,
  CAST(CASE WHEN (party_state = '{HOME_STATE}') <> (k % 73 = 0) THEN tax - CAST(round(tax * 0.5, 2) AS DECIMAL(18,2)) ELSE 0 END AS DECIMAL(18,2)) AS cgst,
  CAST(CASE WHEN (party_state = '{HOME_STATE}') <> (k % 73 = 0) THEN round(tax * 0.5, 2) ELSE 0 END AS DECIMAL(18,2)) AS sgst,
  CAST(CASE WHEN (party_state = '{HOME_STATE}') <> (k % 73 = 0) THEN 0 ELSE tax END AS DECIMAL(18,2)) AS igst,
  CAST(taxable_value + tax + CASE WHEN k % 71 = 0 THEN 10 ELSE 0 END AS DECIMAL(18,2)) AS total, is_new_vendor
FROM inv_base
"""

PAY = """
SELECT concat('TXN', lpad(CAST(k AS STRING), 8, '0')) AS txn_id, k,
  inv_date + CAST((k * 7) % 50 AS INT) - CAST(CASE WHEN k % 71 = 0 THEN 60 ELSE 0 END AS INT) AS pay_date,
  CAST(CASE WHEN k % 89 = 0 THEN taxable_value WHEN k % 157 = 0 THEN total + 500 ELSE total END - CASE WHEN k % 163 = 0 THEN round(taxable_value * 0.1, 2) ELSE 0 END AS DECIMAL(18,2)) AS amount,
  CAST(CASE WHEN k % 163 = 0 THEN round(taxable_value * 0.1, 2) ELSE 0 END AS DECIMAL(18,2)) AS tds_withheld,
  concat('Payment to ', vendor, ' ', invoice_no) AS narration, CASE WHEN k % 59 = 0 THEN '' ELSE invoice_no END AS reference
FROM inv WHERE k % 61 <> 0
UNION ALL
SELECT concat('TXD', lpad(CAST(k AS STRING), 8, '0')), k, inv_date + CAST((k * 7) % 50 + k % 15 AS INT), total, CAST(0 AS DECIMAL(18,2)), concat('Payment to ', vendor, ' ', invoice_no), invoice_no
FROM inv WHERE k % 101 = 0
UNION ALL
SELECT concat('TXO', lpad(CAST(k AS STRING), 8, '0')), k, inv_date, total, CAST(0 AS DECIMAL(18,2)), 'Cash withdrawal', concat('CASH-', CAST(k AS STRING)) FROM inv WHERE k % 149 = 0
"""

LED = """
SELECT concat('LED', lpad(CAST(k AS STRING), 8, '0')) AS entry_id, k, inv_date + CAST(CASE WHEN k % 107 = 0 THEN 5 ELSE k % 2 END AS INT) AS led_date, 'Purchases' AS account,
  CAST(CASE WHEN k % 103 = 0 THEN total + 75 ELSE total END AS DECIMAL(18,2)) AS debit, CAST(0 AS DECIMAL(18,2)) AS credit,
  CASE WHEN k % 151 = 0 THEN '' ELSE invoice_no END AS reference
FROM inv WHERE k % 67 <> 0
UNION ALL
SELECT concat('LEX', lpad(CAST(k AS STRING), 8, '0')), k, inv_date, 'Journal', total, CAST(0 AS DECIMAL(18,2)), concat('JV-', CAST(k AS STRING)) FROM inv WHERE k % 109 = 0
"""

FIL = """
SELECT concat('FIL', lpad(CAST(k AS STRING), 8, '0')) AS filing_id, k, gstin AS supplier_gstin, vendor AS supplier_name, invoice_no, inv_date AS invoice_date, taxable_value,
  CAST(CASE WHEN k % 127 = 0 THEN tax + 40 ELSE tax END AS DECIMAL(18,2)) AS tax_amount, k % 131 <> 0 AS filed,
  CASE WHEN k % 137 = 0 THEN substr(CAST(inv_date + 31 AS STRING), 1, 7) ELSE substr(CAST(inv_date AS STRING), 1, 7) END AS filing_period
FROM inv WHERE document_type = 'purchase' AND k % 113 <> 0
UNION ALL
SELECT concat('FIX', lpad(CAST(k AS STRING), 8, '0')), k, gstin, vendor, concat('EXT-', CAST(k AS STRING)), inv_date, taxable_value, tax, TRUE, substr(CAST(inv_date AS STRING), 1, 7) FROM inv WHERE k % 139 = 0
"""

#: The books with some bills entered twice: with the same number, or with another letter two days later.
TWICE = """
SELECT * FROM inv
UNION ALL
SELECT k, ck, concat('INVTWO', lpad(CAST(k AS STRING), 8, '0')), CASE WHEN k % 2 = 0 THEN invoice_no ELSE concat(invoice_no, 'A') END, document_type, inv_date + CAST(CASE WHEN k % 2 = 0 THEN 0 ELSE 2 END AS INT),
  vendor, party_state, hsn, taxable_value, tax_rate_pct, tax, gstin, cgst, sgst, igst, total, is_new_vendor
FROM inv WHERE k % 87 = 0
"""

RATES = """
SELECT CAST(h AS STRING) AS hsn, CAST(r AS DECIMAL(5,2)) AS rate, CAST(f AS DATE) AS valid_from, CAST(t AS DATE) AS valid_to, p AS pos
FROM (VALUES ('0', 18, '1990-01-01', NULL, 1), ('1', 18, '1990-01-01', NULL, 2), ('2', 18, '1990-01-01', NULL, 3), ('3', 12, '1990-01-01', '1995-12-31', 4),
  ('3', 18, '1996-01-01', NULL, 5), ('4', 18, '1990-01-01', NULL, 6), ('05', 28, '1990-01-01', '1994-06-30', 7), ('05', 18, '1994-07-01', NULL, 8)) AS v(h, r, f, t, p)
"""

#: The views in the order in which they build on each other.
VIEWS = {"inv_base": INV_BASE, "inv": INV, "pay": PAY, "led": LED, "fil": FIL, "twice": TWICE, "rates": RATES}


def with_clause(*names: str) -> str:
    """A WITH clause (without the word) of the named views and those that they need."""
    need, out = set(names), []
    if need & {"pay", "led", "fil", "twice"}:
        need.add("inv")
    if "inv" in need:
        need.add("inv_base")
    return ", ".join(f"{k} AS ({VIEWS[k]})" for k in VIEWS if k in need)


class Domain:
    """The views as DataFrames over the tables in a folder.

    shared: the books are joined once and written to the folder of checkpoints, for queries that use several views.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, shared: bool = False):
        self.spark, self.sf_dir, self.shared, self._books = spark, sf_dir, shared, None

    def view(self, name: str) -> DataFrame:
        if name == "rates":
            return self.spark.sql(VIEWS[name])
        if name == "inv" and self._books is not None:
            return self._books
        if name == "inv" or not self.shared:
            tables = {t: self.spark.read.parquet(f"{self.sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation")}
            sql = with_clause(name)
            for t in tables:
                sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
            found = self.spark.sql(f"WITH {sql} SELECT * FROM {name}", **tables)
            if name == "inv" and self.shared:
                found = self._books = checkpointed(found.repartition("k"))  # small files come as few partitions
            return found
        return self.spark.sql(re.sub(r"FROM inv\b", "FROM {inv}", VIEWS[name]), inv=self.view("inv"))

    inv = property(lambda self: self.view("inv"))
    pay = property(lambda self: self.view("pay"))
    led = property(lambda self: self.view("led"))
    fil = property(lambda self: self.view("fil"))
    twice = property(lambda self: self.view("twice"))
    rates = property(lambda self: self.view("rates"))
