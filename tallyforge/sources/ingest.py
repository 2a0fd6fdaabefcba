"""Guarded reading, header mapping, standardising, and a log of what changed."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyforge.functions import text
from tallyforge.functions.similarity import ratio, weighted_ratio
from tallyforge.operators.lineage import checkpointed
from tallyforge.sources.reports import read_workbook

FORBIDDEN_FILES = ("injected_errors", "match_challenges", "links")
FORBIDDEN_COLUMNS = ("error_type", "challenge_type")
# The canonical columns of the tables and the headers that name them.
ALIASES = {
    "invoices": {
        "record_id": ["record id", "invoice record id", "row id"], "invoice_no": ["invoice number", "invoice no", "bill number", "document number"], "document_type": ["document type", "type", "purchase sale"],
        "date": ["invoice date", "document date", "date"], "vendor_customer_name": ["vendor", "supplier name", "party name", "customer name"], "GSTIN": ["gstin", "supplier gstin", "tax id"], "party_state": ["state", "vendor state", "place of supply"],
        "HSN": ["hsn", "hsn code", "sac"], "taxable_value": ["taxable value", "taxable amount", "base amount"], "tax_rate_pct": ["tax rate", "gst rate", "rate percent"], "CGST": ["cgst", "central gst"], "SGST": ["sgst", "state gst"], "IGST": ["igst", "integrated gst"],
        "total": ["invoice total", "gross amount", "total amount", "total"], "is_new_vendor": ["new vendor", "is new vendor"],
    },
    "bank_transactions": {
        "txn_id": ["transaction id", "txn id", "bank row id"], "date": ["transaction date", "payment date", "date"], "amount": ["amount", "transaction amount", "payment amount"], "narration": ["narration", "description", "details", "memo"],
        "reference": ["reference", "ref", "cheque number", "invoice reference"], "tds_withheld": ["tds", "tds withheld", "withholding"],
    },
    "ledger": {"entry_id": ["entry id", "ledger id", "journal id"], "date": ["posting date", "entry date", "date"], "account": ["account", "ledger account"], "debit": ["debit", "debit amount"], "credit": ["credit", "credit amount"], "reference": ["reference", "invoice reference", "document number"]},
    "supplier_filings": {
        "filing_id": ["filing id", "row id", "filing record id"], "supplier_GSTIN": ["supplier gstin", "gstin"], "supplier_name": ["supplier name", "vendor name", "legal name"], "invoice_no": ["invoice number", "invoice no", "document number"], "invoice_date": ["invoice date", "document date"],
        "taxable_value": ["taxable value", "taxable amount"], "tax_amount": ["tax amount", "gst amount", "total tax"], "appears_in_supplier_filing": ["appears in filing", "filed", "in gstr2b"], "filing_period": ["filing period", "return period", "tax period"],
    },
    "tax_rates": {"HSN": ["hsn", "hsn code", "sac"], "standard_tax_rate_pct": ["tax rate", "standard rate", "gst rate", "rate percent"], "valid_from": ["valid from", "effective from", "start date"], "valid_to": ["valid to", "effective to", "end date"]},
}
IDENTIFIERS, MONEY = ("invoice_no", "reference"), ("taxable_value", "CGST", "SGST", "IGST", "total", "amount", "tds_withheld", "debit", "credit", "tax_amount")
DATES, NAMES = ("date", "invoice_date", "valid_from", "valid_to"), ("vendor_customer_name", "supplier_name")
TAX_IDS = ("GSTIN", "supplier_GSTIN")


def leaks(name: str, columns: list[str]) -> list[str]:
    """What of a table's name and columns belongs to an answer key."""
    stem = re.sub(r"\.\w+$", "", name.rsplit("/", 1)[-1]).lower()
    return ([stem] if stem in FORBIDDEN_FILES else []) + [c for c in columns if c.lower().startswith("linked_") or c.lower() in FORBIDDEN_COLUMNS]


def assert_safe(tables: dict[str, DataFrame]) -> None:
    """Refuse tables that hold answers; looks at names only."""
    if found := {n: x for n, df in tables.items() if (x := leaks(n, df.columns))}:
        raise ValueError(f"forbidden: {found}")


def strip_answers(df: DataFrame) -> DataFrame:
    return df.drop(*leaks("", df.columns))


def read_table(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """CSV, JSON, Parquet or a workbook's first sheet by suffix, refused if it holds answers; another suffix is an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "json", "parquet", "xlsx"):
        raise ValueError(f"can't read {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    df = read_workbook(spark, path) if kind == "xlsx" else reader.option("header", True).option("encoding", encoding).csv(path) if kind == "csv" else getattr(reader, kind)(path)
    assert_safe({path: df})
    return df


def lint(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """What of each CSV of a folder belongs to an answer key; reads headers only."""
    names = sorted(r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").collect())
    found = {n.rsplit("/", 1)[-1]: leaks(n, spark.read.option("header", True).csv(n).columns) for n in names}
    return {n: x for n, x in found.items() if x}


def safe_member(name: str) -> bool:
    """Whether an archive's member stays inside the folder that it is unpacked to."""
    return not (name.startswith("/") or "\\" in name or ":" in name or ".." in name.split("/"))


def zip_members(spark: SparkSession, path: str, wanted: list[str]) -> dict[str, bytes]:
    """The wanted members of an archive by base name, nested archives included; unsafe, doubled and missing ones are errors."""
    found: dict[str, bytes] = {}

    def walk(data: bytes) -> None:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                if not safe_member(info.filename):
                    raise ValueError(f"unsafe member {info.filename}")
                base = info.filename.rsplit("/", 1)[-1]
                if base.lower().endswith(".zip"):
                    walk(archive.read(info))
                elif base in wanted:
                    if base in found:
                        raise ValueError(f"{base} is there twice")
                    found[base] = archive.read(info)

    walk(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if gone := sorted(set(wanted) - set(found)):
        raise ValueError(f"missing: {gone}")
    return found


def decode(data: bytes) -> str:
    """CSV bytes as text: UTF-8 with or without a mark, else Windows-1252."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("cp1252")


def member_table(spark: SparkSession, data: bytes) -> DataFrame:
    """A CSV member with a header as a table of strings; empty values are null, rows are cut or filled to the header."""
    rows = list(csv.reader(io.StringIO(decode(data), newline="")))
    if not rows:
        raise ValueError("the member has no header")
    n = len(rows[0])
    body = [tuple((x or None) for x in (r + [""] * n)[:n]) for r in rows[1:] if r]
    return spark.createDataFrame(body, StructType([StructField(c, StringType()) for c in rows[0]]))


def later(df: DataFrame, date: str = "date", days: int = 5) -> DataFrame:
    """A held-out table: its dates moved on by so many days."""
    return df.withColumn(date, F.date_add(date, days))


def rewritten(narration: Column) -> Column:
    """A narration whose invoice numbers are written as INV- and digits, which they are already."""
    return F.regexp_replace(narration, r"INV-(\d+)", "INV-$1")


def link_table(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(source_id, invoice_record_id, source_table) of the tables that know which invoice they belong to."""
    out = None
    for name, key in (("bank_transactions", "txn_id"), ("ledger", "entry_id"), ("supplier_filings", "filing_id")):
        if name in tables and "linked_invoice_record_id" in tables[name].columns:
            part = tables[name].select(F.col(key).alias("source_id"), F.col("linked_invoice_record_id").alias("invoice_record_id"), F.lit(name).alias("source_table"))
            out = part if out is None else out.unionByName(part)
    return out


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def header_words(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def table_type(columns: list[str], least: float = 86) -> str:
    """The table whose aliases most headers match; none is an error."""
    heads = [header_words(c) for c in columns]
    scores = {t: sum(any(ratio(h, header_words(x)) >= least for names in ([k, *v] for k, v in fields.items()) for x in names) for h in heads) for t, fields in ALIASES.items()}
    best = max(scores, key=scores.get)
    if not scores[best]:
        raise ValueError("no known table has these columns")
    return best


def suggest_mapping(columns: list[str], table: str, least: float = 72) -> dict[str, str]:
    """Canonical column to the header most like it or one of its aliases, by the weighted ratio, which minds case."""
    out = {}
    for field, aliases in ALIASES[table].items():
        score, head = max(((max(weighted_ratio(c, a) for a in [field, *aliases]), c) for c in columns), key=lambda x: x[0], default=(0, ""))
        if score >= least:
            out[field] = head
    return out


def standardize(df: DataFrame, table: str, mapping: dict[str, str]) -> DataFrame:
    """The canonical columns, each with its raw twin; surrogate record ids follow the order of the raw rows' text."""
    kept = [f for f in ALIASES[table] if f in mapping]
    raw = df.select(*[F.col(f"`{mapping[f]}`").alias(f"{f}_raw") for f in kept])
    new = {}
    for f in kept:
        x = F.col(f"{f}_raw")
        new[f] = text.norm_identifier(x) if f in IDENTIFIERS else text.money(x) if f in MONEY else text.iso_date(x) if f in DATES else text.norm_vendor(x) if f in NAMES else F.upper(F.trim(x)) if f in TAX_IDS else x
    out = raw.withColumns(new)
    if tax := next((t for t in TAX_IDS if t in kept), None):
        out = out.withColumn("gstin_valid", text.gstin_valid(F.col(tax)))
        if table == "invoices":
            out = out.withColumn("party_state", F.coalesce(F.col("party_state") if "party_state" in kept else F.lit(None).cast("string"), text.state_from_gstin(F.col(tax))))
    if table == "invoices" and "record_id" not in kept:
        out = numbered(out, [f"{f}_raw" for f in kept]).withColumn("record_id", F.concat(F.lit("UPINV"), F.lpad(F.col("record_id").cast("string"), 6, "0")))
    return out


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with record_id, the rows' numbers from 1 in the order of the columns: ranges are sorted apart, and counted one after another."""
    sorted_ = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = {r["p"]: r["n"] for r in sorted_.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    begins, at = {}, 0
    for p in sorted(counts):
        begins[p], at = at, at + counts[p]
    if not begins:
        return sorted_.withColumn("record_id", F.lit(0).cast("long")).drop("__at")
    begin = F.element_at(F.create_map(*[F.lit(x) for kv in begins.items() for x in kv]), part)
    return sorted_.withColumn("record_id", (begin + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__at")


def change_log(df: DataFrame, key: str) -> DataFrame:
    """(key, column, before, after): one row for each value that standardising changed."""
    fields = [c[:-4] for c in df.columns if c.endswith("_raw") and c[:-4] in df.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("column"), F.col(f"{f}_raw").cast("string").alias("before"), F.col(f).cast("string").alias("after")) for f in fields]))
    return df.select(F.col(key).alias("key"), pairs.alias("x")).select("key", "x.*").where(~F.col("before").eqNullSafe(F.col("after")))


def validation_report(df: DataFrame, required: list[str], dates: list[str], tax_id: str | None = None) -> DataFrame:
    """One row: rows, missing columns, undated rows, invalid tax ids, and whether the table is ready."""
    gone = sorted(set(required) - set(df.columns))
    bad = F.count_if(~text.gstin_valid(F.col(tax_id))) if tax_id else F.lit(0)
    return df.agg(F.count("*").alias("rows"), F.lit(",".join(gone)).alias("missing_columns"), (sum((F.count_if(F.col(d).isNull()) for d in dates if d in df.columns), F.lit(0))).alias("invalid_dates"), bad.alias("invalid_gstin")).withColumn("ready", (F.col("missing_columns") == "") & (F.col("rows") > 0))


def profile(df: DataFrame, date: str, keys: list[str], patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: count, date span, distinct keys, and whether any value matches each named (column, pattern)."""
    return df.agg(F.count("*").alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"), *[F.countDistinct(k).alias(f"distinct_{k}") for k in keys], *[F.bool_or(F.col(c).rlike(p)).alias(n) for n, (c, p) in patterns.items()])


def write_split(tables: dict[str, DataFrame], truth: dict[str, DataFrame], path: str, reference: dict[str, DataFrame] | None = None, train: bool = False, **more) -> None:
    """Tables without answer columns under raw/, answers and links under truth/, clean tables under reference/ (never for
    a training split), as CSV with headers; and a manifest of what is there."""
    links = link_table(tables)
    truth = truth | ({"links": links} if links is not None else {})
    reference = {} if train or not reference else reference
    for part, own in (("raw", {n: strip_answers(df) for n, df in tables.items()}), ("truth", truth), ("reference", reference)):
        for name, df in own.items():
            df.write.mode("overwrite").option("header", True).csv(f"{path}/{part}/{name}")
    said = {"raw_tables": sorted(tables), "truth_tables": sorted(truth), "reference_tables": sorted(reference), "detector_inputs_exclude_truth": True, **more}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
