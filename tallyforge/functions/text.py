"""Scalar expressions over identifiers, names, tax ids, dates and money; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that end a company's name, and the states of tax-id prefixes.
SUFFIXES = ("LTD", "LIMITED", "PVT", "PRIVATE", "LLP", "PLC", "INC")
STATES = {
    "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana", "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh",
    "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh", "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya", "18": "Assam", "19": "West Bengal",
    "20": "Jharkhand", "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat", "26": "Dadra and Nagar Haveli and Daman and Diu", "27": "Maharashtra", "29": "Karnataka",
    "30": "Goa", "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry", "35": "Andaman and Nicobar Islands", "36": "Telangana", "37": "Andhra Pradesh", "38": "Ladakh", "97": "Other Territory",
}
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def norm_identifier(x: Column) -> Column:
    """Upper-case letters and digits only, with O read as 0 and I as 1; null gives ''."""
    return F.translate(norm_tax_id(x), "OI", "01")


def norm_tax_id(x: Column) -> Column:
    """Upper-case letters and digits only; null gives ''."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]", "")


def norm_vendor(x: Column) -> Column:
    """Upper-case words, & as AND, without company suffixes at the end; null gives ''."""
    plain = F.regexp_replace(F.replace(F.upper(F.coalesce(x, F.lit(""))), F.lit("&"), F.lit(" AND ")), r"[^A-Z0-9 ]+", " ")
    words = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.trim(F.regexp_replace(words, rf"(^| )(({'|'.join(SUFFIXES)})( |$))+$", ""))


def check_digit(prefix: Column) -> Column:
    """The base-36 check character of the first 14 characters."""
    i = F.sequence(F.lit(1), F.lit(14))
    product = lambda p: (F.instr(F.lit(BASE36), F.substring(prefix, p, F.lit(1))) - 1) * (2 - p % 2)
    total = F.aggregate(i, F.lit(0), lambda a, p: a + F.floor(product(p) / 36).cast("int") + product(p) % 36)
    return F.substring(F.lit(BASE36), (36 - total % 36) % 36 + 1, F.lit(1))


def gstin_valid(x: Column) -> Column:
    """15 base-36 characters after punctuation is dropped, Z in place 14, and the right check character."""
    g = norm_tax_id(x)
    return g.rlike("^[0-9A-Z]{13}Z[0-9A-Z]$") & (F.substring(g, 15, 1) == check_digit(g))


def state_from_gstin(x: Column) -> Column:
    """The state of a 15-character tax id's prefix, else null."""
    g = norm_tax_id(x)
    states = F.create_map(*[F.lit(v) for kv in STATES.items() for v in kv])
    return F.when(F.length(g) == 15, F.try_element_at(states, F.substring(g, 1, 2)))


def money(x: Column) -> Column:
    """Text as money: commas and currency signs dropped; what is no number is null."""
    return F.translate(x.cast("string"), ",₹", "").try_cast("decimal(18,2)")


def iso_date(x: Column) -> Column:
    """The date of the first ten characters, or null."""
    return F.try_to_date(F.substring(x.cast("string"), 1, 10))


def hsn_key(x: Column) -> Column:
    return F.ltrim(x, F.lit("0"))


def day_gap(a: Column, b: Column) -> Column:
    """Days between two dates, 9999 if one is unknown."""
    return F.coalesce(F.abs(F.date_diff(a, b)), F.lit(9999))


def first_digit(x: Column) -> Column:
    """The first significant digit of an amount of at least 0.1."""
    return F.when(x >= 0.1, F.substring(F.format_string("%.11e", x.cast("double")), 1, 1).cast("int"))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "auto").when(confidence >= 0.6, "review").otherwise("unmatched")


def issue_id(kind: Column, ids: Column, expected: Column, actual: Column) -> Column:
    """A stable id from an issue's kind, sorted record ids, and expected and actual values."""
    return F.concat(F.lit("ISS-"), F.upper(F.substring(F.sha1(F.concat_ws("|", kind, F.array_join(F.array_sort(ids), ","), expected, actual)), 1, 12)))
