"""Matching tiers: exact, split and bulk by subset sums, fuzzy by mutual best."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import blocking
from tallyforge.operators.lineage import checkpointed, components

TOLERANCE = 1


def paid(pay: DataFrame) -> Column:
    """What a payment settles: its amount and the tax withheld from it."""
    held = F.coalesce(F.abs("tds_withheld"), F.lit(0)) if "tds_withheld" in pay.columns else F.lit(0)
    return (F.coalesce(F.abs("amount"), F.lit(0)) + held).cast("decimal(18,2)")


def exact_matches(inv: DataFrame, pay: DataFrame) -> DataFrame:
    """(record_id, txn_id, tier, confidence): invoices, in the order of record_id, take the one unused payment of their key and amount.

    A payment's amount counts with the tax withheld from it. Keys are independent. Where a key has one invoice this is
    a count; only keys with several go through a grouped function. Tables have no order of rows, so ids stand for it.
    """
    i = inv.select("record_id", F.abs("total").alias("total"), text.norm_identifier(F.col("invoice_no")).alias("key")).where("key <> ''")
    p = pay.select("txn_id", paid(pay).alias("paid"), text.norm_identifier(F.col("reference")).alias("key"))
    pairs = i.join(p, "key").where(F.abs(F.col("total") - F.col("paid")) <= TOLERANCE).select("key", "record_id", "txn_id")
    shape = Window.partitionBy("key")
    counted = pairs.withColumns({"n": F.min("record_id").over(shape) != F.max("record_id").over(shape), "m": F.count("*").over(Window.partitionBy("record_id"))})
    plain = counted.where("NOT n AND m = 1").select("record_id", "txn_id")

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for record, own in rows.sort_values(["record_id", "txn_id"]).groupby("record_id", sort=True):
            free = [t for t in own["txn_id"] if t not in used]
            if len(free) == 1:
                used.add(free[0])
                out.append((record, free[0]))
        return pd.DataFrame(out, columns=["record_id", "txn_id"])

    several = counted.where("n").select("key", "record_id", "txn_id").groupBy("key").applyInPandas(take, "record_id string, txn_id string")
    return plain.unionByName(several).select("record_id", "txn_id", F.lit("exact").alias("tier"), F.lit(0.99).alias("confidence"))


def baseline_matches(inv: DataFrame, pay: DataFrame) -> DataFrame:
    """(record_id, txn_id): the naive baseline, each invoice taking the unused payment of its number that is nearest in amount."""
    i = inv.select("record_id", F.abs("total").alias("total"), text.norm_identifier(F.col("invoice_no")).alias("key")).where("key <> ''")
    p = pay.select("txn_id", paid(pay).alias("paid"), text.norm_identifier(F.col("reference")).alias("key"))
    pairs = i.join(p, "key").select("key", "record_id", "txn_id", F.abs(F.col("total") - F.col("paid")).alias("gap")).where(f"gap <= {TOLERANCE}")

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for record, own in rows.sort_values(["record_id", "gap", "txn_id"]).groupby("record_id", sort=True):
            free = [t for t in own["txn_id"] if t not in used]
            if free:
                used.add(free[0])
                out.append((record, free[0]))
        return pd.DataFrame(out, columns=["record_id", "txn_id"])

    alone = pairs.withColumns({"n": F.count("*").over(Window.partitionBy("key"))})
    several = alone.where("n > 1").select("key", "record_id", "txn_id", F.col("gap").cast("double").alias("gap"))
    return alone.where("n = 1").select("record_id", "txn_id").unionByName(several.groupBy("key").applyInPandas(take, "record_id string, txn_id string"))


cut = checkpointed


def mutual_best(edges: DataFrame) -> DataFrame:
    """The greedy one-to-one matching of edges (record_id, txn_id, confidence) in order of confidence.

    Under a total order (confidence, then ids) the greedy matching is that of repeatedly taking the edges that
    are the best of both ends. Rounds go on until no edge is open; each takes the best open edge at least.
    """
    open_, taken = cut(edges.select("record_id", "txn_id", "confidence")), None
    order = [F.col("confidence").desc(), F.col("record_id"), F.col("txn_id")]
    while not open_.isEmpty():
        ranked = open_.withColumns({"a": F.row_number().over(Window.partitionBy("record_id").orderBy(*order)), "b": F.row_number().over(Window.partitionBy("txn_id").orderBy(*order))})
        best = cut(ranked.where("a = 1 AND b = 1").select("record_id", "txn_id", "confidence"))
        taken = best if taken is None else taken.unionByName(best)
        open_ = cut(open_.join(best.select("record_id"), "record_id", "left_anti").join(best.select("txn_id"), "txn_id", "left_anti"))
    return open_ if taken is None else taken


def subset_sum(values: list[int], target: int, least: int, most: int, tolerance: int = 0, nodes: int = 10_000) -> list[int] | None:
    """Positions of least..most positive values nearest to target within tolerance, by a bounded search from the largest on."""
    order = sorted((i for i, v in enumerate(values) if v > 0), key=lambda i: (-values[i], i))
    best: tuple[int, list[int]] | None = None
    seen, stack = 0, [(0, 0, [])]
    while stack and seen < nodes:
        at, total, chosen = stack.pop()
        seen += 1
        gap = abs(target - total)
        if len(chosen) >= least and gap <= tolerance and (best is None or gap < best[0]):
            best = (gap, chosen)
            if gap == 0:
                break
        if len(chosen) < most:
            stack += [(k + 1, total + values[order[k]], [*chosen, order[k]]) for k in range(len(order) - 1, at - 1, -1) if total + values[order[k]] <= target + tolerance]
    return sorted(best[1]) if best else None


def group_matches(edges: DataFrame, one: str, many: str, least: int, most: int, shortlist: int, nodes: int) -> DataFrame:
    """(one, many[]) where amounts of 2 or more of `many` sum up to the amount of `one`, within 1.00.

    edges: (one, one_amount, many, many_amount, mentioned, gap, part), part naming a component of the edges;
    within it, ones take in order and what is taken is gone. The shortlist and the bound of the search are part of
    the operator: they keep a group of many candidates from being searched exhaustively.
    """

    def settle(rows: list[tuple]) -> list[tuple]:
        """One component: rows (one, one_amount, many, many_amount, mentioned, gap)."""
        used, out = set(), []
        for key, own in groupby(sorted(rows, key=lambda r: (r[0], r[2])), key=lambda r: r[0]):
            free = sorted((r for r in own if r[2] not in used), key=lambda r: (not r[4], r[5], r[2]))[:shortlist]
            if len(free) >= least and (found := subset_sum([round(r[3] * 100) for r in free], round(free[0][1] * 100), least, most, 100, nodes)):
                ids = sorted(free[k][2] for k in found)
                used |= set(ids)
                out.append((key, ids))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Components lie one after another; one at a time is held, across batches."""
        part, own = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[0] != part and own:
                    out += settle(own)
                    own = []
                part = row[0]
                own.append(row[1:])
            yield pd.DataFrame(out, columns=[one, "members"])
        yield pd.DataFrame(settle(own), columns=[one, "members"])

    rows = edges.select("part", one, "one_amount", many, "many_amount", "mentioned", "gap")
    return rows.repartition("part").sortWithinPartitions("part").mapInPandas(run, f"{one} string, members array<string>")


def _eligible(word: str):
    """Of a candidate's features: the payment mentions the invoice, or is marked by `word`, of a like vendor and near in time."""
    return (F.col("reference_contains_invoice") == 1) | (F.col("body").contains(word) & (F.col("vendor_name_similarity") >= 0.70) & (F.col("date_gap_days") <= 45))


def _group_edges(scored: DataFrame, inv: DataFrame, pay: DataFrame, word: str, one: str, many: str) -> DataFrame:
    amounts = {"record_id": inv.select("record_id", F.abs("total").alias("of_record_id")), "txn_id": pay.select("txn_id", paid(pay).alias("of_txn_id"))}
    e = scored.where(_eligible(word)).join(amounts["record_id"], "record_id").join(amounts["txn_id"], "txn_id")
    e = e.select("record_id", "txn_id", F.col(f"of_{one}").alias("one_amount"), F.col(f"of_{many}").alias("many_amount"), (F.col("reference_contains_invoice") == 1).alias("mentioned"), F.col("date_gap_days").alias("gap"))
    return _with_part(e, one, many)


def split_matches(scored: DataFrame, inv: DataFrame, pay: DataFrame) -> DataFrame:
    """(record_id, members): invoices settled by 2 or 3 payments; scored: candidates with their features."""
    return group_matches(_group_edges(scored, inv, pay, "PART", "record_id", "txn_id"), "record_id", "txn_id", 2, 3, 18, 10_000)


def bulk_matches(scored: DataFrame, inv: DataFrame, pay: DataFrame) -> DataFrame:
    """(txn_id, members): payments that settle 2 to 6 invoices; scored: candidates with their features."""
    return group_matches(_group_edges(scored, inv, pay, "BULK", "txn_id", "record_id"), "txn_id", "record_id", 2, 6, 20, 30_000)


def _with_part(edges: DataFrame, one: str, many: str) -> DataFrame:
    """edges with a name of their connected component.

    Ones with a single edge can't form a group and are left out first, so that components stay small.
    """
    several = edges.groupBy(one).agg(F.count("*").alias("n")).where("n > 1").select(one)
    edges = cut(edges.join(several, one, "left_semi"))
    return edges.join(components(edges, one, many), many)


def fuzzy_matches(scored: DataFrame, least: float = 0.60) -> DataFrame:
    """The greedy matching of candidates with a confidence of `least` or more, with their band."""
    best = mutual_best(scored.where(F.col("confidence") >= least))
    return best.withColumn("band", text.band(F.col("confidence")))


def three_way(inv: DataFrame, led: DataFrame, fil: DataFrame, matched: DataFrame) -> DataFrame:
    """(record_id, entry_id, filing_id) of matched invoices: the ledger entry and the filing that are theirs alone."""
    own = inv.join(matched.select("record_id").distinct(), "record_id", "left_semi").select("record_id", "total", text.norm_identifier(F.col("invoice_no")).alias("key"), text.norm_tax_id(F.col("gstin")).alias("tax_id"))
    entries = led.select("entry_id", (F.abs("debit") + F.abs("credit")).alias("booked"), text.norm_identifier(F.col("reference")).alias("key"))
    one = own.where("key <> ''").join(entries, "key").where(F.abs(F.col("total") - F.col("booked")) <= TOLERANCE).withColumn("n", F.count("*").over(Window.partitionBy("entry_id"))).where("n = 1").groupBy("record_id").agg(F.max("entry_id").alias("entry_id"))
    filed = fil.where(F.coalesce("filed", F.lit(True))).select("filing_id", text.norm_identifier(F.col("invoice_no")).alias("key"), text.norm_tax_id(F.col("supplier_gstin")).alias("tax_id"))
    two = own.where("key <> ''").join(filed, ["key", "tax_id"]).withColumn("n", F.count("*").over(Window.partitionBy("filing_id"))).where("n = 1").groupBy("record_id").agg(F.max("filing_id").alias("filing_id"))
    return own.select("record_id").join(one, "record_id", "left").join(two, "record_id", "left")


def reconcile(inv: DataFrame, pay: DataFrame, model=None) -> DataFrame:
    """(tier, record_ids, txn_ids, confidence, band): exact, then split, then bulk, then fuzzy matches.

    Candidates are made once, of what exact matching leaves. model: a function from candidates with features to
    the same with `confidence`; without one the rules give it. Only matches of band auto use up their ids.
    """
    exact = cut(exact_matches(inv, pay).select("record_id", "txn_id"))
    left, paid = cut(inv.join(exact, "record_id", "left_anti")), cut(pay.join(exact, "txn_id", "left_anti"))
    scored = cut(blocking.features(blocking.scored_candidates(left, paid), left, paid))
    split = cut(split_matches(scored, left, paid))
    used = split.select(F.explode("members").alias("txn_id"))
    rest = scored.join(split.select("record_id"), "record_id", "left_anti").join(used, "txn_id", "left_anti")
    bulk = cut(bulk_matches(rest, left, paid))
    rest = rest.join(bulk.select("txn_id"), "txn_id", "left_anti").join(bulk.select(F.explode("members").alias("record_id")), "record_id", "left_anti")
    fuzzy = fuzzy_matches(model(rest) if model else rest.withColumn("confidence", blocking.confidence()))
    row = lambda df, tier, records, txns, sure, band: df.select(F.lit(tier).alias("tier"), records.alias("record_ids"), txns.alias("txn_ids"), sure.alias("confidence"), band.alias("band"))
    auto, sure = F.lit("auto"), F.lit(0.97)
    parts = [row(split, "split", F.array("record_id"), F.col("members"), sure, auto), row(bulk, "bulk", F.col("members"), F.array("txn_id"), sure, auto), row(fuzzy, "fuzzy", F.array("record_id"), F.array("txn_id"), F.col("confidence"), F.col("band"))]
    out = row(exact, "exact", F.array("record_id"), F.array("txn_id"), F.lit(0.99), auto)
    for p in parts:
        out = out.unionByName(p)
    return out


def accepted(matches: DataFrame, least: float = 0.60) -> DataFrame:
    """(record_id, txn_id) of reconcile()'s matches whose confidence is `least` or more: each invoice with each payment of its match."""
    sure = matches.where(F.col("confidence") >= least)
    return sure.select(F.explode("record_ids").alias("record_id"), "txn_ids").select("record_id", F.explode("txn_ids").alias("txn_id"))


def unmatched(ids: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    """Of ids (one column) those that no match of band auto holds in its array `column`."""
    name = ids.columns[0]
    return ids.join(matches.where("band = 'auto'").select(F.explode(column).alias(name)), name, "left_anti")
