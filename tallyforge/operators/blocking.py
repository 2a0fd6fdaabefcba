"""Candidate pairs of invoices and payments, by equi-joins only."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.functions.similarity import CELLS, WORD, Letters, Texts, WordSets, lcs_of_masks, partial_of_masks, partial_ratio_udf, partial_ratios, ratio_udf, ratios, stretches_of_masks, token_set_ratio_udf
from tallyforge.operators.lineage import checkpointed as cut
from tallyforge.operators.nearby import SLACK, best_nearby, cents, day_number

WINDOW_DAYS, LEAST_VENDOR, MOST_CANDIDATES, ID_BYPASS = 45, 55, 25, 0.88


def window_pairs(inv: DataFrame, pay: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(record_id, txn_id) of payments within so many days of the invoice, both ends included.

    Days are cut into buckets of that length; an invoice meets its own bucket and both neighbours.
    """
    epoch = F.lit("1970-01-01").cast("date")
    left = inv.where("inv_date IS NOT NULL").select("record_id", "inv_date", F.explode(F.array(*[F.floor(F.date_diff("inv_date", epoch) / days) + d for d in (-1, 0, 1)])).alias("b"))
    right = pay.where("pay_date IS NOT NULL").select("txn_id", "pay_date", F.floor(F.date_diff("pay_date", epoch) / days).alias("b"))
    return left.join(right, "b").where(F.abs(F.date_diff("inv_date", "pay_date")) <= days).select("record_id", "txn_id")


def reference_pairs(inv: DataFrame, pay: DataFrame, between: str = "") -> DataFrame:
    """(record_id, txn_id) where the payment's text holds the invoice's key, at any date; between: what parts reference and narration.

    Payments are cut into all substrings of the keys' few lengths, which meet the keys in an equi-join.
    """
    keys = inv.select("record_id", text.norm_identifier(F.col("invoice_no")).alias("key")).where("key <> ''")
    lengths = sorted(r[0] for r in keys.select(F.length("key")).distinct().collect())
    body = F.concat_ws(between, text.norm_identifier(F.col("reference")), text.norm_identifier(F.col("narration")))
    cuts = F.concat(*[F.when(F.length("body") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("body") - (n - 1), F.lit(1))), _cut(n))).otherwise(F.array().cast("array<string>")) for n in lengths]) if lengths else F.array().cast("array<string>")
    parts = pay.select("txn_id", body.alias("body")).select("txn_id", F.explode(F.array_distinct(cuts)).alias("key"))
    return keys.join(parts, "key").select("record_id", "txn_id").distinct()


def _cut(n: int):
    return lambda i: F.substring(F.col("body"), i, F.lit(n))


def window_counts(inv: DataFrame, pay: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(record_id, n): how many payments lie within so many days of each dated invoice, where any does.

    Counted without pairs: payments are summed by day, and a window over the calendar's days (whose number the
    data's size doesn't raise) sums around each date on which an invoice lies.
    """
    number = lambda c: F.date_diff(c, F.lit("1970-01-01").cast("date"))
    paid = pay.where("pay_date IS NOT NULL").groupBy(number("pay_date").alias("day")).agg(F.count("*").alias("m"))
    asked = inv.where("inv_date IS NOT NULL").select(number("inv_date").alias("day")).distinct().withColumn("m", F.lit(0).cast("long"))
    daily = paid.unionByName(asked).groupBy("day").agg(F.sum("m").alias("m"))
    sums = daily.select("day", F.sum("m").over(Window.orderBy("day").rangeBetween(-days, days)).alias("n")).where("n > 0")
    return inv.where("inv_date IS NOT NULL").select("record_id", number("inv_date").alias("day")).join(sums, "day").select("record_id", "n")


def pair_texts(pairs: DataFrame, inv: DataFrame, pay: DataFrame) -> DataFrame:
    """Pairs (record_id, txn_id) with the normalised texts, dates and amounts that scores are made of."""
    held = F.lit(0).cast("decimal(18,2)")
    tds = F.coalesce(F.abs("tds_withheld"), held) if "tds_withheld" in pay.columns else held
    i = inv.select("record_id", "inv_date", F.abs(F.coalesce("total", held)).alias("total"), F.lower(F.coalesce("document_type", F.lit("purchase"))).alias("document_type"), text.norm_identifier(F.col("invoice_no")).alias("key"), text.norm_vendor(F.col("vendor")).alias("name"))
    ref, said = text.norm_identifier(F.col("reference")), text.norm_identifier(F.col("narration"))
    p = pay.select("txn_id", "pay_date", F.col("amount").alias("signed"), F.abs(F.coalesce("amount", held)).alias("amount"), tds.alias("tds"), ref.alias("ref"), F.concat_ws(" ", ref, said).alias("body"), text.norm_vendor(F.col("narration")).alias("said"))
    return pairs.join(i, "record_id").join(p, "txn_id").withColumns({
        "direct": (F.col("key") != "") & ((F.col("key") == F.col("ref")) | F.contains("body", "key")), "day_gap": text.day_gap(F.col("inv_date"), F.col("pay_date")),
        "amount_gap": F.abs(F.col("total") - F.col("amount") - F.col("tds")), "amount_share": F.abs(F.col("total") - F.col("amount") - F.col("tds")).cast("double") / F.greatest(F.col("total").cast("double"), F.lit(1.0)),
    })


def _likeness(a: str, b: str, likeness, sure, known: str | None = None):
    """A similarity of 0 to 1; the function is called only where `sure` doesn't already give 1, both have text and the column known has none."""
    open_ = ~sure if known is None else ~sure & F.col(known).isNull()
    made = F.when((F.col(a) == "") | (F.col(b) == ""), 0.0).when(sure, 1.0).otherwise(likeness(F.when(open_, F.col(a)), F.when(open_, F.col(b))) / 100)
    return made if known is None else F.coalesce(known, made)


def _name_likeness(known: str | None = None):
    held = F.size(F.array_except(F.split("name", " "), F.split("said", " "))) == 0
    return _likeness("name", "said", token_set_ratio_udf, held, known)


def _id_likeness(known: str | None = None):
    held = F.contains(F.col("body"), F.col("key"))
    return F.greatest(_likeness("key", "ref", ratio_udf, F.col("key") == F.col("ref"), known), _likeness("key", "body", partial_ratio_udf, held, known))


def candidates(inv: DataFrame, pay: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(record_id, txn_id, score, direct): dated invoices' payments in the window or of their reference, by likeness.

    A pair stays if the vendor is named or the number is much alike; of these each invoice keeps its best and all
    direct ones. Made for what exact matching leaves over. Direct pairs come from an equi-join; the others are scored in
    cells of the window, which give each invoice's best and no other pair.
    """
    return scored_candidates(inv, pay, most).select("record_id", "txn_id", "score", "direct")


#: The likenesses that pairs of a window were scored by; null for direct ones.
LIKENESSES = ("alike", "named", "told")


def scored_candidates(inv: DataFrame, pay: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """candidates() with LIKENESSES, so that features() needn't compare their texts again."""
    own = inv.where("inv_date IS NOT NULL")
    t = pair_texts(reference_pairs(own, pay, " "), own, pay)
    soon = F.greatest(F.lit(0.0), 1 - F.col("day_gap") / WINDOW_DAYS)
    score = 0.45 * F.lit(1.0) + 0.35 * F.lit(0.0) + 0.15 / (1 + F.col("amount_share")) + 0.05 * soon
    direct = t.where("direct").select("record_id", "txn_id", score.alias("score"), "direct", *[F.lit(None).cast("double").alias(n) for n in LIKENESSES])
    held = F.lit(0).cast("decimal(18,2)")
    tds = F.coalesce(F.abs("tds_withheld"), held) if "tds_withheld" in pay.columns else held
    left = own.select("record_id", day_number("inv_date").alias("day"), text.norm_identifier(F.col("invoice_no")).alias("key"), text.norm_vendor(F.col("vendor")).alias("name"), cents(F.abs(F.coalesce("total", held))).alias("total"))
    ref = text.norm_identifier(F.col("reference"))
    right = pay.where("pay_date IS NOT NULL").select(F.col("txn_id").alias("other_id"), day_number("pay_date").alias("day"), ref.alias("ref"), F.concat_ws(" ", ref, text.norm_identifier(F.col("narration"))).alias("body"), text.norm_vendor(F.col("narration")).alias("said"), (cents(F.abs(F.coalesce("amount", held))) + cents(tds)).alias("paid"))
    near = best_nearby(left, right, WINDOW_DAYS, most, _Indirect, ("score", *LIKENESSES), bounded=True).select("record_id", F.col("other_id").alias("txn_id"), "score", F.lit(False).alias("direct"), *LIKENESSES)
    return top_candidates(cut(direct.unionByName(near)), most)


class _Indirect:
    """For best_nearby: scores of invoices with payments that don't hold their number, NaN where neither vendor nor number is alike."""

    def __init__(self, r: pd.DataFrame):
        self.refs, self.bodies, self.saids = r["ref"].tolist(), r["body"].tolist(), r["said"].tolist()
        self.day, self.paid = r["day"].to_numpy(), r["paid"].to_numpy()
        self.ref, self.body, self.said = Texts(self.refs), Texts(self.bodies), WordSets(self.saids)

    def _slow(self, key: str, rows) -> np.ndarray:
        """Which rows a key can't be compared with by masks."""
        if len(key) > WORD or "\0" in key:
            return np.ones(len(self.day[rows]), dtype=bool)
        return (self.body.lengths[rows] <= len(key)) | self.body.odd[rows] | self.ref.odd[rows]

    def _ids(self, keys: list[str], which: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs: the likeness of numbers, that of the number and the reference, both 0 to 100, and whether the body holds the key."""
        whole, told, direct = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), dtype=bool)
        sizes, slow = np.array([len(k) for k in keys])[which], np.zeros(len(rows), dtype=bool)
        ends = np.searchsorted(which, np.arange(len(keys) + 1)).tolist()
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < b and keys[k]:
                slow[a:b] = self._slow(keys[k], rows[a:b])
        for n in np.unique(sizes[(sizes > 0) & ~slow]).tolist():
            patterns = sorted({keys[k] for k in np.unique(which) if len(keys[k]) == n})
            number = {p: i for i, p in enumerate(patterns)}
            pattern = np.array([number.get(k, 0) for k in keys])
            fast = np.flatnonzero((sizes == n) & ~slow)
            bodies, refs = self.body.tables(patterns), self.ref.tables(patterns)
            step = max(64, CELLS // max(len(self.body.codes), 1))
            for k in range(0, len(fast), step):
                at = fast[k : k + step]
                own, p = rows[at], pattern[which[at]]
                whole[at] = partial_of_masks(self.body.masks_of(bodies, p, own), n, self.body.lengths[own])
                size = self.ref.lengths[own]
                told[at] = np.where(size > 0, 200.0 * lcs_of_masks(self.ref.masks_of(refs, p, own), n) / (n + size), 0.0)
            direct[fast] = whole[fast] == 100.0
        at = np.flatnonzero(slow)
        if len(at):
            pairs = [(keys[k], r) for k, r in zip(which[at].tolist(), rows[at].tolist(), strict=True)]
            whole[at] = partial_ratios([(key, self.bodies[r]) for key, r in pairs])
            told[at] = np.where([self.refs[r] != "" for _, r in pairs], ratios([(key, self.refs[r]) for key, r in pairs]), 0.0)
            direct[at] = [key in self.bodies[r] for key, r in pairs]
        return np.maximum(whole, told), told, direct

    def pairs(self, lefts: pd.DataFrame, which: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        alike, told, direct = self._ids(lefts["key"].tolist(), which, rows)
        own = np.split(rows, np.searchsorted(which, np.arange(1, len(lefts))))
        alike, named = alike / 100, self.said.scores_of(lefts["name"].tolist(), own, plain=True) / 100
        total = lefts["total"].to_numpy()[which]
        share = np.abs(total - self.paid[rows]) / 100 / np.maximum(total / 100, 1.0)
        soon = np.maximum(0.0, 1 - np.abs(self.day[rows] - lefts["day"].to_numpy()[which]) / WINDOW_DAYS)
        made = 0.45 * alike + 0.35 * named + 0.15 / (1 + share) + 0.05 * soon
        return {"score": np.where(~direct & ((named * 100 >= LEAST_VENDOR) | (alike >= ID_BYPASS)), made, np.nan), "alike": alike, "named": named, "told": told / 100}

    def bounds(self, lefts: pd.DataFrame) -> _Bounds:
        return _Bounds(self, lefts)


#: Numbers of a length are bounded where a cell has so many of them; into how many parts the bodies' stretches are put.
LEAST_BOUNDED, STRETCHES = 16, 7
#: How many pairs get closer bounds at once.
CLOSER_PAIRS = 4096


class _Bounds:
    """Upper bounds of _Indirect's scores, from the letters and words that texts share."""

    def __init__(self, own: _Indirect, lefts: pd.DataFrame):
        self.own, self.keys, self.names = own, lefts["key"].tolist(), lefts["name"].tolist()
        self.totals, self.days = lefts["total"].to_numpy(), lefts["day"].to_numpy()
        self.sizes, self.made = Counter(len(k) for k in self.keys), {}
        self.paid, self.day = own.paid.astype(np.float32), own.day.astype(np.float32)
        letters, said = Letters(set(self.names)), Texts(own.saids)
        self.bits = {name: letters.of(name) for name in set(self.names)}
        self.words = letters.signs(lambda c: said.sums(c)[-1], (len(own.saids),))
        self.words[said.odd] = ~np.uint64(0)

    def of(self, i: int, lo: int, hi: int) -> np.ndarray | None:
        """No score of a left row with these rows is above; None for numbers that masks don't take or whose length few have."""
        key, n = self.keys[i], len(self.keys[i])
        if not 0 < n <= WORD or "\0" in key or self.sizes[n] < LEAST_BOUNDED:
            return None
        if n not in self.made:
            self.made[n] = _Alike(self.own, n, {k for k in self.keys if len(k) == n})
        alike = self.made[n].most(key, lo, hi)
        named = self.own.said.most(self.names[i], *self.bits[self.names[i]], self.words)[lo:hi] / np.float32(100)
        total = np.float32(max(self.totals[i], 100))
        out = np.float32(0.15) * total / (total + np.abs(self.paid[lo:hi] - np.float32(self.totals[i])))
        out += np.maximum(np.float32(0.05) - np.float32(0.05 / WINDOW_DAYS) * np.abs(self.day[lo:hi] - np.float32(self.days[i])), 0)
        out += np.float32(0.45) * alike
        out += np.float32(0.35) * named
        out[(named < LEAST_VENDOR / 100 - SLACK) & (alike < ID_BYPASS - SLACK)] = -np.inf
        return out

    def closer(self, lefts: np.ndarray, rows: np.ndarray, bounds: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Lower bounds of pairs than those that of() gave, of which only ones that reach `least` matter."""
        out, sizes = np.empty(len(rows)), np.array([len(k) for k in self.keys])[lefts]
        for n, alike in self.made.items():
            number = np.array([alike.number.get(k, 0) for k in self.keys])
            at = np.flatnonzero(sizes == n)
            for k in range(0, len(at), CLOSER_PAIRS):
                own = at[k : k + CLOSER_PAIRS]
                out[own] = alike.closer(number[lefts[own]], rows[own], bounds[own], least[own], 0.45)
        return out


class _Alike:
    """Upper bounds of _Indirect's likeness of numbers of n characters with rows, from the letters that they share.

    A stretch of the body can't have more in common with a number than their letters; stretches that start near each other
    share one sign of their highest counts. Shorter stretches, at both ends of the body, and the reference have their own.
    """

    def __init__(self, own: _Indirect, n: int, keys: set[str]):
        self.letters, self.n, body = Letters(keys), n, own.body
        self.slow = (body.lengths <= n) | body.odd | own.ref.odd
        places = len(body.codes)
        starts = max(places - n + 1, 1)
        self.step = -(-starts // STRETCHES)
        self.heads = np.arange(0, starts, self.step)
        short, ends = max(n - 3, 1), np.minimum(body.lengths, places)[None, :]

        def counts(c: str) -> np.ndarray:
            sums = body.sums(c)
            wide = sums[n:] - sums[:-n] if places >= n else sums[-1:]
            last = [sums[-1] - np.take_along_axis(sums, np.maximum(ends - k, 0), axis=0)[0] for k in (short, n - 1)]
            return np.concatenate([np.maximum.reduceat(wide, self.heads, axis=0), np.stack([sums[min(short, places)], last[0], sums[min(n - 1, places)], last[1], own.ref.sums(c)[-1]])])

        self.signs = self.letters.signs(counts, (len(self.heads) + 5, len(body.lengths)))
        met = np.arange(n + 1)
        # of a stretch of k characters, which shares no more than k, twice what it shares over n + k
        self.whole, self.first = (met / n).astype(np.float32), (2 * met / (n + np.maximum(met, 1))).astype(np.float32)
        self.longer = (2 * met / (n + np.maximum(met, min(short + 1, n)))).astype(np.float32)
        size = own.ref.lengths
        self.told = np.where(size > 0, 2 / (n + size), 0).astype(np.float32)
        self.number, bits = {k: i for i, k in enumerate(keys)}, [self.letters.of(k) for k in keys]
        self.bits, self.others = np.array([b for b, _ in bits], dtype=np.uint64), np.array([o for _, o in bits], dtype=np.uint8)
        self.tables, self.by_row = body.tables(list(keys)), np.ascontiguousarray(self.signs.T)
        self.codes = np.concatenate([body.codes, np.zeros((self.step + n, body.codes.shape[1]), dtype=body.codes.dtype)])

    def _ends(self, met: np.ndarray, rows) -> np.ndarray:
        """Bounds by the short stretches at the ends and by the reference; met: how many letters are shared with each stretch, at most."""
        out = self.first.take(np.maximum(met[-5], met[-4]))
        np.maximum(out, self.longer.take(np.maximum(met[-3], met[-2])), out=out)
        np.maximum(out, met[-1] * self.told[rows], out=out)
        out[self.slow[rows]] = 1
        return out

    def most(self, key: str, lo: int, hi: int) -> np.ndarray:
        k = self.number[key]
        met = np.bitwise_count(self.signs[:, lo:hi] & self.bits[k])
        if self.others[k]:
            met += self.others[k]
        return np.minimum(np.maximum(self.whole.take(met[:-5].max(axis=0)), self._ends(met, slice(lo, hi))), 1)

    def closer(self, number: np.ndarray, rows: np.ndarray, bounds: np.ndarray, least: np.ndarray, weight: float) -> np.ndarray:
        """bounds, of which most() had that weight, by the common subsequence itself where the letters of a stretch reach what is needed."""
        met = (np.bitwise_count(self.by_row[rows] & self.bits[number][:, None]) + self.others[number][:, None]).T
        ends, bound = self._ends(met, rows), self.whole.take(met[:-5])
        rest = bounds - weight * np.minimum(np.maximum(bound.max(axis=0), ends), 1)
        need = (least - rest) / weight
        open_ = (bound >= need) & (ends < need)
        bound[open_] = 0
        out = np.maximum(ends, bound.max(axis=0))
        part, at = np.nonzero(open_)
        if len(at):
            places = self.heads[part] + np.arange(self.step + self.n - 1)[:, None]
            codes = self.codes.ravel().take(places * self.codes.shape[1] + rows[at])
            masks = self.tables.ravel().take(codes + number[at] * self.tables.shape[1])
            np.maximum.at(out, at, self.whole.take(stretches_of_masks(masks, self.n)))
        return rest + weight * np.minimum(out, 1)


#: The features of a pair, in the order in which models take them.
FEATURES = ("invoice_id_similarity", "reference_similarity", "invoice_id_edit_distance", "normalized_id_equal", "vendor_name_similarity", "amount_abs_diff", "amount_relative_diff", "date_gap_days", "reference_contains_invoice", "direction_matches", "tds_amount", "same_gstin", "gstin_comparable")


def features(pairs: DataFrame, inv: DataFrame, pay: DataFrame) -> DataFrame:
    """Pairs (record_id, txn_id) with FEATURES as doubles, and the body for the tiers. Pairs may bring LIKENESSES."""
    known = dict.fromkeys(LIKENESSES) if LIKENESSES[0] not in pairs.columns else {n: n for n in LIKENESSES}
    t = pair_texts(pairs.select("record_id", "txn_id", *filter(None, known.values())), inv, pay)
    outward = F.col("document_type") == "purchase"
    own = inv.select("record_id", F.upper(F.coalesce("gstin", F.lit(""))).alias("g1")) if "gstin" in inv.columns else inv.select("record_id", F.lit("").alias("g1"))
    theirs = pay.select("txn_id", F.upper(F.coalesce("gstin", F.lit(""))).alias("g2")) if "gstin" in pay.columns else None
    t = t.join(own, "record_id")
    t = t.withColumn("g2", F.lit("")) if theirs is None else t.join(theirs, "txn_id")
    both = (F.col("g1") != "") & (F.col("g2") != "")
    values = {
        "invoice_id_similarity": _id_likeness(known["alike"]), "reference_similarity": _likeness("key", "ref", ratio_udf, F.col("key") == F.col("ref"), known["told"]), "invoice_id_edit_distance": F.when((F.col("key") == "") | (F.col("ref") == ""), 999).otherwise(F.levenshtein("key", "ref")),
        "normalized_id_equal": (F.col("key") != "") & (F.col("key") == F.col("ref")), "vendor_name_similarity": _name_likeness(known["named"]), "amount_abs_diff": F.col("amount_gap"), "amount_relative_diff": F.col("amount_share"), "date_gap_days": F.col("day_gap"),
        "reference_contains_invoice": (F.col("key") != "") & F.contains("body", "key"), "direction_matches": (outward & (F.coalesce("signed", F.lit(0)) >= 0)) | (~outward & (F.coalesce("signed", F.lit(0)) <= 0)), "tds_amount": F.col("tds"), "same_gstin": both & (F.col("g1") == F.col("g2")), "gstin_comparable": both,
    }
    return t.select("record_id", "txn_id", *[F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES], "body")


def confidence():
    """The rule-based confidence of a pair's features where there is no model."""
    near, soon = (F.col("amount_relative_diff") <= 0.01).cast("double"), (F.col("date_gap_days") <= 45).cast("double")
    return 0.30 * F.col("invoice_id_similarity") + 0.22 * F.col("vendor_name_similarity") + 0.18 * F.col("reference_similarity") + 0.18 * near + 0.12 * soon


def top_candidates(scored: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """Of (record_id, txn_id, score, direct): each invoice's best, and all direct ones; two branches, so that the rank is pushed down."""
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("score").desc(), "txn_id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    return best.unionByName(scored.where("direct")).dropDuplicates(["record_id", "txn_id"])
