"""Similarity digests of improbable features.

Every window of WINDOW bytes has an entropy, in GRADES grades. A grade's rank is its share of all windows
of the corpus: the rarer, the lower; windows of one rank are in the order of their hashes. In every run of
windows the one of lowest rank gets a point, and windows of at least a quarter of the run are the text's
features. A run has an eighth of the text's windows, RUN at most, so that short texts have features enough;
a text of fewer bytes than a window is filled up by zeros. In text order, features are put into a chain of
Bloom filters, PER_FILTER into each. Two digests are compared filter by filter: the bits in common beyond
chance, in units of the most that could be in common beyond chance.

Entropies slide: a window's sum of c*log(c) over its byte counts changes by the counts of the byte that
leaves and the byte that enters, which are found for a whole block of texts by shifted comparisons. Sums are
whole numbers, so a window's grade doesn't depend on what stands before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import blocks, even_keys, mix, release, string_buffers

WINDOW, RUN, GRADES = 16, 64, 1000
#: Windows of a text for each window of a run, and windows of a run for each point that a feature needs.
RUNS, POINTS = 8, 4
#: Features in a filter, bits of a filter, bits that a feature sets.
PER_FILTER, BITS, HASHES = 160, 2048, 5
#: Of what can be in common beyond chance, the share that still counts as chance.
CHANCE = 0.3
#: Ranges of doc_id at most, and those of a partition. Rows of a range stream, so its size bounds a task's time only.
MOST_RANGES, RANGES_EACH = 200_000, 4
_BLOCK, _ROWS = 1 << 17, 256
_UNIT = 1 << 24  # of the whole numbers that entropies are summed in
_F = np.rint(np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))]) * _UNIT).astype(np.int64)
_STEP = np.diff(_F)  # by the count before: what one more adds


def entropy_grades(data: np.ndarray) -> np.ndarray:
    """The grade of each window of the bytes (as many as len(data) - WINDOW + 1, or none)."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    out = np.empty(n, np.int32)
    for low in range(0, n, _BLOCK):
        out[low : low + _BLOCK] = _grades(data[low : low + _BLOCK + WINDOW - 1])
    return out


def _grades(t: np.ndarray) -> np.ndarray:
    n = len(t) - WINDOW + 1
    after, before = np.zeros(len(t), np.uint8), np.zeros(len(t), np.uint8)
    for d in range(1, WINDOW):
        same = (t[:-d] == t[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    s = np.empty(n, np.int64)
    s[0] = _F[np.bincount(t[:WINDOW], minlength=256)].sum()
    # from window i to i + 1: t[i] leaves (its count falls to `after`), t[i + WINDOW] enters (it rises from `before`)
    np.subtract(_STEP[before[WINDOW:]], _STEP[after[: n - 1]], out=s[1:])
    np.cumsum(s, out=s)
    return ((_F[WINDOW] - s) * GRADES // _F[WINDOW]).astype(np.int32)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another, short ones filled up by zeros: their bytes, where each begins, and its windows (an empty text: none)."""
    length = np.array([len(t) for t in texts], np.int64)
    room = np.where(length > 0, np.maximum(length, WINDOW), 0)
    starts = np.cumsum(room) - room
    data = np.zeros(int(room.sum()), np.uint8)
    for t, a in zip(texts, starts.tolist(), strict=True):
        data[a : a + len(t)] = t
    return data, starts, np.maximum(room - WINDOW + 1, 0) * (length > 0)


def window_keys(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each window of the bytes its rank, then 54 bits of a hash of its bytes: what windows are ordered by."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for low in range(0, n, _BLOCK):
            part = np.ascontiguousarray(data[low : low + _BLOCK + WINDOW - 1])
            m = len(part) - WINDOW + 1
            h = np.full(m, 0x51ED270B, np.uint64)
            for at in range(0, WINDOW, 16):
                a, b = (np.ndarray((m,), "<u8", part, at + k, (1,)) for k in (0, 8))
                h = mix((h ^ a) * np.uint64(0x9E3779B97F4A7C15) + b)
            out[low : low + m] = ranks[_grades(part)].astype(np.uint64) << np.uint64(54) | h >> np.uint64(10)
    return out


def features(keys: np.ndarray) -> np.ndarray:
    """Hashes of the features of a text with these windows, in text order, each once."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.uint64)
    run = min(RUN, max(1, n // RUNS))
    least, width = keys, 1
    while width < run:
        step = min(width, run - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    points = np.diff(np.append(new, len(least)))  # a window's points lie together
    h = mix(least[new][points >= min(max(1, run // POINTS), points.max())])
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def filters(h: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters of feature hashes, a row of packed bits each."""
    k = -(-len(h) // PER_FILTER)
    bits = np.zeros((k, BITS), np.uint8)
    row = np.arange(len(h)) // PER_FILTER
    for i in range(HASHES):
        bits[row, (h >> np.uint64(11 * i)).astype(np.int64) & (BITS - 1)] = 1
    return np.packbits(bits, axis=1)


def fingerprint(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The digest of a text's bytes; of an empty one, no filter."""
    return filters(features(window_keys(joined([data])[0], ranks)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean, over the shorter digest's filters weighted by their bits, of the best likeness to a filter of the other.

    Two empty digests are alike (1), an empty one and another are not (0).
    """
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = np.bitwise_count(a).sum(axis=1).astype(float), np.bitwise_count(b).sum(axis=1).astype(float)
    best = np.zeros(len(a))
    for i, row in enumerate(a):
        most = np.minimum(x[i], y)
        chance = x[i] * y / BITS
        floor = chance + CHANCE * (most - chance)
        both = np.bitwise_count(row & b).sum(axis=1)
        # filters of very unequal fill say little of each other
        best[i] = (np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1) * (most / np.maximum(np.maximum(x[i], y), 1)) ** 0.5).max()
    return float((best * x).sum() / x.sum())


def text_of(chain: np.ndarray) -> str:
    """A digest as text: the number of filters and their bits in base 64."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def learn_ranks(docs: DataFrame) -> np.ndarray:
    """Each grade's rank, 0 the rarest that occurs, from the grades of all windows of all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRADES + 1, np.int64)
        for batch in batches:
            for _, _, data, offs, _ in blocks(batch.column("text")):
                if np.diff(offs).min() < WINDOW:
                    data, starts, _ = joined([data[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
                    offs = np.append(starts, len(data))
                total += np.bincount(_whole(entropy_grades(data), offs), minlength=GRADES + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["grade", "n"])

    counts = np.zeros(GRADES + 1, np.int64)
    for row in docs.select("text").mapInArrow(run, "grade int, n long").groupBy("grade").agg(F.sum("n").alias("n")).collect():
        counts[row["grade"]] = row["n"]
    return ranks_of(counts)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Ranks from the windows of each grade; grades without any come last."""
    order = np.lexsort((np.arange(GRADES + 1), np.where(counts > 0, counts, np.iinfo(np.int64).max)))
    ranks = np.empty(GRADES + 1, np.int32)
    ranks[order] = np.arange(GRADES + 1)
    return ranks


def _whole(grades: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of the grades over joined texts, those of windows within one text."""
    ends = np.repeat(offs[1:], np.diff(offs))[: len(grades)]
    return grades[np.arange(len(grades)) + WINDOW <= ends]


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) for each row of docs (doc_id, text); ranks are learned from docs if not given.

    A null or empty text has a digest without filters. Equal texts have equal digests, of any length; rows
    that repeat a doc_id have one each. Other columns are not read. An empty table gives no rows.
    """
    ranks = learn_ranks(docs) if ranks is None else ranks
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, _ = string_buffers(batch.column("text"))
            out = [text_of(fingerprint(data[a:b], shared.value)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, rows_per_range: int = 1000) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; and the likeness to the next document.

    The edited text's last third (of code points, rounded down) is as much of the begin of the next document,
    in descending order of doc_id; the last one's next is the first. Equal doc_ids are ordered by their text,
    a null doc_id comes last, a null text is empty; a document alone is its own next one. Two empty texts are
    alike (1), an empty one and another are not (0). Other columns are not read. An empty table gives no rows.

    Documents are dealt by ranges of doc_id between quantiles, one shuffle; each range also gets the document
    that follows its last one, found from the ranges' largest ids alone.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranks = spark.sparkContext.broadcast(learn_ranks(docs))
    ranges = max(1, min(MOST_RANGES, -(-plain.count() // rows_per_range)))
    marks = plain.select(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("q")).first()["q"] if ranges > 1 else None
    marks = sorted(set(marks or []))
    # ranges are numbered in descending order of ids; the nulls are in the last
    known = spark.sparkContext.broadcast(np.array(marks, dtype=np.int64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(len(known.value) - np.searchsorted(known.value, ids.to_numpy(), side="left"), dtype="int32")

    dealt = plain.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(marks) + 1)).otherwise(place(F.coalesce("doc_id", F.lit(0)))))
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    wants = spark.createDataFrame([(heads[i - 1]["part"], h["part"], h["head"]) for i, h in enumerate(heads)], "to int, part int, head long")
    wants = wants.select("to", F.col("part").alias("h_part"), "head")
    lent = dealt.join(F.broadcast(wants), (F.col("part") == F.col("h_part")) & F.col("doc_id").eqNullSafe(F.col("head")))
    # of rows of one doc_id only the first in order is the head
    lent = lent.groupBy("to").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("part"), F.lit(1).alias("lent"))
    both = dealt.withColumn("lent", F.lit(0)).unionByName(lent)
    # neighbouring ranges share a partition, of which each has as many
    parts = -(-len(heads) // RANGES_EACH)
    even = spark.sparkContext.broadcast(even_keys(spark, parts))

    @F.pandas_udf("int")
    def key(part: pd.Series) -> pd.Series:
        return pd.Series(even.value[np.minimum(part.to_numpy() // RANGES_EACH, parts - 1)], dtype="int32")

    sorted_ = both.withColumn("deal", key("part")).repartition(parts, "deal").sortWithinPartitions("part", "lent", F.col("doc_id").desc_nulls_last(), "text").drop("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                rows = list(zip(*[batch.column(c).slice(low, _ROWS).to_pylist() for c in ("doc_id", "text", "part", "lent")], strict=True))
                out, held = _compared(held, rows, ranks.value)
                release()
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in out], schema=_ARROW)

    return sorted_.mapInArrow(run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_ARROW = pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in SCHEMA.split(", ")])


class _Text:
    """A row with its bytes, the keys of its windows and its digest."""

    def __init__(self, row: tuple, data: np.ndarray):
        (self.doc, self.text, self.part, self.lent), self.data = row, data
        self.keys: np.ndarray = np.zeros(0, np.uint64)
        self.chain: np.ndarray = np.zeros((0, BITS // 8), np.uint8)


def _all_keys(texts: list[np.ndarray], ranks: np.ndarray) -> list[np.ndarray]:
    data, starts, windows = joined(texts)
    keys = window_keys(data, ranks)
    return [keys[a : a + n].copy() for a, n in zip(starts.tolist(), windows.tolist(), strict=True)]


def _compared(held: _Text | None, rows: list[tuple], ranks: np.ndarray) -> tuple[list[tuple], _Text | None]:
    """Results of the rows whose next one is among `rows` too, `held` being the one before; and the row that waits for its next."""
    texts = [_Text(r, np.frombuffer(r[1].encode("utf-8", "surrogatepass"), np.uint8)) for r in rows]
    for t, keys in zip(texts, _all_keys([t.data for t in texts], ranks), strict=True):
        t.keys, t.chain = keys, filters(features(keys))
    pairs = [(a, b) for a, b in zip([held, *texts[:-1]], texts, strict=True) if a is not None and not a.lent and a.part == b.part]
    edits, pieces = [], []
    for own, following in pairs:
        cut = len(own.text) // 3
        kept, taken = own.text[: len(own.text) - cut].encode("utf-8", "surrogatepass"), following.text[:cut].encode("utf-8", "surrogatepass")
        a, b = len(kept), len(taken)
        apart = min(a, b) >= WINDOW
        edits.append((kept + taken, a, b, apart))
        # only windows over the cut are new
        pieces.append(np.frombuffer(kept[a - WINDOW + 1 :] + taken[: WINDOW - 1] if apart else kept + taken, np.uint8))
    out = []
    for (own, following), (edited, a, b, apart), new in zip(pairs, edits, _all_keys(pieces, ranks), strict=True):
        keys = np.concatenate([own.keys[: a - WINDOW + 1], new, following.keys[: b - WINDOW + 1]]) if apart else new
        chain = filters(features(keys))
        out.append((own.doc, len(own.text), hashlib.sha256(edited).hexdigest(), text_of(own.chain), text_of(chain), likeness(own.chain, chain), likeness(own.chain, following.chain)))
    return out, texts[-1] if texts else held
