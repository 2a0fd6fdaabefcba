"""A generalised additive model with pairwise interactions for the quality of texts.

Features are read off the text alone. Each is cut into bins at quantiles of the training sample. Boosting
goes over the features in turn: each step fits a shallow tree on the bins of one feature to the gradient
of the logistic loss, and adds it, shrunken, to that feature's table. The pairs of features that explain
most of what is left then get tables of their own, boosted alike. Scoring looks each bin up and adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Words, blocks, crc_residue, small_enough

#: Bound of the training sample (labelled rows, by a hash of doc_id), bins, rounds, shrinkage, leaves of a tree.
SAMPLE_ROWS, BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 20_000, 64, 8, 150, 60, 0.15, 4
#: Pairs with a table, least rows in a leaf, damping of leaf values.
PAIRS, LEAST_ROWS, DAMPING = 6, 10, 1.0

FEATURES = ("log_bytes", "log_words", "word_length", "long_words", "upper", "digits", "punctuation", "symbols", "bars", "exclamations", "high_bytes", "lines", "line_words", "repeated_lines", "distinct_words", "capital_words", "ends", "commas", "top_word", "odd_words", "repeated_pairs")

_KIND = np.zeros((8, 256), np.float32)
_KIND[0, 65:91] = 1
_KIND[1, 48:58] = 1
for _c in b".,;:?'\"()-!":
    _KIND[2, _c] = 1
for _c in b"#$%&*@^~_=+<>{}[]\\/`":
    _KIND[3, _c] = 1
_KIND[4, ord("|")] = 1
_KIND[5, ord("!")] = 1
_KIND[6, 128:] = 1
_KIND[7, ord(",")] = 1
_WORD_LAST = np.zeros(256, bool)
for _c in b".!?":
    _WORD_LAST[_c] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LETTER[list(b".,;:!?'\"()-")] = True


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; all are 0 for an empty one."""
    n = len(offs) - 1
    words = Words(data, offs)
    h, counts = words.hashes(), np.diff(words.ptr)
    out = np.zeros((n, len(FEATURES)))
    upper = (data >= 65) & (data <= 90)
    odd = np.concatenate([[0], np.cumsum(~_LETTER[data])])
    strange = odd[words.ends] > odd[words.starts]
    for i in range(n):
        a, b = offs[i], offs[i + 1]
        p, q = words.ptr[i], words.ptr[i + 1]
        if a == b:
            continue
        t, size = data[a:b], b - a
        hist = np.bincount(t, minlength=256)
        shares = _KIND @ hist / size
        out[i, 0], out[i, 1] = np.log1p(size), np.log1p(q - p)
        out[i, 4:8], out[i, 8:11], out[i, 17] = shares[:4], shares[4:7], shares[7]
        lines = bytes(t).split(b"\n")
        out[i, 11] = np.log1p(len(lines))
        out[i, 13] = 1 - len(set(lines)) / len(lines)
        if q > p:
            length, own = words.ends[p:q] - words.starts[p:q], h[p:q]
            unique, times = np.unique(own, return_counts=True)
            out[i, 2], out[i, 3] = length.mean(), (length > 20).mean()
            out[i, 12] = np.log1p((q - p) / len(lines))
            out[i, 14] = len(unique) / (q - p) ** 0.8
            out[i, 15] = upper[words.starts[p:q]].mean()
            out[i, 16] = _WORD_LAST[data[words.ends[p:q] - 1]].mean()
            out[i, 18] = times.max() / (q - p)
            out[i, 19] = strange[p:q].mean()
            if q - p > 1:
                two = own[1:] * np.uint64(31) + own[:-1]
                out[i, 20] = 1 - len(np.unique(two)) / len(two)
    return out


class Model:
    """Cut points, an intercept, a table for each feature, and tables for pairs of features."""

    def __init__(self, cuts: list[np.ndarray], pair_cuts: list[np.ndarray], start: float, tables: list[np.ndarray], pairs: list[tuple[int, int]], pair_tables: list[np.ndarray]):
        self.cuts, self.pair_cuts, self.start = cuts, pair_cuts, start
        self.tables, self.pairs, self.pair_tables = tables, pairs, pair_tables

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j])]
        coarse = [np.searchsorted(cut, x[:, j]) for j, cut in enumerate(self.pair_cuts)]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of the best tree of so many leaves over ordered bins, grown leaf by leaf."""
    spans, out = [(0, len(g))], np.zeros(len(g))
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for s in spans:
            a, b = s
            if b - a < 2:
                continue
            cg, ch, cn = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
            tg, th, tn = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            gain = cg**2 / (ch + DAMPING) + (tg - cg) ** 2 / (th - ch + DAMPING) - tg**2 / (th + DAMPING)
            gain[(cn < LEAST_ROWS) | (tn - cn < LEAST_ROWS)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], s, a + k + 1)
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + DAMPING)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit to rows of features x and labels y (0 or 1); without rows or with one label the score is a constant."""
    d = x.shape[1]
    cuts, pair_cuts = [_cuts(x[:, j], BINS) for j in range(d)], [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(cuts, pair_cuts, float(np.log(share / (1 - share))), tables, [], [])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, j]) for j, c in enumerate(pair_cuts)]
    f = np.full(len(y), model.start)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = gradient()
            size = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), np.bincount(bins[j], minlength=size), LEAVES)
            tables[j] += step
            f += step[bins[j]]
    g, h = gradient()
    gains = []
    for i, j in combinations(range(d), 2):
        shape = (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        sg, sh = np.bincount(cell, g, shape[0] * shape[1]), np.bincount(cell, h, shape[0] * shape[1])
        gains.append(((sg**2 / (sh + DAMPING)).sum(), (i, j), shape, cell))
    chosen = sorted(gains, key=lambda z: -z[0])[:PAIRS]
    model.pairs, model.pair_tables = [z[1] for z in chosen], [np.zeros(z[2]) for z in chosen]
    for _ in range(PAIR_ROUNDS):
        for (_, _, shape, cell), table in zip(chosen, model.pair_tables, strict=True):
            g, h = gradient()
            size = shape[0] * shape[1]
            sg, sh, n = np.bincount(cell, g, size), np.bincount(cell, h, size), np.bincount(cell, minlength=size)
            # cells in order of their mean gradient, so that a tree's leaves are sets of cells
            order = np.argsort(sg / (sh + DAMPING), kind="stable")
            step = np.zeros(size)
            step[order] = RATE * 0.5 * _tree(sg[order], sh[order], n[order], LEAVES)
            table += step.reshape(shape)
            f += step[cell]
    return model


def held_out(modulus: int = 5):
    """Whether crc32 of doc_id as text, modulo `modulus`, is 0 (null doc_id: not)."""
    return F.coalesce(crc_residue("doc_id", modulus) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on docs (doc_id, text) that labels (doc_id, quality) mark and that are not held out.

    The sample has at most about `sample_rows` labelled rows, by a hash of doc_id. A null label or doc_id is
    left out; of several labels of a document the largest holds.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("__doc")).agg(F.max("quality").alias("__y"))
    total = marked.count()
    chosen = marked if total <= sample_rows else marked.where(F.pmod(F.xxhash64("__doc", F.lit(5)), F.lit(1_000_000)) < sample_rows * 1_000_000 // total)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(small_enough(chosen), F.col("__id") == F.col("__doc")).select("__id", "text", F.col("__y").cast("int").alias("y"))
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs, _ in blocks(batch.column("text")):
                x = features(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(i, j - i), batch.column("y").slice(i, j - i), *[pa.array(c) for c in x.T]], names=["id", "y", *names])

    table = rows.mapInArrow(run, "id long, y int, " + ", ".join(f"{n} double" for n in names)).toArrow()
    x = np.stack([table[n].to_numpy() for n in names], axis=1) if table.num_rows else np.zeros((0, len(names)))
    y, ids = table["y"].to_numpy().astype(float), table["id"].to_numpy()
    order = np.lexsort((*x.T, ids)) if len(ids) else np.zeros(0, int)
    return fit(x[order], (y[order] > 0).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text); a null text is empty, and has a score too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs, _ in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(shared.value.score(features(data, offs)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def train_and_score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; predicted is 1 from `threshold` on."""
    model = train(docs, labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
