"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are rotated by one random orthogonal matrix and kept as the signs of their coordinates, with two
scalars: the norm and the inner product of the rotated unit vector with its code. Vectors of few dimensions
are filled up by zeros to CODE_BITS before they are rotated. An inner product with a query is then estimated
from the bits alone, and is within a bound of the estimate with a high probability. In each block of vectors
the k-th largest exact inner product of those with the largest estimates is a threshold; vectors whose upper
bound reaches it are reranked by exact double-precision inner products.

Vectors are dealt into inverted lists by directions learned from a bounded sample. How many lists a query
probes is learned too: the least number that holds RECALL of the nearest in the sample. Where that is most of
the lists, as the vectors have no clusters, all vectors are searched, and time grows with queries times
vectors; so they are with exact=True. A list's vectors and its queries are dealt into blocks of bounded
expected size; each pair of blocks is one task's group, whose k best are merged per query. Broadcast are the
rotation, the directions and the lists' sizes, all bounded.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Expected vectors and queries in a block, factor of the error bound, seed of the rotation.
VECTORS, QUERIES, BOUND, SEED = 8192, 4096, 2.5, 20_240_601
#: Least bits of a code; vectors that are reranked for the threshold, for each of the k.
CODE_BITS, AHEAD = 128, 3
#: Expected vectors of a list, most lists, most rows of the sample for each list, most sampled queries, and rounds of learning.
LIST, LISTS, SAMPLE, SAMPLE_QUERIES, ROUNDS = 1024, 4096, 48, 256, 8
#: Share of the sample's nearest that the probed lists must hold, and share of the lists from which on all are searched.
RECALL, MOST_PROBED = 0.97, 0.4
#: Queries that are estimated at once.
_STEP = 256


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix; the same for the same dimensions and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of the rows of x, packed, with the scalars that correct them."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        d = x.shape[1]
        self.scale = np.abs(x).max(axis=1)  # against overflow in squares
        unit = x / self.scale[:, None]
        length = np.sqrt((unit**2).sum(axis=1))
        turned = (unit / length[:, None]) @ turn[:d]
        self.bits = np.packbits(turned > 0, axis=1)
        self.dimensions, self.norm = len(turn), length * self.scale
        self.with_code = np.abs(turned).sum(axis=1) / np.sqrt(len(turn))

    def signs(self) -> np.ndarray:
        return np.unpackbits(self.bits, axis=1, count=self.dimensions).astype(np.float32) * 2 - 1

    def estimates(self, queries: np.ndarray, turn: np.ndarray, bound: float, signs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(queries, vectors) estimates of the inner products, and the bounds of their errors."""
        d = self.dimensions
        signs = self.signs() if signs is None else signs
        with_query = (queries @ turn[: queries.shape[1]]).astype(np.float32) @ signs.T / np.float32(np.sqrt(d))
        length = np.sqrt((queries**2).sum(axis=1))
        wide = np.sqrt(np.maximum(0, 1 - self.with_code**2)) / self.with_code / np.sqrt(max(1, d - 1))
        return with_query * (self.norm / self.with_code), bound * np.outer(length, self.norm * wide)


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed alike for equal rows wherever they stand."""
    return (x * q).sum(axis=1)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, turn: np.ndarray, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score, query's place) of each query's k nearest of a block, its own id left out; ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    codes, found = Codes(x, turn), []
    signs, ahead = codes.signs(), min(len(ids), AHEAD * k)
    for low in range(0, len(q), _STEP):
        part, part_ids = q[low : low + _STEP], query_ids[low : low + _STEP]
        scale = np.maximum(np.abs(part).max(axis=1, keepdims=True), 1e-300)
        estimate, error = codes.estimates(part / scale, turn, bound, signs)
        own = part_ids[:, None] == ids[None, :]
        estimate[own] = -np.inf
        first = np.argpartition(estimate, -ahead, axis=1)[:, -ahead:]
        error += estimate  # upper bounds, from here on
        for i, query in enumerate(part):
            known = _exact(x[first[i]], query)
            known[ids[first[i]] == part_ids[i]] = -np.inf
            least = np.partition(known, -k)[-k] / scale[i, 0] if ahead >= k else -np.inf
            at = np.flatnonzero((error[i] >= least) & ~own[i])
            scores = _exact(x[at], query)
            # those of the threshold are in, whatever their bounds say
            at, scores = np.concatenate([first[i], at]), np.concatenate([known, scores])
            at, once = np.unique(at, return_index=True)
            scores = scores[once]
            best = np.lexsort((ids[at], -scores))[:k]
            best = best[scores[best] > -np.inf]
            found.append((np.full(len(best), part_ids[i]), ids[at][best], scores[best], np.full(len(best), low + i)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows whose vector is not null, empty or zero and has finite components only; floats stay floats, others are doubles."""
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda e: e != 0))


def _stacked(column) -> np.ndarray:
    return np.stack(list(column)).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


class Lists:
    """Directions of the lists, and how many of them a query probes."""

    def __init__(self, sample: np.ndarray, queries: np.ndarray, lists: int, k: int, recall: float = RECALL):
        """Learn both from a sample of vectors (one at least) and of queries, whose nearest k of the sample are known exactly."""
        unit, rng = _units(sample), np.random.default_rng(SEED)
        self.directions = unit[rng.permutation(len(unit))[:lists]]
        for _ in range(ROUNDS):
            own = self.of(sample)
            sums = np.zeros_like(self.directions)
            np.add.at(sums, own, unit)
            filled = np.abs(sums).max(axis=1) > 0
            self.directions[filled] = _units(sums[filled])
        own = self.of(sample)
        k = min(k, max(1, len(sample) // 4))
        near = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, :k]
        order = np.argsort(-(queries @ self.directions.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)[np.arange(len(queries))[:, None], own[near]]  # of each near one's list
        held = np.array([(place < p).mean() for p in range(len(self.directions) + 1)]) if len(queries) else np.ones(len(self.directions) + 1)
        self.probes = max(1, int(np.argmax(held >= recall)))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, int), *[(x[low : low + 4096] @ self.directions.T).argmax(axis=1) for low in range(0, len(x), 4096)]]).astype(int)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """(queries, probes) numbers of lists."""
        most = min(self.probes, len(self.directions))
        return np.argpartition(-(q @ self.directions.T), most - 1, axis=1)[:, :most]


def learn_lists(x: DataFrame, q: DataFrame, n: int, n_queries: int, k: int, lists: int, recall: float = RECALL) -> Lists:
    """Lists for the n rows (vec_id, v) of x and queries of q, from at most about lists * SAMPLE and SAMPLE_QUERIES rows, chosen by hash."""

    def some(df: DataFrame, most: int, of: int) -> np.ndarray:
        draw = F.pmod(F.xxhash64("vec_id", F.lit(SEED + 1)), F.lit(1 << 30)) < min(1 << 30, (most << 30) // max(1, of))
        rows = df.where(draw).orderBy("vec_id").limit(2 * most).toPandas()  # the bound is doubled for chance alone
        return _stacked(rows["v"]) if len(rows) else np.zeros((0, 1))

    sample, queries = some(x, lists * SAMPLE, n), some(q, SAMPLE_QUERIES, n_queries)
    if not len(sample):
        sample = _stacked(x.limit(1).toPandas()["v"])
    return Lists(sample, queries if len(queries) else sample[:0], lists, k, recall)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, bound: float = BOUND, seed: int = SEED, vectors_per_block: int = VECTORS, queries_per_block: int = QUERIES, vectors_per_list: int = LIST, exact: bool = False
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of largest inner product, the nearest first.

    vectors and queries hold (vec_id, embedding). Rows that are not `usable`, or whose vec_id is null, take no
    part; a query meets the vectors of its own length. A repeated query row counts once, and rows of one id
    with different vectors have ranks each; a query never finds its own vec_id. Ties go to the smaller vec_id;
    of rows that repeat a vec_id each is a candidate. Fewer than k candidates of the lists probed are all
    returned; empty tables give no rows. Scores are exact inner products of the vectors in double precision. Other
    columns are not read. exact: search all lists.
    """
    spark = vectors.sparkSession
    x, q = usable(vectors), usable(queries).distinct().withColumn("query", F.xxhash64("v"))
    sizes = [{r["d"]: r["n"] for r in df.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()} for df in (x, q)]
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = []
    for d in sorted(sizes[0].keys() & sizes[1].keys()):
        n, n_queries = sizes[0][d], sizes[1][d]
        own, asked = x.where(F.size("v") == d), q.where(F.size("v") == d)
        lists, most = None, min(LISTS, n // vectors_per_list)
        if most > 1 and not exact:
            lists = learn_lists(own, asked, n, n_queries, k, most)
            lists = None if lists.probes > MOST_PROBED * most else lists
        found.append(_nearest_of_length(own, asked, d, n, n_queries, k, bound, seed, vectors_per_block, queries_per_block, lists))
    return reduce(DataFrame.union, found) if found else none


def _listed(df: DataFrame, lists: Lists | None, many: bool) -> DataFrame:
    """df with the list of each row (many: a row for each list that it probes)."""
    if lists is None:
        return df.withColumn("list", F.lit(0))
    shared = df.sparkSession.sparkContext.broadcast(lists)

    @F.pandas_udf("array<int>")
    def of(v: pd.Series) -> pd.Series:
        x = _stacked(v) if len(v) else np.zeros((0, lists.directions.shape[1]))
        return pd.Series(list((shared.value.probed(x) if many else shared.value.of(x)[:, None]).astype(np.int32)))

    return df.withColumn("list", F.explode(of("v")))


def _nearest_of_length(x: DataFrame, q: DataFrame, d: int, n: int, n_queries: int, k: int, bound: float, seed: int, vectors_per_block: int, queries_per_block: int, lists: Lists | None) -> DataFrame:
    """nearest() among the n vectors of length d, for the n_queries queries of that length."""
    schema = "query_id long, query long, vec_id long, score double"
    turn = rotation(max(d, CODE_BITS), seed)
    x, q = _listed(x, lists, False), _listed(q, lists, True)
    if lists is None:
        blocks, parts = {0: max(8, -(-n // vectors_per_block))}, {0: max(1, -(-n_queries // queries_per_block))}
    else:
        blocks, parts = ({r["list"]: -(-r["n"] // most) for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()} for df, most in ((x, vectors_per_block), (q, queries_per_block)))
    both = x.sparkSession.createDataFrame([(i, blocks[i], parts[i]) for i in blocks.keys() & parts.keys()] or [(-1, 1, 1)], "list int, blocks int, parts int")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(f"{own}s")).cast("int")
        return df.join(F.broadcast(both), "list").select("list", "vec_id", "v", *[c for c in df.columns if c == "query"], block.alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        query_ids, ids, scores, numbers = search_block(a["vec_id"].to_numpy(), _stacked(a["v"]), b["vec_id"].to_numpy(), _stacked(b["v"]), k, turn, bound)
        return pd.DataFrame({"query_id": query_ids, "query": b["query"].to_numpy()[numbers], "vec_id": ids, "score": scores})

    keys = ["list", "block", "part"]
    found = dealt(x, "block", "part").groupBy(*keys).cogroup(dealt(q, "part", "block").groupBy(*keys)).applyInPandas(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
