"""Exact Jaccard self-join on word shingles, with token-combination prefixes.

A document is the set of hashes of its k-word shingles. Tokens are ordered by class (rare first)
and hash. A prefix is long enough when, with c tokens of a subclass indexed by w-token combinations,
the sum of max(0, c - w + 1) exceeds the number of tokens that a partner may lack; then two documents
that reach the threshold share a combination. Rare tokens are indexed alone (w = 1), frequent ones in
pairs, very frequent ones in triples; the two upper classes are cut into subclasses by hash, as many as
fit the larger set's size, so that combinations stay in proportion to the set.

Copies of one set are one node. Each combination's nodes are first verified against two of them, chosen
anew for each combination and round, which is linear in the index; once few pairs of nodes in different
components are left, these are verified too.
No pair that reaches the threshold is lost, no group is expanded into all of its pairs. Parity sketches of
the sets bound their symmetric difference from below, so that most pairs go before sets are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, Words, blocks, checkpointed, fresh, mix, small_enough
from tallyforge.llm.components import connected_components

#: Words in a shingle and least percentage of intersection to union.
WORDS, PERCENT = 5, 80
#: Most tokens in the upper classes; it bounds the broadcast (9 bytes each), for any input.
MOST_FREQUENT = 1 << 20
#: A token is never frequent below this count, and very frequent from so many times the bound.
LEAST_COUNT, STEP = 16, 16
#: Rounds of pivots at most; pairs left for each member of a signature from which there is another round.
PIVOT_ROUNDS, PAIRS_EACH = 6, 4
#: Set sizes per subclass, by class.
PER_SUBCLASS = {2: 64, 3: 24}
_SIZE = (1 << 20) - 1
_PARTS = [f"part{i}" for i in range(8)]
_SALT = 0x2545F4914F6CDD1D


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and their offsets."""
    h, ptr = words.hashes(), words.ptr
    n = np.diff(ptr)
    doc = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        start = np.arange(len(h))
        length = np.minimum(n, k)[doc]
        whole = start + length <= ptr[doc + 1]
        at, length = start[whole], length[whole]
        s = mix(length.astype(np.uint64) + np.uint64(_SALT))
        for step in range(k):
            has = length > step
            s[has] = mix(s[has] * np.uint64(0x9E3779B97F4A7C15) + h[at[has] + step])
    doc = doc[at]
    edges = np.searchsorted(doc, np.arange(len(n) + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        s[a:b].sort()
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[keep], np.searchsorted(doc[keep], np.arange(len(n) + 1))


def node_of(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def code_of(node: bytes | None, n: int) -> int | None:
    """43 bits of a node and its set's size (cut at 2^20 - 1): what the index holds instead of the node."""
    return None if node is None else (int.from_bytes(node[:6], "little") & (1 << 43) - 1) << 20 | min(n, _SIZE)


def sketch_of(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts by their low bits, about a bit for each token; halves fold by exclusive or."""
    m = min(max(512, 1 << (len(tokens) - 1).bit_length()), 1 << 16)
    odd = np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(sketch: bytes) -> np.ndarray:
    """A sketch as eight longs."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > 64:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """No more than the size of the symmetric difference of two sets, from their sketches."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _level(n: int) -> int:
    return n.bit_length()


def signatures(tokens: np.ndarray, classes: np.ndarray, missing: int, percent: int) -> np.ndarray:
    """The signatures of one set; classes holds 1, 2 or 3 for each token (ascending by hash)."""
    n, need = len(tokens), missing + 1
    if (classes == 1).sum() >= need:
        return tokens[classes == 1][:need]
    order = np.argsort(classes, kind="stable")
    tokens, classes = tokens[order], classes[order]
    found = [tokens[classes == 1]]
    for level in range(_level(n), _level(n * 100 // percent) + 1):
        units, groups = int((classes == 1).sum()), {}
        for token, w in zip(tokens[classes > 1].tolist(), classes[classes > 1].tolist(), strict=True):
            group = groups.setdefault((w, token % max(1, (1 << level) // PER_SUBCLASS[w])), [])
            group.append(token)
            units += len(group) >= w
            if units >= need:
                break
        sets = [(w, level, c) for (w, _), group in groups.items() for c in combinations(sorted(group), w)]
        for w in (2, 3):
            if rows := [c for x, _, c in sets if x == w]:
                with np.errstate(over="ignore"):
                    s = np.full(len(rows), _SALT ^ (level * 8 + w), dtype=np.uint64)
                    for part in np.array(rows, dtype=np.uint64).T:
                        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + part)
                found.append(s)
    return np.concatenate(found)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i, j, data, offs, _ in blocks(batch.column("text")):
            tokens, ptr = shingle_sets(Words(data, offs), k)
            yield batch.slice(i, j - i), tokens, ptr


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, node, code, sketch, part0..7): each document's set size, a digest that equal sets share, its code and sketch (null: empty)."""

    def run(batches):
        for batch, tokens, ptr in _sets(batches, words):
            nodes = [node_of(tokens[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            codes = [code_of(x, n) for x, n in zip(nodes, np.diff(ptr).tolist(), strict=True)]
            sketches = [sketch_of(tokens[a:b]) if b > a else None for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
            parts = np.array([folded(x) if x else np.zeros(8, np.int64) for x in sketches]).reshape(-1, 8)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(ptr)), pa.array(nodes, pa.binary()), pa.array(codes, pa.int64()), pa.array(sketches, pa.binary()), *map(pa.array, parts.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "code", "sketch", *_PARTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, node binary, code long, sketch binary, " + ", ".join(f"{p} long" for p in _PARTS))


def _classes(sets: DataFrame) -> DataFrame:
    """(node, code, rep, sketch, part0..7): one row for each set, with the smallest doc_id that has it."""
    return sets.where("node IS NOT NULL").groupBy("node").agg(F.min("code").alias("code"), F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), *[F.first(p).alias(p) for p in _PARTS])


def _frequent(docs: DataFrame, words: int, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the upper classes (ascending) and their class, from counts over all plain prefixes."""

    def run(batches):
        for _, tokens, ptr in _sets(batches, words):
            n = np.diff(ptr)
            take = np.arange(len(tokens)) - np.repeat(ptr[:-1], n) <= np.repeat(n * (100 - percent) // 100, n)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[take].view(np.int64))], names=["token"])

    counts = docs.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n"))
    counts = checkpointed(counts.where(F.col("n") >= LEAST_COUNT))
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(LEAST_COUNT, -(-total // most))
    table = counts.where(F.col("n") >= bound).toArrow()
    tokens, n = table["token"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], np.where(n[order] >= bound * STEP, 3, 2).astype(np.int8)


def _index(docs: DataFrame, words: int, percent: int, most: int) -> DataFrame:
    """(sig, code): the signatures of every set that a different set can reach."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words, percent, most))

    def run(batches):
        known, kinds = shared.value
        for _, tokens, ptr in _sets(batches, words):
            at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
            classes = np.where(known[at] == tokens, kinds[at], 1).astype(np.int8) if len(known) else np.ones(len(tokens), np.int8)
            sigs, codes, times = [], [], []
            for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
                n = b - a
                # a different set that reaches the threshold has one token more, or one less
                if n and (n * 100 >= percent * (n + 1) or (n - 1) * 100 >= percent * n):
                    sigs.append(signatures(tokens[a:b], classes[a:b], n * (100 - percent) // 100, percent))
                    codes.append(code_of(node_of(tokens[a:b]), n))
                    times.append(len(sigs[-1]))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(codes, np.int64), times))], names=["sig", "code"])

    return docs.select("text").mapInArrow(run, "sig long, code long")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): the nodes of those pairs (x, y) of codes whose sets reach the threshold, by exact intersection.

    Before sets are fetched, pairs go whose sketches alone show that the sets differ by too much.
    """
    left, right = (classes.select(F.col("code").alias(c), F.col("sketch").alias(k)) for c, k in (("x", "s"), ("y", "t")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            size = (x & _SIZE) + (y & _SIZE)
            differ = np.fromiter((least_difference(a, b) for a, b in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True)), np.int64, len(x))
            keep = (differ * (100 + percent) <= size * (100 - percent)) | (x & _SIZE == _SIZE) | (y & _SIZE == _SIZE)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], names=["x", "y"])

    pairs = scratch.write(pairs.join(left, "x").join(right, "y").mapInArrow(near, "x long, y long").distinct())
    codes = pairs.select(F.col("x").alias("code")).unionByName(pairs.select(F.col("y").alias("code"))).distinct()
    ids = small_enough(scratch.write(classes.join(codes, "code", "left_semi").select(F.col("rep").alias("__rep")).distinct()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi").select("text")

    def run(batches):
        for _, tokens, ptr in _sets(batches, words):
            nodes = [node_of(tokens[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            sets = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([code_of(x, n) for x, n in zip(nodes, np.diff(ptr).tolist(), strict=True)], pa.int64()), pa.array(nodes, pa.binary()), sets], names=["code", "node", "tokens"])

    sets = scratch.write(texts.mapInArrow(run, "code long, node binary, tokens array<long>").where("code IS NOT NULL"))
    left, right = (sets.select(F.col("code").alias(c), F.col("node").alias(n), F.col("tokens").alias(t)) for c, n, t in (("x", "a", "s"), ("y", "b", "t")))
    both = pairs.join(left, "x").join(right, "y")
    common = F.size(F.array_intersect("s", "t"))
    return both.select("a", "b", common.alias("i"), (F.size("s") + F.size("t")).alias("n")).where(f"100 * i >= {int(percent)} * (n - i)").select("a", "b")


def _fit(x: str, y: str, percent: int) -> str:
    """Whether the sizes in two codes allow a link; a size that is cut may be any larger one."""
    least, most = (f"{f}({x} & {_SIZE}, {y} & {_SIZE})" for f in ("least", "greatest"))
    return f"({most} = {_SIZE} OR 100 * {least} >= {int(percent)} * {most})"


def jaccard_links(docs: DataFrame, classes: DataFrame, words: int = WORDS, percent: int = PERCENT, most: int = MOST_FREQUENT) -> DataFrame:
    """(a, b): links between nodes; every two linked nodes are in one component of these links.

    classes is what `document_sets` gives, by node.
    """
    scratch = Scratch(docs.sparkSession)
    index = _index(docs, words, percent, most)
    ends = index.groupBy("sig").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low <> high").select("sig")
    shared = scratch.write(index.join(ends, "sig").distinct())
    links = docs.sparkSession.createDataFrame([], "a binary, b binary")
    rows, roots = shared.withColumn("root", F.lit(None).cast("string")), None
    # nodes that chance gave one code are compared with each other at once, and no component is taken for the code's
    several = classes.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    several = small_enough(scratch.write(several))
    same = scratch.write(several.select(F.col("code").alias("x"), F.col("code").alias("y")))
    links = checkpointed(links.unionByName(_verified(same, docs, classes, words, percent, scratch).where("a < b"))) if not same.isEmpty() else links
    sizes = shared.groupBy("sig").agg(F.count("*").alias("s"))
    before = sizes.agg(F.sum(F.col("s") * (F.col("s") - 1) / 2)).first()[0] or 0
    for turn in range(PIVOT_ROUNDS):
        rows = scratch.write(_with_pivots(rows, turn))
        pivots = [rows.where(f"code <> {p} AND (root IS NULL OR root <> {p}_root) AND {_fit('code', p, percent)}").select(F.least("code", p).alias("x"), F.greatest("code", p).alias("y")) for p in ("low", "high")]
        links = checkpointed(links.unionByName(_verified(scratch.write(pivots[0].unionByName(pivots[1]).distinct()), docs, classes, words, percent, scratch)))
        roots = connected_components(links).join(classes.select("node", "code"), "node").join(several, "code", "left_anti").groupBy("code").agg(F.hex(F.min("root")).alias("root"))
        named = rows.select("sig", "code").join(roots, "code", "left").select("sig", "code", F.coalesce("root", F.col("code").cast("string")).alias("root"))
        counted = named.groupBy("sig", "root").agg(F.count("*").alias("m")).groupBy("sig").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"), F.count("*").alias("k")).where("k > 1")
        apart = checkpointed(counted.select("sig", "s", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")))
        rows = named.join(apart.select("sig"), "sig")
        left, members = apart.agg(F.sum("pairs"), F.sum("s")).first()
        # groups that pivots don't join are not of one component; another round only where the last one joined most
        if not left or left <= PAIRS_EACH * members or left > before / 2:
            break
        before = left
    rest = scratch.write(rows.join(classes.select("code", *_PARTS), "code"))
    right = rest.select("sig", F.col("code").alias("code2"), F.col("root").alias("root2"), *[F.col(p).alias(f"{p}_2") for p in _PARTS])
    differ = " + ".join(f"bit_count({p} ^ {p}_2)" for p in _PARTS)
    near = f"({differ}) * {100 + int(percent)} <= ((code & {_SIZE}) + (code2 & {_SIZE})) * {100 - int(percent)} OR greatest(code & {_SIZE}, code2 & {_SIZE}) = {_SIZE}"
    rest = rest.join(right, (rest.sig == right.sig) & (rest.code < right.code2) & (rest.root != right.root2) & F.expr(_fit("code", "code2", percent)) & F.expr(near))
    rest = scratch.write(rest.select(F.col("code").alias("x"), F.col("code2").alias("y")).distinct())
    links = checkpointed(links.unionByName(_verified(rest, docs, classes, words, percent, scratch)))
    scratch.drop()
    return links


def _with_pivots(rows: DataFrame, turn: int) -> DataFrame:
    """rows (sig, code, root) with two members of each signature, low and high, by an order of its own."""
    order = F.xxhash64("sig", F.lit(turn))
    ends = rows.groupBy("sig").agg(F.min(F.col("code").bitwiseXOR(order)).alias("low"), F.max(F.col("code").bitwiseXOR(order)).alias("high"))
    ends = ends.select("sig", F.col("low").bitwiseXOR(order).alias("low"), F.col("high").bitwiseXOR(order).alias("high"))
    joined = rows.join(ends, "sig")
    if turn == 0:
        return joined.select("sig", "code", "root", "low", "high", F.lit(None).cast("string").alias("low_root"), F.lit(None).cast("string").alias("high_root"))
    own = rows.select("sig", "code", "root")
    for p in ("low", "high"):
        joined = joined.join(own.select("sig", F.col("code").alias(p), F.col("root").alias(f"{p}_root")), ["sig", p])
    return joined.select("sig", "code", "root", "low", "high", "low_root", "high_root")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, most: int = MOST_FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are not read).

    component_id is the smallest doc_id that links reach, the own one included. Documents link when their
    shingle sets' intersection is at least `percent` of the union; equal sets link. A null text, or one
    without words, has an empty set and links with nothing. Rows that repeat a doc_id are rows of their
    own; a null doc_id stays null and counts in a component only where no other id is in it.
    """
    found = _components(docs, words, percent, most)
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _components(docs: DataFrame, words: int, percent: int, most: int) -> DataFrame:
    """(doc_id, n_shingles, node, root, component_id) for each row; node, root and component_id are null for empty sets."""
    sets = checkpointed(document_sets(docs, words))
    scratch = Scratch(docs.sparkSession)
    classes = scratch.write(_classes(sets))
    roots = connected_components(jaccard_links(docs, classes, words, percent, most))
    least = roots.join(classes, "node").groupBy("root").agg(F.min("rep").alias("least"))
    own = classes.join(roots.join(least, "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("least", "rep").alias("component_id"))
    own = checkpointed(own)
    scratch.drop()
    full = sets.where("node IS NOT NULL").join(own, "node").select("doc_id", "n_shingles", "node", "root", "component_id")
    none = F.lit(None)
    return full.unionByName(sets.where("node IS NULL").select("doc_id", "n_shingles", "node", none.cast("binary").alias("root"), none.cast("long").alias("component_id")))


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest id; all columns stay, whatever their names.

    Rows that share a doc_id are decided by their own texts; of rows that repeat in doc_id and set of shingles
    one stays. Null and empty texts link with nothing and stay, all of them, as do rows without a doc_id.
    Texts count whole. An empty table stays empty.
    """
    found = checkpointed(_components(docs, words, percent, MOST_FREQUENT).where("doc_id IS NOT NULL").select("doc_id", "node", "root"))
    first = found.where("node IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("k")).select("k.doc_id", "k.node")
    repeated = checkpointed(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    gone = found.where("node IS NOT NULL").join(first, ["doc_id", "node"], "left_anti").join(repeated, "doc_id", "left_anti")
    names, node, doc = docs.columns, *fresh(docs, "node", "doc")
    gone = small_enough(checkpointed(gone.select(F.col("doc_id").alias(doc))))
    kept = docs.join(gone, docs["doc_id"].cast("long") == F.col(doc), "left_anti")
    if repeated.isEmpty():
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens, ptr in _sets(batches, words):
            nodes = [node_of(tokens[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names=[*names, node])

    again = small_enough(repeated.select(F.col("doc_id").alias(doc)))
    named = kept.join(again, kept["doc_id"].cast("long") == F.col(doc), "left_semi").mapInArrow(run, docs.select(*names).schema.add(node, "binary"))
    one = first.select(F.col("doc_id").alias(doc), F.col("node").alias("first"))
    once = named.join(one, (named["doc_id"].cast("long") == F.col(doc)) & (F.col(node) == F.col("first")), "left_semi").dropDuplicates(["doc_id", node])
    apart = kept.join(again, kept["doc_id"].cast("long") == F.col(doc), "left_anti")
    return apart.unionByName(named.where(F.col(node).isNull()).select(*names)).unionByName(once.select(*names))
