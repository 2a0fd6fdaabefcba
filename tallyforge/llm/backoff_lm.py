"""N-gram scoring by a weighted backoff automaton that no machine holds whole.

A state is a context of two words, of one or of none. An arc carries a seen n-gram's probability; a failure
arc leads to the next shorter context and carries the weight left for it. Bigrams and trigrams are
interpolated: an arc has (1 - left) * count / context's count + left * (the shorter context's probability),
where `left`, the failure arc's weight, depends on the context's count. It is learned for classes of counts
as the share of n-grams that are seen once, of contexts that are seen once more than the class says, which is
how often an n-gram would be new if its occurrence were left out. Words are smoothed by absolute discounting,
the discounted mass being that of one unknown type. Probabilities so sum to one over the vocabulary and it.

The arcs' counts, of every n-gram of the training texts, are dealt out by hash into shards, as many as the
texts' size asks for. Texts are dealt into units of bounded size. A unit sends each shard its different
n-grams once, with their counts in its training texts, packed into one row; the shard sums the counts of all
units and answers each with the totals in the order asked. With the answers a unit's texts are traversed from
left to right, all tokens of a unit at once: at each token the arc of the longest context, or failure arcs
and then an arc. No n-gram is left out and no row stands for a common n-gram more than once a unit, so none
gathers in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, Words, clean, crc_residue, even_keys, mix, release, string_buffers

#: Bytes of text in a unit, in a shard's share and in a partition of units; a longer text is a unit of its own.
UNIT_BYTES, SHARD_BYTES, PART_BYTES = 3 << 20, 6 << 20, 24 << 20
#: Shards of a partition.
SHARDS_EACH = 3
#: The base score's added count; classes of counts for each power of two, and how many there are.
ADDED, FINE, CLASSES = 0.1, 3, 200
#: Bits of an n-gram's code. Of n different n-grams a share of about n / 2^53 has another's code by chance, and its counts.
CODE_BITS = 52
#: The hash that stands for a text's end.
_END = 0x5851F42D4C957F2D


def pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    with np.errstate(over="ignore"):
        return mix(mix(x ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15) + y)


def code(h: np.ndarray, word: bool) -> np.ndarray:
    """What stands for an n-gram between units and shards: CODE_BITS of its hash, the lowest one marking words."""
    h = h >> np.uint64(64 - CODE_BITS)
    return h | np.uint64(1) if word else h & ~np.uint64(1)


def held_out(modulus: int = 10):
    """Whether crc32 of doc_id as text, modulo `modulus`, is 0 (null doc_id: not)."""
    return F.coalesce(crc_residue("doc_id", modulus) == 0, F.lit(False))


def count_class(c: np.ndarray) -> np.ndarray:
    """The class of a context's count (at least 1): FINE for each power of two."""
    return np.minimum(np.floor(np.log2(np.maximum(c, 1)) * FINE + 1e-9).astype(np.int64), CLASSES - 1)


def left_shares(new: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weight of the failure arc by class of the context's count, from n n-grams of which `new` are new."""
    return (new + 0.5) / (n + 1.0)


class Unigrams:
    """N, V and the discount, from the numbers of words that occur once and twice."""

    def __init__(self, n: int, v: int, n1: int, n2: int):
        self.n, self.v = n, v
        self.discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADDED) / (self.n + ADDED * (self.v + 1)))

    def probability(self, c: np.ndarray) -> np.ndarray:
        """At the root, for counts c; one where nothing was learned."""
        if self.n == 0:
            return np.ones(np.shape(c))
        return np.where(np.asarray(c) > 0, c - self.discount, self.discount * self.v) / self.n


class Stream:
    """Tokens of a unit's texts, each text's end among them, and the codes of the n-grams that end at each token.

    at[k - 1]: the tokens that have a k-gram; grams[k - 1]: its code.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        w = Words(data, offs)
        self.n = len(offs) - 1
        self.length = np.diff(w.ptr) + 1
        first = np.cumsum(self.length) - self.length
        last = first + self.length - 1
        h = np.empty(len(w.starts) + self.n, np.uint64)
        inner = np.ones(len(h), bool)
        inner[last] = False
        h[inner] = w.hashes()
        h[last] = _END
        pairs = pair_hash(h[:-1], h[1:])
        inner[:], inner[first] = True, False
        two = np.flatnonzero(inner)
        inner[first[self.length > 1] + 1] = False
        three = np.flatnonzero(inner)
        self.at = [slice(None), two, three]
        self.grams = [code(h, True), code(pairs[two - 1], False), code(pair_hash(pairs[three - 2], pairs[three - 1]), False)]

    def per_token(self, per_text: np.ndarray) -> np.ndarray:
        return np.repeat(per_text, self.length)

    def sums(self, per_token: np.ndarray) -> np.ndarray:
        return np.add.reduceat(per_token, np.cumsum(self.length) - self.length) if self.n else np.zeros(0)

    def keys(self) -> np.ndarray:
        """The different codes, ascending."""
        found = np.sort(np.concatenate(self.grams))
        return found[_changes(found)]

    def counts(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different codes, ascending, and how often each stands in the texts that are marked."""
        marks = self.per_token(counted).astype(np.uint64)
        found = np.sort(np.concatenate([g << np.uint64(1) | marks[at] for at, g in zip(self.at, self.grams, strict=True)]))
        marks = (found & np.uint64(1)).astype(np.int64)
        found >>= np.uint64(1)
        new = _changes(found)
        return found[new], np.add.reduceat(marks, new) if len(new) else marks

    def spread(self, keys: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, ...]:
        """At each token: its count, its bigram's and its trigram's, and those of the two contexts; 0 where there is none."""
        one, two, three, last, last_two = (np.zeros(len(self.grams[0]), np.int64) for _ in range(5))
        for out, at, grams in zip((one, two, three), self.at, self.grams, strict=True):
            out[at] = totals[_places(keys, grams)]
        last[self.at[1]] = one[self.at[1] - 1]
        last_two[self.at[2]] = two[self.at[2] - 1]
        return one, two, three, last, last_two


def _changes(ascending: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.zeros(0, np.int64)


def _places(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where codes stand in keys, which are ascending, evenly spread and have each of them: by the begin of a code's bucket, and on from there."""
    bits = min(CODE_BITS, max(1, int(len(keys)).bit_length()))
    shift = np.uint64(CODE_BITS - bits)
    begin = np.concatenate([[0], np.cumsum(np.bincount((keys >> shift).astype(np.int64), minlength=1 << bits))])
    at = begin[(codes >> shift).astype(np.int64)]
    off = np.flatnonzero(keys[at] != codes)
    while len(off):
        at[off] += 1
        off = off[keys[at[off]] != codes[off]]
    return at


def traverse(counts: tuple[np.ndarray, ...], uni: Unigrams, left: np.ndarray) -> np.ndarray:
    """log10 probability of each token, from `Stream.spread` and the failure arcs' weights of both orders (2 x CLASSES).

    A context without a count is no state: the automaton is in that of the next shorter one.
    """
    one, two, three, last, last_two = counts
    p = uni.probability(one)
    for shares, c, context in ((left[0], two, last), (left[1], three, last_two)):
        fail = shares[count_class(context)]
        p = np.where(context > 0, (1 - fail) * c / np.maximum(context, 1) + fail * p, p)
    return np.log10(p)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as their bytes, the lowest of all first, compressed: small ones leave runs of zeros."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def _from_planes(b: bytes, kind) -> np.ndarray:
    width, n = np.dtype(kind).itemsize, int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], n * width, "zstd"), np.uint8).reshape(width, n).T.copy().view(kind)[:, 0]


def _packed(parts: list[pa.RecordBatch]) -> bytes:
    """Rows as one compressed value."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for part in parts:
            writer.write_batch(part)
    return out.getvalue().to_pybytes()


def _unpacked(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows that follow each other and are of one unit, together."""
    unit, held = None, []
    for batch in batches:
        units = batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            if held and unit != units[a]:
                yield unit, held
                release()
                held = []
            unit = units[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield unit, held
        release()


def _stream(unit: bytes) -> tuple[Stream, pa.Table]:
    table = _unpacked(unit)
    data, offs, _ = string_buffers(table["text"])
    return Stream(data, offs), table.drop_columns(["text"])


def _dealt(rows: DataFrame, unit_bytes: int) -> DataFrame:
    """(unit, size, data): rows of a partition in order, as many as unit_bytes holds, packed, with their texts' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, room, held = TaskContext.get().partitionId() << 36, unit_bytes, []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([unit_bytes - room], pa.int64()), pa.array([_packed(held)], pa.binary())], names=["unit", "size", "data"])

        for batch in batches:
            _, offs, _ = string_buffers(batch.column("text"))
            low = 0
            while low < batch.num_rows:
                high = int(np.searchsorted(offs, offs[low] + room, side="right")) - 1
                if high == low and not held:
                    high = low + 1
                if high > low:
                    held.append(batch.slice(low, high - low))
                    room -= int(offs[high] - offs[low])
                if high < batch.num_rows:
                    yield closed()
                    unit, room, held = unit + 1, unit_bytes, []
                low = high
            # a view would keep its batch in memory
            held = [pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(len(x)))) for c in x.columns], schema=x.schema) for x in held]
        if held:
            yield closed()

    return rows.mapInArrow(run, "unit long, size long, data binary")


def _asked_for(texts: DataFrame, shards: int, partitions: int) -> DataFrame:
    """(deal, shard, unit, keys, counts): for each unit and shard, the unit's n-grams there and their training counts.

    deal has as many neighbouring shards for each of the partitions that it deals into.
    """
    names = ["deal", "shard", "unit", "keys", "counts"]
    even = texts.sparkSession.sparkContext.broadcast(even_keys(texts.sparkSession, partitions).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(s << CODE_BITS) // shards for s in range(1, shards)], np.uint64)
        for unit, data in ((u.as_py(), d.as_py()) for batch in batches for u, d in zip(batch.column("unit"), batch.column("data"), strict=True)):
            stream, table = _stream(data)
            codes, counts = stream.counts(table["counted"].to_numpy())
            del stream, table, data
            cuts = [0, *np.searchsorted(codes, edges).tolist(), len(codes)]
            full = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
            keys = [_planes(np.diff(codes[cuts[s] : cuts[s + 1]], prepend=np.uint64(0))) for s in full]
            own = [_planes(counts[cuts[s] : cuts[s + 1]].astype(np.uint32)) for s in full]
            for low in range(0, len(full), 500):
                part = slice(low, low + 500)
                deal = even.value[np.array(full[part], np.int64) * partitions // shards]
                yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(full[part], pa.int32()), pa.array([unit] * len(full[part]), pa.int64()), pa.array(keys[part], pa.binary()), pa.array(own[part], pa.binary())], names=names)
            release()

    return texts.select("unit", "data").mapInArrow(run, "deal int, shard int, unit long, keys binary, counts binary")


_ANSWER = "unit long, shard int, counts binary, n long, v long, n1 long, n2 long"


def _answers(asked: DataFrame, partitions: int) -> DataFrame:
    """(unit, shard, counts): the totals, in the order asked. A shard's first row also has its words' sums: n, v, n1 and n2."""
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    end = code(np.array([_END], np.uint64), True)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _units(b.rename_columns(["unit", "of", "keys", "counts"]) for b in batches):
            table = pa.Table.from_batches(parts)
            units = table["of"].to_numpy()
            each = [np.cumsum(_from_planes(b, np.uint64)) for b in table["keys"].to_pylist()]
            cuts = np.cumsum([0, *map(len, each)])
            keys, place = np.unique(np.concatenate(each), return_inverse=True)
            del each
            totals = np.zeros(len(keys), np.int64)
            for a, b in zip(cuts[:-1].tolist(), table["counts"].to_pylist(), strict=True):
                own = _from_planes(b, np.uint32)
                totals[place[a : a + len(own)]] += own  # a unit has a key once
            word = (keys & np.uint64(1)).astype(bool) & (totals > 0)
            plain = totals[word & (keys != end)]
            sums = [totals[word].sum(), word.sum(), (plain == 1).sum(), (plain == 2).sum()]
            for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                own = [pa.array([int(x) if i == 0 else 0], pa.int64()) for x in sums]
                yield pa.RecordBatch.from_arrays([pa.array([units[i]], pa.int64()), pa.array([shard], pa.int32()), pa.array([_planes(totals[place[a:b]])], pa.binary()), *own], names=names)

    return asked.repartition(partitions, "deal").drop("deal").sortWithinPartitions("shard", "unit").mapInArrow(run, _ANSWER)


def _answered(texts: DataFrame, answers: DataFrame, partitions: int) -> DataFrame:
    """Each unit's texts and then its answers by shard, in one partition."""
    rows = texts.selectExpr("unit", "-1 AS shard", "data").unionByName(answers.selectExpr("unit", "shard", "counts AS data"))
    return rows.repartition(partitions, "unit").sortWithinPartitions("unit", "shard")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stream, pa.Table, tuple[np.ndarray, ...]]]:
    """For each unit: its tokens, its texts' rows, and the counts at each token."""
    for _, parts in _units(batches):
        texts, *totals = [x.as_py() for part in parts for x in part.column("data")]
        stream, table = _stream(texts)
        totals = np.concatenate([_from_planes(b, np.int64) for b in totals] or [np.zeros(0, np.int64)])
        keys = stream.keys()
        if len(totals) != len(keys):
            raise ValueError(f"a unit of {len(keys)} n-grams got {len(totals)} answers")
        counts = stream.spread(keys, totals)
        del keys, totals, parts, texts
        yield stream, table, counts
        del stream, table, counts


def _learn_left(answered: DataFrame) -> np.ndarray:
    """The failure arcs' weights of bigrams and trigrams, from all tokens of all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, new = np.zeros((2, CLASSES), np.int64), np.zeros((2, CLASSES), np.int64)
        for stream, table, (_, two, three, last, last_two) in _spread(batches):
            counted = stream.per_token(table["counted"].to_numpy())
            for k, c, context in ((0, two, last), (1, three, last_two)):
                at = counted & (context > 1)
                kind = count_class(context[at] - 1)
                n[k] += np.bincount(kind, minlength=CLASSES)
                new[k] += np.bincount(kind[c[at] == 1], minlength=CLASSES)
        order, kind = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(kind), pa.array(n[order, kind]), pa.array(new[order, kind])], names=["k", "class", "n", "new"])

    rows = answered.mapInArrow(run, "k long, class long, n long, new long").groupBy("k", "class").agg(F.sum("n").alias("n"), F.sum("new").alias("new")).collect()
    n, new = np.zeros((2, CLASSES)), np.zeros((2, CLASSES))
    for r in rows:
        n[r["k"], r["class"]], new[r["k"], r["class"]] = r["n"], r["new"]
    return left_shares(new, n)


_SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(answered: DataFrame, uni: Unigrams, left: np.ndarray) -> DataFrame:
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream, table, counts in _spread(batches):
            sums = [stream.length, stream.sums((counts[0] > 0).astype(np.int64)), np.full(stream.n, uni.n, np.int64)]
            sums += [stream.sums(uni.base(counts[0])), stream.sums(traverse(counts, uni, left))]
            out = pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), *map(pa.array, sums)], names=names)
            yield out.filter(table["asked"].combine_chunks())

    return answered.mapInArrow(run, _SCORED)


def _score(rows: DataFrame, unit_bytes: int, shard_bytes: int) -> DataFrame:
    """The scores of the rows that are asked for, by a model of those that are counted."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    texts = scratch.write(_dealt(rows, unit_bytes))
    size = texts.agg(F.sum("size")).first()[0] or 0
    shards, partitions = -(-size // shard_bytes) or 1, -(-size // PART_BYTES) or 1
    dealt = max(1, -(-shards // SHARDS_EACH))
    answers = scratch.write(_answers(_asked_for(texts, shards, dealt), dealt))
    clean(spark)
    n, v, n1, n2 = (int(x or 0) for x in answers.agg(*[F.sum(c) for c in ("n", "v", "n1", "n2")]).first())
    uni = Unigrams(n, v, n1, n2)
    left = _learn_left(_answered(texts, answers, partitions))
    clean(spark)
    return _scored(_answered(texts, answers, partitions), uni, left)


def _rows(docs: DataFrame, counted, asked) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), counted.alias("counted"), asked.alias("asked"), "text")


def score(docs: DataFrame, training: DataFrame, unit_bytes: int = UNIT_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs by a model of training's texts.

    Both hold (doc_id, text); other columns are not read. A null text is empty: it has the end alone. Rows
    that repeat a doc_id are scored each, a null doc_id stays null. Equal texts have equal scores. A text of
    any length is scored whole, in a worker's memory at about 150 bytes a token. Without training texts every
    token has probability one; an empty docs gives no rows.
    """
    rows = _rows(docs, F.lit(False), F.lit(True)).unionByName(_rows(training, F.lit(True), F.lit(False)))
    return _score(rows, unit_bytes, shard_bytes)


def train_and_score(docs: DataFrame, unit_bytes: int = UNIT_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`score` of every row by a model of the rows that are not held out, with held_out."""
    rows = _rows(docs, ~held_out(), F.lit(True))
    return _score(rows, unit_bytes, shard_bytes).withColumn("held_out", held_out())
