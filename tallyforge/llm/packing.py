"""Packing of token sequences as vector bin packing, by the dot-product heuristic.

Every remainder of a document is an item with three demands: tokens, one segment and loss-bearing
tokens. A sequence has as many limits. The sequence being filled takes, from a bounded pool, the item
that fits and has the largest dot product of its demands with what the sequence has left (each in
units of its limit). When no item fits whole, a cut of one fills the rest, so that padding is left only
where the segments or the loss tokens are used up. What is left at a partition's end is cut into
sequences whose lengths are powers of two.

Each partition packs its own rows in their order, with a bounded pool, and numbers its sequences within
its own range: a task that runs again gives the same rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Words, blocks, kept_in_worker

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 4096, 512, 4096
#: Items among which the heuristic chooses, and words whose ids a worker keeps.
POOL, KEPT_WORDS = 1024, 2_000_000
#: New words that are encoded at once.
_AT_ONCE = 10_000
#: The id after each document.
END_ID = 2

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Tokens:
    """Ids of whole texts; a word between white space is encoded once and then looked up by its hash."""

    def __init__(self, tokenizer_json: str, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.end_id = Tokenizer.from_str(tokenizer_json), end_id
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        lengths, flats = [], [self.flat]
        for k in range(0, len(texts), _AT_ONCE):
            ids = [x.ids for x in self.model.encode_batch_fast(texts[k : k + _AT_ONCE], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.fromiter((i for x in ids for i in x), np.uint32, int(lengths[-1].sum())))
        length = np.concatenate(lengths)
        at = np.cumsum(length) - length + len(self.flat)
        self.flat = np.concatenate(flats)
        keys, at, length = np.concatenate([self.keys, keys]), np.concatenate([self.at, at]), np.concatenate([self.length, length])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.length = keys[order], at[order], length[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids begin."""
        words = Words(data, offs, lower=False)
        unique, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self._clear()
        i = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        new = self.keys[i] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            self._learn(unique[new], [words.text(k).decode("utf-8", "replace") for k in first[new]])
            i = np.searchsorted(self.keys, unique)
        at, length = self.at[i][back], self.length[i][back]
        n_docs, end = len(offs) - 1, self.end_id is not None
        # each text's end is one more word, of one id
        place = np.arange(len(back)) + (np.repeat(np.arange(n_docs), np.diff(words.ptr)) if end else 0)
        all_at, all_length = np.zeros(len(back) + n_docs * end, np.int64), np.ones(len(back) + n_docs * end, np.int64)
        all_at[place], all_length[place] = at, length
        flat = self.flat
        if end:
            ends = words.ptr[1:] + np.arange(n_docs)
            all_at[ends] = len(flat)
            flat = np.append(flat, np.uint32(self.end_id))
        sums = np.concatenate([[0], np.cumsum(all_length)])
        ids = flat[np.repeat(all_at - sums[:-1], all_length) + np.arange(sums[-1])]
        return ids, sums[words.ptr + np.arange(n_docs + 1) * end]


class Packer:
    """Fills sequences from a pool of items; `rows` holds finished pieces until they are taken."""

    def __init__(self, first_id: int, tokens: int, segments: int, loss: int, pool: int):
        self.next, self.limits, self.most = first_id, np.array([tokens, segments, loss], float), pool
        self.items: list[list] = []  # doc_id, ids, where its rest begins, first id that bears loss
        self.need = np.zeros((0, 3))
        self.rows: list[tuple] = []

    def _emit(self, item: list, length: int, offset: int) -> None:
        doc, ids, start, _ = item
        self.rows.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), self.next, offset))
        item[2] += length

    @staticmethod
    def _loss(item: list, length: int) -> int:
        return max(0, item[2] + length - max(item[2], item[3]))

    def add(self, doc, ids: np.ndarray, prompt: int) -> None:
        item = [doc, ids, 0, prompt]
        full = int(self.limits[0])
        while len(ids) - item[2] >= full and self._loss(item, full) <= self.limits[2]:
            self._emit(item, full, 0)
            self.next += 1
        if item[2] < len(ids):
            self.items.append(item)
            if len(self.items) >= self.most:
                self.fill(self.most // 2)

    def fill(self, leave: int) -> None:
        """Close sequences until at most `leave` items are in the pool."""
        rest = np.array([len(x[1]) - x[2] for x in self.items], float)
        self.need = np.stack([rest, np.ones(len(rest)), [self._loss(x, len(x[1]) - x[2]) for x in self.items]], axis=1) if len(rest) else np.zeros((0, 3))
        alive = np.ones(len(rest), bool)
        while alive.sum() > leave:
            left, used = self.limits.copy(), 0
            took: list[tuple[list, int]] = []
            while left[0] > 0 and left[1] > 0 and alive.any():
                fits = alive & (self.need <= left).all(axis=1)
                if fits.any():
                    gain = np.where(fits, (self.need / self.limits) @ (left / self.limits), -1.0)
                    i = int(gain.argmax())
                    length = int(self.need[i, 0])
                else:
                    i = int(np.where(alive, self.need[:, 0], -1.0).argmax())
                    item, length = self.items[i], int(min(left[0], self.need[i, 0]))
                    if self._loss(item, length) > left[2]:
                        length = int(max(0, item[3] - item[2]) + left[2])
                    if length <= 0:
                        break
                item = self.items[i]
                loss = self._loss(item, length)
                took.append((item, length))
                self._emit(item, length, used)
                used += length
                left -= (length, 1, loss)
                rest_of = len(item[1]) - item[2]
                alive[i] = rest_of > 0
                self.need[i] = (rest_of, 1, self._loss(item, rest_of))
            if leave == 0 and not alive.any() and 0 < used < self.limits[0]:
                self._recut(took, used)
            self.next += 1
        self.items = [x for x, keep in zip(self.items, alive, strict=True) if keep]

    def _recut(self, took: list[tuple[list, int]], used: int) -> None:
        """The last sequence, cut anew into sequences whose lengths are powers of two."""
        del self.rows[-len(took) :]
        for item, length in took:
            item[2] -= length
        # an item can be in the sequence twice, one cut after the other: its start is the earlier one again
        sizes = [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]
        room, offset = sizes.pop(0), 0
        for item, length in took:
            while length:
                cut = min(length, room)
                self._emit(item, cut, offset)
                length, room, offset = length - cut, room - cut, offset + cut
                if not room and sizes:
                    room, offset = sizes.pop(0), 0
                    self.next += 1


def pack(docs: DataFrame, tokenizer_json: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of the token sequences of docs (doc_id, text, optionally prompt_tokens), placed in sequences.

    A document is its text's ids (null: none), then end_id. Its first prompt_tokens ids (null or no such
    column: 0) bear no loss. Each id is in exactly one piece; pieces lie in a sequence without gaps.
    A row that repeats a doc_id is a document of its own. Other columns are not read. An empty table
    gives no rows. Longer sequences than `tokens` don't occur, nor more segments or loss tokens. Texts are taken
    whole, of any length. Of items of one gain the one that came first is placed. Plain documents bear loss in
    every token, so that with the default limits the third one binds only for rows with prompt_tokens.
    """
    spark = docs.sparkSession
    if "prompt_tokens" not in docs.columns:
        docs = docs.withColumn("prompt_tokens", F.lit(0).cast("long"))
    model = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("tokens", hash(model.value), end_id), lambda: Tokens(model.value, end_id))
        packer = Packer(TaskContext.get().partitionId() << 36, tokens, segments, loss, pool)
        for batch in batches:
            for i, j, data, offs, _ in blocks(batch.column("text")):
                ids, ptr = encoder.encode(data, offs)
                ids = ids.astype("<u4", copy=False)
                docs_in, prompts = batch.column("doc_id").slice(i, j - i).to_pylist(), batch.column("prompt_tokens").slice(i, j - i).to_pylist()
                for k, doc in enumerate(docs_in):
                    # a copy, as a view would keep the block in memory
                    packer.add(doc, ids[ptr[k] : ptr[k + 1]].copy(), prompts[k])
                yield _batch(packer)
        packer.fill(0)
        yield _batch(packer)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("prompt_tokens").cast("long"), F.lit(0)).alias("prompt_tokens"))
    return plain.mapInArrow(run, SCHEMA)


def _batch(packer: Packer) -> pa.RecordBatch:
    rows, packer.rows = packer.rows, []
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)
