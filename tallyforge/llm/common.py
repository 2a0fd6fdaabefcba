"""What the text operators share: checkpoints, size-checked broadcasts, blocks of words as numpy arrays.

The array helpers read Arrow string buffers directly, so a whole batch of texts is
lower-cased, cut into words and hashed without a Python object for each word.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a broadcast may hold (16 MB of longs); beyond it joins shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text that are worked on at once within a batch.
BLOCK_BYTES = 2 << 20
#: Bytes of a range from which it is hashed by a digest of its own.
LONG_RANGE = 512

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None

_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints that all executors share: the session's spark.checkpoint.dir.

    Only a local master may be without one, and gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def clean(spark: SparkSession) -> None:
    """Have the driver find the plans that are done, so that their shuffles leave the executors' disks."""
    for _ in range(2):  # what Python holds goes in the first round, what that held in the JVM in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


class Scratch:
    """Tables of intermediate rows in the folder that all executors share, compressed.

    They go when they are dropped, or else, as those that a result still reads, when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.root}/{len(self.paths)}")
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self, *numbers: int) -> None:
        """Delete the tables, or those of the numbers; nothing that is still to run may read them."""
        for root in [self.paths[i] for i in numbers] or [self.root]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """Mark df for a broadcast only where its counted rows keep the bound; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions a number that Spark's hash partitioning deals into it."""
    rows = spark.range(30 * n).select(F.col("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect()
    keys = np.arange(n)
    keys[[r["at"] for r in rows]] = [r["id"] for r in rows]
    return keys


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes for df to have no such column (in any case)."""
    taken, marks = {c.lower() for c in df.columns}, "__"
    while any(f"{marks}{n}".lower() in taken for n in names):
        marks += "_"
    return [f"{marks}{n}" for n in names]


def crc_residue(column: str, modulus: int):
    """crc32 of a column's text, modulo modulus; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned longs."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A string column's bytes, its n + 1 offsets, and which rows are not null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    valid = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else np.ones(n, dtype=bool)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), valid
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0], valid


class Words:
    """The words of some texts: byte ranges, hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        self.offs = offs
        if len(data):
            space = _SPACE[data]
            first = np.zeros(len(data) + 1, dtype=bool)
            first[offs] = True
            begin = ~space
            begin[1:] &= space[:-1] | first[1:-1]
            end = ~space
            end[:-1] &= space[1:] | first[1:-1]
            self.starts = np.flatnonzero(begin)
            self.ends = np.flatnonzero(end) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.ptr = np.searchsorted(self.starts, offs)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return range_hashes(self.data, self.starts, self.ends)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: its words of eight bytes, the last one filled up by zeros, mixed one after another.

    Each step is a bijection of the state and of the word, so ranges of one length that differ in one word
    never meet, and no structure of the text cancels out, as it may in a polynomial modulo 2^64.
    """
    with np.errstate(over="ignore"):
        length = (ends - starts).astype(np.uint64)
        out = mix(length * _STEP + _SEED)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
        left = np.minimum(ends - starts, LONG_RANGE)
        at = np.flatnonzero((left > 0) & (ends - starts <= LONG_RANGE))
        done = 0
        while len(at):
            word = eight[starts[at] + done]
            rest = left[at] - done
            short = rest < 8
            word[short] &= (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            out[at] = mix((out[at] ^ word) * _STEP)
            done += 8
            at = at[rest > 8]
        for i in np.flatnonzero(ends - starts > LONG_RANGE).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


_kept: dict = {}


def kept_in_worker(key: tuple, make):
    """What a worker process keeps between tasks: one object, of the operator that ran last."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give memory that is free back to the system: workers live on between tasks and share an executor's limit."""
    if _libc is not None:
        _libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Cut a batch's texts into blocks of about `most` bytes: first row, end row, bytes, offsets, not null."""
    data, offs, valid = string_buffers(column)
    n, i = len(valid), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], valid[i:j]
        release()
        i = j
