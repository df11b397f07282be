"""Shared pieces of the training-data operators: stage tables and byte-level text batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on (a longer document is a step of its own).
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


def discard(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Delete a folder that nothing reads any more, now or when the JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(where) if at_exit else files.delete(where, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    The result has no lineage to the work that made it, so a lost executor costs
    only the tasks that were reading it. The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    discard(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path)


def doc_key() -> Column:
    """Together with doc_id this identifies a document: rows with equal doc_id and text are one."""
    return F.xxhash64("text")


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, next to the JVM and later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run for mapInArrow, with give_back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def free_name(docs: DataFrame, name: str) -> str:
    """A column name like `name` that docs does not have yet."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def documents_in(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key column; whatever else the table holds is pruned."""
    return docs.select("doc_id", "text", doc_key().alias("doc_key"))


def is_word_table(breaks: set[int]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(breaks)] = False
    return out


#: Words are maximal runs of anything but ASCII white space.
SPACE_WORDS = is_word_table({0x20, *range(0x09, 0x0E)})
#: Words are maximal runs of a-z, 0-9 and non-ASCII, after A-Z are lower-cased.
ALNUM_WORDS = is_word_table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def byte_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and where each begins (null: empty)."""
    col = pc.fill_null(col, "").cast(pa.large_binary())
    _, ends, data = col.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of documents of about STEP_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = byte_column(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word."""
    inside = is_word[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _S)
    h = h * _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


class WordHash:
    """64-bit hashes of byte spans from one prefix sum of weighted byte codes."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.code = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), STEP_BYTES + 1)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base, np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, self.inverse, np.uint64)])

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _M2)


def run_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive items of h (order counts)."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    n = len(h) - length + 1
    out, weight = np.zeros(n, np.uint64), 0x9E3779B97F4A7C15
    for k in range(length):
        out += h[k : k + n] * np.uint64(weight)
        weight = weight * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)
