"""Shared helpers of the corpus operators: scratch tables, text blocks and word hashing.

Word hashing works on the UTF-8 buffer of an Arrow column, so no Python string is made for a word.
Every helper is bounded by one block of text (``BLOCK_BYTES``, or one document if that is longer).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19
U64 = np.uint64

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For terms: bytes that are no ASCII letter or digit and no part of another character separate them.
TERM_GAPS = np.ones(256, bool)
TERM_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; a null text counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def configure(spark: SparkSession) -> None:
    """Bounds the Arrow batches that reach Python: documents may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function after whose task the worker, which Spark keeps for further tasks, gives free memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not glibc
            pass

    return wrapped


class Scratch:
    """Parquet tables in a folder of their own below ``spark.checkpoint.dir``.

    A stashed table cuts the lineage and survives lost executors. Tables that a returned
    DataFrame still reads stay in the folder; it is emptied like any checkpoint folder.
    Only if the setting is missing (tests, local sessions) a local folder is made.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="skein-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.path = f"{root.rstrip('/')}/skein-{uuid.uuid4().hex}"

    def stash(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (splitmix finaliser)."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


LONG_WORD = 64
_FACTOR = mix(np.arange(LONG_WORD)) | U64(1)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, UTF-8 bytes, byte offsets of the rows); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows of a block.

    Other gaps than white space may be given as a table of 256 bytes (TERM_GAPS splits at punctuation too).
    start, end: byte positions; first: index of each row's first word (one more at the end); hash: 64 bits.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False, hashed: bool = True, gaps: np.ndarray = _SPACES):
        if lower:
            data = _LOWER[data]
        self.data = data
        solid = ~gaps[data]
        begin, last = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = at[(at > 0) & (at < len(data))]
        begin[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, at)
        if hashed:
            self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        """64 bits of each word. Words go from long to short, so that those with a byte at place j stand in front."""
        size = self.end - self.start
        out = np.zeros(len(size), U64)
        if not len(size):
            return out
        short = np.flatnonzero(size <= LONG_WORD)
        order = short[np.argsort(-size[short].astype(np.int16), kind="stable")]
        start, total = self.start[order], np.zeros(len(order), U64)
        left = np.searchsorted(-size[order], -np.arange(1, LONG_WORD + 1), "right")
        with np.errstate(over="ignore"):
            for j, n in enumerate(left.tolist()):
                if not n:
                    break
                total[:n] += (self.data[start[:n] + j] + U64(1)) * _FACTOR[j]
            out[order] = total
            for i in np.flatnonzero(size > LONG_WORD).tolist():
                word = self.data[self.start[i] : self.end[i]]
                out[i] = ((word + U64(1)) * (mix(np.arange(len(word))) | U64(1))).sum(dtype=U64)
        return mix(out ^ size.astype(U64))

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    size = np.asarray(size, np.int64)
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(np.asarray(start, np.int64) - (ends - size), size)


def partitions_for(df: DataFrame, text: str, bytes_each: int) -> tuple[int, int]:
    """How many owners take bytes_each of text each, and the total: one cheap aggregate over the column."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // bytes_each)), total


#: Rows of a table of keys that may be broadcast: some tens of MB as a hash table.
BROADCAST_ROWS = 500_000


def keyed(docs: DataFrame, keys: DataFrame, pairs: list[tuple[Column, str]], how: str) -> DataFrame:
    """docs left_semi or left_anti keys, by null-safe equality of each (column of docs, column of keys).

    keys (read twice, so it should be stored) is broadcast if it has BROADCAST_ROWS rows at most, and the texts stay where they
    are. Column names may clash: the keys get names that docs doesn't have.
    """
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names = [free_name(docs, f"key_{i}") for i in range(len(pairs))]
    keys = keys.select(*(F.col(right).alias(name) for (_, right), name in zip(pairs, names)))
    match = None
    for (left, _), name in zip(pairs, names):
        one = left.eqNullSafe(F.col(name))
        match = one if match is None else match & one
    return docs.join(F.broadcast(keys) if small else keys, match, how)


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_with_hot(big: DataFrame, small: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """big joined with small, which has one row for each key and, in ``count``, how many rows of big have it.

    Keys of over a thousandth of big's rows (total) are fewer than a thousand, so they can be broadcast; the others are shuffled,
    and none of them fills a task. Both tables are read twice, so they should be stored.
    """
    hot = small.filter(F.col(count) > total // 1000)
    cold = small.filter(F.col(count) <= total // 1000)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return big.join(F.broadcast(hot), key).unionByName(rest)
