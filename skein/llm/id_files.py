"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Each id is predicted by three orders: the id that last followed the two ids before it, the one that last followed the
id before it, and an order-0 distribution over ranges of ids (two to each power of two, then uniform bits) that follows
the ranges' counts in the block. Adaptive
shares, chosen by how often the two predicted ids were right of late and whether they agree, mix the three into the
interval that a range coder narrows. All models start anew in each block, so blocks of a file are coded side by side,
one numpy lane a block. Shares are of powers of two and move by shifts, so a step takes few passes over the lanes.

A file: magic, u32 documents, u32 blocks, u32 ids in a block, u32 largest id, u64 ids; i64 doc_ids; u32 ids of each
document; for each block u32 crc32 of its ids (little-endian u32) and u32 bytes; then the blocks' bytes. A document
lies in one file. Files are rows of a Parquet table (file, n_tokens, content), so Spark commits them on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, configure, partitions_for, text_blocks
from .tokens import with_end, word_encoder

MAGIC = b"IDF3"
BLOCK = 2048
FILE_IDS = 12_000_000
MOST = 1 << 18  # ids are below this
SLOTS = 11  # bits of a block's prediction tables
MIX, ZERO = 12, 12  # bits of the mixing shares and of the order-0 shares
RATE = 5  # mixing shares move by 1 / 2^RATE of the way
GAIN, RECOUNT = 8, 16  # what an id adds to its range's count of 1, and after how many ids the order-0 shares follow the counts
SPAN, LEAST = 56, U64(1 << 40)  # bits of a range, and the size below which it grows by 16 bits
HEAD = struct.Struct("<4sIIIIQ")
HIT = 1 << 20  # in a table's entry, above the id it predicts: how often it was right, 3 at most
#: Where the two bounds between order 2, order 1 and order 0 move after each outcome; every share stays above 0.
GOAL1 = np.array([4032, 32, 32], np.int32)
GOAL2 = np.array([4064, 4064, 64], np.int32)


def ranges(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order-0 range of each id, the id's place in it, and the bits of that place."""
    value = ids.astype(np.int64) + 2
    bits = np.frexp(value.astype(np.float64))[1].astype(np.int64) - 2
    return bits * 2 + (value >> bits & 1), value & (1 << bits) - 1, bits


def blank(size: int, dtype: type) -> np.ndarray:
    """Zeros in memory that numpy asks huge pages for, which np.zeros doesn't: steps touch it at one place for each lane."""
    made = np.empty(size, dtype)
    made.fill(0)
    return made


class Lanes:
    """Models and ranges of blocks that are coded side by side."""

    def __init__(self, lanes: int, largest: int):
        self.base = np.arange(lanes, dtype=np.int64)
        self.slots, self.contexts = self.base << SLOTS, self.base << 5
        self.second, self.first = blank(lanes << SLOTS, np.int32), blank(lanes << SLOTS, np.int32)
        self.mixed = np.full(lanes << 5, 1024 | 2048 << 16, np.int32)  # both bounds
        self.kinds = int(ranges(np.array([largest]))[0][0]) + 1
        kind = np.arange(self.kinds + 1, dtype=np.int16)[:, None]
        self.floor, self.room = kind[1:], np.float32((1 << ZERO) - self.kinds)
        self.counts = np.ones((self.kinds, lanes), np.int32)
        self.bounds = np.repeat(((kind.astype(np.int64) << ZERO) // self.kinds).astype(np.int16), lanes, axis=1)
        self.steps = 0
        self.range = np.full(lanes, (1 << SPAN) - 1, U64)
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # the ids before

    def predict(self, n: int) -> None:
        one = self.one[:n] * 40503
        two = self.two[:n] * 51749
        two += one
        one >>= 4
        one &= (1 << SLOTS) - 1
        one += self.slots[:n]
        two >>= 3
        two &= (1 << SLOTS) - 1
        two += self.slots[:n]
        self.at1, self.at2 = one, two
        self.seen1, self.seen2 = self.first.take(one), self.second.take(two)
        self.id1, self.id2 = self.seen1 & HIT - 1, self.seen2 & HIT - 1
        context = self.seen2 >> 20
        context <<= 2
        context += self.seen1 >> 20
        context <<= 1
        context += self.id1 == self.id2
        self.context = self.contexts[:n] + context
        odds = self.mixed.take(self.context)
        self.bound1, self.bound2 = odds & 0xFFFF, odds >> 16

    def interval(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the outcome's share of the mixture begins and ends."""
        n = len(outcome)
        edges = np.zeros((4, n), np.int32)
        edges[1], edges[2], edges[3] = self.bound1, self.bound2, 1 << MIX
        at = outcome * n
        at += self.base[:n]
        begin = edges.take(at)
        at += n
        return begin, edges.take(at)

    def share(self, escaped: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self.bounds.shape[1]
        flat, at = self.bounds.ravel(), kind * width + escaped
        self.counts.ravel()[at] += GAIN
        below = flat.take(at)
        return below.astype(U64), (flat.take(at + width) - below).astype(U64)

    def recount(self) -> None:
        """New order-0 bounds by the counts so far: each range has one part of 2^ZERO and its proportion of the others."""
        below = self.counts.astype(np.float32)  # whole numbers below 2^24: exact
        for kind in range(1, self.kinds):
            below[kind] += below[kind - 1]
        below *= self.room / below[-1]
        np.add(below[:-1].astype(np.int16), self.floor[:-1], out=self.bounds[1:-1])

    def learn(self, n: int, ids: np.ndarray, outcome: np.ndarray) -> None:
        """ids: int32. Every bound moves towards its goal for this outcome and can't meet its neighbours."""
        bound1 = self.bound1 + (GOAL1.take(outcome) - self.bound1 >> RATE)
        bound2 = self.bound2 + (GOAL2.take(outcome) - self.bound2 >> RATE)
        bound2 <<= 16
        bound2 |= bound1
        self.mixed[self.context] = bound2
        self.steps += 1
        if self.steps % RECOUNT == 0 or self.steps & self.steps - 1 == 0:
            self.recount()
        once, most = ids | HIT, ids | 3 * HIT
        self.second[self.at2] = np.where(self.id2 == ids, np.minimum(self.seen2 + HIT, most), once)
        self.first[self.at1] = np.where(self.id1 == ids, np.minimum(self.seen1 + HIT, most), once)
        self.two[:n] = self.one[:n]
        self.one[:n] = ids


def encode_blocks(ids: np.ndarray, block: int = BLOCK, largest: int = MOST - 1) -> list[bytes]:
    """Codes ids (below 2^18) in blocks; each block stands alone. largest: no id is above it; its reader must know it."""
    if not len(ids):
        return []
    if ids.max() > min(largest, MOST - 1):
        raise ValueError("ids must be below 2^18 and not above the largest one")
    count = -(-len(ids) // block)
    grid = np.zeros((count, block), np.int32)
    grid.ravel()[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.T)
    last = len(ids) - (count - 1) * block
    lanes = Lanes(count, largest)
    low, pos = np.zeros(count, U64), np.zeros(count, np.int64)
    width = block + 64
    out = blank(count * width, np.uint32).reshape(count, width)  # 16-bit words and, above, what they carry into the word before
    keep, sixteen = U64((1 << SPAN - 16) - 1), U64(16)
    kind_of, place_of, _ = ranges(np.arange(largest + 1))
    parts = place_of << 8 | kind_of
    for t in range(block if count > 1 else last):
        n = count if t < last else count - 1
        x = grid[t, :n]
        lanes.predict(n)
        outcome = np.where(lanes.id2 == x, 0, np.where(lanes.id1 == x, 1, 2))
        begin, end = lanes.interval(outcome)
        span, base = lanes.range[:n], low[:n]
        span >>= U64(MIX)
        base += span * begin.astype(U64)
        span *= (end - begin).astype(U64)
        escaped = np.flatnonzero(outcome == 2)
        if len(escaped):
            place = parts.take(x[escaped])
            kind = place & 255
            place >>= 8
            below, share = lanes.share(escaped, kind)
            step = span.take(escaped) >> U64(ZERO)
            more = step * below
            step *= share
            step >>= (kind >> 1).astype(U64)
            more += step * place.astype(U64)
            base[escaped] += more
            span[escaped] = step
        lanes.learn(n, x, outcome)
        ready = np.flatnonzero(span < LEAST)
        if t % 16 == 0 and pos.max() >= width - 64:
            out, width = np.concatenate([out, np.zeros((count, block), np.uint32)], axis=1), width + block
        while len(ready):
            top, at = base.take(ready), pos.take(ready)
            out.ravel()[ready * width + at] = top >> U64(SPAN - 16)
            pos[ready] = at + 1
            top &= keep
            base[ready] = top << sixteen
            grown = span.take(ready) << sixteen
            span[ready] = grown
            ready = ready[grown < LEAST]
    words = np.concatenate([out[:, : int(pos.max())].T, np.zeros((4, count), np.uint32)])
    for j in range(4):  # the rest of low; its last word has 8 bits
        words[pos + j, np.arange(count)] = low >> U64(SPAN - 16)
        low = (low & keep) << sixteen
    for j in range(len(words) - 1, 0, -1):
        words[j - 1] += words[j] >> 16
    words = np.ascontiguousarray(words.T.astype(">u2"))
    return [words[i, : pos[i] + 4].tobytes() for i in range(count)]


def decode_blocks(codes: list[bytes], total: int, block: int = BLOCK, largest: int = MOST - 1) -> np.ndarray:
    """The ids of all blocks of a file; total: how many; largest: as they were encoded."""
    count = len(codes)
    if not count:
        return np.zeros(0, np.uint32)
    last = total - (count - 1) * block
    width = max(map(len, codes)) // 2 + 8
    words = blank(count * width, np.uint16)
    for i, c in enumerate(codes):
        words[i * width : i * width + len(c) // 2] = np.frombuffer(c, ">u2")
    begin = np.arange(count, dtype=np.int64) * width
    end = begin + width - 1
    code, sixteen = np.zeros(count, U64), U64(16)
    for j in range(4):
        code = code << sixteen | words[begin + j]
    code >>= U64(64 - SPAN)
    # the range has 56 bits: the code's last 8 bits so far stay for the first word to come
    pos, late = begin + 3, U64(64 - SPAN)
    grid = np.zeros((block, count), np.int32)
    lanes = Lanes(count, largest)
    for t in range(block if count > 1 else last):
        n = count if t < last else count - 1
        lanes.predict(n)
        span, rest = lanes.range[:n], code[:n]
        span >>= U64(MIX)
        value = np.minimum(rest // span, U64((1 << MIX) - 1)).astype(np.int32)
        outcome = (value >= lanes.bound1).astype(np.int64)
        outcome += value >= lanes.bound2
        low, high = lanes.interval(outcome)
        rest -= span * low.astype(U64)
        span *= (high - low).astype(U64)
        x = np.where(outcome == 0, lanes.id2, lanes.id1)
        escaped = np.flatnonzero(outcome == 2)
        if len(escaped):
            step, left = span.take(escaped), rest.take(escaped)
            step >>= U64(ZERO)
            value = np.zeros(n, np.int16)
            value[escaped] = np.minimum(left // step, U64((1 << ZERO) - 1))
            kind = np.add.reduce((lanes.bounds[1:-1, :n] <= value).view(np.int8), axis=0, dtype=np.int8).take(escaped).astype(np.int64)
            below, share = lanes.share(escaped, kind)
            left -= step * below
            step *= share
            bits = kind >> 1
            step >>= bits.astype(U64)
            place = np.minimum((left // step).astype(np.int64), (1 << bits) - 1)
            left -= step * place.astype(U64)
            rest[escaped], span[escaped] = left, step
            x[escaped] = (2 + (kind & 1) << bits) + place - 2
        lanes.learn(n, x, outcome)
        grid[t, :n] = x
        ready = np.flatnonzero(span < LEAST)
        while len(ready):
            at = pos.take(ready)
            pair = words.take(np.minimum(at, end.take(ready))).astype(U64) << sixteen | words.take(np.minimum(at + 1, end.take(ready)))
            code[ready] = code.take(ready) << sixteen | (pair >> late & U64(0xFFFF))
            pos[ready] = at + 1
            grown = span.take(ready) << sixteen
            span[ready] = grown
            ready = ready[grown < LEAST]
    return grid.T.ravel()[:total].astype(np.uint32)


def write_file(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    largest = int(ids.max()) if len(ids) else 0
    codes = encode_blocks(ids, block, largest)
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * i * block : 4 * (i + 1) * block]) for i in range(len(codes))]
    index = np.array([crc, [len(c) for c in codes]], "<u4").T.tobytes()
    return HEAD.pack(MAGIC, len(sizes), len(codes), block, largest, len(ids)) + doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + index + b"".join(codes)


def read_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids. A block whose checksum differs raises ValueError."""
    magic, docs, blocks, block, largest, total = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = HEAD.size
    doc_ids = np.frombuffer(content, "<i8", docs, at)
    sizes = np.frombuffer(content, "<u4", docs, at + 8 * docs).astype(np.int64)
    index = np.frombuffer(content, "<u4", 2 * blocks, at + 12 * docs).reshape(-1, 2)
    ends = at + 12 * docs + 8 * blocks + np.concatenate([[0], np.cumsum(index[:, 1], dtype=np.int64)])
    ids = decode_blocks([content[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], total, block, largest)
    raw = memoryview(ids.astype("<u4").tobytes())
    for i, crc in enumerate(index[:, 0].tolist()):
        if zlib.crc32(raw[4 * i * block : 4 * (i + 1) * block]) != crc:
            raise ValueError(f"block {i} is damaged")
    return doc_ids, sizes, ids


NULL_ID = -(1 << 63)


def _write(tokenizer: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = word_encoder(tokenizer), TaskContext.get().partitionId() << 24
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            parts, held = held, []
            doc_ids, sizes, ids = (np.concatenate(x) for x in zip(*parts))
            del parts
            content = write_file(doc_ids, sizes, ids)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(ids)]), pa.array([content], pa.binary())], ["file", "n_tokens", "content"])
            number += 1

        for batch in batches:
            doc_ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in text_blocks(batch.column(1)):
                ids, offsets = with_end(*encoder.encode(data, at), end)
                held.append((doc_ids[lo:hi], np.diff(offsets), ids))
                if sum(len(x[2]) for x in held) >= FILE_IDS:
                    yield from flush()
        if held:
            yield from flush()

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc_ids, sizes, ids = read_file(content.as_py())
            ends = np.cumsum(sizes)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(before + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", task_bytes: int = 24 << 20) -> None:
    """Writes the ids of all texts, each with end_id behind it, in ascending doc_id order (nulls first, then as -2^63).

    A null text is empty. Ties of doc_id are ordered by the text's hash. An empty table gives a table without files.
    """
    configure(docs.sparkSession)
    tasks, _ = partitions_for(docs, text, task_bytes)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_write(tokenizer, end_id), "file long, n_tokens long, content binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the files."""
    configure(spark)
    files = spark.read.schema("file long, n_tokens long, content binary").parquet(path)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, without content
    starts = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    return files.join(starts, "file").select("before", "content").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the files (to path, or below spark.checkpoint.dir) and reads them back."""
    path = path or Scratch(docs.sparkSession).path + "/ids"
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
