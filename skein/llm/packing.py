"""Packing by Karmarkar-Karp multiway differencing.

Each document's ids are cut into full windows and a rest; the rest is cut evenly into pieces of at most
``piece`` ids. Pieces are dealt at random, by a stored row number, into groups of about ``windows`` windows, and
each group is a task's work: the two partial partitions of largest spread are merged again and again, the
largest sums of one with the smallest of the other, which leaves near-equal windows. If a window exceeds the
capacity, the group is partitioned anew with one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, configure, text_blocks, tidy
from .tokens import with_end, word_encoder


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp for k subsets: the subset of each item, and the subsets' sums."""
    n = len(sizes)
    # nodes: 0 is the empty subset, 1..n the items, then unions of two nodes
    left, right = [np.zeros(n + 1, np.int64)], [np.zeros(n + 1, np.int64)]
    made, heap = n + 1, []
    for i, s in enumerate(sizes.tolist()):
        sums, nodes = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[0], nodes[0] = s, i + 1
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]  # both are sorted downwards: large meets small
        both = (x > 0) & (y > 0)
        nodes = x + y
        nodes[both] = np.arange(made, made + int(both.sum()))
        left.append(x[both])
        right.append(y[both])
        made += int(both.sum())
        down = np.argsort(-sums, kind="stable")
        sums = sums[down]
        order += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), order, sums, nodes[down]))
    _, _, sums, nodes = heap[0]
    left, right = np.concatenate(left), np.concatenate(right)
    where = np.full(made, -1, np.int64)
    where[nodes[nodes > 0]] = np.flatnonzero(nodes > 0)
    for node in range(made - 1, n, -1):  # a union was made after its parts
        where[left[node]] = where[right[node]] = where[node]
    return where[1 : n + 1], sums


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; as few windows as differencing fits under the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        where, sums = differencing(sizes, k)
        if sums.max(initial=0) <= capacity:
            return where
        k += 1


def _cut(tokenizer: str, end: int, capacity: int, piece: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, at in text_blocks(batch.column(1)):
                ids, offsets = with_end(*encoder.encode(data, at), end)
                n = np.diff(offsets)
                full = n // capacity
                rest = n - full * capacity
                parts = -(-rest // piece)
                row = np.repeat(np.arange(len(n)), full + parts)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(full + parts) - full - parts, full + parts)
                late = nth - full[row]
                start = np.where(late < 0, nth * capacity, full[row] * capacity + rest[row] * np.maximum(late, 0) // np.maximum(parts[row], 1))
                stop = np.where(late < 0, start + capacity, full[row] * capacity + rest[row] * (np.maximum(late, 0) + 1) // np.maximum(parts[row], 1))
                raw = memoryview(ids.astype("<u4").tobytes())
                begin, last = (offsets[row] + start) * 4, (offsets[row] + stop) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64()), pa.array(n[row])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return cut


def _deal(capacity: int):
    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        size = group["length"].to_numpy()
        window, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        whole = size == capacity
        window[whole] = np.arange(whole.sum())
        if not whole.all():
            window[~whole] = whole.sum() + pack_group(size[~whole], capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.concatenate([[True], np.diff(window[order]) > 0])
        offset[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        group["sequence_id"] = group["pack"].to_numpy() * (1 << 24) + window
        group["offset"] = offset
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return deal


def pack_sequences(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, piece: int = 1024, windows: int = 64,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    A null or empty text is the end id alone; null or repeated doc_ids are packed like any row. No piece of an
    empty table. Very long texts become many full windows. Other columns are not read.
    """
    if not 0 < piece <= capacity:
        raise ValueError("piece must be between 1 and capacity")
    configure(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    pieces = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        tidy(_cut(tokenizer, end_id, capacity, piece)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )
    # stored with a row number: groups stay the same if a task runs again, and equal rows are dealt apart
    pieces = Scratch(docs.sparkSession).stash(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-tokens // (capacity * windows)))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("pack").applyInPandas(
        _deal(capacity), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
