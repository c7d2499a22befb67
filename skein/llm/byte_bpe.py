"""Byte-level BPE from a rank file, in padded matrices.

A text is cut into pieces by a pattern; each worker encodes the distinct pieces it meets and remembers them in a bounded
memo. Pieces that are no token themselves are laid into matrices by length, one row of byte ids for each. In a round every row
merges its leftmost pair of least rank, pairs are found in a hash table, and the rows close the gap; rows without a pair
leave. Pieces of over ``LONG`` bytes merge all places of their least pair in a round, in a linked list, so that unbroken texts
take about linear time; merging stops early where a new pair ranks lower, which keeps the order of single merges.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, mix, ragged, tidy
from .tokens import Memo

LONG = 256
NONE = np.int32(2**31 - 1)
MEMO_BYTES = 24 << 20
PIECES = 1 << 18

_codecs: dict[tuple[str, str], "ByteBpe"] = {}


def codec(path: str, pattern: str) -> "ByteBpe":
    """The worker's codec for a rank file and a pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(path, pattern)
    return _codecs[path, pattern]


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        find = self.ranks.get
        pairs = [(find(t[:i]), find(t[i:]), rank) for t, rank in self.ranks.items() for i in range(1, len(t))]
        left, right, merged = np.array([p for p in pairs if p[0] is not None and p[1] is not None], np.int64).reshape(-1, 3).T
        self.pairs, self.merged = Memo(), np.append(merged.astype(np.int32), NONE)
        self.pairs.add(self._key(left, right))
        top = max(self.ranks.values())
        size = np.zeros(top + 1, np.int64)
        ordered = sorted(self.ranks.items(), key=lambda x: x[1])
        size[[rank for _, rank in ordered]] = [len(token) for token, _ in ordered]
        self.token_size, self.token_start = size, np.cumsum(size) - size
        self.token_bytes = np.frombuffer(b"".join(token for token, _ in ordered), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.held = 0
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE for one that is no token; an id below 0 stands behind a row's end."""
        out = np.full(left.shape, NONE, np.int32)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        out[real] = self.merged[self.pairs.find(self._key(left[real], right[real]))]  # place -1 is NONE
        return out

    def merge_matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids after all merges of rows padded with -1 at their right: the ids of all rows in turn, and how many each has."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        row = np.arange(len(ids))
        ids = np.concatenate([ids, np.full((len(ids), 1), -1, np.int32)], 1)
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(ids):
            place = ranks.argmin(1)  # the first of equal ones
            best = ranks[np.arange(len(ids)), place]
            going = best < NONE
            if not going.all():
                done.append((row[~going], ids[~going]))
                row, ids, ranks, place, best = row[going], ids[going], ranks[going], place[going], best[going]
                if not len(ids):
                    break
                width = int((ids >= 0).sum(1).max())
                ids, ranks = ids[:, : width + 1], ranks[:, :width]
            at = np.arange(len(ids))
            ids[at, place] = best
            columns = np.arange(ids.shape[1] - 1)
            source = columns + (columns > place[:, None])
            ids[:, :-1] = np.take_along_axis(ids, source, 1)
            # the column behind the last is the padding, whose rank is none
            ranks = np.take_along_axis(np.concatenate([ranks, np.full((len(ids), 1), NONE, np.int32)], 1), source, 1)
            last = np.flatnonzero(place == ids.shape[1] - 2)
            ids[at, -1] = -1
            ranks[at, place] = self.rank(ids[at, place], ids[at, place + 1])
            ranks[last, -1] = NONE
            inner = np.flatnonzero(place > 0)
            ranks[inner, place[inner] - 1] = self.rank(ids[inner, place[inner] - 1], ids[inner, place[inner]])
        count = np.zeros(len(row) + sum(len(r) for r, _ in done), np.int64)
        for rows, left in done:
            count[rows] = (left >= 0).sum(1)
        start, flat = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int32)
        for rows, left in done:
            flat[ragged(start[rows], count[rows])] = left[left >= 0]
        return flat, count

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Ids after all merges of one long row."""
        n = len(ids)
        ids = np.append(ids, np.int32(-1))  # place n ends the list; place -1 is it too
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        before[0] = after[n] = n
        ranks = np.append(self.rank(ids[:-1], ids[1:]), NONE)
        live = np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[ranks[places] < NONE]
            places = places[np.argsort(ranks[places], kind="stable")]
            found = ranks[places]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for rank, some in zip(found[np.append(0, cuts)].tolist() if len(found) else [], np.split(places, cuts)):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(some)

        wait(np.arange(n))
        while heap:
            least = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(least)))
            places = places[live[places] & (ranks[places] == least)]
            if not len(places):
                continue
            # of places that overlap in a row, every second one from the left
            fresh = np.append(True, after[places[:-1]] != places[1:])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            chosen = places[(np.arange(len(places)) - first) % 2 == 0]
            second = after[chosen]
            behind, ahead = after[second], before[chosen]
            joined = np.append(False, behind[:-1] == chosen[1:])  # its left neighbour is merged just before it
            token = np.full(len(chosen), least, np.int32)
            lower = (self.rank(np.where(joined, least, ids[ahead]), token) < least) | (self.rank(token, ids[behind]) < least)
            if lower.any():
                stop = int(lower.argmax()) + 1
                rest = places[places > chosen[stop - 1]]
                chosen, second, behind = chosen[:stop], second[:stop], behind[:stop]
            else:
                rest = places[:0]
            ids[chosen] = least
            live[second] = False
            after[chosen] = behind
            before[behind] = chosen
            before[0] = n
            ranks[chosen] = self.rank(ids[chosen], ids[after[chosen]])
            ahead = before[chosen]
            ahead = ahead[ahead < n]
            ranks[ahead] = self.rank(ids[ahead], ids[after[ahead]])
            wait(np.unique(np.concatenate([chosen, ahead])))
            if len(rest):
                wait(rest[live[rest]])
        return ids[:n][live[:n]]

    def learn(self, pieces: list[str]) -> None:
        """Encodes distinct new pieces and adds them to the memo."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.ranks.get(b, -1) for b in raw), np.int64, len(raw))
        count, parts = np.ones(len(raw), np.int64), [(np.flatnonzero(whole >= 0), whole[whole >= 0].astype(np.int32))]
        low = 1
        while low < LONG:
            some = np.flatnonzero((whole < 0) & (size > low) & (size <= 2 * low))
            low *= 2
            for lo in range(0, len(some), max(1, (1 << 20) // low)):
                rows = some[lo : lo + max(1, (1 << 20) // low)]
                block = np.full((len(rows), low), -1, np.int32)
                block[np.arange(low) < size[rows][:, None]] = self.byte_ids[np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), np.uint8)]
                flat, count[rows] = self.merge_matrix(block)
                parts.append((rows, flat))
        for i in np.flatnonzero((whole < 0) & (size > LONG)).tolist():
            flat = self.merge_long(self.byte_ids[np.frombuffer(raw[i], np.uint8)])
            count[i] = len(flat)
            parts.append((np.array([i]), flat))
        start, flat = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int32)
        for rows, some in parts:
            flat[ragged(start[rows], count[rows])] = some
        self.memo.update(zip(pieces, range(len(self.memo), len(self.memo) + len(pieces))))
        self.held += int(size.sum()) + 32 * len(pieces)
        self.begin = np.concatenate([self.begin, len(self.flat) + start])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in turn, and how many each has."""
        if self.held > MEMO_BYTES:
            self.forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self.memo]
        if new:
            self.learn(new)
        slots = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        count = self.count[slots]
        return self.flat[ragged(self.begin[slots], count)], count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each has; at most PIECES pieces (or a text's of so many signs) are held at a time."""
        total, out, pieces, owner = np.zeros(len(texts), np.int64), [], [], []

        def flush() -> None:
            ids, count = self._ids(pieces)
            out.append(ids)
            ends = np.append(0, np.cumsum(count))[np.append(0, np.cumsum([n for _, n in owner]))]
            np.add.at(total, [i for i, _ in owner], np.diff(ends))
            pieces.clear()
            owner.clear()

        for i, text in enumerate(texts):
            if len(text) <= PIECES:
                found = self.pattern.findall(text)
                pieces += found
                owner.append((i, len(found)))
            else:
                matches = self.pattern.finditer(text)
                while found := [m.group() for m in islice(matches, PIECES)]:
                    pieces += found
                    owner.append((i, len(found)))
                    flush()
            if len(pieces) >= PIECES:
                flush()
        if owner:
            flush()
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), total

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ragged(self.token_start[ids], self.token_size[ids])].tobytes()


def encode_bytes(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of each whole text by a rank file (a token in base64 and its rank on each line).

    A null or empty text has no ids. Null or repeated doc_ids are rows like any other; an empty table gives no row. Very long
    texts are cut into pieces bit by bit, and a very long piece takes memory and about time in proportion to its length.
    Special tokens in a text are ordinary text. Other columns are not read.
    """
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        for batch in batches:
            ids, count = bpe.encode([x or "" for x in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def _id_rows(column: pa.Array) -> Iterator[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield values[a:b]


def decode_bytes(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, bytes binary: the bytes that the ids of encode_bytes stand for. A null list counts as empty; an unknown id is an error."""
    configure(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(ids) for ids in _id_rows(batch.column(1))], pa.binary())], ["doc_id", "bytes"])

    rows = tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(tidy(run), f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, bytes binary")


def token_digests(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes the ids stand for)."""
    configure(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks, pattern)
        for batch in batches:
            rows = list(_id_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(ids) for ids in rows], pa.int64()), pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in rows], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in rows], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(tidy(run), f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
