"""Removal of word windows that start in an earlier document too, by recompression.

Recompression names runs of equal words and then pairs of neighbouring symbols, for two rounds. A symbol's class
(left or right half of a pair) and the name of a pair are hashes, so a name means the same in every document and
no dictionary is needed. A pair is merged only if its left symbol has the left class and its right one the right
class; runs stay alone. Hence equal word sequences get equal symbols away from their ends: whether a symbol begins
at word i depends on words i-3 .. i+2 only, and a symbol that isn't a run has at most 4 words.

So in each window of 13 words some symbol (or a run's word) begins at one of the places 5 to 8, in every copy of the
window. The name of the symbols' surroundings there, ten words, is the anchor that is exchanged.

1. Every task sends each owner of a hash range its distinct anchors, sorted and packed; those in several documents
   of the task are known to repeat and are sent once. Owners answer which others repeat, one packed message to each
   range of documents (a post), not one for each document; posts make one row for each document.
2. The documents with repeated anchors shuffle their text; the windows around these anchors are named (64 bits) and
   exchanged in the same way; owners find the smallest doc_id of each and answer the windows of larger ones.
3. The words of those windows are removed.
A window that thousands of documents share is an entry for each task, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, configure, mix, partitions_for, ragged, text_blocks

LEFT, RIGHT = 5, 4  # words of an anchor before and after its own
ANCHOR_BITS = 48  # anchors only propose; windows are compared by 64 bits
FLUSH = 3_000_000
FACTOR = 0x9E3779B97F4A7C15
MESSAGE = "owner int, keys binary, docs binary, starts binary, names binary"
REPLY = "post int, names binary, sizes binary, values binary"


def planes(values: np.ndarray) -> bytes:
    """Packs 64-bit words as compressed byte planes."""
    values = np.ascontiguousarray(values).astype("<u8", copy=False)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unplanes(code: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(code), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel()


def sequence_names(h: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of h[s : s + length] for each s in start."""
    out = np.zeros(len(start), U64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = out * U64(FACTOR) + h[start + j]
    return mix(out)


def begins(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a symbol of the second round begins, and every further word of a run; first: the documents' first words."""
    n = len(h)
    edge = np.zeros(n + 1, bool)
    edge[first] = True  # also behind the last word
    same = np.zeros(n + 1, bool)
    same[1:n] = (h[1:] == h[:-1]) & ~edge[1:n]
    run = same[:n] | same[1:]  # a word of a run
    level, joined = h, np.zeros(n + 1, bool)  # joined: no symbol begins here
    for step in (1, 2):
        at = np.flatnonzero(~joined[:n])  # where symbols begin
        left = mix(level[at] ^ U64(step)) & U64(1) == 0
        pair = left[:-1] & ~left[1:] & ~edge[at[1:]] & ~run[at[1:]] & ~run[at[1:] - 1]
        if step == 1:
            name = level[at].copy()
            with np.errstate(over="ignore"):
                name[:-1][pair] = mix(name[:-1][pair] * U64(FACTOR) + level[at[1:]][pair])
            level = h.copy()
            level[at] = name
        joined[at[1:][pair]] = True
    return np.flatnonzero(~joined[:n] | same[:n])


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The anchors' words and names; an anchor's ten words lie in one document."""
    at = begins(words.hash, words.first)
    row = words.row()[at] if len(at) else at
    at = at[(at - LEFT >= words.first[:-1][row]) & (at + RIGHT < words.first[1:][row])] if len(at) else at
    return at, sequence_names(words.hash, at - LEFT, LEFT + RIGHT + 1) >> U64(64 - ANCHOR_BITS)


class Outbox:
    """Collects entries (key, document, start) of one task and makes messages to owners and to the task's own post."""

    def __init__(self, owners: int, bits: int):
        self.owners, self.bits = owners, bits
        self.own = owners + TaskContext.get().partitionId() % owners
        self.clear()

    def clear(self) -> None:
        self.keys, self.docs, self.starts, self.names, self.held, self.count = [], [], [], [], 0, 0

    def add(self, keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, names: np.ndarray) -> None:
        """docs: places in names, which has a row (doc_id, ...) for each document."""
        self.keys.append(keys)
        self.docs.append(docs + self.held)
        self.starts.append(starts)
        self.names.append(names)
        self.held += len(names)
        self.count += len(keys)

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, docs, starts, names = (np.concatenate(x) for x in (self.keys, self.docs, self.starts, self.names))
        order = np.lexsort((names[docs, 0], keys)) if len(keys) else np.zeros(0, np.int64)
        self.clear()
        return keys[order], docs[order], starts[order], names

    def messages(self, keys, docs, starts, names, own: bool) -> Iterator[pa.RecordBatch]:
        if own:
            cuts = [(self.own, 0, len(keys))] if len(keys) else []
        else:
            owner = (keys >> U64(self.bits - 24)).astype(np.int64) * self.owners >> 24
            at = np.searchsorted(owner, np.arange(self.owners + 1))
            cuts = [(o, a, b) for o, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        for o, a, b in cuts:
            used, local = np.unique(docs[a:b], return_inverse=True)
            table = names[np.maximum(used, 0)].astype(np.int64)
            known = (used < 0)[local]  # in several documents of this task: no answer wanted
            columns = [planes(np.diff(keys[a:b], prepend=U64(0))), planes(np.where(known, 0, local + 1).astype(U64)), planes(starts[a:b].astype(U64)), table.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([o], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], ["owner", "keys", "docs", "starts", "names"])


def _read(got: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, places in names (-1: no answer wanted), starts, names of all messages."""
    keys, docs, starts, names, held = [], [], [], [], 0
    for k, d, s, n in zip(got["keys"], got["docs"], got["starts"], got["names"]):
        keys.append(np.cumsum(unplanes(k), dtype=U64))
        d = unplanes(d).astype(np.int64)
        docs.append(np.where(d > 0, d - 1 + held, -1))
        starts.append(unplanes(s).astype(np.int64))
        names.append(np.frombuffer(n, np.int64).reshape(-1, width))
        held += len(names[-1])
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(starts), np.concatenate(names)


def _replies(names: np.ndarray, values: np.ndarray, posts: int) -> pd.DataFrame:
    """One packed message to each post; names: a row (doc_id, ...) for each value."""
    post = (mix(names[:, 0].view(U64)) >> U64(40)).astype(np.int64) * posts >> 24
    order = np.lexsort((values, *names.T[::-1], post))
    post, names, values = post[order], names[order], values[order].astype(U64)
    head = np.concatenate([np.ones(min(len(post), 1), bool), (names[1:] != names[:-1]).any(axis=1)])
    cut = np.flatnonzero(head)
    size = np.diff(np.append(cut, len(post)))
    to, first = np.unique(post, return_index=True)
    out = []
    for o, a, b in zip(to.tolist(), first.tolist(), [*first[1:].tolist(), len(post)]):
        c, d = np.searchsorted(cut, [a, b])
        table = np.ascontiguousarray(names[cut[c:d]])
        out.append((o, table.tobytes(), planes(size[c:d].astype(U64)), planes(np.diff(values[a:b], prepend=U64(0)))))
    return pd.DataFrame(out, columns=["post", "names", "sizes", "values"])


def _by_document(width: int, columns: list[str]):
    def by_document(got: pd.DataFrame) -> pd.DataFrame:
        """A row for each document of a post: its names and all its values, packed."""
        names = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, width) for x in got["names"]])
        sizes = np.concatenate([unplanes(x).astype(np.int64) for x in got["sizes"]])
        values = np.concatenate([np.cumsum(unplanes(x), dtype=U64) for x in got["values"]])
        order = np.lexsort(names.T[::-1])
        begin = np.cumsum(sizes) - sizes
        values = values[ragged(begin[order], sizes[order])]
        names, ends = names[order], np.cumsum(sizes[order])
        last = np.append((names[1:] != names[:-1]).any(axis=1), True)
        ends = ends[last]
        raw = values.astype("<u8").tobytes()
        lists = [raw[8 * a : 8 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return pd.DataFrame(dict(zip(columns, [*names[last].T, lists])))

    return by_document


def _send_anchors(owners: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(owners, ANCHOR_BITS)

        def flush() -> Iterator[pa.RecordBatch]:
            keys, docs, starts, names = box.sorted()
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (names[docs[1:], 0] != names[docs[:-1], 0])])
            keys, docs, starts = keys[new], docs[new], starts[new]  # one for each anchor and document
            head = np.concatenate([[True], keys[1:] != keys[:-1]])
            size = np.diff(np.append(np.flatnonzero(head), len(keys)))
            local = np.repeat(size > 1, size)
            yield from box.messages(keys[local], docs[local], starts[local], names, own=True)
            yield from box.messages(keys[head], np.where(size > 1, -1, docs[head]), starts[head], names, own=False)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in text_blocks(batch.column(1)):
                words = Words(data, at)
                where, names = anchors(words)
                if len(where):
                    box.add(names, words.row()[where], np.zeros(len(where), np.int64), ids[lo:hi].reshape(-1, 1))
                if box.count >= FLUSH:
                    yield from flush()
        if box.count:
            yield from flush()

    return send


def _repeated(owners: int):
    def repeated(got: pd.DataFrame) -> pd.DataFrame:
        keys, docs, _, names = _read(got, 1)
        if got["owner"].iloc[0] < owners:
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            twin = np.zeros(len(keys) + 1, bool)
            twin[1:-1] = keys[1:] == keys[:-1]
            mask = (twin[1:] | twin[:-1]) & (docs >= 0)
            keys, docs = keys[mask], docs[mask]
        return _replies(names[docs], keys, owners)

    return repeated


def _send_windows(owners: int, window: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(owners, 64)

        def flush() -> Iterator[pa.RecordBatch]:
            keys, docs, starts, names = box.sorted()
            head = np.concatenate([[True], keys[1:] != keys[:-1]])
            least = np.repeat(names[docs[head], 0], np.diff(np.append(np.flatnonzero(head), len(keys))))
            later = names[docs, 0] > least  # a smaller doc_id of this task has it
            yield from box.messages(keys[later], docs[later], starts[later], names, own=True)
            yield from box.messages(keys[~later], docs[~later], starts[~later], names, own=False)

        for batch in batches:
            names = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            lists = batch.column(3)
            for lo, hi, data, at in text_blocks(batch.column(2)):
                words = Words(data, at)
                where, keys = anchors(words)
                cut = np.searchsorted(where, words.first)
                marked = np.zeros(len(words.hash), bool)
                for i in range(hi - lo):
                    a, b, end = cut[i], cut[i + 1], words.first[i + 1] - window
                    wanted = np.frombuffer(lists[lo + i].as_py(), "<u8")
                    found = where[a:b][np.isin(keys[a:b], wanted)]
                    start = (found[:, None] - np.arange(LEFT, window - RIGHT)).ravel()
                    marked[start[(start >= words.first[i]) & (start <= end)]] = True
                start = np.flatnonzero(marked)
                if len(start):
                    row = words.row()[start]
                    box.add(sequence_names(words.hash, start, window), row, start - words.first[row], names[lo:hi])
                if box.count >= FLUSH:
                    yield from flush()
        if box.count:
            yield from flush()

    return send


def _later(owners: int):
    def later(got: pd.DataFrame) -> pd.DataFrame:
        keys, docs, starts, names = _read(got, 2)
        if got["owner"].iloc[0] < owners:
            order = np.argsort(keys, kind="stable")
            keys, docs, starts = keys[order], docs[order], starts[order]
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            least = np.repeat(np.minimum.reduceat(names[docs, 0], head), np.diff(np.append(head, len(keys))))
            mask = names[docs, 0] > least
            docs, starts = docs[mask], starts[mask]
        return _replies(names[docs], starts, owners)

    return later


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for lo, hi, data, at in text_blocks(batch.column(1)):
                words = Words(data, at, hashed=False)
                n = len(words.start)
                cover = np.zeros(n + 1, np.int64)
                for i in range(hi - lo):
                    if lists[lo + i].is_valid:
                        start = np.frombuffer(lists[lo + i].as_py(), "<u8").astype(np.int64) + words.first[i]
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + window, -1)
                keep = np.cumsum(cover)[:n] == 0
                size = (words.end - words.start)[keep] + 1
                joined = np.full(int(size.sum()), 0x20, np.uint8)
                stop = np.cumsum(size)
                joined[ragged(stop - size, size - 1)] = words.data[ragged(words.start[keep], size - 1)]
                held = np.concatenate([[0], np.cumsum(keep)])[words.first]
                ends = np.concatenate([[0], stop])[held]
                raw = memoryview(joined.tobytes())
                kept = np.diff(held)
                sha = [hashlib.sha256(raw[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                total = np.diff(words.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total), pa.array(total - kept), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return remove


def remove_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", owner_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    Removed is each word that a window covers whose sequence also starts in a document with a smaller doc_id. A null
    text has no words. Rows with a null doc_id neither lose words nor make others lose them; rows that share a doc_id
    don't affect each other. Texts shorter than a window stay whole. Anchors are laid out for windows of 13 words
    and hold for longer ones too.
    """
    if window < LEFT + RIGHT + 4:
        raise ValueError(f"a window has {LEFT + RIGHT + 4} words at least")
    configure(docs.sparkSession)
    owners, _ = partitions_for(docs, text, owner_bytes)
    kind = docs.schema[doc_id].dataType.simpleString()
    # no alias of a column to its own name: one side of the self-join would keep it, and the exchanges would differ
    texts = docs.select(*(F.col(x) if x == y else F.col(x).alias(y) for x, y in ((doc_id, "doc_id"), (text, "text"))))
    known = texts.filter("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    sent = known.select("doc_id", "text").mapInArrow(_send_anchors(owners), MESSAGE)
    repeated = sent.groupBy("owner").applyInPandas(_repeated(owners), REPLY)
    repeated = repeated.groupBy("post").applyInPandas(_by_document(1, ["doc_id", "anchors"]), "doc_id long, anchors binary")
    # the same rows, dealt by doc_id, serve both joins below: Spark reuses their exchange
    named = known.withColumn("text_id", F.xxhash64("doc_id", "text")).select("doc_id", "text_id", "text")
    suspects = named.join(repeated, "doc_id").select("doc_id", "text_id", "text", "anchors")
    windows = suspects.mapInArrow(_send_windows(owners, window), MESSAGE)
    removed = windows.groupBy("owner").applyInPandas(_later(owners), REPLY)
    removed = removed.groupBy("post").applyInPandas(_by_document(2, ["doc_id", "text_id", "starts"]), "doc_id long, text_id long, starts binary")
    same = (F.col("t.doc_id") == F.col("r.doc_id")) & F.col("t.text_id").between(F.col("r.text_id"), F.col("r.text_id"))
    found = named.alias("t").join(removed.alias("r"), same, "left").select(F.col("t.doc_id").cast(kind).alias("doc_id"), "t.text", "r.starts")
    rest = texts.filter("doc_id is null or text is null").withColumn("starts", F.lit(None).cast("binary"))
    return found.union(rest).mapInArrow(_remove(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
