"""Near-duplicates by SuperMinHash, banding, verification on full sets and union-find grouping.

SuperMinHash: each shingle draws, rank by rank, a position of its own random permutation and a value
``rank + random``; a signature keeps the least value of each position. Ranks are drawn for all shingles of a
block at once and stop for a document as soon as all its positions are filled, since later ranks are larger.

Documents with equal shingle sets are one node, named by 128 bits of its set. Nodes that share a band's bucket are candidates:
1. each is compared with its bucket's two pivots (linear in the bucket), and links form components;
2. in buckets that still hold several components all pairs of different components are compared, in blocks of bounded
   size whose intersections are matrix products; a block yields a spanning forest of its links, so no pair of texts
   becomes a row. A large component's nodes make blocks of their own, which don't meet each other.
So each pair that shares a bucket is either compared on the full sets or already in one component: no cap, no
lost link among candidates. With 32 bands of 4 a pair of similarity 0.8 shares no bucket with chance 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, configure, join_with_hot, keyed, mix, text_blocks, tidy
from .components import connected

SET_BITS = 54  # a shingle's hash; above it, the row within a slice
SLICE_ROWS = 1000
BLOCK_NODES, BLOCK_SHINGLES = 1000, 300_000  # of one block; two meet in a task
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, sorted distinct shingle hashes, offsets of the rows)."""
    for base in range(0, len(column), SLICE_ROWS):
        for lo, hi, data, at in text_blocks(column.slice(base, SLICE_ROWS)):
            words = Words(data, at, lower=True)
            count = np.diff(words.first)
            size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
            row = np.repeat(np.arange(hi - lo), size)
            start = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + words.first[:-1][row]
            h = np.zeros(len(row), U64)
            with np.errstate(over="ignore"):
                for j in range(k):
                    inside = j < count[row]
                    h[inside] = mix(h[inside] * U64(0x9E3779B97F4A7C15) + words.hash[start[inside] + j])
            keyed = np.sort((row.astype(U64) << U64(SET_BITS)) | (h >> U64(64 - SET_BITS)))
            if len(keyed):
                keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
            yield base + lo, base + hi, keyed & U64((1 << SET_BITS) - 1), np.searchsorted(keyed >> U64(SET_BITS), np.arange(hi - lo + 1).astype(U64))


def superminhash(shingles: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows x m, uint64: rank above 32 random bits); rows without shingles keep EMPTY."""
    rows = len(offsets) - 1
    sign = np.full(rows * m, EMPTY, U64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    s, place = shingles, None
    for rank in range(m):
        draw = mix(s ^ mix(U64(rank + 1)))
        swap = rank + ((draw & U64(0xFFFFFFFF)) * U64(m - rank) >> U64(32)).astype(np.int64)
        if rank == 0:
            slot = swap
        else:
            own = np.arange(len(s))
            if place is None:
                place = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(s), 1))
                place[own, first] = 0
            slot = place[own, swap].astype(np.int64)
            place[own, swap] = place[own, rank]
        where = row * m + slot
        open_ = sign[where] == EMPTY
        np.minimum.at(sign, where[open_], (U64(rank) << U64(32)) | (draw[open_] >> U64(32)))
        unfilled = (sign.reshape(rows, m) == EMPTY).any(axis=1)
        left = unfilled[row]
        if not left.any():
            break
        if rank == 0:
            first = swap[left]
        if not left.all():
            s, row = s[left], row[left]
            if place is not None:
                place = place[left]
    return sign.reshape(rows, m)


def node_ids(shingles: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """128 bits of each set, as binary; null for rows without shingles."""
    size = np.diff(offsets)
    halves = []
    with np.errstate(over="ignore"):
        for salt in (U64(0), U64(0xA5A5A5A55A5A5A5A)):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(shingles ^ salt), dtype=U64)])
            halves.append(mix((total[offsets[1:]] - total[offsets[:-1]]) ^ mix(size.astype(U64) ^ salt)))
    every = _binary(np.stack(halves, axis=1).astype(">u8").tobytes(), np.arange(len(size) + 1) * 16)
    return every if (size > 0).all() else pc.if_else(pa.array(size > 0), every, pa.scalar(None, pa.binary()))


def _binary(raw: bytes, ends: np.ndarray) -> pa.Array:
    """The pieces of raw between ends, not copied."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)])


def _sign(k: int, bands: int, height: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, shingles, offsets in shingle_sets(batch.column(1), k):
                signature = superminhash(shingles, offsets, bands * height)
                size = np.diff(offsets)
                key = np.broadcast_to(mix(np.arange(bands)), (hi - lo, bands)).copy()
                with np.errstate(over="ignore"):
                    for j in range(height):
                        key = mix(key * U64(0xD6E8FEB86659FD93) + signature[:, j::height])
                flat = pa.array(key[size > 0].view(np.int64).ravel())
                at = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(size.astype(np.int64)), node_ids(shingles, offsets), pa.ListArray.from_arrays(pa.array(at), flat)],
                    ["doc_id", "text_hash", "n", "node", "keys"],
                )

    return sign


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, shingles, offsets in shingle_sets(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([node_ids(shingles, offsets), _binary(shingles.astype("<u8").tobytes(), offsets * 8)], ["node", "shingles"])

    return sets


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(both) - common))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    return verify


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections: frequent shingles by matrix products, rare ones pair by pair."""
    n, size = len(sets), np.array([len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    out = np.zeros((n, n), np.float32)
    often = np.flatnonzero(times > 12)
    place = np.full(len(times), -1)
    place[often] = np.arange(len(often))
    for lo in range(0, len(often), 1024):
        here = (place[code] >= lo) & (place[code] < lo + 1024)
        x = np.zeros((n, min(1024, len(often) - lo)), np.float32)
        x[row[here], place[code[here]] - lo] = 1
        out += x @ x.T
    order = np.argsort(code, kind="stable")
    first = np.cumsum(times) - times
    for t in range(2, 13):
        groups = row[order[first[times == t][:, None] + np.arange(t)]]
        for i in range(t):
            for j in range(t):
                if i != j:
                    np.add.at(out, (groups[:, i], groups[:, j]), 1)
    np.fill_diagonal(out, size)
    return np.rint(out).astype(np.int64)


def _block_links(percent: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the links in one block of a bucket."""
        group = group.sort_values("node", ignore_index=True)
        node, component = group["node"].to_numpy(), group["component"].to_numpy()
        found: list[tuple[bytes, bytes]] = []
        if (component != component[0]).any():
            sets = [np.frombuffer(x, "<u8") for x in group["shingles"]]
            size = np.array([len(x) for x in sets])
            common = common_counts(sets)
            linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
            open_ = np.ones(len(node), bool)
            for start in range(len(node)):
                queue = [start] if open_[start] else []
                open_[start] = False
                while queue:
                    x = queue.pop()
                    for y in np.flatnonzero(linked[x] & open_).tolist():
                        open_[y] = False
                        queue.append(y)
                        found.append((node[x], node[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    return links


def _dealt(member: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, meeting, node, component): the members (key, node, n, component) of buckets with several components, for each
    pair of blocks that their block is in. Blocks of one component alone don't meet.
    """
    by = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    large = (F.col("members") > BLOCK_NODES) | (F.col("total") > BLOCK_SHINGLES)
    # a large component has a family of blocks of its own; the others of a bucket share one
    family = by.groupBy("key", F.when(large, F.col("component")).alias("owner")).agg(F.sum("members").alias("members"), F.sum("total").alias("total"), F.max(large).alias("large"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    family = scratch.stash(family.select("key", "owner", "large", "members", blocks.alias("blocks")), "families")
    block = family.select("key", "owner", "large", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    a, b = (block.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("owner", "large", "block"))) for x in "ab")
    rank = lambda x: F.struct(~F.col(f"large_{x}"), F.coalesce(f"owner_{x}", F.lit(b"")), F.col(f"block_{x}"))
    meet = a.join(b, "key").filter(rank("a") <= rank("b")).filter(~(F.col("large_a") & F.col("large_b") & (F.col("owner_a") == F.col("owner_b"))))
    meet = meet.withColumn("meeting", F.xxhash64("key", rank("a"), rank("b")))
    sides = meet.select("key", F.col("owner_a").alias("owner"), F.col("block_a").alias("block"), "meeting")
    sides = sides.union(meet.select("key", F.col("owner_b").alias("owner"), F.col("block_b").alias("block"), "meeting")).distinct()
    member = member.join(by.filter(large).select("key", "component", F.lit(True).alias("large")), ["key", "component"], "left").withColumn("owner", F.when(F.col("large"), F.col("component")))
    member = member.alias("m").join(family.alias("f"), (F.col("m.key") == F.col("f.key")) & F.col("m.owner").eqNullSafe(F.col("f.owner")))
    member = member.select("m.key", "m.owner", "m.node", "m.component", F.pmod(F.xxhash64("m.node"), F.col("f.blocks")).cast("int").alias("block"))
    return member.alias("m").join(sides.alias("s"), (F.col("m.key") == F.col("s.key")) & (F.col("m.block") == F.col("s.block")) & F.col("m.owner").eqNullSafe(F.col("s.owner"))).select(
        "m.key", "s.meeting", "m.node", "m.component"
    )


def _labelled_rows(docs: DataFrame, k: int, percent: int, bands: int, height: int, doc_id: str, text: str) -> tuple[DataFrame, Scratch]:
    """The rows of near_groups, with text_hash, which tells rows of one doc_id apart; and the scratch tables that they read."""
    spark = docs.sparkSession
    configure(spark)
    scratch = Scratch(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = scratch.stash(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(tidy(_sign(k, bands, height)), f"doc_id {kind}, text_hash long, n long, node binary, keys array<long>"), "signed")
    rows = signed.count()
    nodes = signed.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = nodes.select("node", "x.doc_id", "x.text_hash", "n", "keys")
    # buckets with several nodes
    spread = scratch.stash(nodes.select("node", "n", "doc_id", "text_hash", F.explode("keys").alias("key")), "spread")
    shared = spread.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("members")).filter("low < high")
    shared = scratch.stash(shared, "shared")
    buckets = scratch.stash(join_with_hot(spread, shared, "key", "members", rows * bands), "buckets")
    scratch.drop("spread", "shared")
    pivots = buckets.select("key", F.col("node").alias("b"), F.explode(F.array("low", "high")).alias("a")).filter("a <> b")
    pairs = pivots.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # full sets of the nodes in those buckets, from one text of each
    involved = scratch.stash(buckets.select("doc_id", "text_hash").distinct(), "involved")
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    sets = keyed(texts, involved, [(F.col("doc_id"), "doc_id"), (F.col("text_hash"), "text_hash")], "left_semi").select("text")
    sets = sets.mapInArrow(tidy(_sets(k)), "node binary, shingles binary").filter("node is not null")
    if signed.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])  # rows that repeat id and text
    sets = scratch.stash(sets, "sets")

    def links(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        full = full.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        return full.mapInArrow(tidy(_verify(percent)), "a binary, b binary")

    first = scratch.stash(links(pairs), "links-1")
    labels = scratch.stash(connected(first, scratch, "first"), "labels-1")
    # what is left: buckets with several components, each once; all their pairs are compared in blocks of bounded size
    member = buckets.select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = scratch.stash(member, "member")
    several = member.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"),
    ).filter("lo < hi")
    several = scratch.stash(several.groupBy("who", "members").agg(F.min("key").alias("key")).select("key", "members"), "several")
    member = scratch.stash(join_with_hot(member, several, "key", "members", rows * bands).select("key", "node", "n", "component"), "open")
    rest = _dealt(member, scratch).join(sets, "node").groupBy("key", "meeting").applyInPandas(_block_links(percent), "a binary, b binary")
    second = scratch.stash(rest, "links-2")
    labels = connected(second.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")), scratch, "all")
    labels = scratch.stash(labels, "labels")
    scratch.drop("buckets", "involved", "sets", "links-1", "labels-1", "member", "several", "open", "families", "links-2")

    # a node may be many rows (equal texts) and a component many nodes: neither join leaves them to one task
    sizes = signed.filter("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    sizes = scratch.stash(sizes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "sizes")
    least = sizes.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members"), F.count(F.lit(1)).alias("nodes")).filter("members > 1")
    least = scratch.stash(least, "least")
    named = scratch.stash(join_with_hot(sizes.select("node", "component", "copies"), least, "component", "nodes", rows).select("node", "component_id", "copies"), "named")
    scratch.drop("sizes", "least", "labels")
    out = join_with_hot(signed.select("doc_id", "text_hash", "n", "node"), named.withColumn("found", F.lit(True)), "node", "copies", rows, "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), scratch


def near_groups(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, height: int = 4,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the distinct k-word shingles, or the whole
    sequence if there are fewer words. Without words or text the set is empty and linked with nothing. Links have
    100 * intersection >= percent * union on the full sets. component_id is the smallest doc_id reachable (null ids
    are ignored; null if there is no other); kept tells the rows with doc_id = component_id. Rows that repeat a
    doc_id are linked by their texts like any others. An empty table gives an empty result. A text of any length is
    one set; other columns of docs are not read, whatever their names.
    """
    return _labelled_rows(docs, k, percent, bands, height, doc_id, text)[0].drop("text_hash")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that a smaller doc_id of their group replaces; columns as they are, whatever their names.

    Null and empty texts and texts that are linked with nothing stay, as do all texts of a group without a doc_id. Rows that
    repeat a doc_id are told apart by their texts; rows that repeat both stay or go together. An empty table stays empty.
    """
    rows, scratch = _labelled_rows(docs, k, percent, 32, 4, doc_id, text)
    gone = scratch.stash(rows.filter("not kept").select("doc_id", "text_hash").distinct(), "gone")
    scratch.drop("signed", "named")
    return keyed(docs, gone, [(F.col(doc_id), "doc_id"), (F.xxhash64(text), "text_hash")], "left_anti")
