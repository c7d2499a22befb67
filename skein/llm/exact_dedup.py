"""Exact dedup by a Golomb-coded fingerprint exchange.

1. One scan makes a narrow table: doc_id, row number, SHA-256 of the normalised text, the sending part.
2. Every part sends each owner of a hash range its distinct short fingerprints, sorted and Golomb-Rice coded.
   The fingerprints have log2(rows) + ``extra_bits`` bits, so a lone text is suspected once in 2^extra_bits.
3. An owner answers each part with a bitmap: which of its fingerprints another part has sent too.
4. Only suspects (those, and fingerprints that repeat inside a part) shuffle their texts: a bit filter of bounded size over
   the suspects' hashes goes to the scan, which leaves other texts where they are. Bytes are compared by grouping on the
   text itself, after a combine in each task, so a huge group is a row for each task.
5. Groups of suspects are counted on the narrow table. The driver gets the row counts and the filter, FILTER_BITS at most;
   with so many suspects that it would be full, their texts are picked by the join alone.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, configure, free_name, join_with_hot, keyed, lower_ascii

PART_ROWS = 100_000
FILTER_BITS = 29  # 2^29 bits are 64 MB
FILTER_SLICE = 1 << 16  # bytes that tasks send of it at once


def rice_encode(values: np.ndarray, bits: int) -> bytes:
    """Golomb-Rice code of sorted distinct integers below 2^bits: unary quotients, then remainders.

    Layout: u32 count, u8 parameter, u32 bytes of unary bits, unary bits, remainder bits.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    k = max(0, min(bits, int(math.log2(max(1.0, 0.69 * 2.0**bits / max(1, n))))))
    gaps = np.diff(values, prepend=np.uint64(0))
    quotient, rest = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    planes = ((rest[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.packbits(unary).tobytes()
    return n.to_bytes(4, "little") + bytes([k]) + len(head).to_bytes(4, "little") + head + np.packbits(planes.ravel()).tobytes()


def rice_decode(code: bytes) -> np.ndarray:
    n, k, size = int.from_bytes(code[:4], "little"), code[4], int.from_bytes(code[5:9], "little")
    if not n:
        return np.zeros(0, np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 9)))[:n]
    quotient = np.diff(ones, prepend=-1) - 1
    rest = np.zeros(n, np.uint64)
    if k:
        planes = np.unpackbits(np.frombuffer(code, np.uint8, -1, 9 + size))[: n * k].reshape(n, k).astype(np.uint64)
        rest = (planes << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + rest, dtype=np.uint64)


def _short(sha: pd.Series, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in sha), ">u8").astype(np.uint64) >> np.uint64(64 - bits)


def _send(bits: int, owners: int):
    def send(part: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(_short(part["sha"], bits))
        owner = (values >> np.uint64(max(0, bits - 31))).astype(np.int64) * owners >> min(bits, 31)
        cuts = np.searchsorted(owner, np.arange(owners + 1))
        sent = [(part["part"].iloc[0], o, rice_encode(values[a:b], bits)) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pd.DataFrame(sent, columns=["part", "owner", "code"])

    return send


def _answer(got: pd.DataFrame) -> pd.DataFrame:
    """For each sender a bitmap over its sorted fingerprints: sent by another part too."""
    lists = [rice_decode(x) for x in got["code"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"part": got["part"], "owner": got["owner"], "bitmap": maps})


def _suspect(bits: int, owners: int):
    def suspect(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"doc_id": [], "sha": []})
        short = _short(part["sha"], bits)
        values, inverse, counts = np.unique(short, return_inverse=True, return_counts=True)
        owner = (values >> np.uint64(max(0, bits - 31))).astype(np.int64) * owners >> min(bits, 31)
        marked = counts > 1
        for o, bitmap in zip(answers["owner"], answers["bitmap"]):
            a, b = np.searchsorted(owner, [o, o + 1])
            marked[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: b - a].astype(bool)
        found = part.loc[marked[inverse], ["doc_id", "sha"]]
        return found.drop_duplicates()

    return suspect


def _places(sha: Iterator[bytes], bits: int) -> np.ndarray:
    """Three places in the filter for each SHA-256, from bytes that the fingerprints don't use."""
    words = np.frombuffer(b"".join(x[8:32] for x in sha), "<u8").reshape(-1, 3)
    return (words >> U64(64 - bits)).astype(np.int64)


def _mark(bits: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = np.zeros(1 << bits - 3, np.uint8), min(FILTER_SLICE, 1 << bits - 3)
        for batch in batches:
            at = _places(batch.column(0).to_pylist(), bits).ravel()
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = np.flatnonzero(table.reshape(-1, size).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([table[i * size : (i + 1) * size].tobytes() for i in used], pa.binary())], ["slice", "part"])

    return mark


def _either(group: pd.DataFrame) -> pd.DataFrame:
    total = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["part"]])
    return pd.DataFrame({"slice": group["slice"][:1], "part": [total.tobytes()]})


def bit_filter(sha: DataFrame, count: int) -> Column | None:
    """A condition on a column ``sha`` that holds for every sha of the table, and for one other in about 50; None if it would be full."""
    bits = max(16, math.ceil(math.log2(12 * count + 1)))
    if bits > FILTER_BITS:
        return None
    slices = sha.mapInArrow(_mark(bits), "slice int, part binary").groupBy("slice").applyInPandas(_either, "slice int, part binary").collect()  # 2^FILTER_BITS bits at most
    table, size = np.zeros(1 << bits - 3, np.uint8), min(FILTER_SLICE, 1 << bits - 3)
    for r in slices:
        table[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["part"], np.uint8)
    shared = sha.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be(x: pd.Series) -> pd.Series:
        at = _places(x, bits)
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1))

    return may_be(F.col("sha"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", extra_bits: int = 10, owner_rows: int = 2_000_000) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256 for each row of docs.

    Texts are equal when identical after lower-casing A-Z only; a null text is empty. Of equal texts the row with
    the largest doc_id stays (nulls are smallest); of rows that share that doc_id and text exactly one has kept.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    configure(spark)
    scratch = Scratch(spark)
    texts = docs.select(F.col(doc_id).alias("doc_id"), lower_ascii(F.col(text)).alias("body"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    narrow = texts.select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("body", 256)).alias("sha"))
    # a part: the rows of one scan task, PART_ROWS at most (the row number has the task above bit 33)
    narrow = narrow.withColumn("part", F.expr(f"shiftleft(shiftright(row, 33), 20) + (row & {2**33 - 1}) div {PART_ROWS}"))
    narrow = scratch.stash(narrow, "narrow")
    rows = narrow.count()
    bits = min(63, max(16, math.ceil(math.log2(rows + 2)) + extra_bits))
    owners = max(1, -(-rows // owner_rows))
    prints = narrow.select("doc_id", "part", "sha")
    sent = prints.groupBy("part").applyInPandas(_send(bits, owners), "part long, owner int, code binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "part long, owner int, bitmap binary")
    suspects = prints.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_suspect(bits, owners), f"doc_id {kind}, sha binary").distinct()
    suspects = scratch.stash(suspects, "suspects")
    # the suspects' bytes: grouping by the text compares them exactly, combined in each task first
    hashed = texts.withColumn("sha", F.unhex(F.sha2("body", 256)))
    possible = bit_filter(suspects.select("sha"), suspects.count())
    if possible is not None:
        hashed = hashed.filter(possible)
    moved = hashed.alias("t").join(suspects.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.sha") == F.col("s.sha")), "left_semi")
    checked = moved.groupBy("sha", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    # two texts under one SHA-256 would be a collision that ids cannot tell apart: the query fails rather than merge them
    checked = checked.filter("n > 1").select("sha", F.when(F.col("texts") > 1, F.raise_error("two texts share a SHA-256")).otherwise(F.lit(True)).alias("same"))
    checked = scratch.stash(checked.filter("same").select("sha"), "checked")
    # grouped first: each task combines its rows of one text, so a text of a third of all rows is no hot key
    groups = narrow.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("size"))
    groups = scratch.stash(groups.filter("size > 1").join(checked, "sha", "left_semi"), "groups")
    scratch.drop("suspects", "checked")
    return join_with_hot(narrow.select("doc_id", "row", "sha"), groups, "sha", "size", rows, "left").select(
        "doc_id", "row",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns, whatever their names.

    Of equal texts (null and empty ones are equal) the row with the largest doc_id stays, nulls being smallest. Of rows
    that repeat that doc_id and text one stays. An empty table stays empty; texts may be of any length.
    """
    scratch = Scratch(docs.sparkSession)
    groups = exact_groups(docs, doc_id, text)
    mark = lambda x: F.unhex("text_sha256") if x else F.unhex(F.sha2(lower_ascii(F.col(text)), 256))
    lost = scratch.stash(groups.filter("not kept").select("doc_id", mark(True).alias("sha"), (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("twin")), "lost")
    kept = keyed(docs, lost.filter("not twin").select("doc_id", "sha").distinct(), [(F.col(doc_id), "doc_id"), (mark(False), "sha")], "left_anti")
    if not lost.filter("twin").limit(1).count():
        return kept
    # rows that repeat the doc_id and the text of the one that stays: a number in each such group tells them apart
    number = free_name(docs, "nth")
    twins = scratch.stash(lost.filter("twin").select("doc_id", "sha").distinct(), "twins")
    match = [(F.col(doc_id), "doc_id"), (mark(False), "sha")]
    first = keyed(kept, twins, match, "left_semi").withColumn(number, F.row_number().over(Window.partitionBy(F.col(doc_id), mark(False)).orderBy(F.lit(1)))).filter(F.col(number) == 1).drop(number)
    return keyed(kept, twins, match, "left_anti").unionByName(first)
