"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are ranked in a seeded order and get the fractional rank (2 rank - 1) / (2 n).
Sorting all rows by it interleaves the sources in proportion to their sizes; equal cuts of that order
give shards whose counts differ by one at most and whose mixture of sources matches the whole.

No rank needs a source, or all rows, in one task: ranks come from counts of hash ranges (``buckets`` for
each source) plus a rank within one range, and places in the global order from counts of ranges of the
fractional rank. What is counted in one task has ``buckets`` rows at most, whatever the input's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAW = "rows"


def interleave_shards(
    docs: DataFrame, shards: int = 24, seed: int = 11, buckets: int = 4096,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source: one row for each input row.

    Null sources are one more stratum; a null text has size 8 and crc32 0. The seeded order is by doc_id (null is a value of its
    own) and the text's crc32, so rows that share a doc_id are spread too. Rows with equal doc_id and text are alike, so any order of theirs gives the same result. Equal texts of
    different ids are rows like any others under this law: they may lie in different shards. A text may have any length.
    An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    if shards < 1 or buckets < 1:
        raise ValueError("shards and buckets must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_crc32"))))
    # the first 8 hex digits are uniform over 2^32; a range of them is one bucket
    rows = rows.withColumn("_range", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int"))

    def placed(frame: DataFrame, group: list[str], bucket: str, order: list, rank: str, total: str) -> DataFrame:
        """Adds the rank (from 1) of each row in its group, ordered by bucket and then order, and the group's count."""
        ranges = frame.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
        whole = Window.partitionBy(*group)
        before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(
            *(F.col(c).alias(f"_of_{c}") for c in (*group, bucket)),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias(total),
        )
        match = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, bucket)]
        within = Window.partitionBy(*group, bucket).orderBy(*order)
        ranked = frame.withColumn("_within", F.row_number().over(within)).join(ranges, match, "left")
        return ranked.withColumn(rank, F.col("_within") + F.col("_before")).drop("_within", "_before", *(f"_of_{c}" for c in (*group, bucket)))

    tie = ["_key", "doc_id", "text_crc32", "size"]
    rows = placed(rows, ["source"], "_range", tie, "_rank", "_in_source")
    rows = rows.withColumn("_part", (2 * F.col("_rank") - 1) / (2.0 * F.col("_in_source")))
    rows = rows.withColumn("_range", F.floor(F.col("_part") * buckets).cast("int"))
    rows = placed(rows, [], "_range", ["_part", "source", *tie], "_place", "_all")
    # exact integers: the first place of shard s is ceil(s * n / shards)
    shard = F.expr(f"cast(((_place - 1) * {shards}) div _all as int)")
    return rows.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("_place") - 1 - F.expr(f"(cast(shard as bigint) * _all + {shards} - 1) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )
