"""Hard negatives by norm-bucketed maximum inner product search.

Vectors are quantised to integers, sorted by norm and packed into buckets of one array each (for the first pass by label before the norm).
Anchors are packed into blocks the same way. A block meets a bucket only if the Cauchy-Schwarz bound (the largest norm of the bucket times the anchor's) reaches what some anchor still needs; in a
task the buckets of a block come by falling norm, every anchor keeps its running best k, and the bound is tested again against the kth
score and the window's lower limit. The first pass finds an anchor's positives among vectors of its label, the second the negatives
of each positive's window among the others. Partial results of the tasks are merged by anchor.

Work goes by (block, slice of the buckets), so its pieces are bounded whatever label or norm is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, configure, tidy

TILE = 1024
MOST_PARTITIONS = 20_000
#: (label bounds, norms) of the anchor blocks are broadcast to the buckets: some 60 bytes for each block of anchors.
MOST_BLOCKS = 200_000
#: Norms are capped: a product with another vector's is beyond a long all the same.
MOST_NORM = 1e150
NULL_ID = np.iinfo(np.int64).max

PACK = "block long, low long, high long, norm double, n int, width int, ids array<long>, labels array<long>, norms array<double>, data binary"
PACK_FIELDS = ["block", "low", "high", "norm", "n", "width", "ids", "labels", "norms", "data"]


def _matrix(data: bytes, n: int, width: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * n * width else np.float64
    return np.frombuffer(data, kind).reshape(n, width)


def _packs(rows: int, cells: int):
    """Sorted rows (id, label, norm, vector) to packs of at most ``rows`` rows and ``cells`` components."""

    def pack(number: int, ids: list, labels: list, norms: list, vectors: list) -> tuple:
        width = max(map(len, vectors), default=0)
        data = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            data[i, : len(v)] = v
        exact = np.abs(data).max(initial=0) < 1 << 24
        return (number, min(labels), max(labels), max(norms), len(ids), width, ids, labels, norms, data.astype(np.float32 if exact else np.float64).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: tuple[list, ...] = ([], [], [], [])
        size = 0
        for batch in batches:
            ids, labels, norms = (batch.column(i).to_pylist() for i in range(3))
            offsets, values = batch.column(3).offsets.to_numpy(), batch.column(3).values.to_numpy(zero_copy_only=False)
            for i, (vec, label, norm) in enumerate(zip(ids, labels, norms)):
                vector = values[offsets[i] : offsets[i + 1]]
                if held[0] and (len(held[0]) >= rows or size + len(vector) > cells):
                    yield _pack_batch(pack(number, *held))
                    number, size, held = number + 1, 0, ([], [], [], [])
                for column, x in zip(held, (vec, label, norm, vector)):
                    column.append(x)
                size += len(vector)
        if held[0]:
            yield _pack_batch(pack(number, *held))

    return run


def _pack_batch(pack: tuple) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(pack, kinds)], PACK_FIELDS)


def _anchors(every: int):
    """The anchors in packs of candidates; ``own`` is the anchor's place (pack, row) among the candidates, so it isn't its own positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, width, ids, labels, norms, data in zip(*(batch.column(x).to_pylist() for x in ("block", "n", "width", "ids", "labels", "norms", "data"))):
                rows = [i for i, x in enumerate(ids) if x is not None and x % every == 0]
                matrix = _matrix(data, n, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in rows], pa.int64()), pa.array([labels[i] for i in rows], pa.int64()), pa.array([norms[i] for i in rows], pa.float64()),
                        pa.array([matrix[i].astype(np.float64) for i in rows], pa.list_(pa.float64())), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.int32()),
                    ],
                    ["id", "label", "norm", "vector", "own_block", "own_row"],
                )

    return run


def inner(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products of all rows; bound: no partial sum is larger (the product of the largest norms)."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if bound < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 1 << 52:
        return a.astype(np.float64) @ b.astype(np.float64).T
    a, b = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b))
    top = 2**63 - 1
    return np.array([[np.longdouble(str(min(max(int(v), -top), top))) for v in row] for row in a @ b.T], np.longdouble).reshape(len(a), len(b))


class Best:
    """The best k (score, id) of each row: scores downwards, equal scores by smaller id, null ids last."""

    def __init__(self, n: int, k: int, kind: type):
        self.k, self.kind, self.score, self.id = k, kind, np.full((n, k), -np.inf, kind), np.full((n, k), NULL_ID)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores (-inf: none) of rows against columns that are ordered by id."""
        if not len(rows) or not score.shape[1]:
            return
        k = min(self.k, score.shape[1])
        # ties must fall to the left: the kth score by value, then the first columns that have it
        cut = np.partition(score, score.shape[1] - k, 1)[:, -k][:, None]
        above, at = score > cut, score == cut
        left = k - above.sum(1)
        take = (above | (at & (np.cumsum(at, 1) <= left[:, None]))) & np.isfinite(score)
        width = int(take.sum(1).max(initial=0))
        if not width:
            return
        r, c = np.nonzero(take)
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        s, i = np.full((len(rows), width), -np.inf, self.kind), np.full((len(rows), width), NULL_ID)
        s[r, nth], i[r, nth] = score[r, c], ids[c]
        s, i = np.concatenate([self.score[rows], s], 1), np.concatenate([self.id[rows], i], 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _search(same: bool, k: int, kind: type):
    """Rows of (block, slice): an anchor block, then its buckets by falling norm; yields each window's best k of the slice."""

    def start(row: dict) -> dict:
        n = row["n"]
        if same:
            anchor, window, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, -np.inf, kind), np.full(n, np.inf, kind)
        else:
            anchor, window, low, high = np.array(row["windows"], np.int64).reshape(-1, 4).T
        return {
            "row": row, "matrix": _matrix(row["data"], n, row["width"]), "labels": np.array(row["labels"]), "norms": np.array(row["norms"]), "anchor": anchor, "window": window,
            "low": low.astype(kind), "high": high.astype(kind), "best": Best(len(anchor), k, kind), "own": (np.array(row["own_blocks"], np.int64), np.array(row["own_rows"], np.int64)),
        }

    def meet(x: dict, bucket: dict) -> None:
        ids = np.array([NULL_ID if i is None else i for i in bucket["ids"]], np.int64)
        order = np.argsort(ids, kind="stable")
        ids, labels, matrix = ids[order], np.array(bucket["labels"])[order], _matrix(bucket["data"], bucket["n"], bucket["width"])[order]
        # Cauchy-Schwarz: what no vector of this bucket can reach; a little room for the rounding of the norms
        reach = x["norms"][x["anchor"]] * bucket["norm"] * (1 + 1e-9) + 1
        open_ = np.flatnonzero(reach >= np.maximum(x["low"], x["best"].score[:, -1]))
        for lo in range(0, len(open_), TILE):
            rows = open_[lo : lo + TILE]
            anchors, where = np.unique(x["anchor"][rows], return_inverse=True)
            bound = float(x["norms"][anchors].max() * bucket["norm"])
            score = inner(x["matrix"][anchors], matrix, bound)
            match = (x["labels"][anchors][:, None] == labels) == same
            if same:
                mine = x["own"][0][anchors] == bucket["block"]
                match[np.flatnonzero(mine), np.argsort(order)[x["own"][1][anchors][mine]]] = False
            score = np.where(match, score, -np.inf)
            for first in range(0, len(rows), 256):
                part, some = rows[first : first + 256], where[first : first + 256]
                here = score[some]
                least = np.maximum(x["low"][part], x["best"].score[part, -1])[:, None]
                here = np.where((here >= least) & (here <= x["high"][part][:, None]), here, -np.inf)
                hit = np.flatnonzero((here > -np.inf).any(1))
                x["best"].offer(part[hit], here[hit], ids)

    def finish(x: dict) -> pa.RecordBatch:
        best = x["best"]
        r, c = np.nonzero(best.score > -np.inf)
        ids = best.id[r, c]
        columns = [np.full(len(r), x["row"]["block"]), x["anchor"][r], x["window"][r], best.score[r, c].astype(np.int64)]
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in columns), pa.array(ids, pa.int64(), mask=ids == NULL_ID)], ["block", "anchor", "window", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if not row["side"]:
                    if block is not None:
                        yield finish(block)
                    block = start(row)
                else:
                    meet(block, row)
        if block is not None:
            yield finish(block)

    return run


SIDE = ["side", "to_block", "slice", "rank", *PACK_FIELDS, "own_blocks", "own_rows", "windows"]


def _meetings(buckets: DataFrame, blocks: DataFrame, same: bool, k: int, kind: type, slices: int, partitions: int) -> DataFrame:
    """block, anchor, window, score, id: the best k of each window, from one task for each block and slice."""
    few = F.broadcast(blocks.select(F.col("block").alias("to_block"), F.col("low").alias("block_low"), F.col("high").alias("block_high"), "reach"))
    fits = F.col("norm") >= F.col("reach")
    if same:
        fits = fits & (F.col("low") <= F.col("block_high")) & (F.col("high") >= F.col("block_low"))
    none = [F.lit(None).cast(f"array<{of}>").alias(name) for name, of in (("own_blocks", "long"), ("own_rows", "int"), ("windows", "long"))]
    part = F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice")
    moving = buckets.join(few, fits).select(F.lit(1).alias("side"), "to_block", part, (-F.col("norm")).alias("rank"), *PACK_FIELDS, *none)
    still = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
    still = still.select(F.lit(0).alias("side"), F.col("block").alias("to_block"), "slice", F.lit(0.0).alias("rank"), *PACK_FIELDS, "own_blocks", "own_rows", "windows")
    dealt = still.unionByName(moving).repartition(partitions, "to_block", "slice").sortWithinPartitions("to_block", "slice", "side", "rank", "block")
    found = dealt.select(*SIDE).mapInArrow(tidy(_search(same, k, kind)), "block long, anchor long, window long, score long, id long")
    order = Window.partitionBy("block", "anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, every: int = 50, positives: int = 5, negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, bucket_rows: int = 4096, block_rows: int = 8192, slice_rows: int = 1 << 18, partitions: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, vector or component, or a component that isn't finite, take no part. A component counts floor(scale * x). Anchors
    are rows whose id ``every`` divides; their positives the best other rows of their label, and a positive's negatives the best rows of other
    labels with low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score. Equal scores go by smaller id, null ids last.

    A null id is no anchor; rows with one id are different rows (another one with the anchor's id may be its positive, and repeated anchors give
    their rows each). Shorter vectors count as ended by zeros; scores beyond a long are its bounds. Empty tables and anchors without partners
    give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    configure(spark)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("vector")).filter(
        F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                values = np.nan_to_num(np.floor(scale * values[offsets[0] : offsets[-1]]))
                offsets = offsets - offsets[0]
                norms = [min(MOST_NORM, float(np.sqrt(np.square(values[a:b]).sum()))) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(norms, pa.float64()), lists], ["id", "label", "norm", "vector"])

    ready = rows.mapInArrow(whole, "id long, label long, norm double, vector array<double>")
    total = rows.count()
    parts = max(1, min(MOST_PARTITIONS, -(-total // (4 * bucket_rows))))
    sides = {}
    for name, order in (("by_label", ["label", F.desc("norm"), "id"]), ("by_norm", [F.desc("norm"), "id"])):
        ranged = ready.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        sides[name] = scratch.stash(ranged.mapInArrow(tidy(_packs(bucket_rows, bucket_rows << 9)), PACK), name)
    buckets = sides["by_label"]
    widest = buckets.agg(F.max("norm")).first()[0] or 0.0
    kind = np.float64 if widest * widest < 1 << 52 else np.longdouble  # holds every score exactly

    anchors = scratch.stash(buckets.select("block", "n", "width", "ids", "labels", "norms", "data").mapInArrow(tidy(_anchors(every)), "id long, label long, norm double, vector array<double>, own_block long, own_row int"), "anchors")
    asked = anchors.count()
    order = ["label", F.desc("norm"), "id", "own_block", "own_row"]
    dealt = anchors.repartitionByRange(max(1, min(MOST_PARTITIONS, -(-asked // block_rows))), *order).sortWithinPartitions(*order)
    blocks = scratch.stash(dealt.mapInArrow(tidy(_blocks(block_rows, block_rows << 9)), f"{PACK}, own_blocks array<long>, own_rows array<int>"), "blocks")
    if blocks.count() > MOST_BLOCKS:
        raise ValueError(f"over {MOST_BLOCKS} blocks of anchors: raise block_rows")
    slices = max(1, -(-total // slice_rows), min(spark.sparkContext.defaultParallelism, total // (2 * bucket_rows)))
    if partitions is None:
        partitions = max(spark.sparkContext.defaultParallelism, min(MOST_PARTITIONS, slices * -(-asked // block_rows)))

    everything = blocks.withColumn("windows", F.lit(None).cast("array<long>")).withColumn("reach", F.lit(float("-inf")))
    first = scratch.stash(_meetings(buckets, everything, True, positives, kind, slices, partitions), "positives")
    # a window's limits, in whole scores: ceil and floor of shares of the positive's score
    share = lambda percent: F.col("score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    limits = first.withColumn("low", F.ceil(share(low_percent)).cast("long")).withColumn("high", F.floor(share(high_percent)).cast("long")).filter("low <= high")
    norms = blocks.select("block", F.posexplode("norms").alias("anchor", "norm"))
    need = limits.join(norms.withColumn("anchor", F.col("anchor").cast("long")), ["block", "anchor"])
    need = need.groupBy("block").agg(
        F.flatten(F.collect_list(F.array(*(F.col(x).cast("long") for x in ("anchor", "rank", "low", "high"))))).alias("windows"),
        F.min(F.when(F.col("low") <= 0, float("-inf")).otherwise((F.col("low") - 1) / F.col("norm") * (1 - 1e-9))).alias("reach"),
    )
    second = _meetings(sides["by_norm"], scratch.stash(blocks.join(need, "block"), "windows"), False, negatives, kind, slices, partitions)
    names = blocks.select("block", F.posexplode("ids").alias("anchor", "anchor_id"))
    pairs = first.select("block", "anchor", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        second.select("block", "anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs.withColumn("window", F.col("window").cast("long")), ["block", "anchor", "window"])
        .join(names.withColumn("anchor", F.col("anchor").cast("long")), ["block", "anchor"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def _blocks(rows: int, cells: int):
    """Packs of anchors, with their places among the candidates."""
    inner_run = _packs(rows, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns: list[tuple[int, int]] = []

        def narrow() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owns.extend(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
                yield pa.RecordBatch.from_arrays(batch.columns[:4], ["id", "label", "norm", "vector"])

        for pack in inner_run(narrow()):
            n = pack.column(4)[0].as_py()
            mine, owns[:] = owns[:n], owns[n:]
            yield pa.RecordBatch.from_arrays([*pack.columns, pa.array([[b for b, _ in mine]], pa.list_(pa.int64())), pa.array([[r for _, r in mine]], pa.list_(pa.int32()))], [*PACK_FIELDS, "own_blocks", "own_rows"])

    return run
