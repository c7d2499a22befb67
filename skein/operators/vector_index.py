"""A stored coarse index for cosine search: cells of a k-means, rows packed by cell with int8 residuals, files by cell.

``build_index`` fits the cells on a bounded sample and assigns every row. Rows of a cell are packed into blocks; a block holds ids, codes
(the residual of the unit vector against its cell's centre, in steps of 1/127 of its largest part), each row's step and the exact
length of what the code leaves out, and the vectors themselves. ``search_index`` gives each query its nearest cells, so Spark prunes the
other cells' folders; codes alone give a score and, by the length left out, sure bounds of the exact one. Rows whose upper bound falls
below the kth lower bound can't be among the k best; only the others' vectors are read. With all cells probed the result is exact.

Blocks and bundles of queries are rows of a bounded size, so a cell that holds a third of all rows is many join rows, not one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.lineage import folder, stored
from skein.operators.vectors import is_valid_vector, top_k

SAMPLE_BYTES = 64 << 20
MOST_CELLS = 4096
BLOCK_ROWS = 2048
BUNDLE = 512
DIGITS = 6


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _rows(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]].reshape(len(column), -1).astype(np.float64)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centres by spherical k-means; a cell that loses its rows takes the row that is worst served."""
    sample = _unit(sample)
    cells = min(cells, len(sample))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)] if cells else sample
    for _ in range(rounds if cells else 0):
        best, fit = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        for lo in range(0, len(sample), 4096):
            score = sample[lo : lo + 4096] @ centres.T
            best[lo : lo + 4096], fit[lo : lo + 4096] = score.argmax(1), score.max(1)
        order = np.argsort(best, kind="stable")
        count = np.bincount(best, minlength=cells)
        sums = np.zeros_like(centres)
        held = np.flatnonzero(count)
        sums[held] = np.add.reduceat(sample[order], np.cumsum(count)[held] - count[held], axis=0)
        empty = np.flatnonzero(count == 0)
        sums[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        centres = _unit(sums)
    return centres


def recall_curve(sample: np.ndarray, centres: np.ndarray, k: int = 10, queries: int = 256) -> np.ndarray:
    """What share of a sample row's k nearest others in the sample lies in its 1, 2, ... nearest cells, on average."""
    sample = _unit(sample)
    asked = sample[np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(np.int64)]
    cell = np.concatenate([(sample[lo : lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(sample), 4096)])
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    score = asked @ sample.T
    best = np.argsort(-score, axis=1, kind="stable")[:, 1 : k + 1]  # the first is the row itself
    reached = np.bincount(np.take_along_axis(rank, cell[best], 1).ravel(), minlength=len(centres)) if best.size else np.ones(len(centres))
    return np.cumsum(reached) / max(1, reached.sum())


def probes_for(spark: SparkSession, path: str, recall: float) -> int:
    """The least number of cells whose measured recall on the index's sample is the one wanted."""
    curve = spark.read.parquet(f"{path}/recall").filter(F.col("recall") >= recall).agg(F.min("probes")).first()[0]
    return curve or max(1, spark.read.parquet(f"{path}/cells").count())


def encode(unit: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the residuals, each row's step, and the length of each row's remaining error."""
    residual = unit - centre
    step = np.abs(residual).max(1, initial=0) / 127
    codes = np.rint(residual / np.where(step > 0, step, 1)[:, None]).astype(np.int8)
    return codes, step, np.linalg.norm(residual - codes * step[:, None], axis=1)


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = (_unit(_rows(batch.column(1))) @ centres.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["id", "v", "cell"])

    return run


def _pack(centres: np.ndarray, rows: int):
    """Rows (id, v, cell) sorted by cell to blocks of one cell."""

    def block(cell: int, ids: pa.Array, v: pa.Array) -> pa.RecordBatch:
        exact = _rows(v)
        codes, step, left = encode(_unit(exact), centres[cell])
        kept = exact.astype(v.values.type.to_pandas_dtype())
        whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([cell], pa.int32()), pa.array([len(ids)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([codes.tobytes()], pa.binary()),
                whole(step, pa.float64()), whole(left, pa.float64()), pa.array([kept.tobytes()], pa.binary()),
            ],
            ["cell", "n", "ids", "codes", "steps", "lost", "vectors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                held = yield from flush(held, False)
        yield from flush(held, True)

    def flush(held: list[pa.RecordBatch], last: bool):
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        if table is None or not table.num_rows:
            return []
        cell = table.column("cell").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
        lo = 0
        for hi in cuts.tolist():
            while hi - lo >= rows or (lo < hi and (last or hi < len(cell))):
                n = min(rows, hi - lo)
                yield block(int(cell[lo]), table.column("id").chunk(0).slice(lo, n), table.column("v").chunk(0).slice(lo, n))
                lo += n
        return table.slice(lo).combine_chunks().to_batches() if lo < len(cell) else []

    return run


def build_index(vectors: DataFrame, path: str, cells: int | None = None, sample_rows: int = 65_536, block_rows: int = BLOCK_ROWS) -> int:
    """Writes the index of vectors (id, v) below path and returns the number of cells.

    Vectors that are null, empty or hold a null, NaN or infinity are left out, and those whose length isn't the most frequent one. The cells
    (by default the root of the number of rows, 4,096 at most) are fitted on sample_rows rows or 64 MB of them, the first by a hash of id and vector;
    every row is assigned. How many cells must be probed for which recall is measured on the sample and stored (``probes_for``): data without
    clusters need most of the cells. An empty table gives an index without cells.
    """
    spark = vectors.sparkSession
    valid = vectors.select("id", "v").filter(is_valid_vector(F.col("v")))
    sizes = valid.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    dims, total = (sizes["dims"], sizes["n"]) if sizes else (0, 0)
    valid = valid.filter(F.size("v") == dims)
    sample_rows = min(sample_rows, SAMPLE_BYTES // (8 * max(dims, 1)))
    sample = valid.select("v").orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).toPandas()["v"]
    wanted = cells or round(total**0.5)
    centres = fit_cells(np.stack(sample.to_numpy()).astype(np.float64) if len(sample) else np.zeros((0, 1)), min(max(1, wanted), MOST_CELLS))
    curve = recall_curve(np.stack(sample.to_numpy()).astype(np.float64), centres) if len(sample) else []
    spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(curve)], "probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/recall")
    kind, of = valid.schema["id"].dataType.simpleString(), valid.schema["v"].dataType.simpleString()
    spark.createDataFrame([(i, c.tolist(), dims) for i, c in enumerate(centres)], "cell int, centre array<double>, dims int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    placed = valid.mapInArrow(_assign(centres), f"id {kind}, v {of}, cell int") if len(centres) else valid.withColumn("cell", F.lit(0))
    # rebalancing by cell: a task writes whole cells, and Spark splits those that are too large for one
    packed = placed.hint("rebalance", "cell").sortWithinPartitions("cell", "id").mapInArrow(
        _pack(centres, block_rows), f"cell int, n int, ids array<{kind}>, codes binary, steps array<double>, lost array<double>, vectors binary"
    )
    packed = packed.withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite")
    (packed.partitionBy("cell") if len(centres) else packed).parquet(f"{path}/blocks")
    return len(centres)


def _bundles(spark: SparkSession, path: str, queries: DataFrame, probes: int | None) -> tuple[DataFrame, list[int] | None]:
    """(cell, bundle, qs) of the queries' nearest cells, and the cells that occur (None: all); cells are bounded, so their centres are too."""
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    dims = cells[0]["dims"] if cells else 0
    centres = np.array([c["centre"] for c in cells]).reshape(len(cells), -1)
    count = len(cells) if probes is None else min(probes, len(cells))
    kind = queries.schema["qid"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not count:
                continue
            q = _unit(_rows(batch.column(1)))
            near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :count]
            rows = np.repeat(np.arange(len(q)), count)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(q[rows].ravel()), dims).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists, pa.array(near.ravel(), pa.int32())], ["qid", "qv", "cell"])

    asked = queries.select("qid", "qv").filter(is_valid_vector(F.col("qv")) & (F.size("qv") == dims))
    near = asked.mapInArrow(nearest, f"qid {kind}, qv array<double>, cell int")
    bundles = max(1, -(-queries.count() // BUNDLE))
    packed = near.groupBy("cell", F.pmod(F.xxhash64("qid"), F.lit(bundles)).alias("bundle")).agg(F.collect_list(F.struct("qid", "qv")).alias("qs"))
    used = None if count == len(cells) else [r["cell"] for r in near.select("cell").distinct().collect()]
    return packed, used


def _codes_scores(centres: np.ndarray, k: int, most: int | None):
    """For each bundle and block: the rows of each query whose upper bound reaches the block's kth lower bound (or the first ``most`` by score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                qs = row.column(1).flatten()
                q = _rows(qs.field("qv"))
                n, cell = row.column(3)[0].as_py(), row.column(0)[0].as_py()
                codes = np.frombuffer(row.column(4)[0].as_py(), np.int8).reshape(n, -1)
                steps, lost = row.column(5).flatten().to_numpy(), row.column(6).flatten().to_numpy()
                score = (q @ centres[cell])[:, None] + (q @ codes.T.astype(np.float64)) * steps
                slack = lost + 2e-6  # scores are compared after rounding to six places
                if n > k:
                    low = np.partition(score - slack, n - k, axis=1)[:, n - k]
                    keep = score + slack >= low[:, None]
                else:
                    keep = np.ones(score.shape, bool)
                if most is not None and n > most:
                    keep &= score >= np.partition(score, n - most, axis=1)[:, n - most][:, None]
                a, b = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [qs.field("qid").take(pa.array(a)), pa.array(np.full(len(a), cell), pa.int32()), row.column(2).take(pa.array(np.zeros(len(a), np.int64))), pa.array(b, pa.int32()), pa.array(score[a, b]), pa.array(slack[b])],
                    ["qid", "cell", "block", "place", "near", "slack"],
                )

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids, asked = row.column(1).flatten(), row.column(3).flatten()
            data, n = row.column(2)[0].as_py(), row.column(0)[0].as_py()
            q, place = _rows(asked.field("qv")), asked.field("place").to_numpy()
            kind = np.float64 if len(data) == 8 * n * q.shape[1] else np.float32
            v = _unit(np.frombuffer(data, kind).reshape(n, -1)[place].astype(np.float64))
            yield pa.RecordBatch.from_arrays([asked.field("qid"), ids.take(pa.array(place)), pa.array(np.round((v * q).sum(1), DIGITS) + 0.0)], ["qid", "id", "score"])


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, num_candidates: int | None = None) -> DataFrame:
    """qid, id, score, rank: the k nearest of each query (qid, qv) by cosine, equal scores by id.

    ``probes``: how many cells a query looks into (None: all, which is exact). ``num_candidates``: how many rows of a query are scored exactly, the
    best by their codes; None lets the codes' bounds decide, which never loses a row. Queries with a null, not finite or differently long vector
    get no rows; a zero vector scores 0 with everything.
    """
    cells = spark.read.parquet(f"{path}/cells")
    centres = np.array([c["centre"] for c in cells.orderBy("cell").collect()])
    kind = queries.schema["qid"].dataType.simpleString()
    blocks = spark.read.parquet(f"{path}/blocks")
    if not len(centres):
        return queries.sparkSession.createDataFrame([], f"qid {kind}, id {blocks.schema['ids'].dataType.elementType.simpleString()}, score double, rank int")
    packed, used = _bundles(spark, path, queries, probes)
    blocks = blocks if used is None else blocks.filter(F.col("cell").isin(used))
    work = folder(spark, "search")
    met = packed.join(blocks.select("cell", "block", "n", "codes", "steps", "lost"), "cell").select("cell", "qs", "block", "n", "codes", "steps", "lost")
    near = stored(met.mapInArrow(_codes_scores(centres, k, num_candidates), f"qid {kind}, cell int, block long, place int, near double, slack double"), f"{work}/near")
    if num_candidates is None:
        floor = top_k(near.select("qid", (F.col("near") - F.col("slack")).alias("score"), F.struct("block", "place").alias("id")), k)
        floor = floor.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
        left = near.join(floor, "qid").filter((F.col("n") < k) | (F.col("near") + F.col("slack") >= F.col("low")))
    else:
        left = top_k(near.select("*", F.col("near").alias("score"), F.struct("block", "place").alias("id")), max(k, num_candidates))
    vectors_of = queries.select("qid", F.transform("qv", lambda x: x.cast("double")).alias("qv")).filter(is_valid_vector(F.col("qv")))
    norm = F.sqrt(F.aggregate("qv", F.lit(0.0), lambda s, x: s + x * x))
    vectors_of = vectors_of.withColumn("qv", F.transform("qv", lambda x: x / F.greatest(norm, F.lit(1e-12))))
    # a block's candidates go in bundles, so that a block all queries want is no single row
    bundles = max(1, -(-queries.count() // BUNDLE))
    asked = left.join(vectors_of, "qid").groupBy("cell", "block", F.pmod(F.xxhash64("qid"), F.lit(bundles)).alias("bundle")).agg(F.collect_list(F.struct("qid", "qv", "place")).alias("asked"))
    cell_blocks = blocks.select("cell", "block", "n", "ids", "vectors")
    found = asked.join(cell_blocks, ["cell", "block"]).select("n", "ids", "vectors", "asked").mapInArrow(
        _exact, f"qid {kind}, id {blocks.schema['ids'].dataType.elementType.simpleString()}, score double"
    )
    return top_k(found, k).select("qid", "id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """qid, wanted, hits: how many rows as near as the exact neighbours of each query were found; of equal scores any will do."""
    need = exact.groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"), F.min("score").alias("least"))
    x = need.join(found.select("qid", "score"), "qid", "left")
    return x.groupBy("qid", "wanted").agg(F.least("wanted", F.count_if(F.col("score") >= F.col("least"))).alias("hits"))
