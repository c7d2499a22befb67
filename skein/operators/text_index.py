"""A stored inverted index for BM25: postings in blocks with their largest impact, and a top k that skips blocks.

``build_text_index`` numbers the rows in the order of their keys and cuts the numbers into ranges. A block holds one term's postings of one
field and range, and the largest impact of any of them. Neighbouring ranges form a run, which one task counts, and a stored row holds a term's
blocks of one field and run: the gaps between row numbers, the counts and the fields' lengths as variable-length bytes. A frequent term is many
rows, so none grows with the corpus. ``search_text_index`` first adds up the largest impacts of a query's terms
for each range, which bounds every score in it; it then scores the most promising ranges, takes the kth score as the query's
threshold, and opens only the ranges whose bound reaches it. A task opens a run's blocks once for all queries. The result is the same as scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import postings, vectors
from skein.operators.fulltext import answers, grouped
from skein.operators.lineage import folder, numbered as in_order, stored

RANGE = 1024
BLOCKS = "term string, field string, run long, n int, heads binary, impacts binary, data binary"
#: Rows that form a run at least (whole ranges), runs at most, and postings at which a task that holds more rows ends a run.
RUN, RUNS, RUN_POSTINGS = 4096, 1024, 2_000_000
#: Terms that are pushed to the scan of the postings as a list; more are joined.
PUSHED_TERMS = 5_000


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers as groups of 7 bits, low ones first; the top bit says that more follow."""
    return _packed(values)[0].tobytes()


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pack_numbers and how many each number takes."""
    most = int(np.max(values)) if len(values) else 0
    values = np.asarray(values).astype(np.uint32 if most < 1 << 32 else np.uint64)
    width = max(1, -(-most.bit_length() // 7))
    out, there = np.empty((len(values), width), np.uint8), np.ones((len(values), width), bool)
    for i in range(width):
        np.greater_equal(values, 1 << 7 * i, out=there[:, i])
        out[:, i] = (values >> type(values[0])(7 * i)).astype(np.uint8) & 127 if len(values) else 0
        if i:
            out[:, i - 1] |= there[:, i].view(np.uint8) << 7
    there[:, 0] = True
    return out[there], there.sum(1)


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def _lists(numbers: list[np.ndarray], sizes: np.ndarray) -> pa.Array:
    """One binary a row: the row's ``sizes`` numbers of each array, one array behind the other, packed."""
    ends, m = np.cumsum(sizes), len(numbers)
    starts = ends - sizes
    values = np.zeros(m * int(sizes.sum()), np.int64)
    for i, x in enumerate(numbers):
        values[postings.expand(m * starts + i * sizes, sizes)] = x
    raw, used = _packed(values)
    cuts = np.append(0, np.cumsum(used))[np.append(0, m * ends)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _unlist(data: pa.ChunkedArray, m: int, sizes: np.ndarray) -> list[np.ndarray]:
    """The ``m`` arrays of _lists, for rows of these sizes."""
    flat, starts = unpack_numbers(b"".join(data.to_pylist())), m * (np.cumsum(sizes) - sizes)
    return [flat[postings.expand(starts + i * sizes, sizes)] for i in range(m)]


def _lengths(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(fields) + 1, np.int64)
        for batch in batches:
            for piece in postings.pieces(batch, fields):
                n += [*(postings.how_many(piece.column(f)) for f in fields), piece.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in n], [*(f"words{i}" for i in range(len(fields))), "n"])

    return run


class _Run:
    """Postings of one field that wait for the end of their run."""

    def __init__(self):
        self.words, self.parts, self.known, self.held = [], [], 0, 0

    def add(self, words: tuple[np.ndarray, pa.Array], first: int, rows: int) -> None:
        row, word = words
        terms, code = _sorted(word)
        term, place, tf = postings.count(code, row, rows)
        length = np.bincount(row, minlength=rows)[place]
        self.words.append(terms)
        self.parts.append((term + self.known, first + place, tf, length))
        self.known, self.held = self.known + len(terms), self.held + len(term)

    def take(self, before: int) -> tuple[pa.Array, tuple[np.ndarray, ...]]:
        """The postings of the rows below ``before``, by term and row; the others stay."""
        terms, code = _sorted(pa.concat_arrays(self.words))
        term, *others = (np.concatenate(x) for x in zip(*self.parts))
        term, now = code[term], others[0] < before
        self.words, self.parts, self.known, self.held = [], [], 0, 0
        if not now.all():
            self.words, self.parts, self.known, self.held = [terms], [(term[~now], *(x[~now] for x in others))], len(terms), int((~now).sum())
            term, others = term[now], [x[now] for x in others]
        # each part is by term and row, and rows grow from part to part
        order = np.argsort(term, kind="stable")
        return terms, (term[order], *(x[order] for x in others))


def _sorted(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in order, and each one's place among them."""
    x = words.dictionary_encode()
    order = pc.sort_indices(x.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return x.dictionary.take(order), rank[x.indices.to_numpy(zero_copy_only=False)]


def _runs(starts: list[int], means: dict[str, float], k1: float, b: float, size: int):
    """Rows (segment, fields), the rows of a segment in their order, to BLOCKS; starts: the segments' first row numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, segment, begin, row = {f: _Run() for f in means}, None, 0, 0
        for batch in batches:
            segments = batch.column("segment").to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.diff(segments, prepend=-1)), len(segments))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if segments[lo] != segment:
                    yield from ended(held, begin, row)
                    segment = int(segments[lo])
                    begin = row = starts[segment]
                for piece in postings.pieces(batch.slice(lo, hi - lo), list(means)):
                    for f in means:
                        held[f].add(postings.split(piece.column(f)), row, piece.num_rows)
                    row += piece.num_rows
                    if sum(x.held for x in held.values()) >= RUN_POSTINGS and row // size * size > begin:
                        yield from ended(held, begin, row // size * size)
                        begin = row // size * size
        yield from ended(held, begin, row)

    def ended(held: dict[str, _Run], begin: int, end: int) -> Iterator[pa.RecordBatch]:
        for f, x in held.items():
            if not x.held:
                continue
            terms, (term, row, tf, length) = x.take(end)
            if not len(term):
                continue
            at = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(row // size, prepend=-1) != 0))
            gaps = np.diff(row, prepend=0)
            gaps[at] = row[at] % size
            most = np.maximum.reduceat(postings.impact(tf, length, means[f], k1, b), at)
            # as float32 and never below the impact, since it bounds
            most = np.nextafter(most.astype(np.float32), np.float32(np.inf))
            mine, n = term[at], np.diff(np.append(at, len(term)))
            rows = np.flatnonzero(np.diff(mine, prepend=-1))
            blocks = np.diff(np.append(rows, len(mine)))
            sizes = np.add.reduceat(n, rows)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((4 * np.append(rows, len(mine))).astype(np.int32)), pa.py_buffer(most)])
            columns = [terms.take(pa.array(mine[rows])), pa.array([f] * len(rows), pa.string()), pa.array(np.full(len(rows), begin // size)), pa.array(sizes.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, _lists([row[at] // size - begin // size, n], blocks), bytes_, _lists([gaps, tf, length], sizes)], ["term", "field", "run", "n", "heads", "impacts", "data"])

    return run


def build_text_index(docs: DataFrame, path: str, key: str, boosts: dict[str, float], k1: float = 1.2, b: float = 0.75, rows_each: int = RANGE, partitions: int | None = None) -> None:
    """Writes below path: rows (row, key), totals and blocks. Fields are columns of docs; null counts as empty.

    Keys should be unique; of rows with one key each is a row. An empty table gives an empty index. Row numbers are dense, in the order of the
    keys, whatever the number of tasks; ``partitions`` fixes it.
    """
    fields = list(boosts)
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("key"), *(postings.lower(f).alias(f) for f in fields))
    sums = texts.select(*fields).mapInArrow(_lengths(fields), ", ".join(f"words{i} long" for i in range(len(fields))) + ", n long").groupBy().sum().first()
    n = sums[-1] or 0
    means = {f: float(sums[i] / n) if n and sums[i] else 1.0 for i, f in enumerate(fields)}
    spark.createDataFrame([(f, float(boosts[f]), n, means[f], k1, b, rows_each) for f in fields], "field string, boost double, n long, mean double, k1 double, b double, rows_each int").coalesce(1).write.parquet(f"{path}/totals")
    rows = stored(in_order(texts.select("key"), "key", name="row", partitions=partitions).select("row", "key"), f"{path}/rows")
    # a segment begins where a range does, and its key is another than the one before, so the key tells a text's segment
    each = -(-max(RUN, -(-n // RUNS)) // rows_each) * rows_each
    seams = {r["row"]: r["key"] for r in rows.filter((F.col("row") % each).isin(0, each - 1)).collect()}
    starts = [0, *(at for at in range(each, n, each) if seams[at] != seams[at - 1])]
    kind = texts.schema["key"].dataType
    cuts = F.array(*(F.lit(seams[at]).cast(kind) for at in starts[1:]))
    segment = F.size(F.filter(cuts, lambda x: x <= F.col("key"))) if len(starts) > 1 else F.lit(0)
    texts = texts.select(segment.alias("segment"), "key", *fields)
    texts = texts.repartition("segment") if partitions is None else texts.repartition(partitions, "segment")
    texts.sortWithinPartitions("segment", "key").drop("key").mapInArrow(_runs(starts, means, k1, b, rows_each), BLOCKS).write.parquet(f"{path}/blocks")


def _heads(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each block the row of its list, its range within the run, its number of postings and its largest impact."""
    sizes = pc.binary_length(table.column("impacts")).to_numpy().astype(np.int64) // 4
    at, n = _unlist(table.column("heads"), 2, sizes)
    impact = np.frombuffer(b"".join(table.column("impacts").to_pylist()), np.float32).astype(np.float64)
    return np.repeat(np.arange(len(sizes)), sizes), at, n, impact


def _terms_of(table: pa.Table, asked: postings.Asked, field: str) -> tuple[pa.Table, np.ndarray]:
    """The lists of a field's asked terms, by term, and the terms' numbers."""
    part = table.filter(pc.equal(table.column("field"), field))
    term = pc.index_in(part.column("term"), asked.fields[field][0]).to_numpy()
    at = np.flatnonzero(~np.isnan(term)) if term.dtype.kind == "f" else np.arange(len(term))
    at = at[np.argsort(term[at], kind="stable")]
    return part.take(pa.array(at)), term[at].astype(np.int64)


def _bounds(shared, boosts: dict[str, float]):
    """A run's lists to (q, run, range, most, blocks)."""

    def run(table: pa.Table) -> pa.Table:
        asked, found, number = shared.value, {}, {}
        size, every = 1, np.arange(len(asked.qids))
        for f in asked.fields:
            part, term = _terms_of(table, asked, f)
            row, at, _, impact = _heads(part)
            found[f], size = (term[row], at, impact), max(size, int(at.max(initial=0)) + 1)
        for f, (term, at, impact) in found.items():
            terms, idf = asked.fields[f][:2]
            found[f] = postings.Postings(term, at, idf[term] * impact, len(terms), size)
            number[f] = postings.Postings(term, at, np.ones(len(at)), len(terms), size)
        out = []
        for lo, hi in postings.spans(sum((p.load(*asked.fields[f][2:], len(every)) for f, p in found.items()), np.zeros(len(every), np.int64)), postings.PAIRS):
            most, blocks = np.zeros((hi - lo, size)), np.zeros((hi - lo, size))
            for f, p in found.items():
                qi, ti = asked.of_queries(f, every[lo:hi])
                most = np.maximum(most, p.sums(qi, ti, hi - lo) * boosts[f])
                blocks += number[f].sums(qi, ti, hi - lo)
            q, at = np.nonzero(blocks)
            out.append((q + lo, at, most[q, at], blocks[q, at].astype(np.int64)))
        q, at, most, blocks = (np.concatenate(x) for x in zip(*out))
        first = table.column("run")[0].as_py()
        return pa.table({"q": q.astype(np.int32), "run": np.full(len(q), first), "range": first + at, "most": most, "blocks": blocks})

    return run


def _score(shared, k: int, k1: float, b: float, means: dict[str, float], boosts: dict[str, float], size: int):
    """A run's lists and its wanted (q, range, least) to each query's best rows of a range, equal scores by row."""

    def run(table: pa.Table, wanted: pa.Table) -> pa.Table:
        asked, found, out = shared.value, {}, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if table.num_rows and wanted.num_rows:
            first = table.column("run")[0].as_py()
            for f in asked.fields:
                part, term = _terms_of(table, asked, f)
                row, at, n, _ = _heads(part)
                gaps, tf, length = _unlist(part.column("data"), 3, part.column("n").to_numpy().astype(np.int64))
                ends, total = np.cumsum(n), np.cumsum(gaps)
                place = total - np.repeat((total - gaps)[ends - n], n) if len(n) else total
                term, at = np.repeat(term[row], n), np.repeat(at, n)
                part = postings.impact(tf, length, means[f], k1, b, asked.fields[f][1][term])
                order = np.argsort(at, kind="stable")  # by range, term and row
                found[f] = (at[order], term[order], place[order], part[order])
            q, at, least = (wanted.column(c).to_numpy() for c in ("q", "range", "least"))
            order = np.lexsort((q, at))
            q, at, least = q[order].astype(np.int64), at[order] - first, least[order]
            cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                here = {}
                for f, (ranges, *x) in found.items():
                    i, j = np.searchsorted(ranges, [at[lo], at[lo] + 1])
                    here[f] = postings.Postings(*(y[i:j] for y in x), len(asked.fields[f][0]), size)
                for queries, score in postings.scores(asked, q[lo:hi], here, boosts):
                    score[score < least[lo:hi][np.searchsorted(q[lo:hi], queries)][:, None]] = -np.inf
                    i, j = vectors._best(score.T, k)
                    out.append((queries[j], (first + at[lo]) * size + i, score[j, i]))
        q, row, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"q": q.astype(np.int32), "row": row, "score": score})

    return run


def search_text_index(spark: SparkSession, path: str, queries: DataFrame, k: int, counts: list[DataFrame] | None = None) -> DataFrame:
    """qid, doc, score, rank: the k best rows of each query (qid, term), equal scores by key; the best boosted field decides.

    Queries with the same terms are searched together. Each distinct term of a query counts once; null terms and terms that don't occur count nothing. ``counts``, if given, gets a DataFrame
    (qid, blocks, opened): the postings blocks of the query's terms and how many of them were read.
    """
    totals = spark.read.parquet(f"{path}/totals").collect()
    n = totals[0]["n"]
    work = folder(spark, "text-search")
    members, asked = grouped(queries)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = [r["term"] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    blocks = _lists_of(spark.read.parquet(f"{path}/blocks").select("term", "field", "n"), terms if len(terms) <= PUSHED_TERMS else asked.select("term").distinct())
    terms = blocks.groupBy("field", "term").agg(F.sum("n").alias("df"))
    known = stored(asked.join(terms, "term").select("qid", "term", "field", idf.alias("idf")), f"{work}/asked")
    found, read = [], []
    for i, rows in enumerate(postings.blocks_of(known)):
        one, many = _search(spark, path, postings.Asked.of(rows), totals, k, work if not i else f"{work}/{i}")
        found.append(one)
        read.append(many)
    both = lambda parts, kinds: spark.createDataFrame([], kinds) if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(both(parts[1:], kinds))
    if counts is not None:
        counts.append(answers(both(read, "qid string, blocks long, opened long"), members))
    found = both(found, "qid string, row long, score double, rank int")
    return answers(found.join(spark.read.parquet(f"{path}/rows"), "row").select("qid", F.col("key").alias("doc"), "score", "rank"), members)


def _lists_of(blocks: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    return blocks.filter(F.col("term").isin(terms)) if isinstance(terms, list) else blocks.join(terms, "term", "left_semi")


def _search(spark: SparkSession, path: str, asked: postings.Asked, totals: list, k: int, work: str) -> tuple[DataFrame, DataFrame]:
    """For a block of queries: (qid, row, score, rank) and (qid, blocks, opened)."""
    means, boosts = {x["field"]: x["mean"] for x in totals}, {x["field"]: x["boost"] for x in totals}
    k1, b, size = (totals[0][x] for x in ("k1", "b", "rows_each"))
    names = spark.createDataFrame(pa.table({"q": pa.array(range(len(asked.qids)), pa.int32()), "qid": asked.qids}).to_pandas(), "q int, qid string")
    shared = spark.sparkContext.broadcast(asked)
    terms = pc.unique(pa.concat_arrays([x[0] for x in asked.fields.values()])).to_pylist()
    blocks = _lists_of(spark.read.parquet(f"{path}/blocks"), terms if len(terms) <= PUSHED_TERMS else F.broadcast(spark.createDataFrame([(x,) for x in terms], "term string")))
    bound = blocks.select("run", "field", "term", "heads", "impacts").groupBy("run").applyInArrow(_bounds(shared, boosts), "q int, run long, range long, most double, blocks long")
    bound = stored(bound, f"{work}/bounds")

    def scored(ranges: DataFrame) -> DataFrame:
        # runs that nobody wants are not shuffled
        lists = blocks.join(F.broadcast(ranges.select("run").distinct()), "run", "left_semi").select("run", "field", "term", "n", "heads", "impacts", "data")
        return lists.groupBy("run").cogroup(ranges.groupBy("run")).applyInArrow(_score(shared, k, k1, b, means, boosts, size), "q int, row long, score double")

    promising = Window.partitionBy("q").orderBy(F.desc("most"), "range")
    first = stored(bound.withColumn("nth", F.row_number().over(promising)).filter("nth <= 2").select("q", "run", "range", "blocks", F.lit(-1.0).alias("least")), f"{work}/first")
    start = stored(scored(first), f"{work}/start")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "row")
    threshold = start.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k).select("q", (F.col("score") - 1e-4).alias("least"))
    rest = bound.join(first.select("q", "range"), ["q", "range"], "left_anti").join(threshold, "q", "left").withColumn("least", F.coalesce("least", F.lit(-1.0))).filter("most >= least")
    rest = stored(rest.select("q", "run", "range", "blocks", "least"), f"{work}/rest")
    read = first.select("q", "blocks").unionByName(rest.select("q", "blocks")).groupBy("q").agg(F.sum("blocks").alias("opened"))
    read = bound.groupBy("q").agg(F.sum("blocks").alias("blocks")).join(read, "q").join(F.broadcast(names), "q")
    found = start.unionByName(scored(rest)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(F.broadcast(names), "q")
    return found.select("qid", "row", "score", "rank"), read.select("qid", "blocks", "opened")
