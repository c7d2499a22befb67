"""Toxicity: a convolutional text classifier, trained in numpy, with thresholds calibrated by language.

A word's embedding is the sum of a row from each of two hashed tables, so one chance collision doesn't make a word look
like another, and one channel more: the word's evidence, the log-odds of toxic texts among the labelled texts that have it,
shrunk towards nothing by how few they are. Filters of several widths slide over the embeddings of the whole text; each filter's
maximum enters a logistic layer. Scoring folds each filter into the tables, so a word costs a few table reads whatever its text's length.

Every labelled row trains. The rows lie in shards of bounded size; in each round the tasks train on their shards, from the same
network, and the changes are averaged, a table's row by how often each shard moved it. Counts of words are sums over all rows.
The rows fall into PARTS by their ids' hashes: a row's evidence comes from the other parts, as a new text's would, and the last part
trains nothing and sets the thresholds. The language that picks a threshold is guessed from the words; the labelled rows' lang
teaches that guess, and no row's own lang reaches its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, TERM_GAPS, U64, Scratch, Words, configure, text_blocks, tidy

BITS = 16
WIDTHS = (1, 2, 3)
PARTS = 5  # of the labelled rows; the last one calibrates
SHARD_TEXTS, SHARD_BYTES = 8192, 64 << 20  # of a shard that trains at once: texts, and bytes of their words' hashes
BATCH_WORDS = 100_000  # of a step's texts, if they are more than one
SLICE = 4096  # rows of a table that move together
LANGUAGES = 64  # thresholds of their own: the most frequent languages
HELD_WORDS = 1 << 20  # with evidence; of more, those in most toxic texts


def word_rows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two tables for word hashes."""
    return (h >> U64(64 - BITS)).astype(np.int64), (h & U64((1 << BITS) - 1)).astype(np.int64)


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in text_blocks(batch.column(2)):
            words = Words(data, at, lower=True, gaps=TERM_GAPS)
            raw = words.hash.astype("<u8").tobytes()
            out = pa.array([raw[8 * a : 8 * b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), out, *(batch.column(i).slice(lo, hi - lo) for i in (3, 4))], ["toxic", "lang", "words", "_order", "shard"])


def _hash_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that _hash_words makes of each text, without hashing."""
    for batch in batches:
        for lo, hi, data, at in text_blocks(batch.column(1)):
            first = Words(data, at, hashed=False, gaps=TERM_GAPS).first
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(8 * np.diff(first))], ["_id", "bytes"])


class Evidence:
    """Words and their evidence; only words whose evidence is at least ``least`` are held, the others count 0."""

    def __init__(self, texts: list[np.ndarray], y: np.ndarray, prior: float = 2.0, least: float = 0.5):
        self.words, self.value = np.zeros(0, U64), np.zeros(0, np.float32)
        if 0 < y.sum() < len(y):
            seen, place = np.unique(np.concatenate(texts), return_inverse=True)
            n, k = np.bincount(place), np.bincount(place, weights=np.repeat(y, [len(t) for t in texts]))
            share = y.mean()
            q = (k + prior * share) / (n + prior)
            value = np.log(q / (1 - q)) - np.log(share / (1 - share))
            held = value >= least
            self.words, self.value = seen[held], value[held].astype(np.float32)
        self._mark()

    @classmethod
    def known(cls, words: np.ndarray, values: list[np.ndarray]) -> list["Evidence"]:
        """One for each array of values, over the same sorted words."""
        out = [cls([], np.zeros(0)) for _ in values]
        out[0].words = words
        out[0]._mark()
        for x, value in zip(out, values):
            x.words, x.value, x.there = words, value, out[0].there
        return out

    def _mark(self) -> None:
        # a bit for each hash's low bits tells nearly all other words apart before the search
        self.there = np.zeros(1 << 20, bool)
        self.there[self.words & U64((1 << 20) - 1)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.float32)
        near = np.flatnonzero(self.there[h & U64((1 << 20) - 1)])
        if len(near) and len(self.words):
            place = np.minimum(np.searchsorted(self.words, h[near]), len(self.words) - 1)
            out[near] = np.where(self.words[place] == h[near], self.value[place], 0)
        return out


class Network:
    """Two embedding tables and a channel of evidence, filters of each width, a logistic layer; Adam steps on the rows that a batch touches."""

    def __init__(self, dim: int = 8, filters: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tables = [(rng.normal(0, 0.05, (1 << BITS, dim))).astype(np.float32) for _ in range(2)]
        self.filters = [rng.normal(0, 0.5, (w, dim + 1, filters)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, -1] = 0
            f[:, -1, 0] = 1  # the first filter of each width begins with the evidence
        self.bias = [np.zeros(filters, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * filters).astype(np.float32)
        self.out[::filters] = 0.5
        self.shift = np.float32(-2.0)
        self.moments: dict = {}
        self.moved = [np.zeros(1 << BITS, np.int32) for _ in range(2)]  # how often each row of a table was moved

    def pooled(self, one, two, evidence, first):
        """Each filter's maximum over each text, and where it was found. Texts shorter than a filter pool to 0."""
        x = np.concatenate([self.tables[0][one] + self.tables[1][two], evidence[:, None]], axis=1)
        pools, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            n = max(0, len(x) - w + 1)
            act = sum((x[j : j + n] @ f[j] for j in range(w)), np.zeros((n, f.shape[2]), np.float32)) + b
            pool, place = np.zeros((len(first) - 1, f.shape[2]), np.float32), np.full((len(first) - 1, f.shape[2]), -1)
            for i, (a, e) in enumerate(zip(first[:-1].tolist(), (first[1:] - w + 1).tolist())):
                if e > a:
                    top = act[a:e].argmax(axis=0)
                    pool[i], place[i] = act[a + top, np.arange(len(top))], a + top
            places.append(np.where(pool > 0, place, -1))
            pools.append(np.maximum(pool, 0))
        return x, np.concatenate(pools, axis=1), places

    def step(self, one, two, evidence, first, y, weight, rate, trust):
        """trust: how far each word's embedding may move; rare ones would only learn their few texts by heart."""
        x, pool, places = self.pooled(one, two, evidence, first)
        p = 1 / (1 + np.exp(-(pool @ self.out + self.shift)))
        g = ((p - y) * weight / weight.sum()).astype(np.float32)
        back = g[:, None] * self.out
        d_x = {}
        grads = [("out", None, pool.T @ g), ("shift", None, g.sum())]
        rows, parts = [], []
        at = 0
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            size = f.shape[2]
            gk, place = back[:, at : at + size], places[k]
            at += size
            doc, fil = np.nonzero(place >= 0)
            where, gv = place[doc, fil], gk[doc, fil]
            df, db = np.zeros_like(f), np.zeros(size, np.float32)
            np.add.at(db, fil, gv)
            for j in range(w):
                part = np.zeros((size, f.shape[1]), np.float32)
                np.add.at(part, fil, gv[:, None] * x[where + j])
                df[j] = part.T
                rows.append(where + j)
                parts.append(gv[:, None] * f[j, :-1].T[fil])
            grads += [("filters", k, df), ("bias", k, db)]
        rows, parts = np.concatenate(rows), np.concatenate(parts)
        parts *= trust[rows][:, None]
        for t, index in enumerate((one, two)):
            used, inverse = np.unique(index[rows], return_inverse=True)
            d = np.zeros((len(used), parts.shape[1]), np.float32)
            np.add.at(d, inverse, parts)
            self.moved[t][used] += 1
            self._adam(("tables", t), self.tables[t], d + 1e-5 * self.tables[t][used], rate, used)
        for name, k, d in grads:
            if name == "shift":
                self.shift = np.float32(self.shift - rate * d * 10)
            else:
                value = self.out if k is None else getattr(self, name)[k]
                self._adam((name, k), value, d, rate)

    def _adam(self, key, value, grad, rate, rows=None):
        m, v, t = self.moments.setdefault(key, (np.zeros_like(value), np.zeros_like(value), [0]))
        t[0] += 1
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-7)

    def copy(self) -> "Network":
        """The same values, with moments and counts begun anew."""
        out = Network.__new__(Network)
        out.tables, out.filters, out.bias = ([x.copy() for x in xs] for xs in (self.tables, self.filters, self.bias))
        out.out, out.shift, out.moments, out.moved = self.out.copy(), self.shift, {}, [np.zeros_like(m) for m in self.moved]
        return out

    def dense(self) -> np.ndarray:
        return np.concatenate([*(x.ravel() for x in (*self.filters, *self.bias)), self.out, [self.shift]]).astype(np.float32)

    def changes(self, start: "Network", shard: int, texts: int) -> pa.RecordBatch:
        """What training changed, as slices (of the first table, the second, all else), each change times its weight."""
        change, weight = [], []
        for mine, old, moved in zip(self.tables, start.tables, self.moved):
            for lo in range(0, len(mine), SLICE):
                n = moved[lo : lo + SLICE].astype(np.float32)
                change.append(((mine[lo : lo + SLICE] - old[lo : lo + SLICE]) * n[:, None]).astype("<f4").tobytes())
                weight.append(n.astype("<f4").tobytes())
        change.append(((self.dense() - start.dense()) * texts).astype("<f4").tobytes())
        weight.append(np.array([texts], "<f4").tobytes())
        k = len(change)
        return pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array([shard] * k, pa.int32()), pa.array([texts] * k, pa.int64()), pa.array(change, pa.binary()), pa.array(weight, pa.binary())],
            ["slice", "shard", "texts", "change", "weight"],
        )

    def apply(self, at: int, change: np.ndarray, weight: np.ndarray) -> None:
        """Adds the mean change of a slice."""
        each = (1 << BITS) // SLICE
        if at < 2 * each:
            table, lo = self.tables[at // each], at % each * SLICE
            table[lo : lo + SLICE] += (change.reshape(SLICE, -1) / np.maximum(weight, 1)[:, None]).astype(np.float32)
            return
        mean, lo = (change / weight[0]).astype(np.float32), 0
        for x in (*self.filters, *self.bias, self.out):
            x += mean[lo : lo + x.size].reshape(x.shape)
            lo += x.size
        self.shift = np.float32(self.shift + mean[lo])

    def folded(self) -> list:
        """For each width and place in the filter, both tables times the filter, and what it makes of evidence."""
        return [[[*(t @ f[j, :-1] for t in self.tables), f[j, -1]] for j in range(w)] for w, f in zip(WIDTHS, self.filters)]


def logits(network: Network, folded: list, one: np.ndarray, two: np.ndarray, evidence: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The logit of each text; first: the texts' first words, one more at the end."""
    total = np.full(len(first) - 1, network.shift, np.float64)
    at = 0
    strong = np.flatnonzero(evidence)
    for w, parts, bias in zip(WIDTHS, folded, network.bias):
        size = np.diff(first) - w + 1
        full = np.flatnonzero(size > 0)
        width = len(bias)
        if len(full):
            n = len(one) - w + 1
            act = parts[0][0][one[:n]] + parts[0][1][two[:n]]
            for j in range(1, w):
                act += parts[j][0][one[j : j + n]]
                act += parts[j][1][two[j : j + n]]
            for j in range(w):
                place = strong[(strong >= j) & (strong - j < n)]
                act[place - j] += evidence[place][:, None] * parts[j][2]
            # places whose filter would reach into the next text don't count
            for j in range(1, w):
                edge = first[1:-1] - j
                act[edge[(edge >= 0) & (edge < n)]] = -1e9
            top = np.maximum.reduceat(act, first[:-1][full], axis=0) + bias
            total[full] += np.maximum(top, 0) @ network.out[at : at + width]
        at += width
    return total


def guess_languages(table: np.ndarray, one: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The index of the likeliest language of each text by its words (0 for a text without words)."""
    scores = np.zeros((len(first) - 1, table.shape[1]))
    for j in range(table.shape[1]):
        ends = np.concatenate([[0.0], np.cumsum(table[:, j][one], dtype=np.float64)])
        scores[:, j] = ends[first[1:]] - ends[first[:-1]]
    return scores.argmax(axis=1)


def sample_ids(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, each: int, most_bytes: int = 16 << 20) -> list[tuple]:
    """(id, toxic) of at most ``each`` labelled documents of either label, those whose id hashes lowest.

    In that order a document is passed over if its texts would bring the label's sample over ``most_bytes``. Only ids and
    lengths are joined and shuffled. Counts of hash ranges (4,096 a label) tell where a label's sample ends, so that tasks
    don't send ``each`` rows apiece to the one that cuts it. An id that repeats counts once for each label, with all its texts.
    """
    ids = docs.filter(F.col(text).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.sum(F.octet_length(text)).alias("_bytes"))
    marks = labels.filter(F.col(toxic).isNotNull()).select(F.col(doc_id).alias("_id"), (F.col(toxic) > 0).cast("int").alias("toxic")).distinct()
    scratch = Scratch(docs.sparkSession)
    found = scratch.stash(ids.join(marks, "_id").withColumn("_order", F.xxhash64("_id")), "labelled")
    part = F.shiftright("_order", 52)
    counts = sorted((r["toxic"], r["part"], r["count"]) for r in found.groupBy("toxic", part.alias("part")).count().collect())
    picked = []
    for label in (1, 0):
        total, last = 0, -(1 << 12)
        for _, last, n in (x for x in counts if x[0] == label):
            total += n
            if total >= each:
                break
        size = 0
        for r in found.filter((F.col("toxic") == label) & (part <= last)).orderBy("_order", "_id").limit(each).collect():
            if size + r["_bytes"] <= most_bytes:
                size += r["_bytes"]
                picked.append((r["_id"], label))
    scratch.drop("labelled")
    return picked


class Labelled:
    """The rows of docs with a text and a label. What they come to is counted before anything is stored, so that they are stored once, in their shards."""

    def __init__(self, docs: DataFrame, labels: DataFrame, text: str, toxic: str, lang: str, doc_id: str):
        kind = docs.schema[doc_id].dataType  # hashes of another type would differ
        marks = labels.filter(F.col(toxic).isNotNull()).select(F.col(doc_id).cast(kind).alias("_id"), (F.col(toxic) > 0).cast("int").alias("toxic"))
        self.marks = marks.filter("_id is not null").distinct()
        self.small = self.marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        known = docs.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
        self.docs = known.filter("_id is not null and text is not null")

    def sizes(self) -> tuple[np.ndarray, int]:
        """Rows by part and label, and the bytes of all words' hashes. No text is shuffled."""
        kind = self.docs.schema["_id"].dataType.simpleString()
        found = self.docs.select("_id", "text").mapInArrow(tidy(_hash_bytes), f"_id {kind}, bytes long")
        found = found.join(F.broadcast(self.marks) if self.small else self.marks, "_id").groupBy(_part(F.xxhash64("_id")).alias("part"), "toxic")
        size, total = np.zeros((PARTS, 2), int), 0
        for r in found.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect():
            size[r["part"], r["toxic"]] = r["n"]
            total += r["bytes"]
        return size, total

    def words(self, shards: int) -> DataFrame:
        """(shard, toxic, lang, words, _order, part), a shard in one task, in order; words: the hashes of the whole text.

        Texts are shuffled once, and only labelled ones while their labels can be broadcast; beyond that the join goes by the shards' partitions.
        """
        docs, marks = (x.withColumn("_order", F.xxhash64("_id")) for x in (self.docs, self.marks))
        if self.small:
            known = docs.join(F.broadcast(self.marks), "_id").repartition(shards, "_order").withColumn("shard", F.spark_partition_id())
        else:
            # numbered before the join, or Spark would raise the number of partitions to its own; an equality of ids would shuffle again
            docs = docs.repartition(shards, "_order").withColumn("shard", F.spark_partition_id())
            known = docs.join(marks.withColumnRenamed("_id", "_key").repartition(shards, "_order"), "_order").filter("_id <= _key and _id >= _key")
        hashed = known.select("toxic", "lang", "text", "_order", "shard").mapInArrow(tidy(_hash_words), "toxic int, lang string, words binary, _order long, shard int")
        hashed = hashed.sortWithinPartitions("_order", "toxic", "words")
        return hashed.select("shard", "toxic", "lang", "words", "_order", _part(F.col("_order")).alias("part"))


def _part(order: Column) -> Column:
    return F.pmod(order, F.lit(PARTS)).cast("int")


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in column]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, part, n, k): texts, and toxic ones, of a part that have a word; summed in blocks of some million words."""
    kept: list[list[np.ndarray]] = [[] for _ in range(2 * PARTS)]
    size = 0

    def flush():
        for part in range(PARTS):
            clean, bad = (np.concatenate(kept[2 * part + y] or [np.zeros(0, "<u8")]) for y in (0, 1))
            seen, place = np.unique(np.concatenate([clean, bad]), return_inverse=True)
            if len(seen):
                n = np.bincount(place, minlength=len(seen))
                k = np.bincount(place[len(clean) :], minlength=len(seen))
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(np.full(len(seen), part, np.int32)), pa.array(n), pa.array(k)], ["word", "part", "n", "k"])
            kept[2 * part], kept[2 * part + 1] = [], []

    for batch in batches:
        for w, y, part in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept[2 * part + y].append(np.unique(w))
            size += len(kept[2 * part + y][-1])
            if size > 2_000_000:
                yield from flush()
                size = 0
    yield from flush()


def learn_evidence(rows: DataFrame, texts: np.ndarray, bad: np.ndarray, prior: float = 2.0, least: float = 0.5) -> list[Evidence]:
    """The evidence from all parts, and for each part the one its texts see: of the training parts without itself.

    texts, bad: the parts' texts, and toxic ones. Words whose evidence is below ``least`` count 0, as in Evidence.
    """
    counts = rows.select("words", "toxic", "part").mapInArrow(tidy(_count_words), "word long, part int, n long, k long")
    of = lambda c, j: F.sum(F.when(F.col("part") == j, F.col(c)).otherwise(0)).alias(f"{c}{j}")
    counts = counts.groupBy("word").agg(*(of(c, j) for c in "nk" for j in range(PARTS)))
    seen = [list(range(PARTS)), *([i for i in range(PARTS - 1) if i != j] for j in range(PARTS))]
    values = []
    for parts in seen:
        total, toxic = int(texts[parts].sum()), int(bad[parts].sum())
        if not 0 < toxic < total:
            values.append(F.lit(0.0))
            continue
        share = toxic / total
        n, k = (sum((F.col(f"{c}{i}") for i in parts), F.lit(0)) for c in "nk")
        q = (k + prior * share) / (n + prior)
        value = F.log(q / (1 - q)) - float(np.log(share / (1 - share)))
        values.append(F.when(value >= least, value).otherwise(0.0))
    held = counts.select("word", sum(F.col(f"k{j}") for j in range(PARTS)).alias("k"), *(v.cast("float").alias(f"v{i}") for i, v in enumerate(values)))
    held = held.filter(F.greatest(*(f"v{i}" for i in range(len(values)))) > 0).orderBy(F.desc("k"), "word").limit(HELD_WORDS)
    got = held.select("word", *(f"v{i}" for i in range(len(values)))).toArrow()  # HELD_WORDS at most
    words = got.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Evidence.known(words[order], [got.column(f"v{i}").to_numpy()[order] for i in range(len(values))])


def learn_languages(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The LANGUAGES most frequent languages, and the logarithm of each one's shares of the hashed words."""
    langs = sorted(r["lang"] for r in rows.filter("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()) or ["und"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << BITS), np.int64)
        place = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            for w, lang in zip(_texts(batch.column(0)), batch.column(1).to_pylist()):
                if lang in place:
                    np.add.at(total[place[lang]], word_rows(w)[0], 1)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["lang", "row", "n"])

    got = rows.select("words", "lang").mapInArrow(tidy(count), "lang int, row int, n long").groupBy("lang", "row").agg(F.sum("n").alias("n")).toArrow()
    guess = np.full((1 << BITS, len(langs)), 0.1)
    guess[got.column("row").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
    return langs, np.log(guess / guess.sum(axis=0)).astype(np.float32)


def _train(shared, steps: int, begun: int, total: int, few: float, balance: float, seed: int):
    """``steps`` batches of 64 on each shard of the task's rows (shard, toxic, words, part), of which ``begun`` out of ``total`` are done.

    For each shard its changes: slices of the tables' rows, each times how often it moved, and the filters and the logistic layer.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, evidence = shared.value
        for shard, y, words, part in _shards(batches):
            network = start.copy()
            rng = np.random.default_rng([seed, begun, shard])
            proof = [evidence[p + 1].of(w) for p, w in zip(part, words)]
            seen, texts = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
            order, at = rng.permutation(len(y)), 0
            for step in range(steps):
                index, size = [], 0
                if at >= len(order):
                    order, at = rng.permutation(len(y)), 0
                while at < len(order) and len(index) < 64 and (not index or size + len(words[order[at]]) <= BATCH_WORDS):
                    index.append(order[at])
                    size += len(words[order[at]])
                    at += 1
                h = np.concatenate([words[i] for i in index])
                number = texts[np.searchsorted(seen, h)]
                one, two = word_rows(h)
                first = np.concatenate([[0], np.cumsum([len(words[i]) for i in index])])
                weight = np.where(y[index] > 0, balance, 1.0).astype(np.float32)
                network.step(one, two, np.concatenate([proof[i] for i in index]), first, y[index], weight, 0.01 * (1 - (begun + step) / total) + 0.001, (number / (number + few)).astype(np.float32))
            yield network.changes(start, shard, len(y))

    return train


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The runs of rows of one shard: its number, labels, words, parts."""
    shard, y, words, part = None, [], [], []
    for batch in batches:
        for s, t, w, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if s != shard and y:
                yield shard, np.array(y, np.float32), words, part
                y, words, part = [], [], []
            shard = s
            y.append(t)
            words.append(np.frombuffer(w, "<u8"))
            part.append(p)
    if y:
        yield shard, np.array(y, np.float32), words, part


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """The sums of the shards' changes and weights, in the shards' order."""
    group = group.sort_values(["shard", "texts"])
    change, weight = (sum(np.frombuffer(x, "<f4").astype(np.float64) for x in group[c]) for c in ("change", "weight"))
    return pd.DataFrame({"slice": group["slice"][:1], "change": [change.tobytes()], "weight": [weight.tobytes()]})


def train_network(rows: DataFrame, shards: int, evidence: list[Evidence], balance: float, steps: int, rounds: int, few: float, seed: int) -> Network:
    """rows (shard, toxic, words, part): the network after ``rounds`` rounds (one, if there is a single shard) of ``steps`` batches a shard in all."""
    network, rounds = Network(seed=seed), rounds if shards > 1 else 1
    each = -(-steps // rounds)
    for turn in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((network, evidence))
        run = tidy(_train(shared, each, turn * each, rounds * each, few, balance, seed))
        moved = rows.select("shard", "toxic", "words", "part").mapInArrow(run, "slice int, shard int, texts long, change binary, weight binary")
        network = network.copy()
        for r in moved.groupBy("slice").applyInPandas(_merge, "slice int, change binary, weight binary").collect():  # the network's size, twice
            network.apply(r["slice"], np.frombuffer(r["change"], "<f8"), np.frombuffer(r["weight"], "<f8"))
        shared.destroy()
    return network


def _margins(shared):
    """(place of the guessed language, toxic, z: the logit in hundredths) of rows (toxic, words, part)."""

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, evidence, guess = shared.value
        folded = network.folded()
        for batch in batches:
            words = _texts(batch.column(1))
            lo = 0
            while lo < len(words):
                hi, size = lo + 1, len(words[lo])
                while hi < len(words) and size + len(words[hi]) <= BATCH_WORDS:
                    size += len(words[hi])
                    hi += 1
                h, first = np.concatenate(words[lo:hi]), np.concatenate([[0], np.cumsum([len(w) for w in words[lo:hi]])])
                proof = np.concatenate([evidence[p + 1].of(w) for p, w in zip(batch.column(2).slice(lo, hi - lo).to_pylist(), words[lo:hi])])
                one, two = word_rows(h)
                z = np.clip(logits(network, folded, one, two, proof, first), -300, 300)
                yield pa.RecordBatch.from_arrays([pa.array(guess_languages(guess, one, first).astype(np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(np.round(100 * z).astype(np.int32))], ["place", "toxic", "z"])
                lo = hi

    return margins


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", lang: str = "lang", doc_id: str = "doc_id", steps: int = 750, rounds: int = 3, few: float = 10.0, shrink: float = 20.0, seed: int = 5) -> dict:
    """Trains on every labelled row outside the calibrating part, and calibrates the thresholds on all rows of that part.

    Rows with a null label or text are no examples. Without examples of both labels every score is the share of toxic ones. A single
    shard trains in ``steps`` batches of 64; several in 410 at least (four times through a shard), in ``rounds`` rounds. A word in n texts of
    a shard moves its embedding by n / (n + few) of a step; a language's own threshold, against the common one, counts
    c / (c + shrink), where c texts of its rarer label calibrate it.
    """
    spark = docs.sparkSession
    configure(spark)
    scratch = Scratch(spark)
    labelled = Labelled(docs, labels, text, toxic, lang, doc_id)
    size, held = labelled.sizes()
    learn = size[:-1].sum(axis=0)
    few_rows = not learn.all()  # so few examples that a part decides: all train, and all calibrate
    if few_rows:
        learn = size.sum(axis=0)
    shards = max(1, -(-int(learn.sum()) // SHARD_TEXTS), -(-held // SHARD_BYTES))
    rows = scratch.stash(labelled.words(shards), "labelled", compression="zstd")
    langs, guess = learn_languages(rows)
    model = {"langs": langs, "guess": guess, "network": None, "evidence": None, "thresholds": np.zeros(len(langs)), "prior": float(size[:, 1].sum() / max(1, size.sum()))}
    if few_rows:
        rows = rows.withColumn("part", F.lit(0))
        size = np.vstack([learn, np.zeros((PARTS - 1, 2), int)])
    if not learn.all():
        scratch.drop("labelled")
        return model
    evidence = learn_evidence(rows, size.sum(axis=1), size[:, 1])
    train = rows.filter(F.col("part") < PARTS - 1)
    balance = float(np.sqrt(max(1.0, learn[0] / learn[1])))
    network = train_network(train, shards, evidence, balance, steps if shards == 1 else max(410, steps // shards), rounds, few, seed)
    network.moments = {}
    model["network"], model["evidence"] = network, evidence[0]
    # the training texts calibrate only if the held ones lack a label
    held = rows.filter(F.col("part") == PARTS - 1) if size[-1].all() else rows.filter(F.col("part") < PARTS - 1)
    shared = spark.sparkContext.broadcast((network, evidence, guess))
    margins = held.select("toxic", "words", "part").mapInArrow(tidy(_margins(shared)), "place int, toxic int, z int").groupBy("place", "toxic", "z").count().toArrow()
    shared.destroy()
    place, y, z, n = (margins.column(c).to_numpy() for c in ("place", "toxic", "z", "count"))
    model["common"] = best_threshold(z / 100, y, n)
    model["thresholds"][:] = model["common"]
    for j in range(len(langs)):
        mine = place == j
        both = min(n[mine & (y == 1)].sum(), n[mine & (y == 0)].sum())
        if both:  # a language's own threshold counts by how many texts of its rarer label speak for it
            model["thresholds"][j] += both / (both + shrink) * (best_threshold(z[mine] / 100, y[mine], n[mine]) - model["common"])
    scratch.drop("labelled")
    return model


def best_threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The logit with the least cost, where a share of clean rows called toxic costs three times a share of toxic ones missed.

    Of equal ones, the middle of the widest range. n: how many rows each stands for.
    """
    order = np.argsort(z, kind="stable")
    z, y, n = z[order], y[order], np.ones(len(z)) if n is None else n[order]
    # rows below the cut are called clean
    bad, good = y * n, (1 - y) * n
    missed = np.concatenate([[0], np.cumsum(bad)]) / max(1, bad.sum())
    wrong = (good.sum() - np.concatenate([[0], np.cumsum(good)])) / max(1, good.sum())
    cost = missed + 3 * wrong
    ends = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = ends[1:] - ends[:-1]
    cost[gap <= 0] = np.inf
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    i = best[gap[best].argmax()]
    return float((ends[i] + ends[i + 1]) / 2)


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        network = model["network"]
        folded = network.folded() if network else None
        for batch in batches:
            for lo, hi, data, at in text_blocks(batch.column(2)):
                if network:
                    words = Words(data, at, lower=True, gaps=TERM_GAPS)
                    one, two = word_rows(words.hash)
                    z = logits(network, folded, one, two, model["evidence"].of(words.hash), words.first)
                    z = z - model["thresholds"][guess_languages(model["guess"], one, words.first)]
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                else:
                    p = np.full(hi - lo, model["prior"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def score_toxicity(docs: DataFrame, model: dict, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) for each row of docs.

    A null or empty text has the score of a text without words. Null or repeated doc_ids are rows like any other; an empty
    table gives an empty result. A text of any length is scored whole; other columns are not read.
    """
    spark = docs.sparkSession
    configure(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # a few MB, set by BITS and the network's sizes
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(_score(shared)), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _keep(shared, column: str):
    score = _score(shared)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(column))
            none = pa.nulls(len(text), pa.bool_())
            clean = [pa.compute.equal(x.column(3), 0) for x in score(iter([pa.RecordBatch.from_arrays([none, none, text], ["doc_id", "held_out", "text"])]))]
            yield batch.filter(pa.chunked_array(clean).combine_chunks())

    return keep


def learn_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", lang: str = "lang", **fit) -> dict:
    return fit_toxicity(docs.filter(~held_out), labels, text, toxic, lang, doc_id, **fit)


def outside_fold(docs: DataFrame, folds: int, fold: int, doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, doc_id: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """Learns from the labelled rows outside the held-out fold (crc32 of doc_id as text, modulo folds); scores all rows."""
    held_out = outside_fold(docs, folds, fold, doc_id)
    return score_toxicity(docs, learn_toxicity(docs, labels, held_out, doc_id, text, **fit), held_out, doc_id, text)


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, doc_id: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """docs without the documents that are predicted toxic; columns as they are, whatever their names.

    Rows are judged one by one by their texts: null, empty and repeated ones too. An empty table stays empty.
    """
    model = learn_toxicity(docs, labels, outside_fold(docs, folds, fold, doc_id), doc_id, text, **fit)
    return docs.mapInArrow(tidy(_keep(docs.sparkSession.sparkContext.broadcast(model), text)), docs.schema)
