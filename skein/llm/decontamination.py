"""Benchmark decontamination by latent semantic retrieval.

Terms (lower-case runs of letters and digits) are hashed; passages are runs of terms. The inverse document frequencies
count all passages of all documents. A randomised SVD of TF-IDF passages gives the latent space: those of the benchmark, and
those of all documents, whose rows together weigh CORPUS_SHARE of the benchmark's, so that the corpus' co-occurrences shape the
space and don't crowd the benchmark out. One scan sums the documents' co-occurrences by pairs of the benchmark's features, if these
are MOMENTS at most; else each turn of the SVD scans the documents. Sketches are summed per feature over
the tasks, with power iterations; the singular values and vectors are those of the last sketch. Only features that the
benchmark has get coordinates, since others cannot bring a text nearer to it.

Every window of every document is compared with all benchmark passages, in blocks of ``block`` passages, by cosine in
that space. A near pair is checked on its terms: longest common subsequence, and the answers, which are the passage's
rarest terms. The check covers the item around the passage too: each run of PASSAGE terms, wherever it starts, and runs
of RUN equal terms, so that a quotation across the cuts counts in full. A document is contaminated by an item if enough
of the item's passages, or of its terms, are found in it. Items of fewer than SHORT terms are found by their whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TERM_GAPS, U64, Scratch, Words, configure, keyed, mix, ragged, text_blocks, tidy

BITS = 18  # features
SLICE = 4096  # features whose counts move together
WINDOW, STRIDE = 32, 16  # terms of a document window
PASSAGE = 24  # terms of a benchmark passage at most
STEP = 4  # between the runs of PASSAGE terms that are checked around a near passage
RUN = 5  # equal terms in a row that count as found by themselves
SEARCH_BYTES = 1 << 17  # of text whose terms get their latent coordinates at once
SHORT = 8  # items of fewer terms are looked up whole
CORPUS_SHARE = 0.1  # of the benchmark's weight in the latent space
MOMENTS = 4096  # features whose co-occurrences a task sums as a matrix
PACK, PACK_ROWS = 64, 16  # features whose rows of a sketch, and of the co-occurrences, move together
CHECKED = 1 << 14  # near pairs whose terms are counted at once
SEEN_BYTES = 4 << 20  # of marks for the features of windows
LEAST_BYTES, MOMENT_BYTES = 32 << 20, 256 << 20  # of text for each such task: at least, and if there are more tasks than cores


def features(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int64)


def cut_passages(n: int, size: int = PASSAGE) -> list[tuple[int, int]]:
    """Cuts n terms evenly into runs of at most size."""
    parts = -(-n // size)
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many runs of WINDOW terms each feature occurs in, packed in slices, and the runs."""
    total, runs = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for _, _, data, at in text_blocks(batch.column(0)):
            words = Words(data, at, lower=True, gaps=TERM_GAPS)
            count = np.diff(words.first)
            many = -(-count // WINDOW)
            run = np.repeat(np.cumsum(many) - many, count) + (np.arange(len(words.hash)) - np.repeat(words.first[:-1], count)) // WINDOW
            keyed = np.sort(run << BITS | features(words.hash))
            if len(keyed):
                keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
            total += np.bincount(keyed & (1 << BITS) - 1, minlength=1 << BITS)
            runs += int(many.sum())
    cut = [total[i : i + SLICE].astype("<i8").tobytes() for i in range(0, len(total), SLICE)]
    n = len(cut)
    yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(cut, pa.binary()), pa.array([runs] + [0] * (n - 1))], ["slice", "counts", "runs"])


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<i8") for x in group["counts"])
    return pd.DataFrame({"slice": group["slice"][:1], "counts": [np.asarray(total, "<i8").tobytes()], "runs": [group["runs"].sum()]})


def _cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in text_blocks(batch.column(1)):
            words = Words(data, at, lower=True, gaps=TERM_GAPS)
            row, nth, of, terms, left, around, n = [], [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                cuts = cut_passages(b - a) if b > a else []
                for j, (x, y) in enumerate(cuts):
                    row.append(lo + i)
                    nth.append(j)
                    of.append(len(cuts))
                    terms.append(words.hash[a + x : a + y].astype("<u8").tobytes())
                    left.append(max(0, x - PASSAGE))
                    around.append(words.hash[a + left[-1] : min(b, a + y + PASSAGE)].astype("<u8").tobytes())
                    n.append(b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(nth, pa.int32()), pa.array(of, pa.int32()), pa.array(terms, pa.binary()),
                 pa.array(left, pa.int32()), pa.array(around, pa.binary()), pa.array(n, pa.int32())],
                ["item_id", "passage", "passages", "terms", "left", "around", "n"],
            )


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, at in text_blocks(batch.column(0)):
            words = Words(data, at, lower=True, gaps=TERM_GAPS)
            terms = [words.hash[a + x : a + y].astype("<u8").tobytes() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()) if b > a for x, y in cut_passages(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary())], ["terms"])


def _co_occurrences(shared):
    """The sum of a a' over the texts' passages a (TF-IDF, unit length), for the benchmark's features: rows of T, where T + T' is that sum.

    The rows are packed; see packs. The pack -1 holds the number of passages.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, place = shared.value
        n, passages = len(weights), 0
        total = np.zeros(n * n, np.float32)
        for batch in batches:
            for _, _, data, ends in text_blocks(batch.column(0)):
                words = Words(data, ends, lower=True, gaps=TERM_GAPS)
                count = np.diff(words.first)
                many = -(-count // PASSAGE)
                nth = np.arange(len(words.hash)) - np.repeat(words.first[:-1], count)
                # the cuts of cut_passages: part i of p begins at n * i // p
                parts, size = np.repeat(many, count), np.repeat(count, count)
                row = np.repeat(np.cumsum(many) - many, count) + ((nth + 1) * parts - 1) // np.maximum(size, 1)
                at = place[features(words.hash)]
                known = np.flatnonzero(at >= 0)
                at, row = at[known], row[known]
                passages += int(many.sum())
                if not len(at):
                    continue
                w = weights[at]
                w = (w / np.sqrt(np.bincount(row, w * w))[row]).astype(np.float32)
                np.add.at(total, at * n + at, w * w / 2)
                for gap in range(1, PASSAGE):
                    pair = np.flatnonzero(row[gap:] == row[:-gap])
                    if not len(pair):
                        break
                    np.add.at(total, at[pair] * n + at[pair + gap], w[pair] * w[pair + gap])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([np.array([passages], "<f8").tobytes()], pa.binary())], ["pack", "at", "part"])
        yield from packs(total.reshape(n, n), PACK_ROWS, "<f4")

    return scan


def packs(total: np.ndarray, each: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The rows of total that aren't 0, in packs of the rows below each, 2 each, ...: (pack, the rows' places, the rows)."""
    used = np.flatnonzero(total.any(axis=1))
    cuts = np.flatnonzero(np.diff(used // each)) + 1
    for rows in np.split(used, cuts) if len(used) else ():
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[0] // each], pa.int32()), pa.array([rows.astype("<i4").tobytes()], pa.binary()), pa.array([total[rows].astype(kind).tobytes()], pa.binary())], ["pack", "at", "part"]
        )


def unpack(at: bytes, part: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(at, "<i4")
    return at, np.frombuffer(part, kind).reshape(len(at), -1).astype(np.float64)


PACKED = "pack int, at binary, part binary"


def _add_packs(each: int, kind: str):
    """The sum of a pack's rows over the tasks. That of the pack -1 is a number of passages."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        pack = int(group["pack"].iloc[0])
        if pack < 0:
            at, total = b"", sum(np.frombuffer(x, "<f8") for x in group["part"]).astype("<f8").tobytes()
        else:
            total, there = None, np.zeros(each, bool)
            for one, part in zip(group["at"], group["part"]):
                one, part = unpack(one, part, kind)
                total = np.zeros((each, part.shape[1])) if total is None else total
                total[one - pack * each] += part
                there[one - pack * each] = True
            at, total = (np.flatnonzero(there) + pack * each).astype("<i4").tobytes(), total[there].astype(kind).tobytes()
        return pd.DataFrame({"pack": [pack], "at": [at], "part": [total]})

    return add


def _times(shared, rank: int):
    """(T + T') times the basis, times the shared weight, of packed rows of T; see _co_occurrences."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, basis = shared.value
        total = np.zeros((len(basis), rank))
        for batch in batches:
            for at, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, rows = unpack(at, part, "<f4")
                total[at] += rows @ basis
                total += rows.T @ basis[at]
        yield from packs(total * weight, PACK, "<f8")

    return times


def _sketch(shared, rank: int):
    """One half step of the randomised SVD: the sum over passages a of weight * a (a . basis), for the basis' features."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, place, basis = shared.value
        total = np.zeros((len(basis), rank))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = [place[features(np.frombuffer(x, "<u8"))] for x in part.column(0).to_pylist()]
                size = np.array([len(x) for x in lists])
                at, row = np.concatenate(lists), np.repeat(np.arange(len(size)), size)
                at, row = at[at >= 0], row[at >= 0]
                if not len(at):
                    continue
                w = weights[at]
                w = w / np.sqrt(np.bincount(row, w * w, len(size)))[row]
                heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                projected = np.zeros((len(size), rank))
                projected[row[heads]] = np.add.reduceat(w[:, None] * basis[at], heads, axis=0)
                projected *= part.column(1).to_numpy(zero_copy_only=False)[:, None]
                order = np.argsort(at, kind="stable")
                at, row, w = at[order], row[order], w[order]
                heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                total[at[heads]] += np.add.reduceat(w[:, None] * projected[row], heads, axis=0)
        yield from packs(total, PACK, "<f8")

    return sketch


def latent_space(passages: DataFrame, weights: np.ndarray, place: np.ndarray, rank: int, power: int = 2, seed: int = 3, moments: tuple[DataFrame, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The passages' (terms, weight) leading singular values and right singular vectors (features x rank), by randomised SVD.

    moments: the co-occurrences (packed rows) of further passages and the weight of each of these.
    """
    context = passages.sparkSession.sparkContext
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(weights), rank)))
    for turn in range(power + 1):
        shared = context.broadcast((weights, place, basis))  # features x rank, 2^BITS x rank at most
        parts = passages.select("terms", "weight").mapInArrow(_sketch(shared, rank), PACKED)
        if moments is not None:
            further = context.broadcast((moments[1], basis))
            parts = parts.union(moments[0].mapInArrow(_times(further, rank), PACKED))
        total = np.zeros_like(basis)
        for r in parts.groupBy("pack").applyInPandas(_add_packs(PACK, "<f8"), PACKED).collect():
            at, rows = unpack(r["at"], r["part"], "<f8")
            total[at] = rows
        shared.destroy()
        if moments is not None:
            further.destroy()
        if turn < power:
            basis, _ = np.linalg.qr(total + 1e-9 * basis)
    # total = A'A Q: the eigenvectors of Q'A'A Q turn Q into the singular vectors
    small = basis.T @ total
    values, turns = np.linalg.eigh((small + small.T) / 2)
    return np.sqrt(np.maximum(values[::-1], 0)), basis @ turns[:, ::-1]


def _short_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in text_blocks(batch.column(1)):
            words = Words(data, at, lower=True, gaps=TERM_GAPS)
            count = np.diff(words.first)
            few = np.flatnonzero((count > 0) & (count < SHORT))
            names = [sequence_name(words.hash[words.first[i] : words.first[i + 1]]) for i in few]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + few)), pa.array(count[few].astype(np.int32)), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64())], ["item_id", "n", "one", "two"])


def sequence_name(h: np.ndarray, start: np.ndarray | None = None, length: int | None = None) -> list[tuple] | tuple:
    """128 bits of the terms h, or of each h[s : s + length]."""
    alone = start is None
    start, length = (np.zeros(1, np.int64), len(h)) if alone else (start, length)
    out = []
    with np.errstate(over="ignore"):
        for salt in (U64(length), U64(length) ^ U64(0x5851F42D4C957F2D)):
            x = np.full(len(start), mix(salt), U64)
            for j in range(length):
                x = mix(x * U64(0x9E3779B97F4A7C15) + (h[start + j] ^ salt))
            out.append(x.view(np.int64))
    return (int(out[0][0]), int(out[1][0])) if alone else out


def _find_short(lengths: list[int], shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text_hash, n, one, two) of the sequences of a text that some short item may have."""
        ones = shared.value
        for batch in batches:
            for lo, hi, data, at in text_blocks(batch.column(1)):
                words = Words(data, at, lower=True, gaps=TERM_GAPS)
                row = words.row()
                for n in lengths:
                    start = np.flatnonzero(np.arange(len(row)) + n <= words.first[1:][row]) if len(row) else np.zeros(0, np.int64)
                    one, two = sequence_name(words.hash, start, n)
                    hit = np.flatnonzero(np.isin(one, ones)) if ones is not None else np.arange(len(one))
                    keys = np.unique(np.stack([row[start[hit]], one[hit], two[hit]], axis=1), axis=0) if len(hit) else np.zeros((0, 3), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(pa.array(lo + keys[:, 0])) for i in (0, 2)), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys[:, 1]), pa.array(keys[:, 2])], ["doc_id", "text_hash", "n", "one", "two"]
                    )

    return find


def common_subsequence(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    where: dict[int, int] = {}
    for i, v in enumerate(x):
        where[v] = where.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for v in y:
        hit = row & where.get(v, 0)
        row = (row + hit | row - hit) & full
    return len(x) - row.bit_count()


def aligned(x: list[int], y: list[int]) -> int:
    """The terms of x (as bits) in one longest common subsequence."""
    where: dict[int, int] = {}
    for i, v in enumerate(x):
        where[v] = where.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    rows = [full]
    for v in y:
        hit = rows[-1] & where.get(v, 0)
        rows.append((rows[-1] + hit | rows[-1] - hit) & full)
    i, j, out = len(x), len(y), 0
    while i and j:
        if rows[j] >> i - 1 & 1:
            i -= 1
            continue
        j -= 1
        if rows[j] >> i - 1 & 1:
            i -= 1
            out |= 1 << i
    return out


def runs_of(terms: list[int]) -> Iterator[tuple]:
    return zip(*(terms[j:] for j in range(RUN)))


def found_terms(around: list[int], rare: set[int], region: list[int], distinct: set[int], there: set[tuple] | None, lcs: float, answers: float) -> int:
    """The terms of around (as bits) that the region has: in RUN equal terms in a row, or in a run of PASSAGE terms that passes the checks."""
    out = 0
    for i, run in enumerate(runs_of(around) if there else ()):
        if run in there:
            out |= (1 << RUN) - 1 << i
    present = sum(1 << i for i, x in enumerate(around) if x in distinct)
    size = min(PASSAGE, len(around))
    starts = [*range(0, len(around) - size, STEP), len(around) - size]
    for i in starts:
        here = (1 << size) - 1 << i
        if (present & here).bit_count() < lcs * size or not here & present & ~out:
            continue  # a longer common subsequence can't be, or nothing is added
        part = around[i : i + size]
        matched, wanted = aligned(part, region), rare.intersection(part)
        if matched.bit_count() >= lcs * size and len(wanted & distinct) >= answers * len(wanted):
            out |= matched << i
    return out


def cell_sums(space: np.ndarray, row: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """The sum of space[row] over each of n cells of STRIDE terms at most; cell is in order. Full cells go first, as in Words._hash."""
    size = np.bincount(cell, minlength=n)
    order = np.argsort(-size, kind="stable")
    start, total = (np.cumsum(size) - size)[order], np.zeros((n, space.shape[1]), space.dtype)
    for j, many in enumerate(np.searchsorted(-size[order], -np.arange(1, STRIDE + 1), "right").tolist()):
        if not many:
            break
        total[:many] += space[row[start[:many] + j]]
    out = np.empty_like(total)
    out[order] = total
    return out


def run_names(h: np.ndarray) -> np.ndarray:
    """64 bits of each run of RUN terms of h."""
    out = np.zeros(max(0, len(h) - RUN + 1), U64)
    with np.errstate(over="ignore"):
        for j in range(RUN):
            out = out * U64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return out


class TermCheck:
    """Which near pairs of window and passage can pass the checks on their terms, before each is checked by itself.

    Such a pair has RUN equal terms in a row, or enough of the terms around the passage stand in the window's region. Terms count
    by their features and runs by their names for all passages together, so a pair may be kept in vain, and none is lost.
    """

    def __init__(self, around: list[list[int]], dense: list[float], place: np.ndarray, features_: int):
        hashes = [np.array(t, U64) for t in around]
        self.place, self.dense = place, np.array(dense)
        # the terms around a passage are all of its item, so their features are the benchmark's; the last column is never marked
        self.around = np.full((len(hashes), max(map(len, hashes))), features_, np.int64)
        for i, t in enumerate(hashes):
            self.around[i, : len(t)] = place[features(t)]
        self.runs = np.unique(np.concatenate([run_names(t) for t in hashes]))
        self.first = np.zeros(1 << 20, bool)
        self.first[self.runs >> U64(44)] = True
        self.seen = np.zeros((max(1, SEEN_BYTES // (features_ + 1)), features_ + 1), np.uint8)

    def of(self, h: np.ndarray) -> np.ndarray:
        """How many of the runs that begin before each term of h, and at its end, some passage has."""
        names = run_names(h)
        maybe = np.flatnonzero(self.first[names >> U64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.runs, names[maybe]), len(self.runs) - 1)
            maybe = maybe[self.runs[at] == names[maybe]]
        hit = np.zeros(len(h) + 1, np.int64)
        hit[maybe + 1] = 1
        return np.cumsum(hit)

    def keep(self, row: np.ndarray, runs: np.ndarray, a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of the pairs (terms a to b of the text, passage q), in the order of a: those that can pass. row: the terms' places; runs: see of."""
        keep = runs[np.maximum(a, b - RUN + 1)] > runs[a]
        apart = np.flatnonzero(~keep)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(a[apart]) != 0])) if len(apart) else apart
        window = np.zeros(len(apart), np.int64)
        window[heads] = 1
        window = np.cumsum(window) - 1
        for lo in range(0, len(heads), len(self.seen)):
            some = apart[heads[lo : lo + len(self.seen)]]
            size = b[some] - a[some]
            owner, feature = np.repeat(np.arange(len(some)), size), row[ragged(a[some], size)]
            owner, feature = owner[feature >= 0], feature[feature >= 0]
            self.seen[owner, feature] = 1
            x, y = heads[lo], heads[lo + len(some)] if lo + len(some) < len(heads) else len(apart)
            for i in range(x, y, CHECKED):
                pair = apart[i : min(i + CHECKED, y)]
                there = self.seen[(window[i : i + len(pair)] - lo)[:, None], self.around[q[pair]]].sum(axis=1, dtype=np.int64)
                keep[pair] = there >= self.dense[q[pair]]
            self.seen[owner, feature] = 0
        return keep


def _search(shared, similarity: float, lcs: float, answers: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, place, block = shared.value  # float32 weights x basis; feature -> row or -1; the block's passages
        queries, terms, rare, idf = block["vectors"], block["terms"], block["rare"], block["idf"]
        sets, around = [set(t) for t in terms], block["around"]
        runs, dense = [set(runs_of(t)) for t in around], [lcs * min(PASSAGE, len(t)) for t in around]
        check, square = TermCheck(around, dense, place, len(space)), idf**2
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, at in text_blocks(batch.column(1), SEARCH_BYTES):
                words = Words(data, at, lower=True, gaps=TERM_GAPS)
                if not len(words.hash):
                    continue
                count = np.diff(words.first)
                many = -(-count // STRIDE)  # cells of STRIDE terms; a window is a cell and the next
                base = np.cumsum(many) - many
                cell = np.repeat(base, count) + (np.arange(len(words.hash)) - np.repeat(words.first[:-1], count)) // STRIDE
                feature = features(words.hash)
                row = place[feature]
                known = np.flatnonzero(row >= 0)
                if not len(known):
                    continue
                window = cell_sums(space, row[known], cell[known], int(many.sum()))
                inner = np.ones(len(window), bool)
                inner[(base + many - 1)[many > 0]] = False  # the last cell of a text stands alone
                inner = np.flatnonzero(inner)
                window[inner] += window[inner + 1]  # the right side is a copy
                energy = np.append(np.bincount(cell, square[feature], int(many.sum())), 0)  # of all terms, the benchmark's or not
                after = energy[1:].copy()
                after[(base + many - 1)[many > 0]] = 0
                size = np.sqrt(energy[:-1] + after + 1e-9).astype(np.float32)
                # a window whose latent part is too small is near no passage (Cauchy-Schwarz)
                live = np.flatnonzero(np.einsum("ij,ij->i", window, window) > (similarity * block["least"] * size) ** 2)
                owner = np.repeat(np.arange(hi - lo), many)
                begin = words.first[owner] + (np.arange(len(owner)) - base[owner]) * STRIDE
                begin, end = np.maximum(words.first[owner], begin - STRIDE // 2), np.minimum(words.first[owner + 1], begin + WINDOW + STRIDE // 2)
                shared_runs = check.of(words.hash)
                found: dict[tuple[int, int], tuple[float, int, int, int, bool]] = {}
                for i in range(0, len(live), 8192):
                    part = live[i : i + 8192]
                    near = (window[part] / size[part, None]) @ queries.T
                    w, q = np.divmod(np.flatnonzero(near >= similarity), near.shape[1])
                    able = np.flatnonzero(check.keep(row, shared_runs, begin[part[w]], end[part[w]], q))
                    last = -1
                    for w, q in zip(w[able].tolist(), q[able].tolist()):
                        if w != last:  # pairs come window by window
                            last, doc = w, int(owner[part[w]])
                            region = words.hash[begin[part[w]] : end[part[w]]].tolist()
                            distinct, there = set(region), set(runs_of(region))
                        apart = there.isdisjoint(runs[q])
                        if apart and sum(map(distinct.__contains__, around[q])) < dense[q]:
                            continue  # neither RUN equal terms nor a long common subsequence can be
                        bits = found_terms(around[q], block["rarest"][q], region, distinct, None if apart else there, lcs, answers)
                        got = common_subsequence(terms[q], region) if bits or len(sets[q] & distinct) >= lcs * len(sets[q]) else 0
                        here = len(rare[q] & distinct)
                        whole = got >= lcs * len(terms[q]) and here >= answers * len(rare[q])
                        if bits or whole:
                            old = found.get((doc, q), (0.0, 0, 0, 0, False))
                            best = max(old[:3], (float(near[w, q]), got, here), key=lambda x: x[1:])
                            found[doc, q] = (*best, old[3] | bits, old[4] or whole)
                if found:
                    q = [k[1] for k in found]
                    cells = [[block["left"][i] + j for j in range(len(around[i])) if v[3] >> j & 1] for v, i in zip(found.values(), q)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([lo + k[0] for k in found])), batch.column(2).take(pa.array([lo + k[0] for k in found])), pa.array([block["item"][i] for i in q], pa.int64()), pa.array([block["nth"][i] for i in q], pa.int32()), pa.array([block["of"][i] for i in q], pa.int32()),
                         pa.array([v[0] for v in found.values()]), pa.array([v[1] / len(terms[i]) for v, i in zip(found.values(), q)]), pa.array([v[2] / max(1, len(rare[i])) for v, i in zip(found.values(), q)]),
                         pa.array([v[4] for v in found.values()], pa.bool_()), pa.array([block["n"][i] for i in q], pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                        ["doc_id", "text_hash", "item_id", "passage", "passages", "cosine", "lcs", "answers", "whole", "n", "cells"],
                    )

    return search


def _rarest(terms: np.ndarray, idf: np.ndarray) -> set[int]:
    if not len(terms):
        return set()
    distinct = np.unique(terms)
    return set(distinct[np.argsort(-idf[features(distinct)], kind="stable")][: max(1, len(distinct) // 3)].tolist())


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The pairs of contaminated_texts without text_hash: a row for each item and each distinct text of a doc_id."""
    return contaminated_texts(docs, benchmark, **options).drop("text_hash")


PAIR = "text_hash long, item_id long, passages int, found long, cosine double, lcs double, answers double, covered double"


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, rank: int = 160, similarity: float = 0.3, lcs: float = 0.7, answers: float = 0.5, share: float = 0.5,
    block: int = 4096, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, text_hash, item_id, passages (of the item), found (in the document), cosine, lcs, answers (the best), covered: contaminated pairs only.

    covered is the share of the item's terms that are found in the document. A pair is contaminated if the share of
    passages found or of terms found is at least ``share``; an item of fewer than SHORT terms, if they stand in a row.
    Null texts have no terms, and items without terms are in no document. Rows with a null or repeated doc_id are told
    apart by their texts. Empty tables give an empty result. Texts of any length are searched whole; other columns are not
    read. The frequencies, the latent space and the search cover everything.
    """
    spark = docs.sparkSession
    configure(spark)
    scratch = Scratch(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, item_id long, passage int, passages int, cosine double, lcs double, answers double, whole boolean, n int, cells array<int>"
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null")
    passages = items.mapInArrow(_cut_items, "item_id long, passage int, passages int, terms binary, left int, around binary, n int").filter(f"n >= {SHORT}")
    passages = scratch.stash(passages, "passages")
    total = passages.count()
    short = _contaminated_by_short(texts, items, scratch, kind)
    if not total:
        return short
    packed = "slice int, counts binary, runs long"
    slices = texts.select("text").mapInArrow(tidy(_frequencies), packed).groupBy("slice").applyInPandas(_sum, packed).collect()  # 2^BITS numbers
    runs = max(1, sum(r["runs"] for r in slices))
    frequency = np.zeros(1 << BITS, np.int64)
    for r in slices:
        frequency[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<i8")
    del slices
    # never 0: a leak that many documents copy makes its terms as frequent as stop words
    idf = np.log((runs + 1) / np.minimum(frequency + 1, max(1.0, 0.1 * (runs + 1))))
    # features of the benchmark, at most 2^BITS
    has = {int(r[0]) for r in passages.select("terms").mapInArrow(_distinct, "feature int").distinct().collect()}
    own = np.array(sorted(has), np.int64)
    place = np.full(1 << BITS, -1, np.int64)
    place[own] = np.arange(len(own))
    rank = min(rank, len(own))
    fit, moments = passages.select("terms", F.lit(1.0).alias("weight")), None
    if len(own) <= MOMENTS:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        tasks = max(1, min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES), size // MOMENT_BYTES)
        shared = spark.sparkContext.broadcast((idf[own], place))
        summed = texts.select("text").coalesce(tasks).mapInArrow(tidy(_co_occurrences(shared)), PACKED).groupBy("pack").applyInPandas(_add_packs(PACK_ROWS, "<f4"), PACKED)
        summed = scratch.stash(summed, "moments")
        shared.destroy()
        there = sum(np.frombuffer(r["part"], "<f8")[0] for r in summed.filter("pack = -1").collect())
        moments = (summed.filter("pack >= 0"), CORPUS_SHARE * total / max(1.0, there))
    else:
        some = texts.select("text").mapInArrow(tidy(_cut_texts), "terms binary")
        fit = fit.union(some.select("terms", F.lit(CORPUS_SHARE * total / max(1, some.count()))))
    _, space = latent_space(fit, idf[own], place, rank, moments=moments)
    if moments is not None:
        scratch.drop("moments")
    shared_space = (idf[own, None] * space).astype(np.float32)

    found = None
    blocks = -(-total // block)
    for i in range(blocks):  # the benchmark's passages in blocks of about ``block``; each is a broadcast of bounded size
        rows = passages.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == i).collect()
        if not rows:
            continue
        terms = [np.frombuffer(r["terms"], "<u8") for r in rows]
        vectors = np.stack([shared_space[p[p >= 0]].sum(axis=0) if (p := place[features(t)]).max(initial=-1) >= 0 else np.zeros(rank, np.float32) for t in terms])
        # the cosine of a window x with a passage q in the latent space, against |x| itself and the share of q that the space
        # keeps: <xV, qV> / |x| |q| >= similarity * |qV|^2 / |q|^2, so a window that equals the passage has 1
        inner = np.maximum((vectors**2).sum(axis=1, keepdims=True), 1e-9)
        length = np.array([[np.sqrt((idf[features(t)] ** 2).sum() + 1e-9)] for t in terms])
        vectors = vectors * length / inner
        least = float((np.sqrt(inner) / length).min())
        around = [np.frombuffer(r["around"], "<u8") for r in rows]
        rare = [_rarest(t, idf) for t in terms]
        # the rarest terms of all passages that a neighbourhood touches, cut as the item's passages are
        rarest = [set().union(*(_rarest(t[max(0, x - r["left"]) : max(0, y - r["left"])], idf) for x, y in cut_passages(r["n"]))) for t, r in zip(around, rows)]
        shared = spark.sparkContext.broadcast((shared_space, place, {
            "vectors": vectors.astype(np.float32), "least": least, "idf": idf.astype(np.float32), "terms": [t.tolist() for t in terms], "rare": rare,
            "around": [t.tolist() for t in around], "rarest": rarest, "left": [r["left"] for r in rows], "n": [r["n"] for r in rows],
            "item": [r["item_id"] for r in rows], "nth": [r["passage"] for r in rows], "of": [r["passages"] for r in rows],
        }))
        part = scratch.stash(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(tidy(_search(shared, similarity, lcs, answers)), schema), f"found-{i}")
        shared.destroy()
        found = part if found is None else found.union(part)
    scratch.drop("passages")
    covered = F.size(F.array_distinct(F.flatten(F.collect_set("cells"))))
    pairs = found.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("passages").alias("passages"), F.count_distinct(F.when(F.col("whole"), F.col("passage"))).alias("found"), F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answers").alias("answers"),
        (covered / F.max("n")).alias("covered"),
    )
    return pairs.filter((F.col("found") >= F.ceil(F.col("passages") * share)) | (F.col("covered") >= share)).union(short)


def _contaminated_by_short(texts: DataFrame, items: DataFrame, scratch: Scratch, kind: str) -> DataFrame:
    """Items of fewer than SHORT terms in the documents that have them in a row: an equi-join on 128-bit names of sequences."""
    spark = texts.sparkSession
    short = scratch.stash(items.mapInArrow(_short_items, "item_id long, n int, one long, two long"), "short")
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())
    if not lengths:
        return spark.createDataFrame([], f"doc_id {kind}, {PAIR}")
    # up to a million names go to the scan, so that other sequences don't leave it; more are left to the join
    ones = [r["one"] for r in short.select("one").distinct().limit(1_000_001).collect()]
    shared = spark.sparkContext.broadcast(np.array(sorted(ones), np.int64) if len(ones) <= 1_000_000 else None)
    there = texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(tidy(_find_short(lengths, shared)), f"doc_id {kind}, text_hash long, n int, one long, two long").distinct()
    one = F.lit(1.0)
    return there.join(short, ["n", "one", "two"]).select("doc_id", "text_hash", "item_id", F.lit(1).alias("passages"), F.lit(1).cast("long").alias("found"), one.alias("cosine"), one.alias("lcs"), one.alias("answers"), one.alias("covered"))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(np.frombuffer(x, "<u8")) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found or [np.zeros(0, np.int64)])).astype(np.int32))], ["feature"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", least_terms: int = 5, item_text: str = "text", **options) -> DataFrame:
    """docs without the documents that hold benchmark items; columns as they are, whatever their names.

    An item of fewer than least_terms terms is a phrase that any text may have, and no reason to drop one. Null and empty texts
    stay. Rows that repeat a doc_id are told apart by their texts; rows that repeat both go together. Empty tables change nothing.
    """
    scratch = Scratch(docs.sparkSession)
    terms = F.filter(F.split(F.lower(item_text), "[^a-z0-9\\x{80}-\\x{10FFFF}]+"), lambda x: x != "")
    long_enough = benchmark.filter(F.size(terms) >= least_terms)
    gone = contaminated_texts(docs, long_enough, doc_id=doc_id, text=text, item_text=item_text, **options).select("doc_id", "text_hash").distinct()
    gone = scratch.stash(gone, "contaminated")
    return keyed(docs, gone, [(F.col(doc_id), "doc_id"), (F.xxhash64(text), "text_hash")], "left_anti")
