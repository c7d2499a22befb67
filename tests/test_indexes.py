"""Stored indexes against brute force: broken vectors, ties, hot cells and terms, empty tables."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import graph, text_index, vector_index, vectors
from skein.operators.lineage import folder


def some_vectors(n=400, dims=12, clusters=10, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 3
    rows = [(i, [float(np.float32(x)) for x in (centres[i % clusters] + rng.normal(size=dims))]) for i in range(n)]
    rows += [(1000 + i, [1.0] * dims) for i in range(n // 2)]  # a third of all rows is one vector
    return rows + [(2000, None), (2001, []), (2002, [float("nan")] * dims), (2003, [float("inf")] + [0.0] * (dims - 1)), (2004, [1.0]), (2005, [None] * dims), (2006, [0.0] * dims)]


def nearest(rows, asked, k):
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v)]
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    out = {}
    for q, v in asked:
        if v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v):
            scores = sorted(((-round(float(unit(np.array(v)) @ unit(w)), 6) + 0.0, i) for i, w in good))[:k]
            out[q] = [(i, round(-s, 6) + 0.0) for s, i in scores]
    return out


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.id, r.score + 0.0))
    return out


@pytest.fixture(scope="module")
def rows():
    return some_vectors()


@pytest.fixture(scope="module")
def tables(spark, rows):
    asked = [r for r in rows if r[0] % 25 == 0 or r[0] >= 2000]
    return spark.createDataFrame(rows, "id long, v array<float>").repartition(3), spark.createDataFrame(asked, "qid long, qv array<float>"), asked


def close(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [s for _, s in a[q]] == pytest.approx([s for _, s in b[q]], abs=2e-6), q
        top = b[q][-1][1]
        assert {i for i, s in a[q] if s > top + 2e-6} == {i for i, s in b[q] if s > top + 2e-6}


@pytest.mark.parametrize("k", [3, 10, 2000])
def test_knn_leaves_broken_vectors_out(tables, rows, k):
    got = found(vectors.knn(tables[1].select("qid", "qv"), tables[0], k))
    close(got, nearest(rows, tables[2], k))


def test_vector_index_is_exact(spark, tables, rows):
    path = folder(spark, "vi")
    assert vector_index.build_index(tables[0], path, cells=7, block_rows=16) == 7
    got = found(vector_index.search_index(spark, path, tables[1], 10))
    want = nearest(rows, tables[2], 10)
    close(got, want)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in got)  # equal scores by id
    close(found(vector_index.search_index(spark, path, tables[1], 2000)), nearest(rows, tables[2], 2000))


def test_vector_index_probes(spark, tables, rows):
    """On clustered data a few cells give nearly all neighbours; the other cells' files are not read."""
    path = folder(spark, "vi")
    vector_index.build_index(tables[0], path, cells=12)
    probes = vector_index.probes_for(spark, path, 0.95)
    assert probes < 6
    exact = vectors.knn(tables[1], tables[0], 10)
    hits = vector_index.recall(vector_index.search_index(spark, path, tables[1], 10, probes=probes, num_candidates=60), exact).agg(F.sum("hits"), F.sum("wanted")).first()
    assert hits[0] >= 0.9 * hits[1]
    one = tables[1].limit(1)
    packed, used = vector_index._bundles(spark, path, one, 1)
    assert used is not None and len(used) == 1


def test_vector_index_empty(spark):
    path = folder(spark, "vi")
    none = spark.createDataFrame([(1, None)], "id long, v array<float>")
    vector_index.build_index(none, path)
    assert vector_index.search_index(spark, path, spark.createDataFrame([(1, [1.0])], "qid long, qv array<float>"), 3).collect() == []


def test_code_bounds():
    rng = np.random.default_rng(2)
    v = vector_index._unit(rng.normal(size=(50, 9)))
    centre = vector_index._unit(rng.normal(size=(1, 9)))[0]
    codes, step, lost = vector_index.encode(v, centre)
    q = vector_index._unit(rng.normal(size=(20, 9)))
    near = (q @ centre)[:, None] + (q @ codes.T.astype(float)) * step
    assert (np.abs(near - q @ v.T) <= lost + 1e-12).all() and lost.max() < 0.02


WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def some_docs(n=90, seed=4):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS[: 2 + i % 9]) + (str(rng.randrange(9)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(0, 30)))
        docs.append((i * 3, None if i % 17 == 3 else text if i % 5 else docs[-1][1] if docs else text, " ".join(rng.sample(WORDS, 2))))
    return docs


def bm25(docs, field, terms):
    split = [[w for w in re.split("[^a-z0-9]+", (d[field] or "").lower()) if w] for d in docs]
    mean = sum(map(len, split)) / len(docs) or 1.0
    out = {}
    for d, words in zip(docs, split):
        score = 0.0
        hit = False
        for t in terms:
            df = sum(t in w for w in split)
            tf = words.count(t)
            if tf:
                hit = True
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if hit:
            out[d[0]] = round(score, 5)
    return out


def test_text_index(spark):
    docs = some_docs()
    path = folder(spark, "ti")
    text_index.build_text_index(spark.createDataFrame(docs, "doc_id long, body string, title string").repartition(4), path, "doc_id", {"body": 1.0, "title": 2.0}, rows_each=4)
    queries = {1: ["alpha", "beta"], 2: ["theta"], 3: ["nothing"], 4: ["alpha3", "kappa", "kappa", None], 5: []}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "qid long, term string")
    counts = []
    got = {}
    for r in text_index.search_text_index(spark, path, asked, 5, counts).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.doc, r.score))
    for q, terms in queries.items():
        terms = sorted({t for t in terms if t})
        body, title = bm25(docs, 1, terms), bm25(docs, 2, terms)
        both = {d: max(body.get(d, -1), round(title.get(d, -1) * 2, 5)) for d in body.keys() | title.keys()}
        want = sorted(both.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [d for d, _ in got.get(q, [])] == [d for d, _ in want] and [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-5)
    read = {r.qid: (r.opened, r.blocks) for r in counts[0].collect()}
    assert all(a <= b for a, b in read.values()) and any(a < b for a, b in read.values())


def test_text_index_empty(spark):
    path = folder(spark, "ti")
    text_index.build_text_index(spark.createDataFrame([], "doc_id long, body string"), path, "doc_id", {"body": 1.0})
    assert text_index.search_text_index(spark, path, spark.createDataFrame([(1, "a")], "qid long, term string"), 3).collect() == []


def test_numbers():
    values = [0, 1, 127, 128, 300, 2**20, 2**40, 0, 5]
    assert text_index.unpack_numbers(text_index.pack_numbers(np.array(values))).tolist() == values
    assert text_index.unpack_numbers(text_index.pack_numbers(np.array([], int))).tolist() == []


def test_tree_levels(spark):
    chain = [(i, i - 1 if i % 30 else None) for i in range(90)]
    rows = chain + [(100, 999), (101, 100), (200, 201), (201, 200), (202, 201), (300, 300), (None, 5), *((1000 + i, 89) for i in range(50))]
    got = {r.id: (r.root, r.level) for r in graph.tree_levels(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert all(got[i] == (i - i % 30, i % 30) for i in range(90)) and all(got[1000 + i] == (60, 30) for i in range(50))
    assert got[100] == (100, 0) and got[101] == (100, 1) and got[200] == got[201] == got[202] == got[300] == (None, None) and None not in got
    assert graph.tree_levels(spark.createDataFrame([], "id long, parent_id long")).count() == 0
