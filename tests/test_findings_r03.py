"""Cases of the third round's findings."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein import providers
from skein.functions import values
from skein.llm import decontamination, toxicity
from skein.operators import extraction, fulltext, graph, masks, text_index, vectors


def test_stated_numbers_are_no_years(spark):
    df = spark.createDataFrame([("total", "int", "2024"), ("total", "int", "1969"), ("day", "datetime", "2024"), ("total", "int", "2024-05-06")], "name string, kind string, value string")
    got = df.select(*values.stated_or_parsed(F.col("name"), F.col("kind"), F.col("value"), F.lit("kg"))).select("int_value", F.year("datetime_value"), "value_unit").collect()
    assert [tuple(r) for r in got] == [(2024, None, "kg"), (1969, None, "kg"), (None, 2024, "kg"), (None, 2024, "kg")]


def test_knn_returns_k_rows_a_batch(spark, monkeypatch):
    """Equal scores at the cut don't leave the task, and no matrix of a batch with all queries is made."""
    monkeypatch.setattr(vectors, "top_k", lambda df, k: df)
    monkeypatch.setattr(vectors, "SCORES", 5000)
    rows = spark.range(2000).coalesce(1).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("v"))
    asked = spark.range(7).select(F.col("id").alias("qid"), F.array(F.lit(1.0), F.col("id").cast("double")).cast("array<float>").alias("qv"))
    got = vectors.knn(asked, rows, 3).collect()
    assert sorted((r.qid, r.id) for r in got) == [(q, i) for q in range(7) for i in range(3)]


@pytest.mark.parametrize("most", [None, 2])
def test_score_ids_takes_no_row_for_a_pair_and_no_vector(spark, most):
    v = {0: [1.0, 0.0], 1: [1.0, 1.0], 2: None, 3: [1.0], 4: [float("nan"), 1.0], 5: [0.0, 0.0], 6: [1.0, None], 7: [-1.0, 0.0], 8: [1.0, 0.0]}
    rows = spark.createDataFrame(list(v.items()), "id long, v array<float>").coalesce(1)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 2.0, 2.0])], "qid string, qv array<float>")
    wanted = spark.createDataFrame([(q, i) for q in "abc" for i in v if q != "b" or i > 0], "qid string, id long")
    scored = vectors.score_ids(asked, rows, wanted, most)
    got = {(r.qid, r.id): r.score for r in (scored if most is None else vectors.top_k(scored, most)).collect()}
    old = wanted.join(asked, "qid").join(rows, "id").select("qid", "id", F.round(vectors.cosine(F.col("qv"), F.col("v")), 6).alias("score"))
    want = {(r.qid, r.id): r.score for r in (old if most is None else vectors.top_k(old, most)).collect()}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k], equal_nan=True) for k in want)
    assert "qv" not in scored._jdf.queryExecution().optimizedPlan().toString()


def _as_rows(spark, x, known, key):
    return sorted(tuple(r) for r in masks.unpack(x, known, key).collect())


def test_masks_expand_as_rows_do(spark):
    """More queries than bits in a word, gates and several hops."""
    pick = random.Random(3)
    edges = spark.createDataFrame([(e, pick.randrange(60)) for e in range(150) for _ in range(2)], "event_id long, entity_id long").distinct().cache()
    seeds = spark.createDataFrame([(q, pick.randrange(60)) for q in range(5, 140) for _ in range(2)], "qid long, entity_id long").distinct().cache()
    known = masks.numbers(seeds).cache()
    assert [tuple(r) for r in known.orderBy("n").collect()] == [(q, q - 5) for q in range(5, 140)]
    start = graph.entity_to_event(seeds, edges).cache()
    s, e = masks.pack(seeds, known, "entity_id"), masks.pack(start, known, "event_id")
    for hops in (0, 1, 2):
        want = [] if not hops else sorted((r.qid, r.event_id) for r in graph.expand(seeds, start, edges, hops)[0].collect())
        assert _as_rows(spark, masks.expand(s, e, edges, hops), known, "event_id") == want
    half = start.filter("event_id % 2 = 0")
    for most, retries in ((0, 3), (4, 1), (4, 2), (6, 3)):
        want = sorted((r.qid, r.event_id) for r in graph.phase_b(seeds, half, edges, most, retries).collect())
        assert _as_rows(spark, masks.phase_b(s, masks.pack(half, known, "event_id"), edges, most, retries), known, "event_id") == want


def test_equal_queries_are_asked_once(spark, monkeypatch):
    docs = spark.range(50).select(F.col("id").alias("entity_id"), F.lit("red ring").alias("name"))
    asked = spark.range(40).select(F.col("id").alias("qid"), F.explode(F.array(F.lit("ring"), F.lit("red"))).alias("term"))
    seen, real = [], fulltext.multi_match
    monkeypatch.setattr(fulltext, "multi_match", lambda queries, *rest: seen.append(queries.count()) or real(queries, *rest))
    got = sorted((r.qid, r.rank, r.doc) for r in fulltext.match_names(asked, docs, 3).collect())
    assert got == [(q, i + 1, i) for q in range(40) for i in range(3)] and seen == [2]


def test_equal_queries_share_the_bounds_of_the_index(spark, monkeypatch, tmp_path):
    docs = spark.range(64).select("id", F.lit("red ring").alias("name"))
    path = f"file://{tmp_path}/index"
    text_index.build_text_index(docs, path, "id", {"name": 1.0}, rows_each=16, partitions=4)
    assert sorted(r.row for r in spark.read.parquet(f"{path}/rows").select("row").collect()) == list(range(64))
    sizes, real = {}, text_index.stored
    monkeypatch.setattr(text_index, "stored", lambda df, at: (out := real(df, at), sizes.update({at.rsplit("/", 1)[1]: out.count()}))[0])
    asked = spark.range(30).select(F.col("id").alias("qid"), F.lit("ring").alias("term"))
    got = sorted((r.qid, r.rank, r.doc) for r in text_index.search_text_index(spark, path, asked, 2).collect())
    assert got == [(q, i + 1, i) for q in range(30) for i in range(2)] and sizes["bounds"] == 4


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows of a label than the former sample had, in several shards: every one is counted, trains or calibrates."""
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", 1000)
    n, seen = 2700, []
    rows = [(i, f"common w{i % 50} bad{i // 2}") for i in range(n)] + [(n + i, f"common w{i % 50} calm") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).coalesce(2)
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(n + 300)], "doc_id long, toxic int")
    real = toxicity.Network.apply
    monkeypatch.setattr(toxicity.Network, "apply", lambda self, at, change, weight: seen.append(weight.sum()) if len(weight) == 1 else real(self, at, change, weight))
    model = toxicity.fit_toxicity(docs, labels, steps=3)
    words = toxicity.Words(np.frombuffer("".join(f"bad{i} " for i in range(n // 2)).encode(), np.uint8), np.array([0, sum(len(f"bad{i} ") for i in range(n // 2))]), lower=True, gaps=toxicity.TERM_GAPS)
    share = n / (n + 300)
    q = (2 + 2 * share) / 4
    want = np.log(q / (1 - q)) - np.log(share / (1 - share))
    assert want >= 0.5 and np.allclose(model["evidence"].of(words.hash), want, atol=1e-4)
    part = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.PARTS)).alias("part")).filter(f"part < {toxicity.PARTS - 1}").count()
    assert seen and set(seen) == {part}


def test_latent_space_takes_every_document(spark, monkeypatch):
    """The co-occurrences summed in one scan are those of all passages, so either way gives the same space."""
    pick = random.Random(4)
    rows = [(i, " ".join(f"t{pick.randrange(90)}" for _ in range(pick.choice([0, 1, 23, 24, 25, 70])))) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(f"t{pick.randrange(60)}" for _ in range(30))) for i in range(12)], "item_id long, text string")
    seen, real = [], decontamination.latent_space

    def note(*args, **options):
        seen.append((args[0].count(), options["moments"] and options["moments"][1], real(*args, **options)))
        return seen[-1][2]

    monkeypatch.setattr(decontamination, "latent_space", note)
    one = decontamination.contaminated_pairs(docs, bench, rank=20)
    monkeypatch.setattr(decontamination, "MOMENTS", 0)
    two = decontamination.contaminated_pairs(docs, bench, rank=20)
    cut = sum(-(-len(t.split()) // decontamination.PASSAGE) for _, t in rows)
    assert seen[0][0] == 24 and seen[1][0] == 24 + cut and np.isclose(seen[0][1], 0.1 * 24 / cut)
    assert np.allclose(seen[0][2][0], seen[1][2][0], rtol=1e-4)
    assert sorted(map(str, one.select("doc_id", "item_id", "passages", "found").collect())) == sorted(map(str, two.select("doc_id", "item_id", "passages", "found").collect()))


@pytest.mark.parametrize("broadcast", [True, False])
def test_toxicity_stores_labelled_rows_once(spark, monkeypatch, broadcast):
    """Each labelled row is stored once, in its shard; its text is shuffled once, whether or not the labels can be broadcast."""
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", 100)
    if not broadcast:
        monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    n, stored, real = 600, [], toxicity.Scratch.stash

    def stash(self, df, name, **options):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = real(self, df, name, **options)
        stored.append((out.select("toxic", "words", "shard").collect(), plan.count("Exchange hashpartitioning(_order")))
        return out

    monkeypatch.setattr(toxicity.Scratch, "stash", stash)
    docs = spark.createDataFrame([(i if i % 9 else None, f"Word{i} two-words {'bad' * (i % 2)}" if i % 7 else None) for i in range(n)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(None, 1), *((i, i % 2 if i % 5 else None) for i in range(n))], "doc_id int, toxic int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert toxicity.fit_toxicity(docs, labels, steps=3)["network"] is not None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = [i for i in range(n) if i % 9 and i % 7 and i % 5]
    ((rows, exchanges),) = stored
    assert sorted((r.toxic, len(r.words) // 8) for r in rows) == sorted((i % 2, 3 + i % 2) for i in want)
    part = docs.filter(F.col("doc_id").isin(want)).filter(F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.PARTS)) < toxicity.PARTS - 1).count()
    assert {r.shard for r in rows} == set(range(-(-part // 100))) and exchanges == (1 if broadcast else 2)


def test_embedder_takes_texts_once_and_in_bounded_batches(spark, monkeypatch):
    """A provider's worker holds some MB of texts, not a batch of any size, and a filter by the vector doesn't embed again."""
    monkeypatch.setattr(providers, "TEXT_BYTES", 1 << 16)
    texts = spark.range(4000).coalesce(1).select(F.col("id").alias("chunk_id"), F.repeat(F.lit("Harbour "), 125).alias("content"))
    seen = providers.embedder(lambda part: [[float(len(part))]] * len(part), batch=1 << 20)
    old = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        events = extraction.extract_events(texts, providers.rule_events)
        rows = events.select(seen("content").alias("v")).filter(vectors.is_valid_vector(F.col("v")))
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        got = [r.v[0] for r in rows.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", old)
    assert len(got) == 4000 and max(got) <= 200


def test_latent_search_checks_only_windows_that_can_pass(spark, monkeypatch):
    """Windows that are near a passage, but have no run of it and too few of its terms, aren't taken apart; the others' rows stay."""
    pick = random.Random(5)
    items = [[f"t{pick.randrange(60)}" for _ in range(30)] for _ in range(12)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    texts = [" ".join(items[i % 12][:15] + [f"t{pick.randrange(60)}" for _ in range(40)]) for i in range(20)] + [" ".join(sorted(items[i % 12][::2] * 3)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, real = [], decontamination._search
    monkeypatch.setattr(decontamination, "_search", lambda shared, *args: seen.append((shared.value, args)) or real(shared, *args))
    got = decontamination.contaminated_pairs(docs, bench, rank=20).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(i, i % 12) for i in range(20)}

    value, args = seen[0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([0] * len(texts))], ["doc_id", "text", "text_hash"])
    calls, runs = [], decontamination.runs_of
    monkeypatch.setattr(decontamination, "runs_of", lambda terms: calls.append(len(terms)) or runs(terms))

    def rows(check):
        monkeypatch.setattr(decontamination.TermCheck, "keep", check)
        del calls[:]
        out = [r for b in real(SimpleNamespace(value=value), *args)(iter([batch])) for r in b.to_pylist()]
        return sorted(map(str, out)), len(calls)

    keep = decontamination.TermCheck.keep
    some, few = rows(keep)
    every, many = rows(lambda self, row, runs, a, b, q: np.ones(len(q), bool))
    monkeypatch.setattr(decontamination, "SEEN_BYTES", 200)
    monkeypatch.setattr(decontamination, "CHECKED", 7)
    assert some == every == rows(keep)[0] and few < many / 2


def test_latent_sums_travel_in_packs(spark):
    """Rows of sketches and of co-occurrences are summed by packs, not one group each, and the sums are those of the whole matrix."""
    make = np.random.default_rng(6)
    n, rank = 150, 7
    parts = [make.normal(size=(n, n)).astype(np.float32) for _ in range(3)]
    parts[0][20:90], basis = 0, make.normal(size=(n, rank))
    sent = [b for x in parts for b in decontamination.packs(x, decontamination.PACK_ROWS, "<f4")]
    assert len(sent) < 3 * n / 10
    frame = spark.createDataFrame(pa.Table.from_batches(sent).to_pandas(), decontamination.PACKED)
    summed = frame.repartition(3).groupBy("pack").applyInPandas(decontamination._add_packs(decontamination.PACK_ROWS, "<f4"), decontamination.PACKED)
    shared = spark.sparkContext.broadcast((0.5, basis))
    out = summed.mapInArrow(decontamination._times(shared, rank), decontamination.PACKED).groupBy("pack").applyInPandas(decontamination._add_packs(decontamination.PACK, "<f8"), decontamination.PACKED).collect()
    got, whole = np.zeros((n, rank)), sum(x.astype(np.float64) for x in parts)
    for r in out:
        at, rows = decontamination.unpack(r["at"], r["part"], "<f8")
        got[at] = rows
    assert len(out) == -(-n // decontamination.PACK) and np.allclose(got, 0.5 * (whole + whole.T) @ basis, atol=1e-4)
