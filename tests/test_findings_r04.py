"""Cases of the fourth round's findings."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import fulltext, masks, postings, text_index
from skein.plans import search


def some_texts(spark, n=300, seed=7):
    """Texts of a few words, with signs beyond ASCII, empty and null ones, and many equal ones."""
    pick = random.Random(seed)
    words = ["red", "Ring", "nut", "Kelvin", "İx", "straße", "a1", "b-2", "漢red", "bolt"]
    rows = [(i * 2, None if i % 19 == 0 else "" if i % 23 == 0 else pick.choice([" ", "é", "."]).join(pick.choices(words, k=pick.randrange(1, 12))), pick.choice(words)) for i in range(n)]
    return spark.createDataFrame(rows + [(None, "red ring", "bolt")], "doc_id long, body string, title string").repartition(3)


def some_queries(spark, n=40, seed=8):
    pick = random.Random(seed)
    terms = ["red", "ring", "nut", "kelvin", "x", "i", "stra", "e", "a1", "b", "2", "bolt", "nothing", "", "Ring", None]
    return spark.createDataFrame([(q, t) for q in range(n) for t in pick.choices(terms, k=pick.randrange(1, 6))], "qid long, term string")


def test_full_text_shuffles_no_row_for_a_pair(spark, monkeypatch):
    """The rows that a window chooses from are k for a query and piece of texts, not one for each document that has a term."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("red ring").alias("title"), F.concat(F.lit("nut "), "id").alias("content")).coalesce(2)
    asked = spark.createDataFrame([(q, t) for q in range(9) for t in ("ring", "nut", str(q))], "qid long, term string")
    seen, real = [], fulltext.multi_match
    monkeypatch.setattr(fulltext, "multi_match", lambda *args: (out := real(*args), seen.append(out.count()))[0])
    got = sorted((r.qid, r.rank, r.doc) for r in fulltext.best_matches(asked, docs, {"title": 1.0, "content": 3.0}, 3).collect() if r.rank == 1)
    assert got == [(q, 1, q) for q in range(9)] and seen[0] <= 9 * 3 * 8


def test_full_text_by_scan_gives_the_rows_of_joins(spark, monkeypatch):
    """Small blocks of queries, pieces and sums, ties, odd texts and keys; repeated keys add up."""
    monkeypatch.setattr(postings, "QUERY_BLOCK", 7)
    monkeypatch.setattr(postings, "TEXT_BYTES", 300)
    monkeypatch.setattr(postings, "PAIRS", 50)
    docs, asked, boosts = some_texts(spark).cache(), some_queries(spark), {"title": 2.0, "body": 1.0}
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc")
    for some in (docs, docs.limit(0), docs.filter("body = ''"), docs.union(docs.filter("doc_id % 4 = 0"))):
        members, terms = fulltext.grouped(asked)
        plain = fulltext.answers(fulltext.multi_match(terms, some, boosts).withColumn("rank", F.row_number().over(w)).filter("rank <= 4"), members)
        want = sorted((r.qid, r["rank"], r.doc or -1, r.score) for r in plain.collect())
        got = sorted((r.qid, r["rank"], r.doc or -1, r.score) for r in fulltext.best_matches(asked, some, boosts, 4).collect())
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-9)
    assert fulltext.best_matches(asked.limit(0), docs, boosts, 4).count() == 0


def test_split_gives_the_words_of_the_expression(spark):
    docs = some_texts(spark)
    rows = docs.select(postings.lower("body").alias("t"), fulltext.words("body").alias("w")).toArrow().combine_chunks()
    place, words = postings.split(rows.column("t").combine_chunks().slice(5))
    want = [(i, w) for i, ws in enumerate(rows.column("w").to_pylist()[5:]) for w in ws]
    assert list(zip(place.tolist(), words.to_pylist())) == want
    assert postings.split(pa.array(["", ""], pa.string()))[1].to_pylist() == []


def _split_reads(spark, path, asked, k):
    counts = []
    got = sorted((r.qid, r["rank"], r.doc or -1, r.score) for r in text_index.search_text_index(spark, path, asked, k, counts).collect())
    return got, sorted((r.qid, r.blocks) for r in counts[0].collect())


def test_index_by_runs_gives_the_rows_of_joins(spark, monkeypatch, tmp_path):
    """Several segments and runs, which end anywhere in a piece, repeated keys at their seams, and small blocks of queries."""
    docs, asked, boosts = some_texts(spark).cache(), some_queries(spark), {"title": 2.0, "body": 1.0}
    members, terms = fulltext.grouped(asked)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc")
    plain = fulltext.answers(fulltext.multi_match(terms, docs, boosts).withColumn("rank", F.row_number().over(w)).filter("rank <= 4"), members)
    want, blocks = sorted((r.qid, r["rank"], r.doc or -1, r.score) for r in plain.collect()), None
    for i, (run, postings_each, block) in enumerate([(4096, 2_000_000, 16_384), (60, 60, 7)]):
        for name, value in (("RUN", run), ("RUN_POSTINGS", postings_each)):
            monkeypatch.setattr(text_index, name, value)
        for name, value in (("TEXT_BYTES", 500), ("PAIRS", 60), ("QUERY_BLOCK", block)):
            monkeypatch.setattr(postings, name, value)
        path = f"file://{tmp_path}/{i}"
        text_index.build_text_index(docs, path, "doc_id", boosts, rows_each=8)
        got, read = _split_reads(spark, path, asked, 4)
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-9)
        assert blocks in (None, read)  # where a run ends is not seen in the blocks
        blocks = read
    assert spark.read.parquet(f"{path}/blocks").select("run").distinct().count() > 5  # segments of 64 rows, and runs within them
    same = docs.withColumn("doc_id", F.expr("doc_id div 60"))
    text_index.build_text_index(same, f"file://{tmp_path}/same", "doc_id", boosts, rows_each=8)
    assert sorted(r.row for r in spark.read.parquet(f"file://{tmp_path}/same/rows").collect()) == list(range(301))
    seen = spark.read.parquet(f"file://{tmp_path}/same/blocks").filter("term = 'red' and field = 'body'").agg(F.sum("n")).first()[0]
    assert seen == same.filter(F.array_contains(fulltext.words("body"), "red")).count()


def test_index_opens_a_run_once_for_all_queries(spark, monkeypatch, tmp_path):
    """Many queries of one term: its lists are read and unpacked once a run and phase, and stored once for many ranges."""
    docs = spark.range(512).select("id", F.concat(F.lit("red ring n"), F.col("id") % 7).alias("name"))
    path = f"file://{tmp_path}/index"
    text_index.build_text_index(docs, path, "id", {"name": 1.0}, rows_each=4, partitions=2)
    lists = spark.read.parquet(f"{path}/blocks")
    assert lists.count() == 9 and sorted(r.n for r in lists.collect())[-2:] == [512, 512]
    asked = spark.range(60).select(F.col("id").alias("qid"), F.explode(F.array(F.lit("ring"), F.concat(F.lit("n"), F.col("id") % 7), F.concat(F.lit("none"), "id"))).alias("term"))
    got = sorted((r.qid, r["rank"], r.doc) for r in text_index.search_text_index(spark, path, asked, 2).collect())
    assert got == [(q, i + 1, q % 7 + 7 * i) for q in range(60) for i in range(2)]


def test_few_masks_go_to_the_edges(spark):
    """A step shuffles what it finds, not its edges, also where the planner broadcasts nothing by itself."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 90).alias("entity_id"))
        some = spark.createDataFrame([(5, 0, 3), (6, 0, 4)], "id long, word long, mask long")
        step = masks.step(some, edges, "entity_id", "event_id")
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(tuple(r) for r in step.collect()) == sorted((e, 0, {5: 3, 6: 4}[e % 90]) for e in range(1000) if e % 90 in (5, 6))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_last_step_finds_stored_events_only(spark, monkeypatch):
    """Events that aren't stored can't be ranked: the last step leaves them out, the steps before go through them."""
    pick = random.Random(9)
    edges = spark.createDataFrame([(e, pick.randrange(150)) for e in range(400) for _ in range(2)] * 2, "event_id long, entity_id long").cache()
    vector = F.array(*(F.cos(F.col("id") * i).cast("float") for i in (1, 2, 3)))
    rows = spark.range(40).select("id", vector.alias("v")).cache()
    events = rows.select(F.col("id").alias("event_id"), F.col("id").alias("chunk_id"), F.col("v").alias("title_vector"), F.reverse("v").alias("content_vector"))
    corpus = search.Corpus(events, rows.withColumnRenamed("id", "entity_id"), edges, rows.withColumnRenamed("id", "chunk_id"))
    asked = rows.filter("id % 9 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv")).cache()
    seen, real = [], masks.phase_b
    monkeypatch.setattr(masks, "phase_b", lambda seeds, eventset, *rest: (out := real(seeds, eventset, *rest), seen.append((seeds, eventset, out)))[0])
    for strategy in ("multi1", "hopllm"):
        search.search(asked, asked.select("qid", F.lit(0).alias("ord"), "qv"), corpus, search.SearchConfig(strategy, entity_top_k=3, event_top_k=3, event_threshold=0.9, max_events=4, max_events_a=4, max_events_b=3, max_hop_retries=1)).collect()
        seeds, eventset, found = seen[-1]
        known = masks.numbers(asked)
        assert {r.id for r in found.select("id").collect()} <= set(range(40))
        if strategy == "multi1":  # the same stored events as over all edges
            whole = masks.minus(masks.step(seeds, edges, "entity_id", "event_id"), eventset).filter("id < 40")
            assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, found.collect())) and found.count() > 0
            assert masks.unpack(found, known, "event_id").count() > 0
