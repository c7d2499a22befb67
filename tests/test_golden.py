"""Hand-made cases for what SQL doesn't show."""

import json
import re

import pytest
from pyspark.sql import functions as F

from skein import providers
from skein.api import Engine
from skein.functions import jsonx, text, values
from skein.operators import chunking, extraction, metrics
from skein.plans import search
from skein.plans.search import SearchConfig
from skein.sources import tables


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, number, unit", [("1,200", 1200, None), ("3.5万", 35000, "万"), ("2kg", 2, "kg"), ("5克", 0.005, "克"), ("1e3", 1000, None), ("5万元", 50000, "万元"), ("3亿元", 3e8, "亿元"), ("3吨", 3000, "吨"), ("2小时", 7200, "小时"), ("5M", 5, "M"), ("7个苹果树枝", 7, "个苹果树枝")]
)
def test_numbers(spark, raw, number, unit):
    x = one(spark, values.parse_number(F.col("a")), a=raw)
    assert (x["number"], x["unit"]) == (pytest.approx(number), unit)


@pytest.mark.parametrize("raw, kind, confidence", [("2024年3月5日", "datetime", 0.98), ("2024-03", "datetime", 0.90), ("2024", "datetime", 0.85), ("2024元", "int", 0.95), ("是", "bool", 0.95), ("已", "bool", 0.95), ("y", "text", 1.0), ("5%", "text", 1.0), ("plain", "text", 1.0)])
def test_first_reading(spark, raw, kind, confidence):
    x = one(spark, values.parse_value(F.col("a")), a=raw)
    assert (x["type"], x["confidence"]) == (kind, confidence)


def test_blank_has_no_value(spark):
    assert one(spark, values.parse_value(F.col("a")), a="  ") is None


def test_chinese_numbers(spark):
    read = lambda s, parity=True: (one(spark, values.parse_chinese_number(F.col("a"), parity), a=s) or {"number": None})["number"]
    assert [read(s) for s in ("三百五十", "十", "十五", "一千二百万")] == [350, None, 5, 1002000000]
    assert [read(s, False) for s in ("十", "十五", "一千二百万", "一亿二千万", "一万亿")] == [10, 15, 12000000, 120000000, 10**12]


def test_strict_numbers(spark):
    read = lambda s, *a, **k: (one(spark, values.parse_number(F.col("a"), *a, **k), a=s) or {"number": None, "type": None})
    assert [read(s, "int")["number"] for s in ("12", "1.5", "1e3", "三百")] == [12, None, None, 300]
    assert read("12", "float")["type"] == "float"
    x = one(spark, values.parse_with_unit(F.col("a"), "元"), a="三百个元")
    assert (x["number"], x["unit"], x["confidence"]) == (300, "元", 0.90)


def test_stated_raw(spark):
    read = lambda n, v, u, k: one(spark, values.stated_raw(*(F.col(c) for c in "nvuk")), n=n, v=v, u=u, k=k)
    assert [read("价格", "5", "元", "int"), read("价格5", "5", "元", "int"), read("2024年", "x", None, "datetime"), read("会议", "2024", None, "datetime"), read("a", None, "b", "int")] == ["价格5元", "价格5元", "2024年", "会议2024", "a"]


def test_unicode_text(spark):
    assert one(spark, text.normalize_text(F.col("a")), a=" a 　b ") == "a b"
    assert one(spark, text.normalize_for_embedding(F.col("a")), a="ＡＢ  ﬁ") == "ab fi"


def test_double_encoded_answer(spark):
    assert one(spark, jsonx.unfence(F.col("a")), a='"{\\"type\\":\\"r\\"}"') == '{"type":"r"}'


def test_block_edges(spark):
    blocks = one(spark, F.to_json(chunking.split_blocks(F.col("a"))), a="x\n#\n# a\nb\n####### no\n## c")
    assert blocks == '["x\\n","#\\n# a\\nb\\n####### no\\n","## c"]'  # as with Python's re, white space after # may be a line end


def test_heading_rank_gap(spark):
    df = spark.createDataFrame([(1, "  \n# a\nb\n")], "doc_id long, text string")
    assert [(r["rank"], r["heading"], r["content"]) for r in chunking.chunks_by_heading(df).orderBy("rank").collect()] == [(1, "a", "b")]


def test_splitting_keeps_text():
    for s in ("a" * 500, "one. two? three!\n\nfour，five", "  \n\nx", ""):
        parts = chunking.split_text(s, 20)
        assert "".join(parts) == s and all(chunking._estimate(p) <= 20 for p in parts)


def test_assembly():
    sections = [("h", "x" * 400)] * 3 + [("g", "y" * 4000)] + [("g", "z" * 40)]
    assert chunking.assemble(sections, 250) == [[0, 1], [2], [3], [4]]
    assert chunking.assemble([("a", "x" * 40), ("b", "x" * 40)], 250, strict=True) == [[0], [1]]


def test_providers():
    assert providers.hash_embedding("a b") == providers.hash_embedding("b a") and providers.hash_embedding(None) == [0.0] * 64
    assert providers.rule_entities("The Company met Company") == [("subject", "Company")]


def test_embedder_counts(spark):
    wrong = lambda texts: [[1.0]] * (1 if len(texts) == 1 else len(texts) + 1)
    df = spark.createDataFrame([(str(i),) for i in range(7)], "a string")
    assert df.select(providers.embedder(wrong, batch=3)("a").alias("v")).filter("size(v) = 1").count() == 7
    with pytest.raises(Exception, match="vectors of"):
        df.coalesce(1).select(providers.embedder(wrong, batch=3, fallback=False)("a").alias("v")).collect()


def test_reranker(spark):
    candidates = spark.createDataFrame([(1, 1, 10, 0.9), (1, 2, 11, 0.8), (1, 3, 12, 0.7), (2, 1, 11, 0.5)], "qid long, pos int, event_id long, score double")
    events = spark.createDataFrame([(10, "bb"), (11, "a"), (12, "ccc")], "event_id long, content string")
    longest = lambda texts: [9, *sorted(range(len(texts)), key=lambda i: -len(texts[i])), 0]
    got = [(r.qid, r.pos, r.event_id) for r in search.reranker(longest)(candidates, events, 2).orderBy("qid", "pos").collect()]
    assert got == [(1, 1, 12), (1, 2, 10), (2, 1, 11)]
    assert search.rerank_by_score(candidates, events, 1).count() == 2


def test_paragraph_packing(spark):
    assert chunking.pack_paragraphs("a" * 40 + "\n\n" + "b" * 40 + "\n\n" + "c" * 400, 25) == ["a" * 40 + "\n\n" + "b" * 40, "c" * 400]
    assert chunking.pack_paragraphs("  ", 5) == ["  "]
    df = spark.createDataFrame([(1, "x" * 40 + "\n\n" + "y" * 40), (2, "short"), (3, None)], "id long, text string")
    got = [(r.id, r.part, len(r.text or "")) for r in chunking.packed_sections(df, 10, large=15).orderBy("id", "part").collect()]
    assert got == [(1, 0, 40), (1, 1, 40), (2, 0, 5), (3, 0, 0)]


def test_parts_by_delimiters(spark):
    """split_primary against Python's re on texts with every delimiter."""
    for s in ("one. two? three!\n\nfour\nfive。six", "\n\n\na\n", "no end", "a.b ! c"):
        assert one(spark, F.to_json(chunking.split_primary(F.col("a"))), a=s) == json.dumps([p for p in re.split(chunking.PRIMARY, s) if p], ensure_ascii=False, separators=(",", ":"))


def test_sources_and_engine(spark):
    assert search.sources("a", ["b", "a"]) == ["b", "a"]
    with pytest.raises(ValueError):
        search.sources()
    with pytest.raises(ValueError):
        search.LoadConfig(max_tokens=5)
    with pytest.raises(ValueError):
        search.ExtractConfig(related_threshold=2)
    engine = Engine(spark)
    docs = spark.createDataFrame([(1, "# Heading\nThe Company met someone.")], "doc_id long, text string")
    chunks = engine.load(docs, "heading_strict")
    events = engine.extract(chunks.select(F.col("doc_id").alias("chunk_id"), "content"))
    assert events.count() == 1 and json.loads(engine.result_json(logs=True))["status"] == "COMPLETED"
    assert engine.stage_results().count() == 2


def test_chunk_requests(spark):
    chunks = spark.createDataFrame([(1, "s", 0, "first chunk of twenty signs", 0), (2, "s", 1, "second chunk of twenty signs", 0), (3, "s", 2, "short", 0)], "chunk_id long, source string, rank int, content string, chunk_length int")
    sections = spark.createDataFrame([(1, 0, "TEXT", "a"), (1, 1, "IMAGE", "i"), (1, 2, None, "b")], "chunk_id long, ord int, type string, content string")
    got = {r.chunk_id: (json.loads(r.request)["items"], r.previous) for r in extraction.chunk_requests(chunks, sections, ["time"]).collect()}
    assert got == {1: ([{"id": 1, "content": "a"}, {"id": 2, "content": "b"}], None), 2: ([{"id": 1, "content": "second chunk of twenty signs"}], "first chunk of twenty signs")}


def test_readers(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "", "_id": "q1", "context": [["T", ["a ", "b"]]], "supporting_facts": [["T", 0]]}]))
    (tmp_path / "p.json").write_text(json.dumps([{"question_index": "", "id": "7", "retrieved_docs": ["x"]}, {"id": "8"}]))
    (tmp_path / "a.md").write_text("# A\nb")
    (tmp_path / "a.txt").write_text("no")
    questions = tables.read_questions(spark, str(tmp_path / "q.json"))
    assert [(r.qid, r.doc) for r in metrics.gold_documents(questions, "joined").collect()] == [("q1", "T\na b")]
    assert [r.qid for r in tables.read_predictions(spark, str(tmp_path / "p.json")).collect()] == ["7"]
    assert [r.text for r in tables.read_markdown(spark, str(tmp_path)).collect()] == ["# A\nb"]
    df = spark.createDataFrame([(1, "s"), (2, "t")], "id long, source_config_id string")
    tables.write_index(df, str(tmp_path / "index"))
    tables.write_partition(df.filter("id = 2").withColumn("id", F.lit(9).cast("long")), str(tmp_path / "index"), "source_config_id")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [1, 9]
    tables.write_results(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_scaled_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "entity_id long, v array<double>")
    q = spark.createDataFrame([(5, 0, [1.0, 0.0])], "qid long, ord int, qv array<double>")
    assert search.recall_entities(q, v, 5, 0.7).count() == 1 and search.recall_entities(q, v, 5, 0.7, scaled=True).count() == 2


def test_config_ranges():
    with pytest.raises(ValueError):
        SearchConfig("other")
    with pytest.raises(ValueError):
        SearchConfig(entity_threshold=2)
