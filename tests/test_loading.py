"""Native and tokenizer-exact chunking, mended JSON, replaced articles, routed writes, streams, retries."""

import json
import random
import re
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skein import providers
from skein.api import Engine
from skein.functions import jsonx, mend, text, values
from skein.operators import chunk_plan, chunking, extraction, token_chunks
from skein.operators.lineage import folder
from skein.sources import tables
from skein.sources.replace import ArticleStore, ReplaceError
from skein.streaming import incremental

TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


class Estimate:
    """The library's estimate with longest prefixes by bisection, as a counter for the plan in Python."""

    def counts(self, texts):
        return [chunking._estimate(t) for t in texts]

    def cut(self, s, most):
        return chunking.force_split(s, most)


def markdown(seed):
    rng = random.Random(seed)
    pieces = ["# One\n", "## 二 \n", "word ", "日本語の文。", "a, b; c", "\n", "\n\n", "\r\n", "\r\n\r\n", " \t", "　", "Ende. ", "was? ", "x" * 300, "漢" * 200, "，", "####### no\n", "#\n", "!", "y" * 30 + " "]
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 60)))


def test_native_chunks(spark):
    docs = [(i, markdown(i)) for i in range(150)] + [(200, None), (201, ""), (202, " \n \n"), (203, "z" * 9000), (204, "# only"), (205, "\n# h\n\n\n \n# k\n" + " " * 900 + "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most, section, strict, alone in ((1000, None, False, 600), (80, 40, True, 30), (64, 600, False, 70)):
        got = {}
        for r in chunk_plan.chunks_native(df, most, section, strict=strict, alone=alone).orderBy("doc_id", "rank").collect():
            got.setdefault(r.doc_id, []).append((r.heading, r.content, r.raw_content, r.references, r.render_groups))
        section = max(32, section or 250)
        for d, t in docs:
            blocks = [b for b in re.sub(r"(?ma)^(#{1,6}\s+.+)$", "\x01\\1", t or "").split("\x01") if b]
            heads = [(m.group(1).strip(" ") if (m := re.match(r"(?a)#{1,6}\s+(.+)$", b.split("\n", 1)[0])) else "", b) for b in blocks]
            want = token_chunks.document_chunks(token_chunks.document_sections(heads, section, Estimate()), max(64, min(1000, most)), alone, strict, Estimate()) if heads else []
            assert got.get(d, []) == want, (d, most)


def test_sections_keep_the_text(spark):
    docs = [(i, markdown(i + 500)) for i in range(60)]
    rows = {}
    for r in chunk_plan.section_rows(spark.createDataFrame(docs, "doc_id long, text string"), 40).orderBy("doc_id", "order_index").collect():
        rows.setdefault(r.doc_id, []).append(r)
    for d, t in docs:
        some = rows.get(d, [])
        assert "".join(r.text for r in some) == t and [r.order_index for r in some] == list(range(len(some)))
        assert sum(not r.text.strip() for r in some) == 0 or len(some) == 1 or not t.strip()
        groups = [r.render_group_index for r in some]
        assert groups == sorted(groups)


def test_token_cuts():
    """Parts have at most the tokens asked for, lose nothing, and a text of a million signs takes seconds."""
    tokens = token_chunks.TokenCounter(TOKENIZER)
    rng = random.Random(1)
    for letters in ("abc", "etaoin shrdlu", "日本語", "é😀x ", " "):
        for size in (1, 40, 700):
            s = "".join(rng.choice(letters) for _ in range(size))
            for most in (1, 7, 50):
                parts = tokens.cut(s, most)
                assert "".join(parts) == s and all(n <= most or len(p) == 1 for p, n in zip(parts, tokens.counts(parts)))
    whole = "the quick brown fox " * 40
    assert tokens.counts(tokens.cut(whole, 10))[:-1] == [10] * (len(tokens.cut(whole, 10)) - 1)
    for s in ("".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "a b c d " * 125_000):
        began = time.time()
        parts = tokens.cut(s, 500)
        assert "".join(parts) == s and max(tokens.counts(parts)) <= 500 and time.time() - began < 60


def test_tokenizer_chunks(spark):
    docs = [(i, markdown(i)) for i in range(20)] + [(50, None), (51, "q" * 5000)]
    tokens = token_chunks.TokenCounter(TOKENIZER)
    rows = token_chunks.chunks_standard(spark.createDataFrame(docs, "doc_id long, text string"), 200, 50, tokenizer=TOKENIZER).collect()
    for d, t in docs:
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r["rank"])
        assert "".join(r.raw_content for r in mine) == (t or "")
        assert all(sum(tokens.counts([r.raw_content])) <= 260 for r in mine)


def test_mend_json():
    good = {"a": [1, 2.5, True, None, {"b": "x, y: z"}], "c": "say \"hi\"\n\\done"}
    s = json.dumps(good)
    assert mend.mend_text(s) == (s, False, None)
    for bad in ("```json\n" + s + "\n```", "Well: " + s, s[:-1], s.replace("[1, ", "[ 1 ,"), json.dumps(s), s.replace("}]", "},]"), s + "}}"):
        assert json.loads(mend.mend_text(bad)[0]) == good, bad
    assert json.loads(mend.mend_text("{a: 'b', c: [1, 2,, 3], d: nope, e: {")[0]) == {"a": "b", "c": [1, 2, 3], "d": "nope", "e": {}}
    assert mend.mend_text("no answer")[2] == "no JSON" and mend.mend_text(None)[2] == "null" and mend.mend_text("")[2] == "no JSON"
    rng = random.Random(2)
    for _ in range(300):
        cut = "".join(rng.choice('{}[]",:\\ab1 \n\'') for _ in range(rng.randrange(40)))
        out, _, error = mend.mend_text(cut)
        assert error or json.loads(out) is not None
    deep = "[" * 100_000
    assert mend.mend_text(deep)[2] in (None, "nested too deep")


STORE = {"chunks": "article_id bigint, id bigint, content string", "events": "article_id bigint, id bigint, status string"}


def test_article_store(spark):
    store = ArticleStore(spark, folder(spark, "store"), STORE, {"events": ("status", "DELETED")}, buckets=4)
    assert store.read("chunks").count() == 0 and store.version() == 0
    chunks = spark.createDataFrame([(a, 10 * a + i, "t") for a in range(6) for i in range(3)], STORE["chunks"])
    events = chunks.select("article_id", "id", F.lit("ok").alias("status"))
    ids = chunks.select("article_id")
    assert store.replace(ids, {"chunks": chunks, "events": events}) == {"chunks": 18, "events": 18}
    new = spark.createDataFrame([(2, 99, "n")], STORE["chunks"])
    store.replace(new.select("article_id"), {"chunks": new})
    state = lambda: (sorted(r.id for r in store.read("chunks").collect()), sorted((r.id, r.status) for r in store.read("events").collect()))
    after = state()
    assert after[0] == sorted([10 * a + i for a in range(6) if a != 2 for i in range(3)] + [99]) and [s for i, s in after[1] if i // 10 == 2] == ["DELETED"] * 3
    broken = new.withColumn("content", F.raise_error(F.lit("disk full")).cast("string"))
    for bad in ({"events": events.filter("article_id = 2"), "chunks": broken}, {"chunks": chunks}):
        with pytest.raises(Exception):
            store.replace(new.select("article_id"), bad)
        assert state() == after and store.version() == 2
    assert [r.id for r in store.read("chunks", 1).filter("article_id = 2").orderBy("id").collect()] == [20, 21, 22]
    assert [r.id for r in store.missing("chunks", spark.createDataFrame([(99,), (20,)], "id long")).collect()] == [20]


def test_article_store_checks_what_it_wrote(spark, monkeypatch):
    store = ArticleStore(spark, folder(spark, "store"), STORE, buckets=2)
    chunks = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], STORE["chunks"])
    switch = store._switch
    monkeypatch.setattr(store, "_switch", lambda version, manifest: switch(version, manifest) or switch(version, manifest))
    with pytest.raises(ReplaceError):  # a second switch to the same version is refused
        store.replace(chunks.select("article_id"), {"chunks": chunks})


def test_routed_index(spark, tmp_path):
    rows = [(i, "big" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, source_config_id string")
    tables.write_index(df, str(tmp_path / "x"), rows_each=100)
    back = tables.read_index(spark, str(tmp_path / "x"), ["big"])
    sizes = back.groupBy(F.input_file_name()).count().collect()
    assert back.count() == 2000 and max(r["count"] for r in sizes) <= 200 and len(sizes) >= 15
    assert all("source_config_id=big" in r[0] for r in sizes) and spark.read.parquet(str(tmp_path / "x")).count() == 3001


def test_stream_counts_once(spark, tmp_path):
    schema = "k string, id long, at timestamp, v long"
    rows = spark.range(100).select(F.concat(F.lit("k"), F.col("id") % 4).alias("k"), "id", F.timestamp_seconds(F.col("id") * 60).alias("at"), (F.col("id") * 2).alias("v"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = incremental.source_totals(incremental.table_stream(spark, str(tmp_path / "in"), schema, 2), "k", "id", "at", "v")
    sink = incremental.UpsertFolder(str(tmp_path / "out"), "k")
    for _ in range(2):  # the second time with rows that came before
        sink.run(stream, str(tmp_path / "checkpoint")).awaitTermination()
        rows.filter("id % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted(tuple(r) for r in incremental.source_totals(rows, "k", "id", "at", "v").collect())
    assert sorted(tuple(r) for r in sink.read(spark, stream.schema).collect()) == want


def test_retries_and_order():
    calls, pauses = [], []

    def flaky(x):
        calls.append(x)
        if x == "slow":
            raise providers.ProviderTimeout("slow")
        if x == "odd":
            raise ValueError("unknown")
        if calls.count(x) < 3:
            raise providers.ProviderError("busy")
        return x.upper()

    call = providers.retried(flaky, attempts=3, delay=1.0, pause=pauses.append)
    got = list(providers.in_parallel(call, ["a", "slow", "b", "odd", "c"], 3))
    assert [r for r, _ in got] == ["A", None, "B", None, "C"] and [type(e).__name__ for _, e in got] == ["NoneType", "ProviderTimeout", "NoneType", "ValueError", "NoneType"]
    assert calls.count("slow") == calls.count("odd") == 1 and calls.count("a") == 3 and len(pauses) == 6 and all(0.5 <= p <= 2 for p in pauses)
    with pytest.raises(providers.ProviderError):
        providers.retried(lambda x: (_ for _ in ()).throw(providers.ProviderError("no")), 2, pause=pauses.append)("x")


def test_engine_measures(spark):
    engine = Engine(spark, fail_fast=False)
    docs = spark.createDataFrame([(1, "# A\nsome words here"), (2, "# B\nmore")], "doc_id long, text string")
    assert engine.load(docs).count() == 2
    assert engine.run("broken", lambda: docs.withColumn("x", F.raise_error(F.lit("late")).cast("string"))) is None
    stages = [(r.stage, r.status, r.rows) for r in engine.stage_results().collect()]
    assert stages == [("load", "COMPLETED", 2), ("broken", "FAILED", None)] and json.loads(engine.result_json())["status"] == "FAILED"
    assert engine.usage().filter("stage = 'load'").first().tokens > 4


def test_readings_as_specified(spark):
    cases = {"会议于2024年3月5日召开": ("2024-03-05 00:00:00", 0.98), "2024-03-05 9:5": ("2024-03-05 09:05:00", 0.95), "1850-01-02": ("1850-01-02 00:00:00", 0.98), "2024-03-05T10:00:00Z": ("2024-03-05 10:00:00", 0.98),
             "2024年报": ("2024-01-01 00:00:00", 0.85), "2024元": None, "2024-13-01": ("2024-01-01 00:00:00", 0.85), "x 2024": None, "0000-01-01": None, "2024-02-30": ("2024-02-01 00:00:00", 0.9)}
    df = spark.createDataFrame([(k,) for k in cases], "a string").select("a", values.parse_datetime(F.col("a")).alias("v")).select("a", F.date_format("v.moment", "yyyy-MM-dd HH:mm:ss").alias("m"), "v.confidence")
    assert {r.a: None if r.m is None else (r.m, r.confidence) for r in df.collect()} == cases
    row = spark.createDataFrame([("  ## two \n#no\n# one\n", "## " + "w " * 400, None)], "a string, b string, c string").select(
        text.markdown_headings(F.col("a")), text.normalize_heading(F.col("b")), text.normalize_heading(F.col("c")), text.normalize_heading(F.col("b"), 2), values.parse_strict(F.lit("x"), "enum")
    ).first()
    assert row[0] == ["## two", "# one"] and row[1].endswith("w...") and len(row[1]) <= 500 and row[2:] == ("", "w ", None)
    deep = "[]"
    for i in range(30):
        deep = '[{"title":"t%d","children":%s}]' % (i, deep)
    got = jsonx.flatten_children(spark.createDataFrame([(1, deep), (2, None), (3, "[]")], "id long, j string"), "id", "j").collect()
    assert len(got) == 30 and max(r.level for r in got) == 29
    chunks = spark.createDataFrame([("s", 0, "a"), ("s", 2, "c"), ("s", 3, "d"), ("s", 3, "e"), (None, 1, "x")], "source string, rank int, content string")
    assert sorted((r.content, r.previous) for r in extraction.previous_chunk(chunks, "source", "rank", "content").collect()) == [("a", None), ("c", None), ("d", "c"), ("e", "c"), ("x", None)]
