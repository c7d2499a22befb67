"""Queries of loading: mended answers, replaced articles, routed writes, streams and flaky providers, added to the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein import providers
from skein.api import Engine
from skein.functions import jsonx, mend
from skein.operators import extraction, vectors
from skein.operators.lineage import folder
from skein.plans import search
from skein.plans.catalogue import _COS, _KNN, _qv, _v, query
from skein.sources import tables
from skein.sources.replace import ArticleStore
from skein.streaming import incremental


@query("""SELECT doc_id, 'doc ' || doc_id AS title, text AS content, 3 AS keywords, doc_id % 9 <> 0 AND (doc_id % 9 <> 7 OR contains(text, chr(10))) AS mended, NULL::VARCHAR AS error FROM documents WHERE doc_id % 9 <> 8
    UNION ALL SELECT doc_id, NULL, NULL, NULL, true, 'no JSON' FROM documents WHERE doc_id % 9 = 8""")
def llm_json_mended(t):
    """Whole texts as a model's answers, damaged in eight ways: what is read is what was meant."""
    content = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    good = F.concat(F.lit('{"type":"r","data":{"items":[{"title":"doc '), "doc_id", F.lit('","content":'), content, F.lit(',"keywords":["a","b","c"]}]}}'))
    kind = F.col("doc_id") % 9
    damaged = (
        F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), good, F.lit("\n```\nDone.")))
        .when(kind == 2, F.replace(F.replace(good, F.lit('"c"]'), F.lit('"c",],')), F.lit("}]}}"), F.lit("},],},}")))
        .when(kind == 3, F.expr("substring(g, 1, length(g) - 4)")).when(kind == 4, F.replace(F.replace(good, F.lit('{"type":"r"'), F.lit("{type:'r'")), F.lit('"data":'), F.lit("data :")))
        .when(kind == 5, F.to_json(F.array(good))).when(kind == 6, F.replace(good, F.lit('["a","b","c"]'), F.lit('["a" "b" "c"'))).when(kind == 7, F.replace(good, F.lit("\\n"), F.lit("\n"))).otherwise(F.lit("I can't help with that."))
    )
    # a string that holds the answer, as a model's client may give it back
    damaged = F.when(kind == 5, F.regexp_extract(damaged, r"(?s)^\[(.*)\]$", 1)).otherwise(damaged)
    x = t.documents.withColumn("g", good).select("doc_id", mend.mend_json(damaged).alias("m"))
    item = F.get(jsonx.parse_answer(F.col("m.json"))["data"]["items"], F.lit(0))
    x = x.select("doc_id", "m.mended", "m.error", item.alias("i"))
    return x.select("doc_id", "i.title", "i.content", F.when(F.col("i").isNotNull(), F.size("i.keywords")).alias("keywords"), "mended", "error")


_STORE = {"chunks": "article_id bigint, id bigint, content string", "events": "article_id bigint, id bigint, status string", "vectors": "article_id bigint, id bigint, v array<float>"}


@query("""SELECT kind, count(*) AS rows, sum(id) AS total FROM (
    SELECT 'chunks' AS kind, turn + CASE WHEN conv_id % 4 = 0 THEN 1000 ELSE 0 END AS id FROM conversations WHERE conv_id % 4 <> 0 OR turn % 2 = 0
    UNION ALL SELECT CASE WHEN conv_id % 4 = 0 THEN 'events DELETED' ELSE 'events' END, turn FROM conversations
    UNION ALL SELECT 'events', turn + 1000 FROM conversations WHERE conv_id % 4 = 0 AND turn % 2 = 0
    UNION ALL SELECT 'vectors', turn FROM conversations WHERE conv_id % 4 <> 0) GROUP BY kind""")
def article_replace(t):
    """Three tables after all conversations were loaded and a fourth of them replaced, each time as one step."""
    store = ArticleStore(t.spark, folder(t.spark, "store"), _STORE, {"events": ("status", "DELETED")}, buckets=8)
    rows = t.conversations.select(F.col("conv_id").alias("article_id"), F.col("turn").alias("id"), F.col("text").alias("content"))

    def parts(x):
        return {"chunks": x, "events": x.select("article_id", "id", F.lit("ok").alias("status")), "vectors": x.select("article_id", "id", F.array(F.lit(1.0)).cast("array<float>").alias("v"))}

    store.replace(rows.select("article_id"), parts(rows))
    new = rows.filter("article_id % 4 = 0 AND id % 2 = 0").withColumn("id", F.col("id") + 1000)
    quarter = rows.filter("article_id % 4 = 0").select("article_id")
    store.replace(quarter, {k: v for k, v in parts(new).items() if k != "vectors"})
    events = store.read("events").select(F.when(F.col("status") == "DELETED", "events DELETED").otherwise("events").alias("kind"), "id")
    every = events.union(store.read("chunks").select(F.lit("chunks"), "id")).union(store.read("vectors").select(F.lit("vectors"), "id"))
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("total"))


@query("SELECT source AS source_config_id, count(*) AS rows, sum(doc_id) AS total, true AS split FROM documents WHERE source IS NOT NULL GROUP BY 1")
def routed_index(t):
    """Rows written by source and shard, and read back source by source: no file holds much more than its share."""
    path = folder(t.spark, "index")
    docs = t.documents.select(F.col("source").alias("source_config_id"), F.col("doc_id").alias("id"), "text")
    tables.write_index(docs, path, rows_each=100)
    sources = [r[0] for r in docs.select("source_config_id").distinct().filter("source_config_id IS NOT NULL").collect()]
    files = tables.read_index(t.spark, path, sources).withColumn("file", F.input_file_name())
    most = files.groupBy("source_config_id", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    return most.groupBy("source_config_id").agg(F.sum("n").alias("rows"), F.sum("total").alias("total"), (F.max("n") <= 200).alias("split"))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, sum(cast(round(value * 100) AS BIGINT)) AS total FROM events GROUP BY 1")
def stream_source_totals(t):
    """Events that arrive in eight files, a third of them a second time: the stream's state equals the batch."""
    arriving, work = folder(t.spark, "arriving"), folder(t.spark, "stream")
    rows = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"))
    rows.repartition(6, "event_id").write.parquet(arriving)
    rows.filter("event_id % 3 = 0").repartition(2, "event_id").write.mode("append").parquet(arriving)
    stream = incremental.source_totals(incremental.table_stream(t.spark, arriving, rows.schema, 3), "user_id", "event_id", "ts", "value")
    sink = incremental.UpsertFolder(f"{work}/out", "user_id")
    sink.run(stream, f"{work}/checkpoint").awaitTermination()
    return sink.read(t.spark, stream.schema)


def _flaky(text):
    """Fails at every text of an odd length once, and always at those of a length that 10 divides."""
    if len(text) % 10 == 0:
        raise providers.ProviderTimeout("too slow")
    if len(text) % 2 and text not in _tried:
        _tried.add(text)
        raise providers.ProviderError("busy")
    return providers.rule_events(text)


_tried: set[str] = set()


@query("""SELECT doc_id AS chunk_id, CASE WHEN length(text) % 10 = 0 THEN NULL WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN NULL ELSE 0 END AS event_rank,
    CASE WHEN length(text) % 10 = 0 THEN 'too slow' END AS error FROM documents WHERE length(text) % 10 = 0 OR regexp_replace(text, '\\s+', '', 'g') <> ''""")
def extract_flaky(t):
    """Whole texts through a provider that fails now and then: one row for each chunk, four calls at a time, another attempt for a busy one."""
    provider = providers.retried(_flaky, attempts=3, delay=0.0)
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return extraction.extract_events(chunks, provider, parallel=4).select("chunk_id", "event_rank", "error")


@query("SELECT stage, rows, tokens FROM (SELECT 'load' AS stage, count(*) AS rows, sum(cast(trunc(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) / 4.0) AS BIGINT)) AS tokens FROM documents)")
def engine_stages(t):
    """Rows and tokens of a stage that ran, over whole texts."""
    engine = Engine(t.spark)
    engine.load(t.documents.select("doc_id", F.concat(F.lit("# doc "), "doc_id", F.lit("\n"), "text").alias("text")), "heading_strict")
    return engine.usage().select("stage", "rows", "tokens")


# ---- answers, documents and results

@query("""SELECT l_orderkey AS event_id, '{"event_id":' || l_orderkey || ',"title":"order ' || l_orderkey || '","entity_ids":[' || array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') || ']' || CASE WHEN any_value(o_orderstatus) = 'F' THEN ',"category":"F"' ELSE '' END
    || CASE WHEN l_orderkey % 3 = 0 THEN ',"keywords":["a","' || any_value(o_orderpriority) || '"]' ELSE '' END || '}' AS document FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def event_document_fields(t):
    """Category only where it isn't empty, keywords only where there are some, tags never."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id"))
    words = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.col("o_orderpriority"))).otherwise(F.array().cast("array<string>"))
    events = t.orders.select(
        F.col("o_orderkey").alias("event_id"), F.concat(F.lit("order "), "o_orderkey").alias("title"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("").alias("category"), words.alias("keywords"), F.lit(None).cast("string").alias("tags")
    ).join(lines.select("event_id").distinct(), "event_id", "left_semi")
    return extraction.event_document_json(events, lines, ["title"], ["category", "keywords", "tags"])


@query("""SELECT p_brand AS source, '{"type":"object","properties":{"type":{"type":"string"' || CASE WHEN count(x) = 0 THEN '' ELSE ',"enum":[' || string_agg(DISTINCT '"' || x || '"', ',' ORDER BY '"' || x || '"') || ']' END
    || '},"name":{"type":"string"},"description":{"type":"string"}},"required":["type","name"]}' AS schema FROM (SELECT p_brand, CASE WHEN p_brand <> 'Brand#11' THEN p_type END AS x FROM part) GROUP BY p_brand""")
def answer_schema_types(t):
    """Each brand's part types as its entity types; one has none."""
    return extraction.answer_schemas(t.part.select(F.col("p_brand").alias("source"), F.when(F.col("p_brand") != "Brand#11", F.col("p_type")).alias("type")))


@query("""SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN concat_ws('|', text, CASE WHEN text <> 'x' THEN 'x' END) WHEN 1 THEN concat_ws('|', text, CASE WHEN text <> 'b' THEN 'b' END) WHEN 2 THEN 'r|x' WHEN 3 THEN concat_ws('|', nullif(text, ''), 'p', 't') ELSE 'x' END) AS answers FROM documents""")
def gold_answer_families(t):
    """Whole texts as answers in each family of fields."""
    text = F.regexp_extract(F.to_json(F.struct("text")), r'(?s)^\{"text":(.*)\}$', 1)
    part = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    kind = F.col("doc_id") % 5
    sample = (
        F.when(kind == 0, part('{"answer":', text, ',"reference":"no","answer_aliases":["x","x"]}')).when(kind == 1, part('{"gold_ans":[', text, ',"b"],"obj":"no"}'))
        .when(kind == 2, '{"reference":"r","obj":"no","answer_aliases":["x"]}').when(kind == 3, part('{"obj":', text, ',"possible_answers":["p","p"],"o_wiki_title":"t","o_aliases":""}')).otherwise('{"question":"q","answer_aliases":["x"]}')
    )
    return t.documents.select("doc_id", F.md5(F.array_join(jsonx.gold_answers_of(sample), "|")).alias("answers"))


@query(f"""WITH k AS ({_KNN.format(s=_COS, w="")}), c AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY length(text) DESC, rank) AS pos FROM k JOIN documents ON doc_id = id)
    SELECT qid, cast(pos AS INTEGER) AS pos, id AS event_id, score FROM c WHERE pos <= 4""")
def rerank_by_provider(t):
    """A provider that puts longer texts first, shown the ten nearest documents of each query."""
    longest = lambda texts: sorted(range(len(texts)), key=lambda i: -len(texts[i])) + [99, 0]
    near = vectors.knn(_qv(t), _v(t), 10).select("qid", F.col("rank").alias("pos"), F.col("id").alias("event_id"), "score")
    return search.reranker(longest)(near, t.documents.select(F.col("doc_id").alias("event_id"), F.col("text").alias("content")), 4)


@query(f"""WITH k AS ({_KNN.format(s=_COS, w="")}) SELECT qid, 'vector' AS strategy, 10 AS count, 0 AS reranked, string_agg(rank || ':' || id, ',' ORDER BY rank) AS sections FROM k GROUP BY qid""")
def search_envelope(t):
    """The result of the vector strategy as one row for each query."""
    config = search.SearchConfig("vector")
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    none = t.embeddings.limit(0)
    corpus = search.Corpus(entities=none, events=none, edges=none, chunks=chunks)
    out = search.envelope(search.search(_qv(t), none, corpus, config), _qv(t), config)
    return out.withColumn("sections", F.array_join(F.transform("sections", lambda s: F.concat(s["pos"].cast("string"), F.lit(":"), s["chunk_id"].cast("string"))), ","))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) ORDER BY p_retailprice, p_partkey LIMIT 100")
def entities_by_ids_limited(t):
    wanted = t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return tables.by_ids(t.part, wanted, "p_partkey", "p_retailprice", most=100).select("p_partkey")
