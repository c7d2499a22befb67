"""More of the catalogue: whole search strategies over stored vectors, full text, gold documents and relations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein import providers
from skein.functions import values
from skein.operators import chunking, extraction, fulltext, metrics, vectors
from skein.plans.catalogue import _COS, _gold, _pred, _scalar, query
from skein.plans.search import Corpus, SearchConfig, search
from skein.sources import tables

# ---- strategies: events, chunks and entities share the stored vectors; an event's content vector is its title's, reversed


def _stored(t) -> Corpus:
    e = t.embeddings
    events = e.select(F.col("vec_id").alias("event_id"), F.expr("vec_id div 2").alias("chunk_id"), F.col("embedding").alias("title_vector"), F.reverse("embedding").alias("content_vector"))
    # an edge may come twice: steps over edges give sets
    edges = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id"))
    return Corpus(events, e.select(F.col("vec_id").alias("entity_id"), F.col("embedding").alias("v")), edges, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")))


def _asked(t):
    """Queries, each with two entities: its own vector and the next."""
    q = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    named = q.select("qid", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    named = named.join(t.embeddings, F.col("vec_id") == F.col("qid") + F.col("ord")).select("qid", "ord", F.col("embedding").alias("qv"))
    return q, named


_SEARCH = """q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
    edges AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem),
    direct AS (SELECT qid, vec_id AS chunk_id, {dk} AS score FROM q, embeddings e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 20),
    qe AS (SELECT qid, ord, e.embedding AS v FROM q, (VALUES (0), (1)) o(ord) JOIN embeddings e ON e.vec_id = qid + ord),
    sh AS (SELECT qid, ord, vec_id AS entity_id, round(list_cosine_similarity(qe.v::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM qe, embeddings e QUALIFY row_number() OVER (PARTITION BY qid, ord ORDER BY score DESC, vec_id) <= 20),
    seeds AS (SELECT DISTINCT qid, entity_id FROM sh WHERE score >= 0.9),
    st AS (SELECT qid, event_id FROM edges JOIN seeds USING (entity_id) UNION SELECT qid, chunk_id FROM direct WHERE score >= 0.4),
    p1 AS (SELECT DISTINCT qid, entity_id FROM edges JOIN st USING (event_id) EXCEPT SELECT * FROM seeds),
    e1 AS (SELECT DISTINCT qid, event_id FROM edges JOIN p1 USING (entity_id) EXCEPT SELECT * FROM st),
    es AS (SELECT * FROM st UNION SELECT * FROM e1),
    sc AS (SELECT qid, vec_id AS event_id, {ek} AS score FROM q, embeddings e),
    ra AS (SELECT qid, event_id, score, 1 AS phase FROM es JOIN sc USING (qid, event_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, event_id) <= {most}),
    origin AS ({origin}), sb AS (SELECT DISTINCT qid, entity_id FROM edges JOIN origin USING (event_id)),
    b1 AS (SELECT DISTINCT qid, event_id FROM edges JOIN sb USING (entity_id) EXCEPT SELECT * FROM es),
    rb AS (SELECT qid, event_id, score, 2 AS phase FROM b1 JOIN sc USING (qid, event_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, event_id) <= {most_b}),
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY phase, score DESC, event_id) AS pos FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb)),
    ch AS (SELECT qid, pos, event_id // 2 AS chunk_id, score FROM rk WHERE pos <= {rerank} QUALIFY row_number() OVER (PARTITION BY qid, event_id // 2 ORDER BY pos) = 1),
    al AS (SELECT qid, pos, chunk_id, score, 1 AS src FROM ch UNION ALL SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id), chunk_id, score, 2 FROM direct ANTI JOIN ch USING (qid, chunk_id))"""
_DK = "round(list_cosine_similarity(q.v::DOUBLE[], e.embedding::DOUBLE[]), 6)"
_CK = "round(list_cosine_similarity(q.v::DOUBLE[], list_reverse(e.embedding)::DOUBLE[]), 6)"


def _strategy_sql(vector: str, most: int, most_b: int, rerank: int, origin: str) -> str:
    body = _SEARCH.format(dk=_DK, ek=vector, most=most, most_b=most_b, rerank=rerank, origin=origin)
    return f"WITH {body} SELECT qid, cast(row_number() OVER (PARTITION BY qid ORDER BY src, al.pos) AS INTEGER) AS pos, chunk_id, score AS weight, src FROM al QUALIFY row_number() OVER (PARTITION BY qid ORDER BY src, al.pos) <= 10"


_RANKED = "SELECT qid, event_id FROM ra"
_STRATEGIES = {
    "vector": (SearchConfig("vector"), f"SELECT qid, cast(rank AS INTEGER) AS pos, chunk_id, score AS weight, 1 AS src FROM (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 10"),
    "multi": (SearchConfig("multi"), _strategy_sql(_CK, 100, 0, 10, _RANKED)),
    "atomic": (SearchConfig.atomic(), _strategy_sql(_DK, 1000, 0, 5, _RANKED)),
    "multi1": (SearchConfig("multi1", max_events=5, max_events_b=4, max_hop_retries=1), _strategy_sql(_CK, 5, 4, 10, "SELECT * FROM e1")),
    "hopllm": (SearchConfig("hopllm", max_events_a=5, max_events_b=4, max_hop_retries=1), _strategy_sql(_CK, 5, 4, 10, _RANKED)),
}


def _add_strategy(name: str, config: SearchConfig, sql: str) -> None:
    def run(t):
        return search(*_asked(t), _stored(t), config)

    run.__name__ = f"search_{name}"
    query(sql)(run)


for _name, (_config, _sql) in _STRATEGIES.items():
    _add_strategy(_name, _config, _sql)


@query(f"SELECT q.vec_id AS qid, cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS INTEGER) AS rank, v.vec_id AS event_id, 'e' || v.vec_id AS title, '' AS category, coalesce(n, 0) AS entities FROM embeddings q, embeddings v LEFT JOIN (SELECT l_orderkey, least(count(*), 2) AS n FROM lineitem GROUP BY 1) ON l_orderkey = v.vec_id WHERE q.vec_id % 50 = 0 AND {_COS} >= 0.3 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) <= 3")
def related_events(t):
    events = t.embeddings.select(F.col("vec_id").alias("event_id"), F.concat(F.lit("e"), "vec_id").alias("title"), F.lit(None).cast("string").alias("category"), F.col("embedding").alias("content_vector"))
    links = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("ord"), F.lit("part").alias("type"), F.col("l_partkey").cast("string").alias("name"))
    return extraction.related_events(_asked(t)[0], events, links, least=0.3, most=2).withColumn("entities", F.size("entities").cast("long"))


@query(f"SELECT * FROM (SELECT q.vec_id AS qid, v.vec_id AS id, {_COS} AS score, cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS INTEGER) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.label % 3 = 1) WHERE rank <= 5")
def knn_associations(t):
    links = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.when(F.col("label") % 3 == 1, False).when(F.col("label") % 3 == 2, True).alias("is_delete"))
    return vectors.knn_associations(_asked(t)[0], links, 5).select("qid", "id", "score", "rank")


@query("SELECT vec_id AS id, len(embedding) AS dims FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def vectors_by_id(t):
    ids = t.part.filter("p_size > 25").select(F.col("p_partkey").cast("long").alias("id"))
    return vectors.vectors_of(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), ids).select("id", F.size("v").cast("long").alias("dims"))


@query(f"SELECT q.vec_id AS qid, l_orderkey AS event_id, l_partkey AS entity_id, {_COS} AS score FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN embeddings v ON l_orderkey = v.vec_id JOIN embeddings q ON q.vec_id % 50 = 0 AND l_partkey % 50 = 0 AND q.vec_id // 50 % 7 = l_orderkey % 7")
def pair_scores(t):
    q = _asked(t)[0]
    edges = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")).distinct()
    links = edges.join(t.embeddings.select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("v")), "event_id")
    wanted = edges.filter("entity_id % 50 = 0").withColumn("m", F.col("event_id") % 7).join(q.select("qid", F.expr("qid div 50 % 7").alias("m")), "m").select("qid", "event_id", "entity_id")
    return vectors.pair_scores(wanted, links, q)


# ---- full text over several fields, names, associations

_W = "[x FOR x IN string_split_regex(lower({}), '[^a-z0-9]+') IF x <> '']"


def _field_sql(table: str, key: str, field: str, boost: float, name: str) -> str:
    """CTEs that score one field by BM25."""
    return f"""w{name} AS (SELECT {key} AS doc, {_W.format(f"coalesce({field}, '')")} AS w FROM {table}), a{name} AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w{name}),
    t{name} AS (SELECT doc, term, length, count(*) AS tf FROM (SELECT doc, len(w) AS length, unnest(w) AS term FROM w{name}) WHERE term IN (SELECT term FROM q) GROUP BY ALL), d{name} AS (SELECT term, count(*) AS df FROM t{name} GROUP BY 1),
    s{name} AS (SELECT qid, doc, round(round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 5) * {boost}::DOUBLE, 5) AS score FROM q JOIN t{name} USING (term) JOIN d{name} USING (term), a{name} GROUP BY ALL)"""


def _match_sql(asked: str, fields: list[tuple[str, str, str, float]], k: int) -> str:
    ctes = ", ".join(_field_sql(table, key, field, boost, str(i)) for i, (table, key, field, boost) in enumerate(fields))
    union = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(fields)))
    return f"WITH q AS ({asked}), {ctes}, m AS (SELECT qid, doc, max(score) AS score FROM ({union}) GROUP BY ALL) SELECT qid, doc, score, cast(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM m QUALIFY rank <= {k}"


def _best(out):
    """The documents themselves: equal scores go by id."""
    return out.select("qid", "doc", "score", "rank")


_ASKED = f"SELECT item_id AS qid, unnest(list_distinct({_W.format('text')})) AS term FROM benchmark"


def _terms(t):
    return t.benchmark.select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(fulltext.words("text"))).alias("term"))


@query(_match_sql(_ASKED, [("(SELECT doc_id, substring(text, 1, 80) AS title FROM documents)", "doc_id", "title", 3.0), ("(SELECT doc_id, lang || ' ' || source AS summary FROM documents)", "doc_id", "summary", 2.0), ("documents", "doc_id", "text", 1.0)], 10))
def event_full_text(t):
    docs = t.documents.select("doc_id", F.substring("text", 1, 80).alias("title"), F.concat("lang", F.lit(" "), "source").alias("summary"), F.col("text").alias("content"))
    return _best(fulltext.best_matches(_terms(t), docs, fulltext.EVENT_FIELDS, 10))


@query(_match_sql(_ASKED, [("documents", "doc_id", "source", 2.0), ("documents", "doc_id", "text", 1.0)], 10))
def chunk_full_text(t):
    return _best(fulltext.best_matches(_terms(t), t.documents.select("doc_id", F.col("source").alias("heading"), F.col("text").alias("content")), fulltext.CHUNK_FIELDS, 10))


@query(_match_sql(f"SELECT p_partkey AS qid, unnest(list_distinct({_W.format('p_name')})) AS term FROM part WHERE p_partkey % 50 = 0", [("part", "p_partkey", "p_name", 1.0)], 5))
def entity_name_match(t):
    asked = t.part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.explode(F.array_distinct(fulltext.words("p_name"))).alias("term"))
    return _best(fulltext.match_names(asked, t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")), 5))


@query("SELECT entity_id, name FROM (SELECT p_partkey AS entity_id, p_brand AS name FROM part) WHERE name IN (SELECT p_brand FROM part WHERE p_size < 5) QUALIFY row_number() OVER (PARTITION BY name ORDER BY entity_id) <= 3")
def names_exact_limited(t):
    names = t.part.filter("p_size < 5").select(F.col("p_brand").alias("name"))
    return fulltext.names_exact(t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("name")), names, each=3)


@query("SELECT event_id, entity_id FROM (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem) WHERE entity_id IN (SELECT p_partkey FROM part WHERE p_size = 7) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_id) <= 4")
def associations_by_entity(t):
    edges = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")).distinct()
    return fulltext.associations(edges, t.part.filter("p_size = 7").select(F.col("p_partkey").alias("entity_id")), "entity_id", "event_id", 4)


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) <= 20")
def chunks_by_source(t):
    return fulltext.by_source(t.documents, "source", ["n_chars", "doc_id"], 20).select("doc_id", "source")


# ---- relations, references, embeddings

@query("SELECT o_orderkey AS event_id, (SELECT string_agg(DISTINCT p_partkey || ':' || p_brand, ',' ORDER BY p_partkey || ':' || p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey) AS entities FROM orders WHERE o_orderpriority = '1-URGENT'")
def events_with_entities(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id"))
    x = extraction.with_relations(t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("event_id")), links, t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("name")))
    return x.select("event_id", F.array_join(F.array_sort(F.transform("entities", lambda e: F.concat(e["entity_id"].cast("string"), F.lit(":"), e["name"]))), ",").alias("entities"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def unique_entities(t):
    links = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("entity_id"))
    return extraction.unique_entities(links, t.part.select(F.col("p_partkey").alias("entity_id"), "p_brand")).withColumnRenamed("entity_id", "p_partkey")


@query("SELECT conv_id AS doc_id, turn // 3 AS rank, string_agg(conv_id || '-' || turn, ',' ORDER BY turn) AS sections FROM conversations GROUP BY ALL")
def section_references(t):
    c = t.conversations.select(F.col("conv_id").alias("doc_id"), F.expr("cast(turn div 3 AS bigint)").alias("rank"), F.col("turn").alias("order_index"))
    chunks = c.groupBy("doc_id", "rank").agg(F.array_sort(F.collect_list("order_index")).alias("references"))
    sections = c.select("doc_id", "order_index", F.concat_ws("-", "doc_id", "order_index").alias("section_id"))
    return chunking.section_references(chunks, sections).select("doc_id", "rank", F.array_join("references", ",").alias("sections"))


@query("SELECT conv_id AS doc_id, turn // 3 AS rank, count(*) AS n FROM conversations WHERE turn // 3 % 2 = 0 GROUP BY ALL UNION ALL SELECT DISTINCT conv_id, turn // 3, count(*) OVER (PARTITION BY conv_id) FROM conversations QUALIFY turn // 3 % 2 = 1")
def chunk_sections_or_all(t):
    c = t.conversations.select(F.col("conv_id").alias("doc_id"), F.expr("cast(turn div 3 AS bigint)").alias("rank"), F.col("turn").alias("order_index"))
    chunks = c.groupBy("doc_id", "rank").agg(F.collect_list(F.when(F.col("rank") % 2 == 0, F.col("order_index"))).alias("references"))
    sections = c.select("doc_id", "order_index", F.concat_ws("-", "doc_id", "order_index").alias("section_id"))
    return chunking.chunk_sections(chunks, sections).groupBy("doc_id", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM embeddings) AS rows, (SELECT count(*) FROM embeddings WHERE vec_id % 3 = 0) AS replaced, 0::BIGINT AS missing")
def embedding_upsert(t):
    old = t.embeddings.filter("vec_id % 2 = 0 OR vec_id % 3 = 0").select(F.col("vec_id").alias("id"), vectors.pack_float32("embedding").alias("vec"), F.lit(1).alias("stamp"))
    new = t.embeddings.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), vectors.pack_float32(F.reverse("embedding")).alias("vec"), F.lit(2).alias("stamp"))
    new = new.union(t.embeddings.filter("vec_id % 2 = 1 AND vec_id % 3 <> 0").select("vec_id", vectors.pack_float32("embedding"), F.lit(0)))
    written = extraction.upsert_embeddings(old, new)
    return written.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("stamp") == 2).alias("replaced")).join(F.broadcast(extraction.missing_embeddings(written, new).agg(F.count(F.lit(1)).alias("missing"))))


_STRIP = r"regexp_replace(text, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g')"


@query(f"SELECT doc_id AS chunk_id, substring(split_part({_STRIP}, chr(10), 1), 1, 80) AS title, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{5,}}'))) AS entities FROM documents WHERE {_STRIP} <> ''")
def extracted_events(t):
    chunks = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return extraction.extract_events(chunks, providers.rule_events).filter("event_rank is not null").select("chunk_id", "title", F.size("entities").cast("long").alias("entities"))


@query("SELECT item_id AS qid, count(DISTINCT n) AS named FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS n FROM benchmark) GROUP BY 1")
def query_entities(t):
    return providers.query_entities(t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))).groupBy("qid").agg(F.count(F.lit(1)).alias("named"))


# ---- values that a model or a constraint states

_scalar("value_with_unit", lambda: values.parse_with_unit(F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "个人").otherwise("人")), "人")["number"], "cast(l_quantity AS INTEGER)::DOUBLE", "lineitem", ("l_orderkey", "l_linenumber"))
_scalar("value_strict_int", lambda: values.parse_strict(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5"))), "int")["number"], "CASE WHEN l_linenumber % 2 = 0 THEN cast(l_quantity AS INTEGER)::DOUBLE END", "lineitem", ("l_orderkey", "l_linenumber"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'text' ELSE 'bool' END AS value_type, CASE o_orderkey % 3 WHEN 0 THEN 'total' || o_custkey || 'kg' WHEN 1 THEN o_orderpriority ELSE '已' END AS value_raw,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS int_value, CASE WHEN o_orderkey % 3 = 0 THEN 'kg' END AS value_unit, CASE WHEN o_orderkey % 3 < 2 THEN 'llm' ELSE 'code' END AS value_source FROM orders""")
def value_stated(t):
    m = F.col("o_orderkey") % 3
    name = F.when(m == 0, "total").when(m == 1, F.col("o_orderpriority")).otherwise("已")
    kind = F.when(m == 0, "int").when(m == 1, "text").otherwise("none such")
    cols = values.stated_or_parsed(name, kind, F.when(m == 0, F.col("o_custkey").cast("string")), F.when(m == 0, "kg"))
    return t.orders.select("o_orderkey", *cols).select("o_orderkey", "value_type", "value_raw", "int_value", "value_unit", "value_source")


# ---- gold documents and recall

def _questions(t):
    d = t.documents
    sentences = F.to_json(F.array(F.lit(" one."), F.col("lang"), F.lit("two. ")))
    other = F.to_json(F.array(F.lit("three")))
    paragraph = lambda title, body, ok: F.struct(F.lit(0).alias("idx"), title.alias("title"), body.alias("paragraph_text"), ok.alias("is_supporting"))
    return d.select(
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("").alias("id"), F.concat(F.lit("x"), "doc_id").alias("_id"),
        F.array(F.array(F.col("source"), sentences), F.array(F.lit("B"), other), F.array(F.lit("C"), other)).alias("context"),
        F.array(F.array(F.lit("B"), F.lit("0")), F.array(F.col("source"), F.lit("0")), F.array(F.lit("B"), F.lit("1")), F.array(F.lit("Z"), F.lit("0"))).alias("supporting_facts"),
        F.when(F.col("doc_id") % 3 == 0, F.array(paragraph(F.lit("P"), F.col("text"), F.lit(True)), paragraph(F.lit("Q"), F.lit("no"), F.lit(False)))).alias("paragraphs"),
    )


_QID = "CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'x' || doc_id END AS qid"


@query(f"""SELECT {_QID}, 'joined' AS style, idx, CASE idx WHEN 0 THEN source || chr(10) || ' one.' || lang || 'two. ' ELSE 'B' || chr(10) || 'three' END AS doc FROM documents, (VALUES (0), (1)) v(idx)
    UNION ALL SELECT {_QID}, 'spaced', idx, CASE idx WHEN 0 THEN source || chr(10) || ' one. ' || lang || ' two. ' ELSE 'B' || chr(10) || 'three' END FROM documents, (VALUES (0), (1)) v(idx)
    UNION ALL SELECT {_QID}, 'paragraphs', 0, 'P' || chr(10) || text FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT {_QID}, 'stripped', 0, 'P' || chr(10) || text FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT {_QID}, 'stripped', idx, CASE idx WHEN 1 THEN source || chr(10) || 'one. ' || lang || ' two.' ELSE 'B' || chr(10) || 'three' END FROM documents, (VALUES (0), (1)) v(idx) WHERE doc_id % 3 <> 0""")
def gold_documents(t):
    out = None
    for style in ("joined", "spaced", "paragraphs", "stripped", "other"):
        x = metrics.gold_documents(_questions(t), style).select("qid", F.lit(style).alias("style"), "idx", "doc")
        out = x if out is None else out.union(x)
    return out


_INDEXED = "g AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc) AS idx, doc % 7 AS doc FROM gold), p AS (SELECT qid, pos, doc % 7 AS doc FROM pred)"


def _indexed(t):
    found = _gold(t)
    gold = found.withColumn("idx", F.row_number().over(Window.partitionBy("qid").orderBy("doc"))).withColumn("doc", F.col("doc") % 7)
    return _pred(t, found).withColumn("doc", F.col("doc") % 7), gold


def _gold_pred_sql() -> str:
    from skein.plans.catalogue import _GOLD

    return f"WITH {_GOLD}, {_INDEXED}"


@query(_gold_pred_sql() + " SELECT qid, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM p WHERE p.qid = g.qid AND p.doc = g.doc AND pos <= 3)) / count(*)::DOUBLE, 6) AS recall FROM g GROUP BY qid")
def recall_by_index(t):
    return metrics.recall_by_index(*_indexed(t), 3)


@query(_gold_pred_sql() + """, f AS (SELECT g.qid, idx, (SELECT min(pos) FROM p WHERE p.qid = g.qid AND p.doc = g.doc) AS first FROM g), r AS (SELECT qid, k, count(*) FILTER (WHERE first <= k) / count(*)::DOUBLE AS recall FROM f, (VALUES (1), (3), (8)) v(k) GROUP BY ALL)
    SELECT k, round(avg(recall), 6) AS mean_recall, count(*) FILTER (WHERE recall >= 1) AS "full", count(*) FILTER (WHERE recall > 0 AND recall < 1) AS partial, count(*) FILTER (WHERE recall = 0) AS zero, coalesce(string_agg(qid, ',' ORDER BY qid) FILTER (WHERE recall = 0), '') AS without FROM r GROUP BY k""")
def recall_table(t):
    return metrics.recall_table(*_indexed(t), [1, 3, 8]).withColumn("without", F.array_join(F.col("without").cast("array<string>"), ","))


@query(_gold_pred_sql() + """, n AS (SELECT item_id AS qid FROM benchmark), f AS (SELECT DISTINCT qid, doc, (SELECT min(pos) FROM p WHERE p.qid = g.qid AND p.doc = g.doc) AS first FROM g),
    r AS (SELECT n.qid, k, coalesce(count(*) FILTER (WHERE first <= k) / nullif(count(doc), 0)::DOUBLE, 0) AS recall FROM n LEFT JOIN f USING (qid), (VALUES (1), (5), (10), (20)) v(k) GROUP BY ALL)
    SELECT k, round(avg(recall), 4) AS recall FROM r GROUP BY k""")
def pooled_recall(t):
    pred, gold = _indexed(t)
    return metrics.pooled_recall(pred, gold, t.benchmark.select(F.col("item_id").alias("qid")), [1, 5, 10, 20])


@query(_gold_pred_sql() + """, w AS (SELECT qid, count(*) AS n FROM g GROUP BY qid), h AS (SELECT qid, count(*) AS hits FROM p WHERE EXISTS (SELECT 1 FROM g WHERE g.qid = p.qid AND g.doc = p.doc) GROUP BY qid)
    SELECT CASE WHEN coalesce(hits, 0) = 0 THEN 'zero' WHEN hits < n THEN 'partial' ELSE 'full' END AS class, count(*) AS n FROM w LEFT JOIN h USING (qid) GROUP BY 1""")
def recall_hit_classes(t):
    return metrics.hit_classes(*_indexed(t))


@query(_gold_pred_sql() + """, m AS (SELECT least((SELECT max(qid) FROM p), (SELECT max(qid) FROM g WHERE qid < 30)) AS q), f AS (SELECT g.qid, idx, (SELECT min(pos) FROM p WHERE p.qid = g.qid AND p.doc = g.doc) AS first FROM g, m WHERE g.qid < 30 AND g.qid <= q),
    r AS (SELECT qid, k, count(*) FILTER (WHERE first <= k) / count(*)::DOUBLE AS recall FROM f, (VALUES (1), (2), (5), (10)) v(k) GROUP BY ALL)
    SELECT k, round(avg(recall), 6) AS mean_recall, count(*) FILTER (WHERE recall >= 1) AS "full", count(*) FILTER (WHERE recall > 0 AND recall < 1) AS partial, count(*) FILTER (WHERE recall = 0) AS zero FROM r GROUP BY k""")
def recall_truncated(t):
    """Both sides cut to the shorter one's questions: here the gold side ends at 30."""
    pred, gold = _indexed(t)
    pred, gold = metrics.truncate_pairs(pred, gold.filter("qid < 30"))
    return metrics.recall_table(pred, gold, [1, 2, 5, 10]).drop("without")


@query("SELECT count(*) AS chunks, (SELECT count(*) FROM lineitem) AS events, round((SELECT count(*) FROM lineitem) / count(*)::DOUBLE, 2) AS events_per_chunk FROM orders")
def stage_stats(t):
    return metrics.stage_stats(t.orders, t.lineitem)


@query("SELECT doc_id FROM documents WHERE doc_id BETWEEN 17 AND 60")
def index_range(t):
    return metrics.index_range(t.documents.select("doc_id"), "doc_id", 17, 60)


@query("SELECT doc_id FROM documents WHERE CASE doc_id % 3 WHEN 0 THEN false WHEN 1 THEN true END = false")
def not_removed(t):
    return t.documents.withColumn("is_delete", F.when(F.col("doc_id") % 3 == 0, False).when(F.col("doc_id") % 3 == 1, True)).filter(extraction.not_removed(F.col("is_delete"))).select("doc_id")


@query("SELECT source, doc_id AS path FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) = 1")
def newest_of_each(t):
    x = t.documents.select("source", F.col("doc_id").alias("path"), F.struct("n_chars", "doc_id").alias("stamp"))
    return tables.latest_snapshot(x, ["source"]).select("source", "path")

