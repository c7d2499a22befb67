"""Queries over stored indexes and trees, added to the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import jsonx
from skein.operators import chunk_plan, fulltext, graph, text_index, vector_index, vectors
from skein.operators.lineage import folder
from skein.plans.catalogue import _COS, _KNN, _S, _qv, _v, query
from skein.plans.catalogue_search import _ASKED, _W, _match_sql, _terms

# ---- vectors


def _broken(t):
    """Vectors of which a third is null, empty, short, or holds a null, NaN or infinity."""
    v, i = F.col("embedding"), F.col("vec_id")
    bad = lambda x: F.transform(v, lambda y, at: F.when(at == 5, F.lit(x).cast("float")).otherwise(y))
    v = F.when(i % 6 == 1, bad(float("nan"))).when(i % 7 == 1, bad(float("-inf"))).when(i % 11 == 1, bad(None)).when(i % 13 == 1, F.slice(v, 1, 0)).when(i % 17 == 1, F.slice(v, 1, 30)).when(i % 19 != 1, v)
    return t.embeddings.select(F.col("vec_id").alias("id"), v.alias("v"))


_WHOLE = "AND v.vec_id % 6 <> 1 AND v.vec_id % 7 <> 1 AND v.vec_id % 11 <> 1 AND v.vec_id % 13 <> 1 AND v.vec_id % 17 <> 1 AND v.vec_id % 19 <> 1"
_BROKEN = _KNN.format(s=_COS, w=_WHOLE + " " + _WHOLE.replace("v.vec_id", "q.vec_id"))


def _broken_queries(t):
    return _broken(t).filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))


@query(_BROKEN)
def knn_broken_vectors(t):
    return vectors.knn(_broken_queries(t), _broken(t), 10).select("qid", "id", "score", "rank")


def _index(t, rows, **options):
    path = folder(t.spark, "vectors")
    vector_index.build_index(rows, path, **options)
    return path


@query(_KNN.format(s=_COS, w=""))
def knn_indexed(t):
    """The stored index with all cells probed: exact by the codes' bounds."""
    return vector_index.search_index(t.spark, _index(t, _v(t)), _qv(t), 10)


@query(_BROKEN)
def knn_indexed_broken(t):
    return vector_index.search_index(t.spark, _index(t, _broken(t)), _broken_queries(t), 10)


@query("SELECT count(*) AS queries, true AS enough, true AS pruned FROM embeddings WHERE vec_id % 50 = 0")
def knn_probed_recall(t):
    """The cells that the index's sample calls for at a recall of 0.95, and 100 candidates a query: nine tenths of the exact neighbours, without the other cells' files."""
    path = _index(t, _v(t))
    cells, probes = t.spark.read.parquet(f"{path}/cells").count(), vector_index.probes_for(t.spark, path, 0.95)
    found = vector_index.search_index(t.spark, path, _qv(t), 10, probes=probes, num_candidates=100)
    exact = vectors.knn(_qv(t), _v(t), 10)
    return vector_index.recall(found, exact).agg(F.count(F.lit(1)).alias("queries"), (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("enough"), F.lit(probes < cells).alias("pruned"))


# ---- text


def _indexed(t, docs, key, boosts, asked, k, **options):
    path = folder(t.spark, "text")
    text_index.build_text_index(docs, path, key, boosts, **options)
    return text_index.search_text_index(t.spark, path, asked, k)


@query(_match_sql(_ASKED, [("(SELECT doc_id, substring(text, 1, 80) AS title FROM documents)", "doc_id", "title", 3.0), ("(SELECT doc_id, lang || ' ' || source AS summary FROM documents)", "doc_id", "summary", 2.0), ("documents", "doc_id", "text", 1.0)], 10))
def event_full_text_indexed(t):
    docs = t.documents.select("doc_id", F.substring("text", 1, 80).alias("title"), F.concat("lang", F.lit(" "), "source").alias("summary"), F.col("text").alias("content"))
    return _indexed(t, docs, "doc_id", fulltext.EVENT_FIELDS, _terms(t), 10, rows_each=128)


@query(_match_sql(_ASKED, [("documents", "doc_id", "source", 2.0), ("documents", "doc_id", "text", 1.0)], 10))
def chunk_full_text_indexed(t):
    docs = t.documents.select("doc_id", F.col("source").alias("heading"), F.col("text").alias("content"))
    return _indexed(t, docs, "doc_id", fulltext.CHUNK_FIELDS, _terms(t), 10)


@query(_match_sql(f"SELECT p_partkey AS qid, unnest(list_distinct({_W.format('p_name')})) AS term FROM part WHERE p_partkey % 50 = 0", [("part", "p_partkey", "p_name", 1.0)], 5))
def entity_name_match_indexed(t):
    asked = t.part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.explode(F.array_distinct(fulltext.words("p_name"))).alias("term"))
    return _indexed(t, t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")), "entity_id", {"name": 1.0}, asked, 5, rows_each=64)


@query(f"""WITH q AS ({_ASKED}), w AS (SELECT doc_id, {_W.format("text")} AS w FROM documents), r AS (SELECT w, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS r FROM w)
    SELECT qid, count(*) AS blocks, true AS some_skipped FROM q JOIN (SELECT DISTINCT r, unnest(w) AS term FROM r) USING (term) GROUP BY qid""")
def text_index_blocks(t):
    """How many postings blocks a query's terms have, and that the search didn't open more."""
    path, counts = folder(t.spark, "text"), []
    text_index.build_text_index(t.documents.select("doc_id", "text"), path, "doc_id", {"text": 1.0}, rows_each=64)
    text_index.search_text_index(t.spark, path, _terms(t), 10, counts)
    return counts[0].select("qid", "blocks", (F.col("opened") <= F.col("blocks")).alias("some_skipped"))


# ---- trees

_LEVELS = 12
_PART = f"substring(text, cast(level * ceil(length(text) / {_LEVELS}.0) + 1 AS BIGINT), cast(ceil(length(text) / {_LEVELS}.0) AS BIGINT))"


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, text, 0 AS level, '0' AS path, NULL::VARCHAR AS parent FROM documents
    UNION ALL SELECT doc_id, text, level + 1, path || '.0', path FROM r WHERE level < {_LEVELS - 1} AND (doc_id + level) % 9 <> 0)
    SELECT doc_id, path, parent, level, {_PART} AS title FROM r WHERE (doc_id + level) % 9 <> 0
    UNION ALL SELECT doc_id, CASE WHEN level = 0 THEN '1' ELSE parent || '.1' END, parent, level, 'leaf' FROM r""")
def json_deep_tree(t):
    """Whole texts in twelve nested items; an invalid one takes all below it along, not its sibling."""
    size = F.ceil(F.length("text") / F.lit(float(_LEVELS))).cast("int")
    item = lambda acc, n: F.concat(
        F.lit("["), F.regexp_replace(F.to_json(F.struct(F.substring(F.col("text"), (n * size + 1).cast("int"), size).alias("title"))), r"\}\z", ""), F.lit(',"is_valid":'),
        ((F.col("doc_id") + n) % 9 != 0).cast("string"), F.lit(',"children":'), acc, F.lit('},{"title":"leaf"}]'),
    )
    nested = F.aggregate(F.sequence(F.lit(_LEVELS - 1), F.lit(0)), F.lit("[]"), item)
    return jsonx.flatten_children(t.documents.select("doc_id", nested.alias("j")), "doc_id", "j")


@query(f"""WITH l AS (SELECT doc_id, text, unnest(range({_LEVELS}))::INTEGER AS level FROM documents)
    SELECT doc_id, {2 * _LEVELS}::BIGINT AS items, {_LEVELS}::BIGINT + count(*) FILTER (WHERE (doc_id + level) % 5 = 0) AS no_references, count(*) FILTER (WHERE trim({_PART}) = '') AS no_title,
        {_LEVELS}::BIGINT AS no_content, CASE WHEN doc_id % 2 = 0 THEN 'alien' ELSE '' END AS unknown_types FROM l GROUP BY doc_id""")
def answer_quality(t):
    """Soft counts over whole texts in twelve nested items, invalid ones included."""
    size = F.ceil(F.length("text") / F.lit(float(_LEVELS))).cast("int")
    kind = F.when(F.col("doc_id") % 2 == 0, "alien").otherwise("person")
    item = lambda acc, n: F.concat(
        F.lit("["), F.regexp_replace(F.to_json(F.struct(F.substring(F.col("text"), (n * size + 1).cast("int"), size).alias("title"), F.lit("c").alias("content"), F.array(F.struct(kind.alias("type"), F.lit("n").alias("name"))).alias("entities"))), r"\}\z", ""),
        F.lit(',"is_valid":'), ((F.col("doc_id") + n) % 9 != 0).cast("string"), F.lit(',"references":'), F.when((F.col("doc_id") + n) % 5 == 0, "[]").otherwise("[1]"), F.lit(',"children":'), acc, F.lit('},{"title":"leaf"}]'),
    )
    nested = F.aggregate(F.sequence(F.lit(_LEVELS - 1), F.lit(0)), F.lit("[]"), item)
    out = jsonx.answer_quality(t.documents.select("doc_id", nested.alias("j")), "doc_id", "j", ["person", "place"])
    return out.withColumn("unknown_types", F.array_join("unknown_types", ","))


_PARENT = "CASE WHEN doc_id % 40 = 0 THEN NULL WHEN doc_id % 40 = 39 THEN -1 - doc_id WHEN doc_id % 40 < 25 THEN doc_id - 1 ELSE doc_id - doc_id % 40 + (doc_id % 40) // 2 END"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {_PARENT} AS parent_id FROM documents),
    r AS (SELECT id, parent_id, id AS root, 0::BIGINT AS level FROM d WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM d)
    UNION ALL SELECT d.id, d.parent_id, r.root, r.level + 1 FROM d JOIN r ON d.parent_id = r.id) SELECT * FROM r""")
def event_tree(t):
    """Chains of 24 levels with branches, and rows whose parent is missing."""
    return graph.tree_levels(t.documents.select(F.col("doc_id").alias("id"), F.expr(_PARENT.replace("//", "div")).alias("parent_id")))


# ---- chunks

_SOLID = _S.replace("[", "[^", 1)
def _stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_ENDS = {1: r"\r\n\r\n|\n\n|\r\n|\n|\r|。|！|？|!|\?|\. ", 2: "[，,、；;]"}


def _glued(name: str, source: str, keys: str, ends: str) -> str:
    """Parts up to each end sign; a blank part counts to the group of the solid one before it, a leading one to the first."""
    return rf"""{name}_a AS (SELECT {keys}, unnest(x) AS part, unnest(range(len(x))) AS n FROM (SELECT *, regexp_extract_all(part, '(?s).*?(?:{ends})|(?s).+') AS x FROM {source})),
    {name}_b AS (SELECT *, greatest(1, count(*) FILTER (regexp_matches(part, '{_SOLID}')) OVER (PARTITION BY {keys} ORDER BY n)) AS g FROM {name}_a),
    {name} AS (SELECT {keys}, g AS {name}_n, string_agg(part, '' ORDER BY n) AS part FROM {name}_b GROUP BY {keys}, g)"""


def _sections_sql(blocks: str, most: int) -> str:
    """Texts without Han signs: a token is four signs, so a forced part has 4 * most + 3 of them."""
    size = 4 * most + 3
    return rf"""blocks AS (SELECT doc_id, unnest([0, 1, 2]) AS block, unnest({blocks}) AS part FROM documents), {_glued("one", "blocks", "doc_id, block", _ENDS[1])},
    long AS (SELECT * FROM one WHERE length(part) // 4 > {most}), {_glued("two", "long", "doc_id, block, one_n", _ENDS[2])},
    every AS (SELECT doc_id, block, one_n, 0 AS two_n, 0 AS three_n, part FROM one WHERE length(part) // 4 <= {most} UNION ALL SELECT doc_id, block, one_n, two_n, 0, part FROM two WHERE length(part) // 4 <= {most}
        UNION ALL SELECT doc_id, block, one_n, two_n, k, substring(part, k * {size} + 1, {size}) FROM (SELECT *, unnest(range(cast(ceil(length(part) / {size}.0) AS INTEGER))) AS k FROM two WHERE length(part) // 4 > {most})),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, one_n, two_n, three_n) AS i FROM every),
    grouped AS (SELECT *, min(i) OVER (PARTITION BY doc_id, block) AS render, greatest(1, count(*) FILTER (regexp_matches(part, '{_SOLID}')) OVER (PARTITION BY doc_id ORDER BY i)) AS g, regexp_matches(part, '{_SOLID}') AS solid FROM numbered),
    sections AS (SELECT doc_id, cast(g - 1 AS INTEGER) AS order_index, cast(arg_min(render, i) FILTER (solid) AS INTEGER) AS render_group_index, arg_min(block, i) FILTER (solid) AS block, string_agg(part, '' ORDER BY i) AS text FROM grouped GROUP BY doc_id, g)"""


_MD = "[' ' || chr(10) || chr(10), '# doc ' || doc_id || chr(10) || text || chr(10), '### ' || coalesce(source, '-') || chr(10) || text]"
_HEADS = "['', 'doc ' || doc_id, (SELECT coalesce(source, '-') FROM documents x WHERE x.doc_id = s.doc_id)]"


def _md(t):
    return t.documents.select("doc_id", F.concat(F.lit(" \n\n# doc "), "doc_id", F.lit("\n"), "text", F.lit("\n### "), F.coalesce("source", F.lit("-")), F.lit("\n"), "text").alias("text"))


def _chunks_sql(section_most: int, most: int, alone: int, strict: bool) -> str:
    other = "OR s.block <> r.block" if strict else ""
    fresh = f"NOT r.open OR s.tokens > {alone} OR r.used + s.tokens > {most} {other}"
    return rf"""WITH RECURSIVE {_sections_sql(_MD, section_most)},
    s AS MATERIALIZED (SELECT *, {_stripped("text")} AS body, length({_stripped("text")}) // 4 AS tokens FROM sections),
    r AS (SELECT doc_id, order_index AS i, 0 AS rank, tokens AS used, tokens <= {alone} AS open, block FROM s WHERE order_index = 0
        UNION ALL SELECT s.doc_id, s.order_index, CASE WHEN {fresh} THEN r.rank + 1 ELSE r.rank END, CASE WHEN {fresh} THEN s.tokens ELSE r.used + s.tokens END, s.tokens <= {alone}, s.block
        FROM r JOIN s ON s.doc_id = r.doc_id AND s.order_index = r.i + 1)
    SELECT doc_id, r.rank, CASE arg_min(s.block, i) WHEN 1 THEN 'doc ' || doc_id ELSE (SELECT coalesce(d.source, '-') FROM documents d WHERE d.doc_id = s.doc_id) END AS heading,
        {_stripped("string_agg(s.body, chr(10) ORDER BY i)")} AS content, md5(string_agg(CASE WHEN s.tokens > {alone} THEN s.body ELSE s.text END, '' ORDER BY i)) AS raw_md5, string_agg(i, ',' ORDER BY i) AS sections,
        list_sort(list(DISTINCT s.render_group_index))[1] AS render_group FROM r JOIN s ON s.doc_id = r.doc_id AND s.order_index = r.i GROUP BY s.doc_id, r.rank""".replace("SELECT doc_id, r.rank", "SELECT s.doc_id, r.rank").replace("'doc ' || doc_id ELSE", "'doc ' || s.doc_id ELSE")


def _chunk_columns(out):
    return out.select("doc_id", "rank", "heading", "content", F.md5("raw_content").alias("raw_md5"), F.array_join("references", ",").alias("sections"), F.get("render_groups", F.lit(0)).alias("render_group"))


@query(_chunks_sql(250, 1000, 600, False))
def chunk_standard(t):
    """Whole texts twice, under two headings, behind a blank beginning."""
    return _chunk_columns(chunk_plan.chunks_native(_md(t)))


@query(_chunks_sql(60, 90, 45, True))
def chunk_standard_strict(t):
    """Small limits: long parts are cut by force, large sections stand alone, and headings break chunks."""
    return _chunk_columns(chunk_plan.chunks_native(_md(t), 90, 60, strict=True, alone=45))


@query(f"WITH {_sections_sql(_MD, 60)} SELECT doc_id, order_index, render_group_index, CASE block WHEN 1 THEN 'doc ' || doc_id ELSE (SELECT coalesce(d.source, '-') FROM documents d WHERE d.doc_id = s.doc_id) END AS heading, text FROM sections s")
def section_rows(t):
    return chunk_plan.section_rows(_md(t), 60)
