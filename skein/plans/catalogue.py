"""Every operator as a query over the test tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import providers
from skein.functions import jsonx, text, time, values
from skein.operators import chunking, extraction, fulltext, graph, metrics, vectors
from skein.operators.lineage import cut
from skein.plans.search import Corpus, SearchConfig, assemble_candidates, recall_channels, search
from skein.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- text

DOC = "'# doc ' || doc_id || chr(10) || text || chr(10) || '  ### '  || text"


def _scalar(name: str, make: Callable, sql: str, table: str = "documents", key: tuple[str, ...] = ("doc_id",), where: str | None = None) -> None:
    """A query that applies one expression to each row of a table."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{table}.parquet")
        return (df.filter(where) if where else df).select(*key, make().alias("value"))

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(key)}, {sql} AS value FROM {table}" + (f" WHERE {where}" if where else "")


_t = lambda: F.col("text")
_S = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"  # white space beyond ASCII, as the operators see it
_scalar("text_normalize", lambda: text.normalize_text(_t()), r"trim(regexp_replace(text, '[\s\x0B\x85\p{Z}]+', ' ', 'g'))")
_scalar("text_entity_name", lambda: text.normalize_entity_name(_t()), rf"trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\s\x0B\x1C-\x1F\x85\p{{Z}}]', '', 'g'), '{_S}+', ' ', 'g'))")
_scalar("text_headings", lambda: F.array_join(text.markdown_headings(F.concat(F.lit("# doc "), "doc_id", F.lit("\n"), "text", F.lit("\n  ### "), "text")), "|"), rf"array_to_string([regexp_replace(s, '^(#{{1,6}}){_S}+(.+)$', '\1 \2') FOR s IN list_transform(string_split({DOC}, chr(10)), lambda l: regexp_replace(l, '^{_S}+|{_S}+$', '', 'g')) IF regexp_matches(s, '^#{{1,6}}{_S}+.+$')], '|')")
_scalar("text_hash", lambda: text.text_hash(_t()), "md5(text)")
_scalar("text_truncate", lambda: text.truncate_text(_t(), 100), "CASE WHEN length(text) > 100 THEN substring(text, 1, 97) || '...' ELSE text END")
_scalar("text_heading", lambda: text.normalize_heading(F.concat(F.lit("## [a "), "doc_id", F.lit("](http://x) "), _t())), "[CASE WHEN length(x) > 500 THEN regexp_replace(substring(x, 1, 497), '" + _S + "+$', '') || '...' ELSE x END FOR x IN [trim(regexp_replace(regexp_replace(regexp_replace('## [a ' || doc_id || '](http://x) ' || text" + r", '^#{1,6}\s*', ''), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '" + _S + "+', ' ', 'g'))]][1]")
_scalar("text_paragraphs", lambda: F.array_join(text.paragraphs(_t()), "|"), r"array_to_string([regexp_replace(p, '^\s+|\s+$', '', 'g') FOR p IN string_split(text, chr(10) || chr(10)) IF regexp_replace(p, '^\s+|\s+$', '', 'g') <> ''], '|')")
_scalar("text_han_count", lambda: text.han_count(F.concat("text", F.lit("三百元"))), r"length(regexp_replace(text || '三百元', '[^\x{4e00}-\x{9fff}]', '', 'g'))")
_scalar("text_tokens", lambda: text.estimate_tokens(_t()), "cast(trunc(length(text) / 4.0) AS INTEGER)")
_scalar("text_tokens_weighted", lambda: text.estimate_tokens_weighted(_t()), r"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, cast(trunc(len(regexp_extract_all(text, '[a-zA-Z]+')) * 1.3 + length(regexp_replace(text, '[a-zA-Z\s\x0B]', '', 'g')) * 0.5) AS INTEGER)) END")
_scalar("text_clean_whitespace", lambda: text.clean_whitespace(_t()), r"array_to_string([regexp_replace(s, '^\s+|\s+$', '', 'g') FOR s IN string_split(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))], chr(10))")
_scalar("text_cut_to_tokens", lambda: text.cut_to_tokens(_t(), 200), "CASE WHEN trunc(length(text) / 4.0) > 200 THEN substring(text, 1, cast(trunc(length(text) * (200.0::DOUBLE / trunc(length(text) / 4.0)) * 0.9::DOUBLE) AS INTEGER)) ELSE text END")
_scalar("text_sentences", lambda: F.size(text.sentences(_t())), r"len([s FOR s IN regexp_split_to_array(text, '[.!?]+') IF regexp_replace(s, '^\s+|\s+$', '', 'g') <> ''])")
_bare = r"regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g')"
for _ in range(2):  # a word of its own, also beside accented letters; twice, since neighbours share the sign between them
    _bare = rf"regexp_replace({_bare}, '(^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:a|an|the)($|[^\p{{L}}\p{{M}}\p{{N}}_])', '\1 \2', 'g')"
_scalar("text_answer", lambda: text.normalize_answer(_t()), f"trim(regexp_replace({_bare}, '{_S}+', ' ', 'g'))")
_scalar("text_section", lambda: text.section_text(F.col("source"), F.concat("source", F.lit("\n"), "text")), "source || chr(10) || text")
_scalar("text_section_markdown", lambda: text.section_markdown(F.col("source"), _t()), "'# ' || source || chr(10) || text")
_scalar("text_previous_context", lambda: text.previous_context(_t()), "CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '…' ELSE text END")
_scalar("text_chunk_embedding", lambda: text.chunk_embedding_text(F.col("source"), _t()), "source || chr(10) || chr(10) || substring(text, 1, 1024)")
_scalar("text_event_embedding", lambda: text.event_embedding_text(F.lit(""), _t()), "substring(text, 1, 500)")
_scalar("text_link_embedding", lambda: text.link_embedding_text(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.col("doc_id").cast("string"), F.col("source")), "CASE WHEN doc_id % 2 = 0 THEN lang ELSE doc_id || '-' || source END")

# ---- time

NOW = "2024-02-15 12:00:00"
_now = lambda: F.lit(NOW).cast("timestamp")
_e = ("event_id",)
_scalar("time_parse_iso", lambda: time.parse_iso(F.when(F.col("event_id") % 3 == 0, "no date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))), "CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END", "events", _e)
_scalar("time_format", lambda: time.format_time(F.col("ts")), "strftime(ts, '%Y-%m-%d %H:%M:%S')", "events", _e)
_secs = f"(epoch_us(TIMESTAMP '{NOW}') // 1000000 - epoch_us(ts) // 1000000)"
_ago = lambda just, *unit: f"CASE WHEN {_secs} < 60 THEN '{just}' WHEN {_secs} < 3600 THEN ({_secs} // 60) || '{unit[0]}' WHEN {_secs} < 86400 THEN ({_secs} // 3600) || '{unit[1]}' WHEN {_secs} < 2592000 THEN ({_secs} // 86400) || '{unit[2]}' ELSE ({_secs} // 2592000) || '{unit[3]}' END"
_scalar("time_ago", lambda: time.time_ago(F.col("ts"), _now()), _ago("刚刚", "分钟前", "小时前", "天前", "个月前"), "events", _e)
_scalar("time_ago_english", lambda: time.time_ago(F.col("ts"), _now(), "en"), _ago("just now", " minutes ago", " hours ago", " days ago", " months ago"), "events", _e)
_scalar("time_decay", lambda: F.round(time.time_decay(F.col("ts"), _now()), 8), f"round(exp(-0.1::DOUBLE * ({_secs} // 86400)), 8)", "events", _e)
_scalar("time_shanghai", lambda: time.to_shanghai(F.col("ts")), "ts + INTERVAL 8 HOUR", "events", _e)
_scalar("time_naive_utc", lambda: time.to_naive_utc(F.col("ts"), "+02:00"), "ts - INTERVAL 2 HOUR", "events", _e)


@query("""SELECT event_id FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 HOUR END AS te FROM events)
    WHERE ts <= TIMESTAMP '2024-01-10 12:00:00' AND ((te IS NOT NULL AND te >= TIMESTAMP '2024-01-10 00:00:00') OR (te IS NULL AND ts >= TIMESTAMP '2024-01-10 00:00:00'))""")
def event_time_range(t):
    x = t.events.withColumn("te", F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 2 HOURS")))
    return x.filter(time.overlaps(F.col("ts"), F.col("te"), "2024-01-10 00:00:00", "2024-01-10 12:00:00")).select("event_id")


# ---- typed values

_units = ("万元", "吨", "小时", "km", "瓶", "cm")
_scalar("value_number", lambda: F.round(values.parse_number(F.concat(F.col("l_quantity").cast("int").cast("string"), F.element_at(F.array(*map(F.lit, _units)), (F.col("l_partkey") % 6 + 1).cast("int"))))["number"], 6), "round(cast(l_quantity AS INTEGER) * list_extract(cast([10000.0, 1000.0, 3600.0, 1000.0, 1.0, 0.01] AS DOUBLE[]), l_partkey % 6 + 1), 6)", "lineitem", ("l_orderkey", "l_linenumber"))
_scalar("value_datetime", lambda: values.parse_datetime(F.date_format("o_orderdate", "yyyy年M月d日"))["moment"], "date_trunc('day', o_orderdate)", "orders", ("o_orderkey",))
_scalar("value_compact_datetime", lambda: values.parse_compact_datetime(F.date_format("o_orderdate", "yyyyMMdd"))["moment"], "date_trunc('day', o_orderdate)", "orders", ("o_orderkey",))
_scalar("value_bool", lambda: values.parse_bool(F.element_at(F.array(*map(F.lit, ("Yes", "no", "maybe", "是", "已", "未", "启用", "关闭", "y", "1"))), (F.col("o_orderkey") % 10 + 1).cast("int")))["flag"], "CASE WHEN o_orderkey % 10 IN (0, 3, 4, 6) THEN true WHEN o_orderkey % 10 IN (1, 5, 7) THEN false END", "orders", ("o_orderkey",))
_scalar("value_enum", lambda: values.parse_enum(F.col("o_orderpriority"), ["1-URGENT", "HIGH"])["label"], "CASE WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT' WHEN contains('1-URGENT', o_orderpriority) OR contains(o_orderpriority, '1-URGENT') THEN '1-URGENT' WHEN contains(o_orderpriority, 'HIGH') OR contains('HIGH', o_orderpriority) THEN 'HIGH' ELSE 'UNKNOWN' END", "orders", ("o_orderkey",))
_scalar("value_parse", lambda: values.parse_value(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.lit("3.5万")).otherwise(F.col("o_orderpriority")))["type"], "CASE o_orderkey % 3 WHEN 0 THEN 'datetime' WHEN 1 THEN 'int' ELSE 'text' END", "orders", ("o_orderkey",))
_scalar("value_typed_text", lambda: values.typed_text(values.parse_value(F.col("l_linenumber").cast("string"))), "cast(l_linenumber AS VARCHAR)", "lineitem", ("l_orderkey", "l_partkey"))


@query("SELECT l_orderkey, l_linenumber, 'int' AS value_type, cast(cast(l_quantity AS INTEGER) AS VARCHAR) || '公里' AS value_raw, cast(l_quantity AS BIGINT) * 1000 AS int_value, '公里' AS value_unit FROM lineitem")
def value_typed_columns(t):
    v = values.parse_value(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("公里")))
    x = t.lineitem.select("l_orderkey", "l_linenumber", v.alias("v"))
    return x.select("l_orderkey", "l_linenumber", *values.typed_columns(F.col("v"))).select("l_orderkey", "l_linenumber", "value_type", "value_raw", "int_value", "value_unit")


_PLACES = "o_orderkey // 100 % 10 AS h, o_orderkey // 10 % 10 AS d, o_orderkey % 10 AS e"


@query(f"""SELECT o_orderkey, CASE WHEN h * 100 + d * 10 + e > 0 THEN nullif(h * 100 + CASE WHEN h = 0 AND d = 1 THEN 0 ELSE d * 10 END + e, 0) END AS number,
    nullif((h * 100 + d * 10 + e) * 10000, 0) AS meant FROM (SELECT o_orderkey, {_PLACES} FROM orders)""")
def value_chinese(t):
    """The order number's last three digits as a numeral: as the reference reads it (a bare 十 counts nothing), and as it is meant, before 万."""
    digit = lambda n: F.element_at(F.array(*map(F.lit, "零一二三四五六七八九")), (n + 1).cast("int"))
    h, d, e = (F.expr(f"o_orderkey div {n} % 10") for n in (100, 10, 1))
    tens = F.when((h == 0) & (d == 1), "十").when(d > 0, F.concat(digit(d), F.lit("十"))).otherwise("")
    raw = F.concat(F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise(""), tens, F.when(e > 0, digit(e)).otherwise(""))
    meant = values.parse_chinese_number(F.concat(raw, F.lit("万")), parity=False, most=20)["number"]
    return t.orders.select("o_orderkey", values.parse_chinese_number(raw)["number"].cast("long").alias("number"), F.when(raw != "", meant).cast("long").alias("meant"))


_FORMS = ["会议于{d:%Y年%-m月%-d日}召开", "{d:%Y-%m-%d}  9:5", "1850-01-02 x", "{d:%Y-%m-%d}T10:00:00Z", "{d:%Y}年报", "{d:%Y}元", "约{d:%Y}", "{d:%Y-%m}起", "{d:%Y}-13-40", "{d:%Y}-02-30 25:00", "{d:%Y年%-m月%-d日} 10:61", "1969"]
_Y, _YM, _YMD = "strftime(d, '%Y')", "strftime(d, '%Y-%m')", "strftime(d, '%Y-%m-%d')"
_FORM_SQL = [
    f"{{t: {_YMD} || ' 00:00:00', c: 0.98}}", f"{{t: {_YMD} || ' 09:05:00', c: 0.95}}", "{t: '1850-01-02 00:00:00', c: 0.98}", f"{{t: {_YMD} || ' 10:00:00', c: 0.98}}", f"{{t: {_Y} || '-01-01 00:00:00', c: 0.85}}",
    "NULL", "NULL", f"{{t: {_YM} || '-01 00:00:00', c: 0.90}}", f"{{t: {_Y} || '-01-01 00:00:00', c: 0.85}}", f"{{t: {_Y} || '-02-01 00:00:00', c: 0.90}}", f"{{t: {_YMD} || ' 00:00:00', c: 0.98}}", "NULL",
]


@query(f"""SELECT o_orderkey, x.t::TIMESTAMP AS moment, x.c::DOUBLE AS confidence FROM (SELECT o_orderkey,
    CASE o_orderkey % 12 {' '.join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORM_SQL))} END AS x FROM (SELECT o_orderkey, o_orderdate::TIMESTAMP AS d FROM orders))""")
def value_datetime_forms(t):
    """Dates within text, in twelve forms: what is expected of each is written from the rules, not computed the same way."""
    d, y = "o_orderdate", F.date_format("o_orderdate", "yyyy")
    forms = [
        F.concat(F.lit("会议于"), F.date_format(d, "yyyy年M月d日"), F.lit("召开")), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("  9:5")), F.lit("1850-01-02 x"), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:00:00Z")),
        F.concat(y, F.lit("年报")), F.concat(y, F.lit("元")), F.concat(F.lit("约"), y), F.concat(F.date_format(d, "yyyy-MM"), F.lit("起")), F.concat(y, F.lit("-13-40")), F.concat(y, F.lit("-02-30 25:00")),
        F.concat(F.date_format(d, "yyyy年M月d日"), F.lit(" 10:61")), F.lit("1969"),
    ]
    v = values.parse_datetime(F.element_at(F.array(*forms), (F.col("o_orderkey") % 12 + 1).cast("int")))
    return t.orders.select("o_orderkey", v.alias("v")).select("o_orderkey", "v.moment", "v.confidence")


_CLEAN = "regexp_replace(regexp_replace(translate(text || ' ' || '2024年' || (doc_id % 14 + 1) || '月' || (doc_id % 32) || '日', '年月日', '--'), '-+', '-', 'g'), '^-|-$', '', 'g')"
_DAY = r"(\d{4})-(\d{1,2})-(\d{1,2})"


@query(rf"""WITH c AS (SELECT doc_id, {_CLEAN} AS x FROM documents),
    p AS (SELECT doc_id, x, regexp_extract(x, '{_DAY}[\s\x0B\x85\p{{Z}}T]+(\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}})', ['a', 'b', 'c', 'd', 'e', 'f']) AS s, regexp_extract(x, '{_DAY}[\s\x0B\x85\p{{Z}}T]+(\d{{1,2}}):(\d{{1,2}})', ['a', 'b', 'c', 'd', 'e']) AS m,
          regexp_extract(x, '{_DAY}', ['a', 'b', 'c']) AS d, regexp_extract(x, '(\d{{4}})-(\d{{1,2}})(?:[^\d]|$)', ['a', 'b']) AS y FROM c)
    SELECT doc_id, coalesce(try_cast(format('{{}}-{{}}-{{}} {{}}:{{}}:{{}}', s.a, s.b, s.c, lpad(s.d, 2, '0'), lpad(s.e, 2, '0'), lpad(s.f, 2, '0')) AS TIMESTAMP), try_cast(format('{{}}-{{}}-{{}} {{}}:{{}}:00', m.a, m.b, m.c, lpad(m.d, 2, '0'), lpad(m.e, 2, '0')) AS TIMESTAMP),
        try_cast(format('{{}}-{{}}-{{}}', d.a, d.b, d.c) AS TIMESTAMP), try_cast(format('{{}}-{{}}-01', y.a, y.b) AS TIMESTAMP)) AS moment FROM p""".replace("\\\\", "\\"))
def value_datetime_in_text(t):
    """The first date in whole texts."""
    text_ = F.concat("text", F.lit(" 2024年"), F.col("doc_id") % 14 + 1, F.lit("月"), F.col("doc_id") % 32, F.lit("日"))
    return t.documents.select("doc_id", values.parse_datetime(text_)["moment"].alias("moment"))


# ---- JSON

@query("SELECT doc_id, 'doc ' || doc_id AS title, 1 AS items FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 2 <> 0")
def llm_json_parse(t):
    good = F.concat(F.lit('```json\n{"type":"r","data":{"items":[{"title":"doc '), "doc_id", F.lit('","content":"x"}]}}\n```'))
    a = jsonx.parse_answer(F.when(F.col("doc_id") % 2 == 0, good).otherwise("no json"))
    x = t.documents.select("doc_id", a.alias("a"))
    return x.select("doc_id", F.get("a.data.items", F.lit(0))["title"].alias("title"), F.when(jsonx.answer_is_valid(F.col("a")), F.size("a.data.items")).alias("items"))


_TREE = '[{"title":"a%s","children":[{"title":"b","is_valid":false,"children":[{"title":"gone"}]},{"title":"c","children":[{"title":"d"}]}]},{"title":"e","is_valid":false}]'


@query("""SELECT doc_id, path, parent, level, CASE WHEN level = 0 THEN 'a' || doc_id ELSE title END AS title FROM documents,
    (VALUES ('0', NULL, 0, ''), ('0.1', '0', 1, 'c'), ('0.1.0', '0.1', 2, 'd')) v(path, parent, level, title)""")
def json_flatten_children(t):
    left, right = _TREE.split("%s")
    return jsonx.flatten_children(t.documents.select("doc_id", F.concat(F.lit(left), "doc_id", F.lit(right)).alias("j")), "doc_id", "j")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'y' WHEN 1 THEN 'x,y,z' ELSE 'z,x' END AS ids FROM documents")
def references_to_ids(t):
    refs = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("2"), F.lit("9"), F.lit("q"))).when(F.col("doc_id") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("3"), F.lit("1")))
    return t.documents.select("doc_id", F.array_join(jsonx.references_to_ids(refs, F.array(*map(F.lit, "xyz"))), ",").alias("ids"))


@query("""WITH c AS (SELECT conv_id AS qid, cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS cand FROM conversations)
    SELECT qid, cast(row_number() OVER (PARTITION BY qid ORDER BY cand DESC) AS INTEGER) AS rank, cand FROM c QUALIFY rank <= 3""")
def rerank_line_parse(t):
    c = t.conversations.select(F.col("conv_id").alias("qid"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("cand")).withColumn("text", F.concat(F.lit("t"), "cand"))
    line = F.when(F.col("cand") % 2 == 0, F.concat(F.lit("["), "cand", F.lit("] x"))).otherwise(F.concat(F.lit("[99999] t"), "cand"))
    lines = c.select("qid", (-F.col("cand")).alias("pos"), line.alias("line"))
    lines = lines.union(lines.withColumn("pos", F.lit(9))).union(lines.select("qid", "pos", F.lit("no id")))
    return jsonx.parse_rerank_lines(lines, c, 3)


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'a' || item_id || '|b' ELSE 'b' END AS answers FROM benchmark")
def gold_answers(t):
    a = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("a"), "item_id")).otherwise("")
    return t.benchmark.select("item_id", F.array_join(jsonx.gold_answers(a, F.lit(None).cast("string"), F.array(F.lit("b"), F.lit("b"))), "|").alias("answers"))


@query("""SELECT doc_id, '{"items":[{"id":1,"content":"' || lang || '"},{"id":2,"content":"' || source || '"}],"entity_types":["time","person"]}' AS request FROM documents""")
def prompt_input(t):
    return extraction.prompt_input(t.documents.select(F.col("doc_id").alias("chunk_id"), F.array("lang", "source").alias("items")), ["time", "person"]).withColumnRenamed("chunk_id", "doc_id")


# ---- vectors

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
_KNN = "SELECT qid, id, score, cast(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS id, {s} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {s} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {w}) WHERE rank <= 10"


def _qv(t):
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def _v(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _wanted(t):
    """A seventh of all vectors for each query."""
    q = t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.expr("vec_id div 50 % 7").alias("m"))
    return t.embeddings.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("m")).join(F.broadcast(q), "m").select("qid", "id")


@query(_KNN.format(s=_COS, w=""))
def knn_topk(t):
    return vectors.knn(_qv(t), _v(t), 10).select("qid", "id", "score", "rank")


@query(_KNN.format(s=_COS, w="AND v.label = 3"))
def knn_filtered_label(t):
    return vectors.knn(_qv(t), t.embeddings.filter("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10).select("qid", "id", "score", "rank")


@query(f"SELECT q.vec_id AS qid, v.vec_id AS id, {_COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id % 7 = q.vec_id // 50 % 7")
def knn_score_ids(t):
    return vectors.score_ids(_qv(t), _v(t), _wanted(t))


@query("SELECT vec_id, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 <> 0 AS valid FROM embeddings")
def vector_valid(t):
    v, i = F.col("embedding"), F.col("vec_id")
    bad = lambda x: F.transform(v, lambda y, at: F.when(at == 3, F.lit(x).cast("float")).otherwise(y))
    v = F.when(i % 5 == 0, bad(float("nan"))).when(i % 7 == 0, bad(float("inf"))).when(i % 11 == 0, bad(None)).when(i % 13 == 0, F.slice(v, 1, 0)).otherwise(v)
    return t.embeddings.select("vec_id", vectors.is_valid_vector(v).alias("valid"))


@query("SELECT vec_id, 32 AS dims, round(list_sum(embedding[1:32]::DOUBLE[]), 6) AS total, 128 AS bytes FROM embeddings")
def vector_truncate_pack(t):
    v = vectors.truncate_vector(F.col("embedding"), 32)
    x = t.embeddings.select("vec_id", v.alias("v"), vectors.pack_float32(v).alias("b"))
    return x.select("vec_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, y: s + y.cast("double")), 6).alias("total"), F.length("b").alias("bytes"))


@query(f"SELECT qid, id, score, cast(rank AS INTEGER) AS rank FROM ({_KNN.format(s=_COS, w='')}) WHERE rank <= 4 AND score >= 0.3")
def threshold_then_cap(t):
    hits = vectors.knn(_qv(t), _v(t), 12).select("qid", "id", "score")
    return vectors.threshold_then_cap(hits, 4, 0.3).select("qid", "id", "score", "rank")


@query(f"""WITH h AS (SELECT q.vec_id // 50 % 5 AS qid, q.vec_id // 250 AS ord, v.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
    SELECT cast(qid AS BIGINT) AS qid, id, score FROM h WHERE rank <= 20 AND score >= 0.2 QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY ord, rank) = 1""")
def entity_recall_first_seen(t):
    hits = vectors.knn(_qv(t), _v(t), 20).filter("score >= 0.2")
    hits = hits.select(F.expr("qid div 50 % 5").alias("qid"), F.expr("qid div 250").alias("ord"), "rank", "id", "score")
    return vectors.first_seen(hits).select("qid", "id", "score")


@query(f"SELECT qid, id, score, cast(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS qid, v.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id % 7 = q.vec_id // 50 % 7) WHERE rank <= 15")
def coarse_rank_candidates(t):
    return vectors.top_k(vectors.score_ids(_qv(t), _v(t), _wanted(t), 15), 15).select("qid", "id", "score", "rank")


# ---- graph

_G = """edges AS (SELECT DISTINCT l_orderkey AS event_id, l_partkey AS entity_id FROM lineitem),
    seeds AS (SELECT p_partkey // 50 % 4 AS qid, p_partkey AS entity_id FROM part WHERE p_partkey % 50 = 0),
    e0 AS (SELECT DISTINCT qid, event_id FROM edges JOIN seeds USING (entity_id)),
    p1 AS (SELECT DISTINCT qid, entity_id FROM edges JOIN e0 USING (event_id) EXCEPT SELECT qid, entity_id FROM seeds),
    e1 AS (SELECT DISTINCT qid, event_id FROM edges JOIN p1 USING (entity_id) EXCEPT SELECT qid, event_id FROM e0)"""
_G2 = _G + """, k1 AS (SELECT * FROM p1 UNION SELECT * FROM seeds), p2 AS (SELECT DISTINCT qid, entity_id FROM edges JOIN e1 USING (event_id) EXCEPT SELECT qid, entity_id FROM k1),
    e2 AS (SELECT DISTINCT qid, event_id FROM edges JOIN p2 USING (entity_id) EXCEPT (SELECT qid, event_id FROM e0 UNION SELECT qid, event_id FROM e1))"""


def _edges(t):
    """Read by every hop, so cut off once."""
    return cut(t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")).distinct())


def _seeds(t):
    return t.part.filter("p_partkey % 50 = 0").select(F.expr("p_partkey div 50 % 4").alias("qid"), F.col("p_partkey").alias("entity_id"))


@query(f"WITH {_G} SELECT qid, event_id FROM e0 WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def entity_to_event(t):
    events = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("event_id"))
    return graph.entity_to_event(_seeds(t), _edges(t), events)


@query(f"WITH {_G} SELECT qid, event_id FROM e1")
def hop1_frontier(t):
    edges = _edges(t)
    return graph.expand(_seeds(t), graph.entity_to_event(_seeds(t), edges), edges, 1)[0].select("qid", "event_id")


@query(f"WITH {_G} SELECT qid, entity_id FROM p1")
def new_entities(t):
    edges = _edges(t)
    return graph.new_rows(graph.event_entities(graph.entity_to_event(_seeds(t), edges), edges), _seeds(t), "entity_id")


@query(f"WITH {_G2} SELECT qid, event_id, 1 AS hop FROM e1 UNION ALL SELECT qid, event_id, 2 FROM e2")
def multi_hop2(t):
    edges = _edges(t)
    return graph.expand(_seeds(t), graph.entity_to_event(_seeds(t), edges), edges, 2)[0]


@query(f"WITH {_G} SELECT qid, event_id, 0 AS hop FROM e0 UNION ALL SELECT qid, event_id, 1 FROM e1")
def phase_a(t):
    return graph.phase_a(_seeds(t), _edges(t))[0]


@query(f"""WITH {_G}, x AS (SELECT qid, event_id FROM e0 WHERE event_id % 2 = 0), b1 AS (SELECT * FROM e0 EXCEPT SELECT * FROM x),
    open AS (SELECT qid, event_id FROM b1 WHERE qid NOT IN (SELECT qid FROM b1 GROUP BY qid HAVING count(*) >= 150)),
    q1 AS (SELECT DISTINCT qid, entity_id FROM edges JOIN open USING (event_id) EXCEPT SELECT qid, entity_id FROM seeds),
    b2 AS (SELECT DISTINCT qid, event_id FROM edges JOIN q1 USING (entity_id) EXCEPT (SELECT * FROM x UNION SELECT * FROM b1))
    SELECT qid, event_id, 1 AS hop FROM b1 UNION ALL SELECT qid, event_id, 2 FROM b2""")
def phase_b_gated(t):
    edges = _edges(t)
    x = graph.entity_to_event(_seeds(t), edges).filter("event_id % 2 = 0")
    return graph.phase_b(_seeds(t), x, edges, most=150, retries=2)


@query(f"WITH {_G} SELECT qid, event_id FROM e0 UNION ALL SELECT qid, event_id FROM e1")
def multi1_expand(t):
    edges = _edges(t)
    a, entities = graph.phase_a(_seeds(t), edges)
    b = graph.phase_b(entities, a, edges, most=50)  # empty: the events of known entities are known
    return a.select("qid", "event_id").union(b.select("qid", "event_id"))


@query(f"""WITH {_G}, a AS (SELECT * FROM e0 UNION SELECT * FROM e1), r AS (SELECT qid, event_id, row_number() OVER (PARTITION BY qid ORDER BY o_totalprice DESC, event_id) AS rank FROM a JOIN orders ON event_id = o_orderkey QUALIFY rank <= 3),
    s AS (SELECT DISTINCT qid, entity_id FROM edges JOIN r USING (event_id)), b AS (SELECT DISTINCT qid, event_id FROM edges JOIN s USING (entity_id) EXCEPT SELECT * FROM a)
    SELECT qid, event_id, 1 AS phase FROM r UNION ALL SELECT qid, event_id, 2 FROM b""")
def hopllm_expand(t):
    edges = _edges(t)
    a = graph.phase_a(_seeds(t), edges)[0].select("qid", "event_id")
    price = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("score"))
    ranked = vectors.top_k(a.join(price, "event_id").withColumn("id", F.col("event_id")), 3).select("qid", "event_id")
    b = graph.phase_b(graph.event_entities(ranked, edges), a, edges, most=1, retries=1)
    return ranked.withColumn("phase", F.lit(1)).union(b.select("qid", "event_id").withColumn("phase", F.lit(2)))


@query(f"""WITH {_G}, c AS (SELECT qid, event_id, 0.0::DOUBLE AS score FROM e0 UNION ALL SELECT q.vec_id // 50, v.vec_id, {_COS} FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {_COS} >= 0.4
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) <= 20) SELECT qid, event_id, max(score) AS score FROM c GROUP BY ALL""")
def two_channel_recall(t):
    first = graph.entity_to_event(_seeds(t), _edges(t)).withColumn("score", F.lit(0.0))
    second = vectors.knn(_qv(t), _v(t), 20).filter("score >= 0.4").select(F.expr("qid div 50").alias("qid"), F.col("id").alias("event_id"), "score")
    return recall_channels(first, second)


@query(f"WITH {_G} SELECT o_orderkey AS event_id, coalesce(o_orderpriority, '') AS title, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS entities FROM orders JOIN edges ON o_orderkey = event_id WHERE o_orderkey IN (SELECT event_id FROM e0) GROUP BY ALL")
def event_details(t):
    events = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("title"))
    x = graph.event_details(events, graph.entity_to_event(_seeds(t), _edges(t)), _edges(t))
    return x.filter("entity_ids is not null").select("event_id", "title", F.array_join(F.col("entity_ids").cast("array<string>"), ",").alias("entities"))


@query("SELECT o_orderkey AS event_id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, '') AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders")
def candidate_assembly(t):
    x = t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("event_id"))
    x = vectors.top_k(x.withColumns({"score": F.lit(0), "id": F.col("event_id")}), 10**9)
    d = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("title"))
    return assemble_candidates(x.select("qid", "event_id", F.col("rank").cast("long").alias("pos")), d).select("event_id", "title", "pos")


@query(f"""WITH k AS ({_KNN.format(s=_COS, w='')}) SELECT qid, id, cast(CASE WHEN rank % 2 = 1 THEN 1 ELSE 2 END AS INTEGER) AS phase, cast(row_number() OVER (PARTITION BY qid ORDER BY rank % 2 DESC, score DESC, id) AS INTEGER) AS pos FROM k""")
def dual_phase_merge(t):
    k = vectors.knn(_qv(t), _v(t), 10)
    return graph.dual_phase(k.filter("rank % 2 = 1").select("qid", "id", "score"), k.filter("rank % 2 = 0").select("qid", "id", "score")).select("qid", "id", "phase", "pos")


_ROWS = f"k AS ({_KNN.format(s=_COS, w='')}), o AS (SELECT qid, rank, id % 6 AS chunk_id, score FROM k QUALIFY row_number() OVER (PARTITION BY qid, id % 6 ORDER BY rank) = 1), s AS (SELECT qid, cast(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS pos, chunk_id, score AS weight FROM o)"


def _sections(t):
    k = vectors.knn(_qv(t), _v(t), 10)
    return graph.ordered_dedup(k.select("qid", F.col("rank").alias("pos"), (F.col("id") % 6).alias("chunk_id"), "score"))


@query(f"WITH {_ROWS} SELECT * FROM s")
def ordered_dedup_sections(t):
    return _sections(t)


@query(f"""WITH {_ROWS}, h AS (SELECT DISTINCT qid, cast(c AS BIGINT) AS chunk_id, c / 10.0::DOUBLE AS score FROM k, (SELECT unnest(range(0, 9)) AS c)),
    a AS (SELECT qid, pos, chunk_id, weight, 1 AS src FROM s UNION ALL SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id), chunk_id, score, 2 FROM h ANTI JOIN s USING (qid, chunk_id))
    SELECT qid, cast(row_number() OVER (PARTITION BY qid ORDER BY src, pos) AS INTEGER) AS pos, chunk_id, weight, src FROM a QUALIFY pos <= 8""".replace("QUALIFY pos <= 8", "QUALIFY row_number() OVER (PARTITION BY qid ORDER BY src, a.pos) <= 8"))
def native_backfill(t):
    s = _sections(t)
    hits = s.select("qid").distinct().withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long")))).withColumn("score", F.col("chunk_id") / 10)
    return graph.backfill(s, hits, 8).select("qid", "pos", "chunk_id", "weight", "src")


# ---- chunking

_BODY = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def _marked(t):
    return t.documents.select("doc_id", F.concat(F.lit("# doc "), "doc_id", F.lit("\n"), "text").alias("text"))


@query(f"SELECT doc_id, 0 AS rank, 'doc ' || doc_id AS heading, {_BODY} AS content FROM documents")
def chunk_heading_strict(t):
    return chunking.chunks_by_heading(_marked(t))


@query("SELECT doc_id, unnest([1, 2, 3]) AS pos, unnest(['head ' || chr(10), '# a' || chr(10) || text || chr(10), '### b' || chr(10) || source]) AS block FROM documents")
def chunk_blocks(t):
    md = F.concat(F.lit("head \n# a\n"), "text", F.lit("\n### b\n"), "source")
    return t.documents.select("doc_id", F.posexplode(chunking.split_blocks(md)).alias("pos", "block")).select("doc_id", (F.col("pos") + 1).alias("pos"), "block")


@query(r"SELECT doc_id, unnest(range(0, 3))::INTEGER AS pos, unnest([lang || '. ', source || '?', ' end']) AS part FROM documents")
def split_primary(t):
    return t.documents.select("doc_id", F.posexplode(chunking.split_primary(F.concat("lang", F.lit(". "), "source", F.lit("? end")))).alias("pos", "part"))


@query("SELECT conv_id, cast((turn // 3) AS INTEGER) AS rank, arg_min(role, turn) AS heading, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY turn) AS content, string_agg(cast(turn AS VARCHAR), ',' ORDER BY turn) AS refs FROM conversations GROUP BY ALL")
def chunk_build(t):
    x = t.conversations.select("conv_id", F.floor(F.col("turn") / 3).cast("int").alias("rank"), F.col("turn").alias("order_index"), F.col("role").alias("heading"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return chunking.build_chunks(x, "conv_id").select("conv_id", "rank", "heading", "content", F.array_join(F.col("references").cast("array<string>"), ",").alias("refs"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'doc ' || doc_id ELSE 'Untitled' END AS title FROM documents")
def extract_title(t):
    return t.documents.select("doc_id", chunking.document_title(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x\n## doc "), "doc_id")).otherwise("plain")).alias("title"))


@query("SELECT p_partkey, unnest(['| a | b |' || chr(10) || '|---|---|', '| ' || p_size || ' | x |', '| y | z |']) AS section FROM part")
def table_sections(t):
    block = F.concat(F.lit("| a | b |\n|---|---|\n| "), "p_size", F.lit(" | x |\n| y | z |"))
    return t.part.select("p_partkey", F.explode(chunking.table_sections(block)).alias("section"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '[IMAGE] alt: ' || p_brand ELSE p_name END AS section FROM part")
def block_routing(t):
    kind = F.element_at(F.array(*map(F.lit, ("IMAGE", "CODE", "FORMULA"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", F.explode(chunking.block_section(kind, F.col("p_name"), F.col("p_brand"))).alias("section"))


@query("SELECT conv_id, turn, cast(count(*) FILTER (WHERE turned) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS chunk FROM (SELECT *, role <> lag(role, 1, role) OVER (PARTITION BY conv_id ORDER BY turn) AS turned FROM conversations)")
def heading_breaks(t):
    return chunking.heading_breaks(t.conversations, "conv_id", "turn", "role").select("conv_id", "turn", "chunk")


# ---- extraction and relational verbs

_MENTIONS = "m AS (SELECT source, doc_id, unnest(n) AS name, doc_id * 1000000 + unnest(range(len(n))) AS ord FROM (SELECT source, doc_id, regexp_extract_all(text, '[A-Z][a-z]{5,}') AS n FROM documents))"


def _mentions(t):
    x = t.documents.select("source", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"), F.lit(1))).alias("pos", "name"))
    return x.select("source", (F.col("doc_id") * 1000000 + F.col("pos")).alias("ord"), F.lit("subject").alias("type"), "name")


@query(f"WITH {_MENTIONS} SELECT source, 'subject' AS type, lower(name) AS normalized_name, arg_min(name, ord) AS name, count(*) AS mentions, md5(concat_ws(chr(1), source, 'subject', lower(name))) AS entity_id FROM m GROUP BY source, lower(name)")
def entity_resolve(t):
    types = t.spark.createDataFrame(extraction.DEFAULT_TYPES, "type string, weight double, threshold double")
    return extraction.resolve_entities(_mentions(t), types)


@query("SELECT event_id, entity_id, string_agg(description, '、' ORDER BY ord, description) AS description FROM (SELECT l_orderkey AS event_id, l_suppkey % 3 AS entity_id, l_returnflag AS description, min(l_linenumber) AS ord FROM lineitem GROUP BY ALL) GROUP BY ALL")
def description_merge(t):
    x = t.lineitem.select(F.col("l_orderkey").alias("event_id"), (F.col("l_suppkey") % 3).alias("entity_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("description"))
    return extraction.merge_descriptions(x)


@query("SELECT o_orderkey AS event_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END, 9999), o_orderkey % 3, o_orderkey) - 1 AS INTEGER) AS rank FROM orders")
def event_rerank_order(t):
    x = t.orders.select("o_custkey", F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 5).alias("chunk_rank"), (F.col("o_orderkey") % 3).alias("event_rank"))
    return extraction.renumber_events(x, "o_custkey").select("event_id", "rank")


_TYPES = "(VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in extraction.DEFAULT_TYPES) + ") y(type, weight, threshold)"


@query(f"SELECT p_partkey, coalesce(threshold, 0.8::DOUBLE) AS threshold, coalesce(weight, 1.0::DOUBLE) AS weight FROM (SELECT p_partkey, ['time', 'person', 'subject', 'none'][p_partkey % 4 + 1] AS type FROM part) LEFT JOIN {_TYPES} USING (type)")
def type_threshold_join(t):
    kind = F.element_at(F.array(*map(F.lit, ("time", "person", "subject", "none"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    types = t.spark.createDataFrame(extraction.DEFAULT_TYPES, "type string, weight double, threshold double")
    return extraction.type_settings(t.part.select("p_partkey", kind.alias("type")), types).select("p_partkey", "threshold", "weight")


@query("""SELECT type, arg_min(weight, p) AS weight FROM (SELECT p_type AS type, min(p_size)::DOUBLE AS weight, 1 AS p FROM part WHERE p_size > 40 GROUP BY 1
    UNION ALL SELECT p_type, min(p_retailprice)::DOUBLE, 2 FROM part GROUP BY 1 UNION ALL SELECT DISTINCT p_brand, 1.0::DOUBLE, 3 FROM part UNION ALL SELECT DISTINCT p_type, 0.0::DOUBLE, 3 FROM part) GROUP BY type""")
def effective_types(t):
    """A source's own types are those of large parts, the defaults all types, and the runtime ones brands and types."""
    own = t.part.filter("p_size > 40").groupBy(F.col("p_type").alias("type")).agg(F.min("p_size").cast("double").alias("weight"))
    default = t.part.groupBy(F.col("p_type").alias("type")).agg(F.min("p_retailprice").cast("double").alias("weight"))
    runtime = t.part.select(F.col("p_brand").alias("type"), F.lit(1.0).alias("weight")).union(t.part.select("p_type", F.lit(0.0))).distinct()
    return extraction.effective_types(own, default, runtime)


@query("SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderstatus = 'P' THEN 'DELETED' WHEN o_orderstatus = 'F' THEN NULL ELSE 'ok' END) IS DISTINCT FROM 'DELETED'")
def soft_delete_filter(t):
    status = F.when(F.col("o_orderstatus") == "P", "DELETED").when(F.col("o_orderstatus") != "F", "ok")
    return t.orders.filter(extraction.not_deleted(status)).select("o_orderkey")


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND length(text) >= 20")
def chunk_filters(t):
    kind = F.when(F.col("role") == "system", "IMAGE").when(F.col("role") == "user", "TEXT")
    return t.conversations.filter(extraction.not_image(kind) & extraction.long_enough(F.lit(0), F.col("text"))).select("conv_id", "turn")


@query("""WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE (conv_id + turn) % 5 <> 0)
    SELECT a.conv_id, a.turn, b.text AS previous FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def prev_chunk_context(t):
    gaps = t.conversations.filter((F.col("conv_id") + F.col("turn")) % 5 != 0)
    return extraction.previous_chunk(gaps, "conv_id", "turn", "text").select("conv_id", "turn", "previous")


@query("SELECT o_orderkey, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'N') = count(*) THEN 'COMPLETED' WHEN count(*) FILTER (WHERE l_returnflag = 'N') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def article_status(t):
    x = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("article_id"), (F.col("l_returnflag") == "N").alias("ok"))
    return extraction.article_status(x).withColumnRenamed("article_id", "o_orderkey")


@query("SELECT * FROM (VALUES ('inserted', (SELECT count(*) FROM part WHERE p_partkey % 3 = 0)), ('updated', (SELECT count(*) FROM part WHERE p_partkey % 3 = 1)), ('unchanged', (SELECT count(*) FROM part WHERE p_partkey % 3 = 2))) v(state, n)")
def upsert_report(t):
    old = t.part.filter("p_partkey % 3 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 1, F.lit(-1)).otherwise(F.col("p_size")).alias("p_size"))
    return extraction.upsert_report(old, t.part.select("p_partkey", "p_size"), "p_partkey", ["p_size"])


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'DELETED' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -c_custkey, 'NEW' FROM customer WHERE c_mktsegment = 'BUILDING'")
def replace_events(t):
    old = t.orders.select("o_orderkey", F.col("o_custkey").alias("article_id"), F.col("o_orderstatus").alias("status"))
    new = t.customer.filter("c_mktsegment = 'BUILDING'").select((-F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("article_id"), F.lit("NEW").alias("status"))
    return extraction.replace_events(old, new).select("o_orderkey", "status")


@query("SELECT o_orderkey AS event_id, coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (l_suppkey IS NOT NULL))::VARCHAR, '[]') AS entities FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def event_documents(t):
    x = extraction.event_documents(t.orders.select(F.col("o_orderkey").alias("event_id")), t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("entity_id")))
    return x.select("event_id", F.concat(F.lit("["), F.array_join(F.col("entity_ids").cast("array<string>"), ", "), F.lit("]")).alias("entities"))


@query("SELECT o_orderkey AS event_id, coalesce(CASE WHEN o_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01' END, TIMESTAMP '2024-02-15 12:00:00') AS start_time FROM orders")
def event_times(t):
    article = t.customer.select(F.col("c_custkey").alias("article_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-01-01").cast("timestamp")).alias("created_time"))
    return extraction.event_time(article, t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("article_id")), _now()).select("event_id", "start_time")


@query("SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING list_has_any(list(l_partkey), [1, 2, 3])")
def events_by_entities(t):
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("ids"))
    return x.filter(F.arrays_overlap("ids", F.array(*(F.lit(i).cast("long") for i in (1, 2, 3))))).select("o_orderkey")


@query("SELECT l_orderkey, array_agg(l_partkey ORDER BY l_linenumber, l_partkey)::VARCHAR AS parts FROM lineitem SEMI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') USING (l_orderkey) GROUP BY l_orderkey")
def relation_preload(t):
    x = t.lineitem.join(t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    x = x.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"].cast("string")).alias("p"))
    return x.select("l_orderkey", F.concat(F.lit("["), F.array_join("p", ", "), F.lit("]")).alias("parts"))


@query("SELECT doc_id, coalesce(string_agg(turn, ',' ORDER BY turn), '') AS sections FROM documents LEFT JOIN conversations ON doc_id = conv_id AND (turn % 2 = doc_id % 2 OR doc_id % 5 = 0) GROUP BY doc_id")
def chunk_sections(t):
    x = t.documents.join(t.conversations, (F.col("doc_id") == F.col("conv_id")) & ((F.col("turn") % 2 == F.col("doc_id") % 2) | (F.col("doc_id") % 5 == 0)), "left")
    return x.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("turn")).cast("array<string>"), ",").alias("sections"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem SEMI JOIN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') USING (l_orderkey, l_partkey)")
def pair_lookup(t):
    want = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    return t.lineitem.join(want, ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT source AS id, 'source-' || source AS name FROM documents GROUP BY source HAVING min(doc_id) % 2 = 1")
def new_sources(t):
    from skein.api import new_sources as create

    g = t.documents.groupBy(F.col("source").alias("id")).agg((F.min("doc_id") % 2).alias("odd"))
    return create(g.filter("odd = 0").select("id"), g.select("id", F.lit(None).cast("string").alias("name")))


@query()
def extract_events(t):
    return extraction.extract_events(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), providers.rule_events).select("chunk_id", "title", F.size("entities").alias("entities"))


# ---- full text

_BM = """q AS (SELECT item_id AS qid, unnest(list_distinct([x FOR x IN string_split_regex(lower(text), '[^a-z0-9]+') IF x <> ''])) AS term FROM benchmark),
    w AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^a-z0-9]+') IF x <> ''] AS w FROM documents), l AS (SELECT doc_id, len(w) AS length FROM w), a AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    b AS (SELECT qid, doc_id AS doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 5) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (doc_id), a GROUP BY ALL)"""


def _terms(t):
    w = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    return t.benchmark.select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(w)).alias("term"))


@query(f"WITH {_BM} SELECT qid, doc, round(score, 3) AS score FROM b")
def bm25_document(t):
    return fulltext.bm25(_terms(t), t.documents).select("qid", "doc", F.round("score", 3).alias("score"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0)")
def name_exact_batch(t):
    return t.part.join(t.part.filter("p_partkey % 50 = 0").select("p_name").distinct(), "p_name", "left_semi").select("p_partkey", "p_name")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11' ORDER BY ts DESC, event_id LIMIT 50")
def events_newest_first(t):
    return t.events.filter(time.overlaps(F.col("ts"), F.lit(None).cast("timestamp"), "2024-01-10", "2024-01-11")).orderBy(F.col("ts").desc(), "event_id").limit(50).select("event_id", "ts")


# ---- metrics

_GOLD = "gold AS (SELECT item_id AS qid, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)), pred AS (SELECT qid, doc, cast(row_number() OVER (PARTITION BY qid ORDER BY (doc * 7 + qid) % 1009, doc) AS INTEGER) AS pos FROM (SELECT qid, doc FROM gold WHERE doc % 3 <> 0 UNION SELECT item_id, doc_id FROM benchmark JOIN documents ON doc_id % 97 = item_id % 97))"
INNER = 5  # words


def _gold(t):
    """Documents that contain a benchmark text. Candidates share a run of INNER whole words from the needle's second word on, by hash; then the text decides.

    Needles of fewer than INNER + 2 words are compared with every text.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    b = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("needle"), words.alias("w"))
    long = cut(b.filter(F.size("w") >= INNER + 2).select("qid", "needle", F.xxhash64(F.slice("w", 2, INNER)).alias("h")))
    hashes = [r[0] for r in long.select("h").distinct().limit(100_001).collect()]
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - INNER + 1), lambda i: F.xxhash64(F.slice("w", i, INNER))))
    few = len(hashes) <= 100_000
    runs = F.array_intersect(runs, F.lit(hashes).cast("array<long>")) if 0 < len(hashes) <= 10_000 else runs  # others never become rows
    d = t.documents.select(F.col("doc_id").alias("doc"), words.alias("w")).filter(F.size("w") >= INNER).select("doc", F.explode(runs).alias("h"))
    near = d.join(F.broadcast(long) if few else long, "h").select("qid", "needle", "doc")
    found = near.join(t.documents.select(F.col("doc_id").alias("doc"), "text"), "doc").filter(F.col("text").contains(F.col("needle"))).select("qid", "doc").distinct()
    short = b.filter(F.size("w") < INNER + 2)
    if short.limit(1).count():
        found = found.union(t.documents.join(short, F.col("text").contains(F.col("needle"))).select("qid", F.col("doc_id").alias("doc")))
    return cut(found)


def _pred(t, gold):
    """Two of three gold documents, and one document in 97."""
    noise = t.benchmark.select(F.col("item_id").alias("qid"), (F.col("item_id") % 97).alias("m")).join(t.documents.select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 97).alias("m")), "m")
    x = gold.filter("doc % 3 <> 0").union(noise.select("qid", "doc")).distinct()
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy((F.col("doc") * 7 + F.col("qid")) % 1009, "doc"))).select("qid", "doc", "pos")


_RANK = f"""WITH {_GOLD}, g AS (SELECT qid, count(DISTINCT doc) AS n FROM gold GROUP BY qid), h AS (SELECT p.*, g.doc IS NOT NULL AS hit FROM pred p LEFT JOIN gold g USING (qid, doc)),
    m AS (SELECT g.qid, any_value(n) AS n, count(*) FILTER (WHERE hit AND pos <= 5) AS hits, coalesce(sum(CASE WHEN hit AND pos <= 5 THEN 1 / log2(pos + 1) END), 0) AS dcg, min(CASE WHEN hit THEN pos END) AS first FROM g LEFT JOIN h USING (qid) GROUP BY g.qid)
    SELECT qid, round(hits / 5::DOUBLE, 6) AS precision, round(hits / n::DOUBLE, 6) AS recall, round(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n, 5) + 1)]), 6) AS ndcg, coalesce(round(1 / first::DOUBLE, 6), 0) AS mrr FROM m"""


@query(_RANK)
def precision_recall_ndcg_mrr(t):
    gold = _gold(t)
    pred = cut(_pred(t, gold))
    return metrics.ranking_metrics(pred, gold, 5)


@query(f"SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM ({_RANK})")
def macro_average(t):
    gold = _gold(t)
    pred = cut(_pred(t, gold))
    return metrics.macro_average(metrics.ranking_metrics(pred, gold, 5))


_SET = f"""WITH {_GOLD}, g AS (SELECT qid, count(DISTINCT doc) AS n FROM gold GROUP BY qid), s AS (SELECT qid, count(*) AS shown, count(DISTINCT g.doc) AS hits FROM pred p LEFT JOIN gold g USING (qid, doc) WHERE pos <= 8 GROUP BY qid),
    m AS (SELECT g.qid, coalesce(hits / n::DOUBLE, 0) AS r, coalesce(hits / shown::DOUBLE, 0) AS p FROM g LEFT JOIN s USING (qid))
    SELECT qid, round(r, 4) AS recall, round(p, 4) AS precision, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM m"""


@query(_SET)
def precision_f1_at_k(t):
    gold = _gold(t)
    pred = cut(_pred(t, gold))
    return metrics.set_metrics(pred, gold, 8)


@query(f"SELECT CASE WHEN recall >= 1 THEN 'full' WHEN recall > 0 THEN 'partial' ELSE 'zero' END AS class, count(*) AS n FROM ({_SET}) GROUP BY 1")
def recall_distribution(t):
    gold = _gold(t)
    pred = cut(_pred(t, gold))
    return metrics.set_metrics(pred, gold, 8).groupBy(metrics.recall_class(F.col("recall")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT recall, row_number() OVER (ORDER BY qid) AS n FROM ({_SET})), b AS (SELECT cast((n - 1) // 7 AS BIGINT) AS batch, count(*) AS c, sum(recall) AS s FROM r GROUP BY 1)
    SELECT batch, cast(sum(c) OVER w AS BIGINT) AS queries, round(sum(s) OVER w / sum(c) OVER w, 6) AS mean_recall FROM b WINDOW w AS (ORDER BY batch)""")
def cumulative_recall(t):
    gold = _gold(t)
    by = metrics.set_metrics(_pred(t, gold), gold, 8)
    return metrics.cumulative(by.withColumn("n", F.row_number().over(Window.orderBy("qid"))), 7)


@query(f"SELECT round(avg(a.recall), 6) AS mean_a, round(avg(b.recall), 6) AS mean_b, round(avg(a.recall - b.recall), 6) AS difference, count(*) FILTER (WHERE abs(a.recall - b.recall) > 1e-9) AS differing, count(*) FILTER (WHERE a.recall = 0) AS zero_a, count(*) FILTER (WHERE b.recall = 0) AS zero_b FROM ({_SET}) a JOIN ({_SET.replace('pos <= 8', 'pos <= 3')}) b USING (qid)")
def compare_ab(t):
    gold = _gold(t)
    pred = cut(_pred(t, gold))
    return metrics.compare(metrics.set_metrics(pred, gold, 8), metrics.set_metrics(pred, gold, 3))


@query("SELECT item_id * 10 + 5 AS a, item_id AS b, CASE item_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'overlap' ELSE 'place' END AS how FROM benchmark")
def align_questions(t):
    b = t.benchmark.select(F.col("item_id").alias("id"), "text")
    asked = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("  "), "text")).when(F.col("item_id") % 3 == 1, F.concat("text", F.lit(" added"))).otherwise(F.concat(F.lit("nothing alike "), "item_id"))
    return metrics.align_questions(t.benchmark.select((F.col("item_id") * 10 + 5).alias("id"), asked.alias("text")), b)


@query("SELECT role, cast(count(*) AS BIGINT) AS calls, cast(sum(length(text)) AS BIGINT) AS tokens FROM conversations GROUP BY ROLLUP (role)")
def token_usage_rollup(t):
    return t.conversations.rollup("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("text")).cast("long").alias("tokens"))


@query("SELECT count(*) AS documents, count(DISTINCT source) AS sources, round(avg(length(text)), 4) AS mean_length, max(length(text)) AS longest, round(count(*) / count(DISTINCT source)::DOUBLE, 2) AS per_source FROM documents")
def dataset_stats(t):
    return t.documents.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"), F.round(F.avg(F.length("text")), 4).alias("mean_length"), F.max(F.length("text")).cast("long").alias("longest"), F.round(F.count(F.lit(1)) / F.count_distinct("source"), 2).alias("per_source"))


@query("SELECT cast(doc_id // 500 AS BIGINT) AS page, md5(string_agg('# ' || source || chr(10) || text || repeat(chr(10), 3), '' ORDER BY doc_id)) AS hash FROM documents GROUP BY 1")
def markdown_export(t):
    return tables.markdown_pages(t.documents.select(F.col("doc_id").alias("idx"), F.col("source").alias("title"), "text")).select("page", F.md5("text").alias("hash"))


@query("SELECT source, arg_max(doc_id, n_chars * 100000 + doc_id) AS path, max(n_chars * 100000 + doc_id) AS stamp FROM documents GROUP BY source")
def latest_snapshot(t):
    return tables.latest_snapshot(t.documents.select("source", F.col("doc_id").alias("path"), (F.col("n_chars") * 100000 + F.col("doc_id")).alias("stamp")), ["source"])


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def table_by_ids(t):
    return tables.by_ids(t.documents, t.labels.filter("quality = 1").select("doc_id"), "doc_id", "doc_id").select("doc_id", "text")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'q' || doc_id WHEN 1 THEN 'i' || doc_id ELSE NULL END AS qid FROM documents")
def first_truthy_id(t):
    return t.documents.select("doc_id", tables.first_truthy(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("q"), "doc_id")).otherwise("0"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("i"), "doc_id")).otherwise("")).alias("qid"))


# ---- strategies, with offline providers

def _corpus(t):
    chunks = extraction.extract_events(t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), providers.rule_events)
    events = cut(chunks.filter("event_rank is not null").select(F.col("chunk_id").alias("event_id"), "chunk_id", "title", "content", "entities"))
    embed = providers.embedder()
    edges = cut(events.select("event_id", F.explode("entities").alias("entity_id")).distinct())
    entities = edges.select("entity_id").distinct().withColumn("v", embed("entity_id"))
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), embed("text").alias("v"))
    return Corpus(events.select("event_id", "chunk_id", embed("title").alias("title_vector"), embed("content").alias("content_vector")), entities, edges, texts)


def _strategy(name: str):
    def run(t):
        q = t.benchmark
        embed = providers.embedder()
        providers.bound_texts(t.spark)
        names = q.select(F.col("item_id").alias("qid"), F.posexplode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"), F.lit(1)))).alias("ord", "name"))
        config = SearchConfig.atomic() if name == "atomic" else SearchConfig(name, max_events_b=50 if name in ("multi1", "hopllm") else 0)
        return search(q.select(F.col("item_id").alias("qid"), embed("text").alias("qv")), names.select("qid", "ord", embed("name").alias("qv")), _corpus(t), config)

    run.__name__ = f"strategy_{name}"
    query()(run)


for _name in ("vector", "atomic", "multi", "multi1", "hopllm"):
    _strategy(_name)
