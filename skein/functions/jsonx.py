"""JSON and array expressions for model answers and references."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import cut

ENTITY = "struct<type:string,name:string,description:string>"
ITEM = f"struct<title:string,summary:string,content:string,category:string,keywords:array<string>,priority:string,status:string,references:array<string>,is_valid:boolean,entities:array<{ENTITY}>,children:string>"
ANSWER = f"struct<type:string,data:struct<items:array<{ITEM}>,meta:struct<reason:string,confidence:double>>>"


def unfence(x: Column) -> Column:
    """The JSON inside a fenced block, or the text itself; a JSON string that holds JSON is unwrapped."""
    inner = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(inner != "", inner).otherwise(F.trim(x))
    return F.coalesce(F.when(body.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>"), F.lit(0))), body)


def parse_answer(x: Column, schema: str = ANSWER) -> Column:
    return F.from_json(unfence(x), schema, {"mode": "PERMISSIVE"})


def answer_is_valid(answer: Column) -> Column:
    """Hard checks: items are there and each has a title and content."""
    items = answer["data"]["items"]
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda i: (F.coalesce(i["title"], F.lit("")) != "") & (F.coalesce(i["content"], F.lit("")) != "")), F.lit(False))


def references_to_ids(references: Column, ids: Column) -> Column:
    """1-based places (numbers or digit strings) to ids; bad ones are dropped; none left means all ids."""
    good = F.filter(F.transform(references, lambda r: r.try_cast("int")), lambda n: n.between(1, F.size(ids)))
    return F.when(F.size(F.coalesce(good, F.array().cast("array<int>"))) == 0, ids).otherwise(F.transform(good, lambda n: F.element_at(ids, n)))


def project_entities(entities: Column) -> Column:
    return F.transform(entities, lambda e: F.struct(e["type"].alias("type"), e["name"].alias("name"), e["description"].alias("description")))


def gold_answers(answer: Column, gold: Column, aliases: Column) -> Column:
    first = F.coalesce(F.nullif(answer, F.lit("")), gold)
    return F.array_distinct(F.concat(F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.array(first)), F.coalesce(aliases, F.array().cast("array<string>"))))


def gold_answers_of(sample: Column) -> Column:
    """Distinct gold answers of a question's JSON, in order: answer or gold_ans, else reference, else the obj family; then its aliases.

    Each field may be a string or an array of strings; the first field that is there decides, even if it holds null. In the obj family empty answers go.
    """
    field = lambda name: F.get_json_object(sample, f"$.{name}")
    strings = "array<string>"
    none = F.array().cast(strings)
    names = F.coalesce(F.json_object_keys(sample), none)
    some = lambda name: F.coalesce(F.when(field(name).startswith("["), F.from_json(field(name), strings)), F.when(field(name).isNotNull(), F.array(field(name))), none)
    family = F.filter(F.flatten(F.array(*map(some, ("obj", "possible_answers", "o_wiki_title", "o_aliases")))), lambda a: a != "")
    chosen = F.lit(None).cast(strings)
    for name in ("obj", "reference", "gold_ans", "answer"):
        chosen = F.when(F.array_contains(names, name), family if name == "obj" else some(name)).otherwise(chosen)
    return F.array_distinct(F.concat(F.coalesce(chosen, none), some("answer_aliases")))


def flatten_children(df: DataFrame, key: str, items: str, more: tuple[str, ...] = (), prune: bool = True) -> DataFrame:
    """Rows (key, path, parent, level, title) of nested items (a JSON array text), as deep as they go; an invalid item drops its whole subtree.

    ``more`` names further fields, which come as JSON texts; without ``prune`` invalid items and what is below them stay.

    Each round takes the children of the round before, which is stored, until there are none; the rounds are as many as the deepest item's levels.
    """
    schema = "array<string>"
    split = lambda x: F.from_json(x, schema)
    frontier = df.select(key, F.posexplode(split(F.col(items))).alias("pos", "item")).select(key, F.col("pos").cast("string").alias("path"), F.lit(None).cast("string").alias("parent"), "item")
    levels: list[DataFrame] = []
    while True:
        valid = F.coalesce(F.get_json_object("item", "$.is_valid"), F.lit("true")) != "false"
        frontier = cut(frontier.filter(valid) if prune else frontier)
        fields = [F.get_json_object("item", f"$.{name}").alias(name) for name in ("title", *more)]
        levels.append(frontier.select(key, "path", "parent", F.lit(len(levels)).alias("level"), *fields))
        below = frontier.select(key, F.col("path").alias("parent"), F.get_json_object("item", "$.children").alias("children")).filter("children IS NOT NULL")
        frontier = below.select(key, "parent", F.posexplode(split(F.col("children"))).alias("pos", "item")).select(key, F.concat_ws(".", "parent", F.col("pos").cast("string")).alias("path"), "parent", "item")
        if frontier.isEmpty():
            return functools.reduce(DataFrame.union, levels)


def answer_quality(df: DataFrame, key: str, items: str, types: list[str]) -> DataFrame:
    """(key, items, no_references, no_title, no_content, unknown_types) of each answer's items and all below them: warnings, not errors."""
    x = flatten_children(df, key, items, ("content", "references", "entities"), prune=False)
    blank = lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    kinds = F.transform(F.from_json("entities", f"array<{ENTITY}>"), lambda e: e["type"])
    strange = F.filter(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != "") & ~k.isin(types))
    none = F.coalesce(F.size(F.from_json("references", "array<string>")), F.lit(0)) <= 0
    x = x.select(key, none.alias("r"), blank("title").alias("t"), blank("content").alias("c"), strange.alias("strange"))
    return x.groupBy(key).agg(
        F.count(F.lit(1)).alias("items"), F.count_if("r").alias("no_references"), F.count_if("t").alias("no_title"), F.count_if("c").alias("no_content"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("strange")))).alias("unknown_types"),
    )


def parse_rerank_lines(lines: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """lines: qid, pos, line; candidates: qid, cand (1-based), text. The chosen candidates in order, each once, k at most.

    The id stands between the first '[' and the first ']'; if there is no such candidate, the text behind ']' is looked up.
    """
    from pyspark.sql import Window

    x = lines.filter(F.col("line").contains("[") & F.col("line").contains("]"))
    x = x.withColumn("named", F.regexp_extract("line", r"\[([^\]]*)\]", 1).try_cast("int")).withColumn("tail", F.trim(F.regexp_extract("line", r"^[^\]]*\](.*)$", 1)))
    by_id = candidates.select("qid", F.col("cand").alias("named"), F.lit(True).alias("known"))
    by_text = candidates.groupBy("qid", F.trim("text").alias("tail")).agg(F.min("cand").alias("by_text"))
    x = x.join(by_id, ["qid", "named"], "left").join(by_text, ["qid", "tail"], "left")
    x = x.withColumn("cand", F.when(F.col("known"), F.col("named")).otherwise(F.col("by_text"))).filter("cand is not null")
    first = x.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "cand").orderBy("pos"))).filter("_n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("pos")))
    return ranked.filter(F.col("rank") <= k).select("qid", "rank", "cand")
