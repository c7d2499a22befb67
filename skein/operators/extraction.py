"""From chunks to events and entities: prompts, resolution, merging, ranks, states."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import providers

# fixed values: the default entity types with weight and similarity threshold
DEFAULT_TYPES = [
    ("time", 1.0, 0.900), ("location", 1.0, 0.750), ("person", 1.2, 0.950), ("organization", 1.1, 0.850), ("group", 1.0, 0.700), ("subject", 1.5, 0.600),
    ("work", 1.0, 0.850), ("product", 1.1, 0.800), ("action", 1.3, 0.800), ("metric", 1.2, 0.800), ("tags", 0.5, 0.700),
]


def not_deleted(status: Column) -> Column:
    return status.isNull() | (status != "DELETED")


def not_removed(is_delete: Column) -> Column:
    """is_delete = false; a row without the field doesn't count as kept."""
    return F.coalesce(~is_delete, F.lit(False))


def not_image(kind: Column) -> Column:
    return kind.isNull() | (kind != "IMAGE")


def long_enough(chunk_length: Column, content: Column, least: int = 20) -> Column:
    return F.coalesce(F.nullif(chunk_length, F.lit(0)), F.length(content)) >= least


def entity_key(source: Column, kind: Column, name: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", source.cast("string"), kind, F.lower(F.trim(name))))


def resolve_entities(mentions: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(source, type, name, ord) to entities by source, type and lower-cased name; the first name stays, unknown types go.

    Names of at most one visible character are no entities. Ids are hashes of the key, so runs agree without a registry.
    """
    x = mentions.filter(F.length(F.trim("name")) > 1)
    if types is not None:
        x = x.join(types.select("type").distinct(), "type", "left_semi")
    key = entity_key(F.col("source"), F.col("type"), F.col("name"))
    return x.groupBy("source", "type", F.lower(F.trim("name")).alias("normalized_name")).agg(F.min_by("name", "ord").alias("name"), F.first(key).alias("entity_id"), F.count(F.lit(1)).alias("mentions"))


def merge_descriptions(links: DataFrame) -> DataFrame:
    """(event_id, entity_id, ord, description): distinct descriptions in order, joined."""
    one = links.filter(F.coalesce("description", F.lit("")) != "").groupBy("event_id", "entity_id", "description").agg(F.min("ord").alias("ord"))
    return one.groupBy("event_id", "entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "description"))), lambda x: x["description"]), "、").alias("description"))


def renumber_events(events: DataFrame, group: str) -> DataFrame:
    """Ranks 0.. by chunk rank (9999 if null), event rank and id, within group."""
    w = Window.partitionBy(group).orderBy(F.coalesce("chunk_rank", F.lit(9999)), "event_rank", "event_id")
    return events.withColumn("rank", F.row_number().over(w) - 1)


def type_settings(entities: DataFrame, types: DataFrame) -> DataFrame:
    """Joins threshold and weight of the type; defaults 0.8 and 1.0."""
    t = types.select("type", F.col("weight").alias("_w"), F.col("threshold").alias("_t"))
    return entities.join(t, "type", "left").select(entities["*"], F.coalesce("_t", F.lit(0.8)).alias("threshold"), F.coalesce("_w", F.lit(1.0)).alias("weight"))


def effective_types(own: DataFrame, default: DataFrame, runtime: DataFrame) -> DataFrame:
    """A source's types, then defaults, then runtime ones; the first of a type wins."""
    every = own.withColumn("_p", F.lit(1)).unionByName(default.withColumn("_p", F.lit(2))).unionByName(runtime.withColumn("_p", F.lit(3)))
    return every.withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy("_p"))).filter("_n = 1").drop("_n", "_p")


def event_time(article: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    x = events.join(article.select("article_id", "created_time"), "article_id", "left")
    when = F.coalesce("created_time", now)
    return x.withColumns({"start_time": when, "end_time": when}).drop("created_time")


def event_documents(events: DataFrame, links: DataFrame) -> DataFrame:
    lists = links.groupBy("event_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return events.join(lists, "event_id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast(lists.schema["entity_ids"].dataType)))


def event_document_json(events: DataFrame, links: DataFrame, fields: list[str], optional: list[str]) -> DataFrame:
    """(event_id, document): the search store's JSON of each event with its entity_ids; optional fields (text or array) are there only if they hold something."""
    x = event_documents(events, links)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    held = [F.when(F.size(c) > 0 if kinds[c].startswith("array") else F.col(c).cast("string") != "", F.col(c)).alias(c) for c in optional]
    return x.select("event_id", F.to_json(F.struct("event_id", *fields, "entity_ids", *held)).alias("document"))


#: The shape of an answer's entities, whose type may be restricted.
ENTITY_SCHEMA = {"type": "object", "properties": {"type": {"type": "string"}, "name": {"type": "string"}, "description": {"type": "string"}}, "required": ["type", "name"]}


def answer_schemas(types: DataFrame, source: str = "source", kind: str = "type") -> DataFrame:
    """(source, schema): the JSON schema of an entity for each source, its allowed types in order as an enumeration.

    A source has its entity types, a small set; a source whose types are all null gets the schema without an enumeration.
    """
    head, tail = json.dumps(ENTITY_SCHEMA, separators=(",", ":")).split('"type":{"type":"string"', 1)
    allowed = F.array_sort(F.collect_set(kind))
    listed = F.when(F.size(allowed) > 0, F.concat(F.lit(',"enum":'), F.to_json(allowed))).otherwise("")
    return types.groupBy(source).agg(F.concat(F.lit(head + '"type":{"type":"string"'), listed, F.lit(tail)).alias("schema"))


def prompt_input(chunks: DataFrame, types: list[str]) -> DataFrame:
    """(chunk_id, items: array of texts) to the request's JSON, items numbered from 1."""
    items = F.transform("items", lambda x, i: F.struct((i + 1).alias("id"), x.alias("content")))
    return chunks.select("chunk_id", F.to_json(F.struct(items.alias("items"), F.array(*map(F.lit, types)).alias("entity_types"))).alias("request"))


def article_status(chunks: DataFrame) -> DataFrame:
    """(article_id, ok) to COMPLETED, PARTIAL or FAILED by the outcomes."""
    x = chunks.groupBy("article_id").agg(F.count_if("ok").alias("good"), F.count(F.lit(1)).alias("n"))
    return x.select("article_id", F.when(F.col("good") == F.col("n"), "COMPLETED").when(F.col("good") > 0, "PARTIAL").otherwise("FAILED").alias("status"))


def previous_chunk(chunks: DataFrame, source: str, rank: str, content: str) -> DataFrame:
    """chunks with ``previous``: the content of the chunk of the same source whose rank is one less, null where there is none.

    The join's key has the rank in it, so a source of very many chunks is spread; of several chunks of one rank the least content counts.
    """
    before = chunks.groupBy(F.col(source).alias("_source"), (F.col(rank) + 1).alias("_rank")).agg(F.min(content).alias("previous"))
    return chunks.join(before, (F.col(source) == F.col("_source")) & (F.col(rank) == F.col("_rank")), "left").drop("_source", "_rank")


def upsert_report(current: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many rows an upsert inserts, updates and leaves."""
    a = current.select(key, F.struct(*columns).alias("old"))
    b = new.select(key, F.struct(*columns).alias("new"))
    x = a.join(b, key, "full_outer").filter("new is not null")
    state = F.when(F.col("old").isNull(), "inserted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return x.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def replace_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old events of the articles in new are marked DELETED; new ones are added."""
    hit = new.select("article_id").distinct().withColumn("_hit", F.lit(True))
    marked = old.join(hit, "article_id", "left").withColumn("status", F.when(F.col("_hit"), "DELETED").otherwise(F.col("status"))).drop("_hit")
    return marked.unionByName(new)


def extract_events(chunks: DataFrame, provider, partitions: int | None = None, parallel: int = 1) -> DataFrame:
    """Maps chunks (chunk_id, content) through a provider of events; a failing chunk gives its error and no event.

    A task calls for at most ``parallel`` chunks at a time and keeps their order; ``providers.retried`` gives a provider further attempts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, (found, error) in zip(batch["chunk_id"], providers.in_parallel(lambda text: list(provider(text)), batch["content"].tolist(), parallel)):
                if error is None:
                    rows += [(chunk, i, e["title"], e["content"], [n for _, n in e["entities"]], None) for i, e in enumerate(found)]
                else:
                    rows.append((chunk, None, None, None, [], str(error)[:500]))
            yield pd.DataFrame(rows, columns=["chunk_id", "event_rank", "title", "content", "entities", "error"]).astype({"event_rank": "Int32"})

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    providers.bound_texts(chunks.sparkSession)
    x = chunks.select("chunk_id", "content") if partitions is None else chunks.select("chunk_id", "content").repartition(partitions)
    return x.mapInPandas(run, f"chunk_id {kind}, event_rank int, title string, content string, entities array<string>, error string")


def unique_entities(links: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities that links refer to, each once."""
    return entities.join(links.select("entity_id").distinct(), "entity_id", "left_semi")


def related_events(queries: DataFrame, events: DataFrame, links: DataFrame, k: int = 3, least: float = 0.7, most: int = 10) -> DataFrame:
    """(qid, rank, event_id, title, category, entities): the k events nearest by content with a score of at least ``least``.

    queries (qid, qv); events (event_id, title, category, content_vector); links (event_id, ord, type, name): each event shows its first ``most``.
    """
    from skein.operators import vectors

    hits = vectors.knn(queries, events.select(F.col("event_id").alias("id"), F.col("content_vector").alias("v")), k).filter(F.col("score") >= least)
    hits = hits.select("qid", "rank", F.col("id").alias("event_id"))
    named = links.join(hits.select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("ord", "type", "name"))).alias("x"))
    shown = F.transform(F.slice(F.coalesce("x", F.array().cast(named.schema["x"].dataType)), 1, most), lambda e: F.struct(e["type"].alias("type"), e["name"].alias("name")))
    rows = hits.join(events.select("event_id", "title", F.coalesce("category", F.lit("")).alias("category")), "event_id").join(named, "event_id", "left")
    return rows.select("qid", "rank", "event_id", "title", "category", shown.alias("entities"))


def chunk_requests(chunks: DataFrame, sections: DataFrame, types: list[str], least: int = 20) -> DataFrame:
    """The requests of an extraction: long enough chunks with the texts of their sections that are no images, and the chunk before.

    chunks (chunk_id, source, rank, content, chunk_length), sections (chunk_id, ord, type, content): (chunk_id, request, previous).
    """
    from skein.functions.text import previous_context

    long = previous_chunk(chunks, "source", "rank", "content").filter(long_enough(F.col("chunk_length"), F.col("content"), least))
    items = sections.filter(not_image(F.col("type"))).groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda s: s["content"]).alias("items"))
    x = long.join(items, "chunk_id", "left").withColumn("items", F.coalesce("items", F.array("content")))
    return x.join(prompt_input(x, types), "chunk_id").select("chunk_id", "request", previous_context(F.col("previous")).alias("previous"))


def upsert_embeddings(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """current with the rows of new; of rows that share the key the newest stamp stays, and new ones come before current ones."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col("_new").desc(), F.col("stamp").desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def missing_embeddings(written: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The read-back: rows of new whose key or bytes the written table lacks."""
    return new.select(key, "vec").distinct().join(written.select(key, "vec"), [key, "vec"], "left_anti")


def with_relations(events: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """events with their links' entities as an array of (entity_id, name), sorted by id; links to unknown entities are dropped."""
    x = links.join(events.select("event_id"), "event_id", "left_semi").join(entities.select("entity_id", "name"), "entity_id")
    return events.join(x.groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct("entity_id", "name"))).alias("entities")), "event_id", "left")
