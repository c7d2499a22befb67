"""The five search strategies as plans over many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import graph, masks, vectors
from skein.operators.lineage import cut, kept, small


@dataclass(frozen=True)
class SearchConfig:
    """Defaults of the strategies; unknown values of a range raise."""

    strategy: str = "multi"
    entity_top_k: int = 20
    event_top_k: int = 20
    entity_threshold: float = 0.9
    event_threshold: float = 0.4
    max_hops: int = 1
    max_events: int = 100
    max_events_a: int = 100
    max_events_b: int = 0
    max_hop_retries: int = 3
    rerank_top_k: int = 10
    max_sections: int = 10
    scaled: bool = False  # scores are (1 + cosine) / 2, as some stores give them, and not the cosine itself

    def __post_init__(self):
        if self.strategy not in ("vector", "atomic", "multi", "multi1", "hopllm"):
            raise ValueError(f"no strategy {self.strategy}")
        if not (0 <= self.entity_threshold <= 1 and 0 <= self.event_threshold <= 1):
            raise ValueError("thresholds lie between 0 and 1")
        if min(self.entity_top_k, self.event_top_k, self.max_events, self.rerank_top_k, self.max_sections) < 1 or self.max_hops < 0 or self.max_events_b < 0:
            raise ValueError("counts must be positive")

    @staticmethod
    def atomic() -> "SearchConfig":
        return SearchConfig("atomic", max_events=1000, rerank_top_k=5)


@dataclass(frozen=True)
class LoadConfig:
    """Defaults of loading; ranges as in SearchConfig."""

    mode: str = "standard"
    max_tokens: int = 1000
    min_length: int = 20

    def __post_init__(self):
        if self.mode not in ("standard", "heading_strict") or not 64 <= self.max_tokens <= 1000 or self.min_length < 0:
            raise ValueError("mode standard or heading_strict, 64 to 1000 tokens, no negative length")


@dataclass(frozen=True)
class ExtractConfig:
    """Defaults of extraction."""

    related_top_k: int = 3
    related_threshold: float = 0.7
    embedding_batch: int = 10

    def __post_init__(self):
        if min(self.related_top_k, self.embedding_batch) < 1 or not 0 <= self.related_threshold <= 1:
            raise ValueError("counts must be positive, thresholds between 0 and 1")


@dataclass(frozen=True)
class Corpus:
    """events (event_id, chunk_id, title_vector, content_vector), entities (entity_id, v), edges (event_id, entity_id), chunks (chunk_id, v)."""

    events: DataFrame
    entities: DataFrame
    edges: DataFrame
    chunks: DataFrame


def sources(one: str | None = None, many: list[str] | None = None) -> list[str]:
    """One id or several, as a list of distinct ones in order; none is an error."""
    out = list(dict.fromkeys(x for x in [*(many or []), one] if x))
    if not out:
        raise ValueError("a source is needed")
    return out


def rerank_by_score(candidates: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """The stand-in for a reranker: candidates (qid, pos, event_id, score) keep their order."""
    return candidates.filter(F.col("pos") <= k)


def reranker(choose: Callable[[list[str]], list[int]], column: str = "content"):
    """A reranker that shows each query's candidates, in order, to choose(texts) -> places from 0, best first.

    multi shows the events' content, atomic their title. Places that don't exist or repeat are left out. At most max_events rows a query meet in a task.
    """

    def rerank(candidates: DataFrame, events: DataFrame, k: int) -> DataFrame:
        kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("qid", "event_id")}

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["pos", "event_id"], ignore_index=True)
            order = [i for i in dict.fromkeys(choose(group["text"].tolist())) if 0 <= i < len(group)][:k]
            return group.loc[order].assign(pos=range(1, len(order) + 1))[["qid", "pos", "event_id", "score"]]

        shown = candidates.join(events.select("event_id", F.col(column).alias("text")), "event_id")
        return shown.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, pos int, event_id {kinds['event_id']}, score double")

    return rerank


def envelope(results: DataFrame, queries: DataFrame, config: SearchConfig) -> DataFrame:
    """One row for each query: qid, strategy, count, reranked, sections array<struct<pos, chunk_id, weight>> in order (max_sections at most).

    reranked counts the sections that come by events; a query without results has none.
    """
    parts = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "weight"))).alias("sections"), F.count_if(F.col("src") == 0).alias("reranked"))
    x = queries.select("qid").join(parts, "qid", "left")
    sections = F.coalesce("sections", F.array().cast(parts.schema["sections"].dataType))
    return x.select("qid", F.lit(config.strategy).alias("strategy"), F.size(sections).alias("count"), F.coalesce("reranked", F.lit(0)).alias("reranked"), sections.alias("sections"))


def recall_channels(by_entity: DataFrame, by_title: DataFrame) -> DataFrame:
    """Two channels of (qid, event_id, score): the title's score overrides the entities' 0, since it is at least the threshold."""
    return by_entity.unionByName(by_title).groupBy("qid", "event_id").agg(F.max("score").alias("score"))


def assemble_candidates(ranked: DataFrame, events: DataFrame) -> DataFrame:
    """ranked (qid, event_id, pos) with the events' titles, empty where there is none."""
    return ranked.join(events.select("event_id", "title"), "event_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def recall_entities(query_entities: DataFrame, entities: DataFrame, k: int, least: float, scaled: bool = False) -> DataFrame:
    """(qid, ord, qv) of the queries' entities to the stored ones, each at its first place."""
    asked = query_entities.select(F.concat_ws("/", F.col("qid").cast("string"), F.lpad(F.col("ord").cast("string"), 6, "0")).alias("qid"), "qv")
    hits = vectors.knn(asked, entities.select(F.col("entity_id").alias("id"), "v"), k).filter(vectors.score_from_cosine(F.col("score"), scaled) >= least)
    kind = query_entities.schema["qid"].dataType
    hits = hits.select(F.split("qid", "/")[0].cast(kind).alias("qid"), F.split("qid", "/")[1].cast("int").alias("ord"), "rank", "id", "score")
    return vectors.first_seen(hits).select("qid", F.col("id").alias("entity_id"), "score")


def rank_events(queries: DataFrame, candidates: DataFrame, events: DataFrame, vector: str, most: int) -> DataFrame:
    """Cosine of candidate events (qid, event_id) only."""
    known = cut(masks.numbers(queries))
    return rank_masks(queries, known, masks.pack(candidates, known, "event_id"), events, vector, most)


def rank_masks(queries: DataFrame, known: DataFrame, candidates: DataFrame, events: DataFrame, vector: str, most: int) -> DataFrame:
    """rank_events for candidates in bits (id, word, mask)."""
    stored = events.select(F.col("event_id").alias("id"), F.col(vector).alias("v"))
    return vectors.top_k(vectors.score_masks(queries, known, stored, candidates, most), most)


def search(queries: DataFrame, query_entities: DataFrame, corpus: Corpus, config: SearchConfig = SearchConfig(), rerank: Callable[[DataFrame, DataFrame, int], DataFrame] = rerank_by_score) -> DataFrame:
    """queries (qid, qv), query_entities (qid, ord, qv): (qid, pos, chunk_id, weight, src), at most max_sections a query.

    rerank(candidates (qid, pos, event_id, score), events, k) gives the events to show; see rerank_by_score and reranker.
    """
    chunks = corpus.chunks.select(F.col("chunk_id").alias("id"), "v")
    direct = vectors.knn(queries, chunks, 2 * config.max_sections).select("qid", F.col("id").alias("chunk_id"), "score")
    if config.strategy == "vector":
        return vectors.top_k(direct, config.max_sections, tie="chunk_id").select("qid", F.col("rank").alias("pos"), "chunk_id", F.col("score").alias("weight"), F.lit(1).alias("src"))
    seeds = recall_entities(query_entities, corpus.entities, config.entity_top_k, config.entity_threshold, config.scaled)
    seeds = kept(seeds.select("qid", "entity_id"), "seeds")
    by_entity = graph.entity_to_event(small(seeds), corpus.edges).withColumn("score", F.lit(0.0))
    titles = corpus.events.select(F.col("event_id").alias("id"), F.col("title_vector").alias("v"))
    by_title = vectors.knn(queries, titles, config.event_top_k).filter(vectors.score_from_cosine(F.col("score"), config.scaled) >= config.event_threshold).select("qid", F.col("id").alias("event_id"), "score")
    start = kept(recall_channels(by_entity, by_title).select("qid", "event_id"), "start")
    # the expansion goes by bits: its rows are nodes with the queries that reach them
    known = cut(masks.numbers(queries))
    seeds, start = kept(masks.pack(seeds, known, "entity_id"), "masks"), kept(masks.pack(start, known, "event_id"), "masks")
    hops = config.max_hops if config.strategy in ("multi", "atomic") else 1
    two_phases = config.strategy in ("multi1", "hopllm") and config.max_events_b > 0
    # only stored events are ranked, so a last step goes over their edges alone; multi1 goes on from the events it gains, and retries count all
    onward, retries = two_phases and config.strategy == "multi1", two_phases and config.max_hop_retries > 1
    shown = kept(corpus.events.select("event_id").distinct(), "shown")
    ends = kept(corpus.edges.select("event_id", "entity_id").join(small(shown), "event_id", "left_semi").repartition("event_id"), "edges")
    gained = masks.expand(seeds, start, corpus.edges, hops, last=None if onward or retries else ends)
    seen = gained if retries or not onward else gained.join(small(shown.withColumnRenamed("event_id", "id")), "id", "left_semi")
    eventset = kept(masks.union(start, seen), "masks")
    vector = "title_vector" if config.strategy == "atomic" else "content_vector"
    ranked = rank_masks(queries, known, eventset, corpus.events, vector, config.max_events_a if config.strategy == "hopllm" else config.max_events)
    if two_phases:
        ranked = cut(ranked)
        origin = gained if onward else kept(masks.pack(ranked.select("qid", "id"), known, "id"), "masks")
        back = corpus.edges
        if not retries:  # entities that lead to no stored event are left out
            near = kept(ends.select("entity_id").distinct(), "near")
            back = small(kept(corpus.edges.select("event_id", "entity_id").join(small(near), "entity_id", "left_semi"), "edges"))
        seeds_b = kept(masks.step(origin, back, "event_id", "entity_id"), "masks")
        second = kept(masks.phase_b(seeds_b, eventset, corpus.edges, config.max_events_b, config.max_hop_retries, ends), "masks")
        ranked = graph.dual_phase(ranked.select("qid", "id", "score"), rank_masks(queries, known, second, corpus.events, vector, config.max_events_b).select("qid", "id", "score"))
    else:
        ranked = ranked.withColumn("pos", F.col("rank"))
    chosen = rerank(ranked.select("qid", "pos", F.col("id").alias("event_id"), "score"), corpus.events, config.rerank_top_k)
    rows = chosen.join(corpus.events.select("event_id", "chunk_id").filter("chunk_id is not null"), "event_id").select("qid", "pos", "chunk_id", "score")
    return graph.backfill(graph.ordered_dedup(rows), direct, config.max_sections)
