"""Expansion over the bipartite graph of events and entities, for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import cut


def entity_to_event(seeds: DataFrame, edges: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """seeds (qid, entity_id) to distinct (qid, event_id); events, if given, restrict the result."""
    found = edges.join(seeds, "entity_id").select("qid", "event_id").distinct()
    return found if events is None else found.join(events.select("event_id"), "event_id", "left_semi").select("qid", "event_id")


def event_entities(found: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(found, "event_id").select("qid", "entity_id").distinct()


def new_rows(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return candidates.join(known, ["qid", key], "left_anti")


def expand(seeds: DataFrame, start: DataFrame, edges: DataFrame, hops: int, gate: int | None = None, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """hops rounds: new entities of the last events, then their new events.

    seeds (qid, entity_id) are known entities; start (qid, event_id) the events to go on from. With gate, a query takes part in a
    round only while it has gained fewer events. Returns (gained events with their hop, all known entities). The plan is unrolled:
    an empty frontier stays empty, which is the early stop. Each hop's new rows are cut off from their lineage.
    """
    known_entities, frontier, gained = seeds, start, None
    known_events = start if exclude is None else start.union(exclude).distinct()
    for hop in range(1, hops + 1):
        if gate is not None and gained is not None:
            full = gained.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= gate)
            frontier = frontier.join(full, "qid", "left_anti")
        entities = cut(new_rows(event_entities(frontier, edges), known_entities, "entity_id"))
        known_entities = known_entities.union(entities)
        frontier = cut(new_rows(entity_to_event(entities, edges), known_events, "event_id"))
        known_events = known_events.union(frontier)
        step = frontier.withColumn("hop", F.lit(hop))
        gained = step if gained is None else gained.union(step)
    return gained, known_entities


def phase_a(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events of the seeds (hop 0) and of exactly one hop, and the entities known then."""
    start = cut(entity_to_event(seeds, edges))
    gained, entities = expand(seeds, start, edges, 1)
    return start.withColumn("hop", F.lit(0)).union(gained), entities


def phase_b(seeds: DataFrame, eventset: DataFrame, edges: DataFrame, most: int = 0, retries: int = 3) -> DataFrame:
    """From seeds, further hops outside eventset until a query has gained most events; nothing if most is 0 (the default)."""
    events = eventset.select("qid", "event_id")
    if most <= 0 or retries <= 0:
        return events.filter(F.lit(False)).withColumn("hop", F.lit(0))
    first = cut(new_rows(entity_to_event(seeds, edges), events, "event_id"))
    start = first.withColumn("hop", F.lit(1))
    if retries == 1:
        return start
    full = first.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most)
    more, _ = expand(seeds, first.join(full, "qid", "left_anti"), edges, retries - 1, gate=most, exclude=events.union(first))
    return start.union(more.withColumn("hop", F.col("hop") + 1))


def event_details(events: DataFrame, wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """Details with empty texts for nulls, and the sorted entities of each wanted event; associations of unknown events are dropped."""
    rows = events.join(wanted.select("event_id").distinct(), "event_id", "left_semi")
    lists = edges.join(rows.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    texts = [F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    return rows.select(*texts).join(lists, "event_id", "left")


def dual_phase(first: DataFrame, second: DataFrame) -> DataFrame:
    """(qid, id, score) of two phases, each ranked, one behind the other."""
    from pyspark.sql import Window

    both = first.withColumn("phase", F.lit(1)).union(second.withColumn("phase", F.lit(2)))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("phase", F.col("score").desc(), "id")))


def ordered_dedup(rows: DataFrame) -> DataFrame:
    """(qid, pos, chunk_id, score): each chunk once, at its first place; the score becomes the weight."""
    from pyspark.sql import Window

    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("pos"))).filter("_n = 1")
    return one.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("pos")).alias("pos"), "chunk_id", F.col("score").alias("weight"))


def backfill(sections: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """Appends hits (qid, chunk_id, score) that are not there yet, best first, up to most sections a query."""
    from pyspark.sql import Window

    more = hits.join(sections, ["qid", "chunk_id"], "left_anti")
    more = more.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "chunk_id")).alias("pos"), "chunk_id", F.col("score").alias("weight"), F.lit(2).alias("src"))
    both = sections.withColumn("src", F.lit(1)).unionByName(more)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("src", "pos"))).filter(F.col("pos") <= most)


def tree_levels(rows: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """key, parent, root, level for rows that name their parent: a root is a row without one, or whose parent isn't there; it has level 0.

    Each round doubles the way that every row looks up, so a tree of n levels takes log2(n) rounds. Rows in a cycle, or below one, have no
    root: root and level are null. Keys must be unique; a null key is left out.
    """
    rows = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(parent).alias("parent"))
    ids = rows.select(F.col("key").alias("there"))
    state = cut(rows.join(ids, F.col("parent") == F.col("there"), "left").select("key", "parent", F.col("there").alias("up"), F.when(F.col("there").isNotNull(), 1).otherwise(0).cast("long").alias("level")))
    most, reach = state.count(), 1
    while reach <= most and not state.filter("up IS NOT NULL").isEmpty():
        # who has arrived keeps its root in last; the others add their ancestor's way to their own
        above = state.select(F.col("key").alias("at"), F.col("up").alias("next"), F.col("level").alias("more"), *(["last"] if "last" in state.columns else [F.lit(None).cast(state.schema["key"].dataType).alias("last")]))
        going = state.filter("up IS NOT NULL").join(above.withColumnRenamed("last", "found"), F.col("up") == F.col("at"))
        done = state.filter("up IS NULL")
        done = done if "last" in state.columns else done.withColumn("last", F.col("key"))
        moved = going.select("key", "parent", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"), F.when(F.col("next").isNull(), F.coalesce("found", "at")).alias("last"))
        state, reach = cut(moved.unionByName(done)), 2 * reach
    if "last" not in state.columns:
        state = state.withColumn("last", F.col("key"))
    lost = F.col("up").isNotNull()
    return state.select(F.col("key").alias(key), F.col("parent").alias(parent), F.when(~lost, F.col("last")).alias("root"), F.when(~lost, F.col("level")).alias("level"))
