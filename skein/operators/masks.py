"""Sets of nodes for many queries at once, as bits: a row (id, word, mask) holds for a node which of 64 numbered queries have it.

Queries that share a node share its row, so a wide expansion makes a row for each node and 64 queries, not for each node and query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import kept, numbered, small

WORD = 64


def numbers(queries: DataFrame) -> DataFrame:
    """The distinct qids with dense numbers from 0, in order: (qid, n)."""
    return numbered(queries.select("qid").filter("qid IS NOT NULL").distinct(), "qid")


def pack(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows (qid, key) to (id, word, mask); qids that aren't known are left out."""
    x = rows.join(F.broadcast(known), "qid").select(F.col(key).alias("id"), F.expr(f"n div {WORD}").alias("word"), F.expr(f"shiftleft(1L, cast(n % {WORD} AS int))").alias("mask"))
    return _union(x)


def unpack(masks: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(id, word, mask) to rows (qid, key)."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    x = masks.select(F.col("id").alias(key), "word", F.explode(bits).alias("bit")).select(key, (F.col("word") * WORD + F.col("bit")).alias("n"))
    return x.join(F.broadcast(known), "n").select("qid", key)


def _union(masks: DataFrame) -> DataFrame:
    return masks.groupBy("id", "word").agg(F.bit_or("mask").alias("mask"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _union(a.unionByName(b))


def minus(masks: DataFrame, known: DataFrame) -> DataFrame:
    x = masks.join(known.withColumnRenamed("mask", "known"), ["id", "word"], "left")
    return x.select("id", "word", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long")))).alias("mask")).filter("mask <> 0")


def step(masks: DataFrame, edges: DataFrame, at: str, to: str) -> DataFrame:
    """Over the edges, from nodes of one side to those of the other; few masks (stored) go to the edges, which are many, and no edge is shuffled."""
    return _union(edges.select(F.col(at).alias("id"), F.col(to).alias("to")).join(small(masks), "id").select(F.col("to").alias("id"), "word", "mask"))


def open_queries(masks: DataFrame, gained: DataFrame, most: int) -> DataFrame:
    """masks without the queries that have gained ``most`` nodes."""
    bit = lambda c, i: F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long"))
    counts = gained.groupBy("word").agg(*(F.sum(bit(F.col("mask"), i)).alias(f"c{i}") for i in range(WORD)))
    full = counts.select("word", sum((F.shiftleft((F.col(f"c{i}") >= most).cast("long"), i) for i in range(1, WORD)), (F.col("c0") >= most).cast("long")).alias("full"))
    x = masks.join(F.broadcast(full), "word", "left")
    return x.select("id", "word", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("full", F.lit(0).cast("long")))).alias("mask")).filter("mask <> 0")


def expand(seeds: DataFrame, start: DataFrame, edges: DataFrame, hops: int, gate: int | None = None, exclude: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
    """graph.expand over masks: the events gained in ``hops`` rounds from start, of entities that weren't known.

    ``last``, if given, are the edges that the last round takes to events: those of the events that are wanted.
    """
    entities, frontier, gained = seeds, start, None
    events = start if exclude is None else union(start, exclude)
    for hop in range(hops):
        if gate is not None and gained is not None:
            frontier = kept(open_queries(frontier, gained, gate), "masks")
        fresh = kept(minus(step(frontier, edges, "event_id", "entity_id"), entities), "masks")
        frontier = kept(minus(step(fresh, edges if last is None or hop + 1 < hops else last, "entity_id", "event_id"), events), "masks")
        if hop + 1 < hops:
            entities, events = kept(union(entities, fresh), "masks"), kept(union(events, frontier), "masks")
        gained = frontier if gained is None else union(gained, frontier)
    return start.limit(0) if gained is None else gained


def phase_b(seeds: DataFrame, eventset: DataFrame, edges: DataFrame, most: int = 0, retries: int = 3, last: DataFrame | None = None) -> DataFrame:
    """graph.phase_b over masks; last as in expand."""
    if most <= 0 or retries <= 0:
        return eventset.limit(0)
    first = kept(minus(step(seeds, edges if last is None or retries > 1 else last, "entity_id", "event_id"), eventset), "masks")
    if retries == 1:
        return first
    more = expand(seeds, kept(open_queries(first, first, most), "masks"), edges, retries - 1, most, union(eventset, first))
    return union(first, more)
