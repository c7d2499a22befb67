"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_with_hot


def _forest(kind: pa.DataType):
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Union-find over the links of one batch: at most one link for each node, to the smallest one it reaches."""
        for batch in batches:
            root: dict = {}

            def find(x):
                while (up := root.setdefault(x, x)) != x:
                    root[x] = root[up]
                    x = root[x]
                return x

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            links = [(x, find(x)) for x in root]
            links = [x for x in links if x[0] != x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], kind) for i in (0, 1)], ["a", "b"])

    return forest


def connected(links: DataFrame, scratch: Scratch, name: str = "components", rounds: int = 50) -> DataFrame:
    """links: columns a and b, long or binary. Returns node, component (the smallest node reachable) for every node with a link.

    A node that very many links share is joined by broadcast (see join_with_hot), so no task gets all of them.
    """
    kind = links.schema["a"].dataType.simpleString()
    forest = _forest(pa.binary() if kind == "binary" else pa.int64())
    links = links.select("a", "b").filter("a is not null and b is not null").mapInArrow(forest, f"a {kind}, b {kind}").distinct()
    current, mark = scratch.stash(links, f"{name}-0"), None
    count = current.count()
    for i in range(1, rounds + 1):
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        least = scratch.stash(least, f"{name}-least-{i}")
        large = join_with_hot(both, least, "a", "n", 2 * count).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # each larger neighbour now points at smaller ones only: small-star, whose centres are these few
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = large.join(small, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.stash(moved.union(small.select("u", "m")).distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}", f"{name}-least-{i}")
        now = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        current, count = new, now["n"]
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
