"""Replacing an article's rows in several tables at once: new versions are staged, read back, and switched by one manifest file.

A table is a set of buckets by the hash of the article id; a version of a bucket is a folder that never changes. The manifest names each bucket's
folder for every table. A replace rewrites only the buckets of the articles it names, reads them back, and writes the next manifest with a
rename that fails if it is there already, so readers see all tables change together or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class ReplaceError(RuntimeError):
    """The read-back of a staged version lacks rows; nothing was switched."""


class ArticleStore:
    """Tables below a folder that all nodes share.

    ``tables`` gives each table's schema (DDL, with an ``article_id``). ``soft`` names, for tables whose old rows are marked instead of
    deleted, the column and the value that marks them.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str], soft: dict[str, tuple[str, str]] | None = None, buckets: int = 64):
        self.spark, self.path, self.tables, self.soft, self.buckets = spark, path.rstrip("/"), tables, soft or {}, buckets

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the current manifest; 0 before the first replace."""
        place, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(place):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """table -> bucket -> folder."""
        version = self.version() if version is None else version
        if not version:
            return {name: {} for name in self.tables}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's rows in the current (or an older) version."""
        return self._rows(table, sorted(self.manifest(version)[table].values()))

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.tables[table]).parquet(*folders) if folders else self.spark.createDataFrame([], self.tables[table])

    def _bucket(self, article: Column) -> Column:
        return F.pmod(F.xxhash64(article), F.lit(self.buckets)).cast("int")

    def replace(self, articles: DataFrame, new: dict[str, DataFrame]) -> dict[str, int]:
        """Replaces the rows of the articles (article_id) in every table by the new ones; rows written by table.

        Tables without new rows lose (or mark) the articles' rows as well. New rows of articles that aren't named are an error. A failure at any
        point leaves the old state; staged folders of a failed replace are removed.
        """
        version, stage = self.version(), uuid.uuid4().hex
        named = articles.select(F.col("article_id")).distinct()
        current = self.manifest(version)
        touched = sorted(r[0] for r in named.select(self._bucket(F.col("article_id")).alias("b")).distinct().collect())
        following, written = {name: dict(folders) for name, folders in current.items()}, {}
        try:
            for name in self.tables:
                columns = self._rows(name, []).columns
                fresh = new[name].select(*columns) if name in new else self._rows(name, [])
                stray = fresh.join(named, "article_id", "left_anti").limit(1).count()
                if stray:
                    raise ReplaceError(f"{name}: new rows of articles that are not replaced")
                old = self._rows(name, sorted(current[name][str(b)] for b in touched if str(b) in current[name]))
                kept = old.join(named, "article_id", "left_anti").select(*columns)
                if name in self.soft:
                    column, mark = self.soft[name]
                    marked = old.join(named, "article_id", "left_semi").withColumn(column, F.lit(mark)).select(*columns)
                    kept = kept.unionByName(marked)
                rows = kept.unionByName(fresh).withColumn("_bucket", self._bucket(F.col("article_id")))
                root = f"{self.path}/{name}/{stage}"
                found = {} if rows.isEmpty() else self._stage(rows, name, root)
                for b in touched:
                    following[name].pop(str(b), None)
                following[name] |= {str(b): f"{root}/_bucket={b}" for b in found}
                written[name] = sum(found.values())
            self._switch(version + 1, following)
        except Exception:
            for name in self.tables:
                place, fs = self._fs(f"{self.path}/{name}/{stage}")
                fs.delete(place, True)
            raise
        return written

    def _stage(self, rows: DataFrame, name: str, root: str) -> dict[int, int]:
        """Writes rows by bucket and gives the rows that a reader finds in each; all that reached the writer must be there."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(root)
        back = self.spark.read.schema(f"{self.tables[name]}, _bucket int").parquet(root).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        found = {r["_bucket"]: r["n"] for r in back}
        if sum(found.values()) != seen.get["n"]:
            raise ReplaceError(f"{name}: {seen.get['n']} rows written, {sum(found.values())} read back")
        return found

    def _switch(self, version: int, manifest: dict) -> None:
        draft, fs = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        place, _ = self._fs(f"{self.path}/manifests/{version}.json")
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise ReplaceError("another replace was switched first")

    def missing(self, table: str, wanted: DataFrame, key: str = "id") -> DataFrame:
        """The wanted keys that the current version of a table lacks."""
        return wanted.select(key).join(self.read(table).select(key), key, "left_anti")
