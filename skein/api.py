"""The engine's front: load, extract, search, evaluate; each takes and returns DataFrames."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skein import providers
from skein.functions.text import estimate_tokens
from skein.operators import chunking, extraction, metrics
from skein.operators.lineage import folder, stored
from skein.operators.token_chunks import chunks_standard
from skein.plans.search import Corpus, SearchConfig, rerank_by_score, search


def session(name: str = "skein", **settings: str) -> SparkSession:
    """UTC, AQE on; other settings as given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


class Engine:
    """Stages that run: each writes its result below ``store``, so its status, time, rows and tokens are those of the work itself.

    store is a folder that all nodes share (by default a new one below spark.checkpoint.dir). A failing stage is recorded and raised if
    fail_fast; otherwise its result is None.
    """

    def __init__(self, spark: SparkSession, fail_fast: bool = True, store: str | None = None):
        self.spark, self.fail_fast, self.stages = spark, fail_fast, []
        self.store = store or folder(spark, "engine")

    def run(self, name: str, plan: Callable[[], DataFrame], tokens: str | None = None) -> DataFrame | None:
        """Runs a plan as a stage; ``tokens`` names a text column whose estimated tokens are added up on the way."""
        began, error, result = time.time(), None, None
        seen = Observation(f"{name}-{len(self.stages)}")
        try:
            df = plan()
            size = F.sum(F.coalesce(estimate_tokens(F.col(tokens)), F.lit(0))) if tokens else F.lit(None).cast("long")
            measured = [F.count(F.lit(1)).alias("rows"), *([size.alias("tokens")] if tokens else [])]
            result = stored(df.observe(seen, *measured), f"{self.store}/{len(self.stages)}-{name}")
        except Exception as e:  # noqa: BLE001  recorded below
            error = e
        got = seen.get if error is None else {}
        self.stages.append((name, "FAILED" if error else "COMPLETED", time.time() - began, got.get("rows"), got.get("tokens"), str(error) if error else None))
        if error and self.fail_fast:
            raise error
        return result

    def stage_results(self) -> DataFrame:
        return self.spark.createDataFrame(self.stages, "stage string, status string, seconds double, rows long, tokens long, error string")

    def usage(self) -> DataFrame:
        """Stages run, rows and tokens by stage."""
        return self.stage_results().groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))

    def result_json(self, logs: bool = False) -> str:
        """The stages' outcome as JSON; with logs, times and errors too."""
        rows = [{"stage": n, "status": s, "rows": r, "tokens": k} | ({"seconds": round(t, 3), "error": e} if logs else {}) for n, s, t, r, k, e in self.stages]
        return json.dumps({"status": "FAILED" if any(r["status"] == "FAILED" for r in rows) else "COMPLETED", "stages": rows}, ensure_ascii=False, indent=2)

    def load(self, articles: DataFrame, mode: str = "standard", max_tokens: int = 1000, tokenizer: str | None = None) -> DataFrame | None:
        """articles (doc_id, text) to chunks; modes standard (by a tokenizer file's counts, if one is named) and heading_strict."""
        if mode not in ("standard", "heading_strict"):
            raise ValueError(f"no mode {mode}")
        return self.run("load", lambda: chunking.chunks_by_heading(articles) if mode == "heading_strict" else chunks_standard(articles, max_tokens, tokenizer=tokenizer), "content")

    def extract(self, chunks: DataFrame, provider=providers.rule_events, parallel: int = 1) -> DataFrame | None:
        return self.run("extract", lambda: extraction.extract_events(chunks, provider, parallel=parallel), "content")

    def search(self, queries: DataFrame, query_entities: DataFrame, corpus: Corpus, config: SearchConfig = SearchConfig(), rerank=rerank_by_score) -> DataFrame | None:
        return self.run("search", lambda: search(queries, query_entities, corpus, config, rerank))

    def evaluate(self, predictions: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame | None:
        return self.run("evaluate", lambda: metrics.macro_average(metrics.ranking_metrics(predictions, gold, k)))


def new_sources(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources that are not there yet get an id and a name."""
    return wanted.join(known, "id", "left_anti").withColumn("name", F.coalesce("name", F.concat(F.lit("source-"), "id")))
