"""Readers and writers: Markdown folders, corpora and questions in JSON, predictions, snapshots, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "title string, text string, idx int"
QUESTION = "id string, _id string, question string, answer string, answer_aliases array<string>, context array<array<string>>, supporting_facts array<array<string>>, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
PREDICTION = "question_index string, id string, query_id string, question string, retrieved_docs array<string>"
SCHEMAS = {
    "article": "id string, source_config_id string, title string, summary string, content string, category string, tags string, status string, parse_status string, created_time timestamp",
    "article_section": "id string, article_id string, order_index int, render_group_index int, type string, rank int, heading string, content string, raw_content string, image_url string, length int",
    "source_chunk": "id string, source_config_id string, source_type string, source_id string, article_id string, heading string, content string, raw_content string, references array<string>, rank int, chunk_length int",
    "source_event": "id string, source_config_id string, source_type string, source_id string, article_id string, title string, summary string, content string, category string, keywords array<string>, type string, priority string, status string, rank int, level int, parent_id string, start_time timestamp, end_time timestamp, references array<string>, chunk_id string",
    "entity_type": "id string, scope string, source_config_id string, article_id string, type string, name string, weight decimal(3,2), similarity_threshold decimal(4,3), is_active boolean, is_default boolean, value_format string, value_constraints string",
    "entity": "id string, source_config_id string, entity_type_id string, type string, name string, normalized_name string, value_type string, value_raw string, int_value bigint, float_value decimal(20,4), datetime_value timestamp, bool_value boolean, enum_value string, value_unit string, value_confidence decimal(5,4)",
    "event_entity": "id string, event_id string, entity_id string, weight decimal(3,2), description string",
    "event_entity_embedding": "id string, vec binary",
    "source_config": "id string, name string, description string, target_config string",
    "kb_document": "id string, name string, file_size int, file_type string, knowledge_base_id string, parse_status string, urls string, document_metadata string",
}


def create_tables(spark: SparkSession) -> None:
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def verify_tables(spark: SparkSession) -> DataFrame:
    """(table, missing): the columns that each table of SCHEMAS lacks in the session's catalogue; all of them if the table isn't there."""
    rows = []
    for name, columns in SCHEMAS.items():
        wanted = [c.split(" ")[0] for c in columns.split(", ")]
        there = set(spark.table(name).columns) if spark.catalog.tableExists(name) else set()
        rows.append((name, [c for c in wanted if c not in there]))
    return spark.createDataFrame(rows, "table string, missing array<string>")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Whole Markdown files with their path; other suffixes are not read."""
    return spark.read.option("pathGlobFilter", "*.{md,markdown}").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path, multiLine=True)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path, multiLine=True)


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null, empty nor zero."""
    return F.coalesce(*(F.when(~c.isin("", "0"), c) for c in columns))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.schema(PREDICTION).json(path, multiLine=True).filter("retrieved_docs is not null")
    return x.select(first_truthy(F.col("question_index"), F.col("id"), F.col("query_id")).alias("qid"), "question", "retrieved_docs")


def latest_snapshot(snapshots: DataFrame, key: list[str], stamp: str = "stamp", path: str = "path") -> DataFrame:
    return snapshots.groupBy(*key).agg(F.max_by(path, stamp).alias(path), F.max(stamp).alias(stamp))


def by_ids(table: DataFrame, ids: DataFrame, key: str, rank: str, most: int | None = None) -> DataFrame:
    """The rows of the ids in the order of rank, at most ``most`` of them (ENTITY_LIMIT and LINK_LIMIT are the stores' own)."""
    found = table.join(ids, key, "left_semi").orderBy(rank, key)
    return found if most is None else found.limit(most)


# fixed values: how many entities and associations a lookup by ids gives at most
ENTITY_LIMIT, LINK_LIMIT = 5000, 3000


def markdown_pages(corpus: DataFrame, each: int = 500) -> DataFrame:
    """(idx, title, text) to one text for each page of each documents: '# title', text, two blank lines."""
    one = F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.col("text"), F.lit("\n\n\n"))
    x = corpus.select(F.floor(F.col("idx") / each).alias("page"), F.struct("idx", one.alias("t")).alias("s"))
    return x.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "").alias("text"))


def write_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replaces just the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def routed(df: DataFrame, source: str, key: str, rows_each: int = 1_000_000) -> DataFrame:
    """df with ``shard``: rows of one source share a shard, but a source of over rows_each rows is dealt among several by the hash of the key."""
    sizes = df.groupBy(F.col(source).alias("_source")).agg(F.ceil(F.count(F.lit(1)) / rows_each).cast("int").alias("_shards"))
    x = df.join(sizes, F.col(source).eqNullSafe(F.col("_source")))
    return x.withColumn("shard", F.pmod(F.xxhash64(key), F.col("_shards")).cast("int")).drop("_source", "_shards")


def write_index(df: DataFrame, path: str, partition: str = "source_config_id", key: str = "id", rows_each: int = 1_000_000) -> None:
    """Appends df in folders by source, so reads of some sources prune the others; a large source's shards go to several tasks, and no file has over rows_each rows."""
    rows = routed(df, partition, key, rows_each).repartition(partition, "shard").drop("shard")
    rows.write.mode("append").option("maxRecordsPerFile", rows_each).partitionBy(partition).parquet(path)


def read_index(spark: SparkSession, path: str, sources: list, partition: str = "source_config_id") -> DataFrame:
    """The rows of some sources; the scan lists their folders only."""
    return spark.read.parquet(path).filter(F.col(partition).isin(sources))


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
