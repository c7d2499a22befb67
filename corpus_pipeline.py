"""A training corpus in five stages, each one of the operators in skein.llm; every stage's rows are written and read again.

Each stage takes all rows the one before kept. Rows are judged by their texts: null and empty texts are equal, never toxic, near or
contaminated by themselves, and one of them stays; null and repeated doc_ids are rows like any others, and a repeated row goes with its
equal texts. Texts may be of any length, other columns may have any names and stay until the last stage, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import Scratch
from skein.llm.decontamination import drop_contaminated
from skein.llm.exact_dedup import drop_exact_copies
from skein.llm.near_dup import drop_near_copies
from skein.llm.packing import pack_sequences
from skein.llm.queries import tokenizer_file
from skein.llm.toxicity import drop_toxic


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels outside its held-out fold, calls toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles stays."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole, in good part or paraphrased, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 4,096."""
    return pack_sequences(docs, tokenizer_file())


STAGES = [
    ("toxicity", clean_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The classifier, the retrieval and the tokenizer cannot be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of the documents that all stages keep."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.stash(stage(spark, docs, sf_dir), name)
    return docs
