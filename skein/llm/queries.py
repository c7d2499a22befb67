"""The queries of the corpus operators, with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_bytes, token_digests
from .conversation_repair import conversation_digests, repair_conversations
from .decontamination import contaminated_pairs
from .exact_dedup import exact_groups
from .hard_negatives import mine_hard_negatives
from .id_files import token_round_trip
from .language_id import identify_languages
from .near_dup import near_groups
from .packing import pack_sequences
from .personal_data import find_personal_data
from .repair_sql import REPAIR
from .sharding import interleave_shards
from .substring_dedup import remove_repeats
from .toxicity import toxicity


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_docs(spark, sf_dir)).drop("row")


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards(_docs(spark, sf_dir))


def op7_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_docs(spark, sf_dir))


def op8_differencing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(_docs(spark, sf_dir), tokenizer_file())


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_docs(spark, sf_dir))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_docs(spark, sf_dir), k=2, percent=80)


def op4_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_docs(spark, sf_dir))


def op6_context_mixing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(_docs(spark, sf_dir), tokenizer_file())


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that crc32(conv_id:turn) % 20 picks, and how many copies of each row there are (0: dropped)."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(text("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def op11_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(repair_conversations(damaged_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")), copies="copies"))


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", moved))


def op13_matrix_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return token_digests(encode_bytes(_docs(spark, sf_dir), ranks, pattern), ranks, pattern)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_stratified_shards, op4_latent_retrieval, op5_recompression, op6_context_mixing_files, op7_language_bayes, op8_differencing_packs, op9_personal_data, op10_superminhash, op11_viterbi_repair, op12_norm_buckets, op13_matrix_byte_bpe)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": f"""
            WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
        "op5_recompression": r"""
            WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
            s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
            k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM s),
            f AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
            c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM k JOIN f USING (h) WHERE least < doc_id),
            x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
            o AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
            SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)""",
        "op11_viterbi_repair": REPAIR,
        "op12_norm_buckets": """
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                       list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                       WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
                  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
            p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
                   other_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
            QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3""",
    }
