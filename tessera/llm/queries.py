"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslice, infill, licenses, line_dedup, multi_index, packing, pii, quality, sentencepiece_viterbi, simhash_golay, suffix_dedup, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.round_trip(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op3_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"), min_share=line_dedup.SHARE)


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_quality_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_sentencepiece_viterbi": op1_sentencepiece_viterbi,
    "op2_pii_disclosure": op2_pii_disclosure,
    "op3_license_dice": op3_license_dice,
    "op4_toxicity_compression": op4_toxicity_compression,
    "op5_line_templates": op5_line_templates,
    "op6_bit_sliced_top_k": op6_bit_sliced_top_k,
    "op7_suffix_groups": op7_suffix_groups,
    "op8_inverted_multi_index": op8_inverted_multi_index,
    "op9_simhash_golay": op9_simhash_golay,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_quality_convolution": op11_quality_convolution,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL: dict[str, str] = {
    "op3_license_dice": licenses.oracle_sql(),
    "op6_bit_sliced_top_k": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op12_fill_in_middle": infill.oracle_sql(),
    "op13_vector_codes": vector_codes.oracle_sql(),
}
