"""The corpus operators as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import held_out
from .decontaminate import contained_items
from .extract import main_texts
from .near_dedup import near_duplicates
from .packing import packed
from .ppm import likelihoods
from .quality_model import quality_scores
from .quality_rules import quality_rules
from .ranked_search import ranked_documents
from .sharding import grown, shard_rows, topology
from .substring_dedup import without_repeats
from .token_counts import token_counts
from .url_filter import judge_urls
from .whitening import whitened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_consensus_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_additive_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 5))
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihoods(_table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10))


def op7_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = topology(16)
    return shard_rows(_table(spark, sf_dir, "documents"), leaves, grown(leaves))


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op11_exact_scatter_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings"))


def op12_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict:
    return {f.__name__: f for f in (op1_sum_of_squares_packing, op2_consensus_host_paths, op10_minhash_containment, op3_minhash_near_dedup, op4_additive_quality_model, op5_fm_index_substrings, op6_partial_matching, op7_hash_tree_sharding, op8_url_trees, op9_quality_rules, op11_exact_scatter_whitening, op12_tput_search, op13_heap_token_counts)}


def oracle_sql() -> dict[str, str]:
    leaves = topology(16)
    return {"op10_minhash_containment": sql.CONTAINMENT, "op12_tput_search": sql.RANKED, "op3_minhash_near_dedup": sql.NEAR_DEDUP, "op5_fm_index_substrings": sql.SUBSTRINGS, "op7_hash_tree_sharding": sql.sharding(leaves, grown(leaves))}
