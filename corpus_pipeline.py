"""A training corpus from `documents`: quality rules, near and passage deduplication, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import gathered, small_or_shuffled, written
from umbra.llm.decontaminate import contained_items
from umbra.llm.near_dedup import near_duplicates
from umbra.llm.packing import packed
from umbra.llm.quality_rules import quality_rules
from umbra.llm.queries import tokenizer_path
from umbra.llm.substring_dedup import without_repeats


ID_ROWS = 2_000_000  # dropped keys up to this count are broadcast (16 MB)


def _without(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """docs less the rows whose key is among those of a one-column table; rows with a null key stay."""
    gone = keys.toDF("_gone").where("_gone is not null").distinct()
    gone = small_or_shuffled(written(gathered(gone, docs.count(), ID_ROWS // 40)), ID_ROWS)
    own = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return own.join(gone, F.col("key") == F.col("_gone"), "left_anti").select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).where("kept").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    return _without(docs, near_duplicates(docs).where("not kept").select("doc_id"), F.col("doc_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those with passages met earlier have the rest of their words as text."""
    cut = F.col("n_removed") > 0
    out = without_repeats(docs)
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; told apart by their texts, so that null and repeated ids do no harm."""
    text = F.xxhash64("text")
    found = contained_items(docs.select(text.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select("doc_id"), text)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents with their places in sequences."""
    return packed(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_good),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Tokenization and the hashed n-gram table have no SQL equivalent; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
