"""From raw documents to token ids: quality, boilerplate lines, near duplicates, benchmark leaks, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldcast.llm import bpe, decontam, lines, quality, setjoin
from foldcast.llm.queries import VOCABULARY
from foldcast.llm.registry import documents, labels, small_batches
from foldcast.llm.shared import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores at its threshold or above."""
    small_batches(spark)
    net = quality.train_quality_net(docs, labels(spark, sf_dir), quality.learnable())
    scored = quality.score_quality(docs, net, name="_score")
    return scored.where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go, near copies counted as one page; n_chars follows the text."""
    small_batches(spark)
    cleaned = lines.drop_boilerplate(docs, pages=setjoin.with_groups(docs.select("source", "text")))
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked shingle sets."""
    small_batches(spark)
    return setjoin.keep_one(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    small_batches(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that decoding gives back."""
    small_batches(spark)
    encoded = bpe.encode_documents(docs.drop("n_chars"), VOCABULARY, decoded=True)
    return encoded.drop("text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", leak_stage),
    ("BPE encoding and decoding", token_stage),
]

# The first stage is a trained network, so SQL cannot state the rows; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
