"""The registered queries of the dealt operators, with SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldcast.llm import bpe, classlm, decontam, lines, pii, quality, resample, rules, runs, secrets, setjoin, shards, simhash
from foldcast.llm.registry import documents, labels, query

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = quality.train_quality_net(docs, labels(spark, sf_dir), quality.learnable())
    scored = quality.score_quality(docs.select("doc_id", "text"), net)
    return scored.select(
        "doc_id", (~quality.learnable()).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted")
    )


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan_secrets(docs, secrets.train_secret_net(docs))


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.link_components(documents(spark, sf_dir))


@query("op4_class_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    classes, words = classlm.fit_word_classes(docs.where(classlm.trained_on()))
    lines = classlm.class_lines(docs, classes, words)  # of all documents: once for the class bigrams and for the scores
    scored = classlm.score_lines(lines, classlm.fit_steps(lines.where(classlm.trained_on()), classes))
    return scored.select("doc_id", (~classlm.trained_on()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_bpe_automaton")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), VOCABULARY)


OP6_SQL = """
WITH pages AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
cut AS (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM pages),
seen AS (SELECT DISTINCT host, text, trim(line, ' ') AS line FROM cut WHERE trim(line, ' ') <> ''),
often AS (SELECT host, line, count(*) AS n FROM seen GROUP BY host, line HAVING count(*) >= 5),
gone AS (SELECT host, list(line) AS lines FROM often JOIN totals USING (host) WHERE n > 0.02 * pages GROUP BY host),
cleaned AS (
  SELECT doc_id, text, CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)),
    lambda x: trim(x, ' ') = '' OR NOT list_contains(lines, trim(x, ' '))), chr(10)) END AS kept,
    CASE WHEN lines IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)),
    lambda x: trim(x, ' ') <> '' AND list_contains(lines, trim(x, ' ')))) END AS n_dropped
  FROM documents LEFT JOIN gone ON coalesce(source, '') = host)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, kept AS text FROM cleaned
"""


@query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    cleaned = lines.drop_boilerplate(docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long")), counted="n_dropped")
    return cleaned.select("doc_id", "n_lines", "n_dropped", "text")


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


@query("op8_jump_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign_shards(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(documents(spark, sf_dir), labels(spark, sf_dir))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "anomaly")


@query("op10_benchmark_leaks")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = resample.weigh(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return resample.draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(runs.repeat_tails(documents(spark, sf_dir)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best")
    return found.withColumn("best", runs.strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_simhash_copies")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, sf_dir))
