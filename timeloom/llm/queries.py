"""The registered queries of this subpackage: every operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import (
    fim,
    licenses,
    lm,
    mixing,
    near_dup,
    packing,
    prefix_trie,
    quality,
    repeats,
    rotated_codes,
    token_files,
    topk,
    toxicity,
)
from timeloom.llm.common import crc_of_id, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), length=4096, end_id=2)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_texts(table(spark, sf_dir, "documents"), lm.in_training())
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), F.col("n_tokens").cast("long"), "n_known",
                         "train_tokens", "base_score", "score")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    scored = docs.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"),
                         toxicity.score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return repeats.digest_without(docs, repeats.repeated_spans(docs))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.soft_mix(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")), mixing.TARGETS)
    posteriors = [F.get("posteriors", k).alias(f"p_{d}") for k, d in enumerate(mixing.TARGETS)]
    return mix.select("doc_id", "tokens", *posteriors, "rate", "copies")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), end_id=1)
    return token_files.read_token_files(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_openings(lists)).withColumn(
        "depth", F.col("depth").cast("long"))


def op13_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_curve_packing, op2_maxent_scores, op3_near_duplicates, op4_quality_rules, op5_toxicity,
    op6_repeated_passages, op7_top_k, op8_soft_mix, op9_token_files, op10_licenses, op11_fill_in_middle,
    op12_prefix_trie, op13_rotated_codes,
)}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
