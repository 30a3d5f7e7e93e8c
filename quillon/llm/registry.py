"""Queries of the problems over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import (
    byte_bpe, coverage_cutoff, cube_sample, match_groups, related_splits, source_mixture, split_overlap, subject_model, vector_neighbors,
)
from quillon.llm.oracles import ORACLES
from quillon.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = match_groups.matching_pairs(table(spark, d, "raabin_duplicate_audit"))
    return match_groups.connected_groups(pairs, "left_id", "right_id").withColumnRenamed("id", "image_id")


def p1_image_groups(spark: SparkSession, d: str) -> DataFrame:
    return match_groups.image_groups(table(spark, d, "raabin_image"), table(spark, d, "raabin_duplicate_audit"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlap.cross_split_pairs(table(spark, d, "raabin_image"), table(spark, d, "raabin_duplicate_audit"))
    return pairs.select(F.least("train_id", "eval_id").alias("image_id_a"), F.greatest("train_id", "eval_id").alias("image_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, d, "raabin_image"), table(spark, d, "raabin_duplicate_audit"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cuts = coverage_cutoff.dataset_cutoffs(table(spark, d, "triage_signal"), table(spark, d, "operating_point"))
    return cuts.select("point_id", "dataset", F.round(F.col("cutoff") * 1_000_000).cast("bigint").alias("cutoff_ppm"), "n_kept")


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    cuts = coverage_cutoff.dataset_cutoffs(table(spark, d, "triage_signal"), table(spark, d, "operating_point"))
    return cuts.withColumn("kept_share", F.col("n_kept") / F.col("n_records"))


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return cube_sample.balanced_sample(table(spark, d, "sample_manifest"), table(spark, d, "sampling_target"), table(spark, d, "label_alias"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = _sampled(spark, d)
    return report.where("short").select("plan_id", F.col("label").alias("canonical_label"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.broken_relations(table(spark, d, "triage_signal"), table(spark, d, "split_config")).select("sample_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return related_splits.assigned_splits(table(spark, d, "triage_signal"), table(spark, d, "split_config"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_neighbors.similar_pairs(table(spark, d, "embedding_archive"))


def p6_neighbors(spark: SparkSession, d: str) -> DataFrame:
    near = vector_neighbors.nearest_samples(table(spark, d, "embedding_archive"))
    return near.withColumn("similarity", F.round("similarity", 6))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.text_ids(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return source_mixture.mix_sources(table(spark, d, "documents"), table(spark, d, "mixture_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].where("short").select("mix_id", "source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subject_model.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_label"), table(spark, d, "subject_area"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("n_documents"), F.round(F.sum("share"), 6).alias("weight"))


QUERIES = [
    p1_found, p1_image_groups, p2_found, p2_report, p3_found, p3_cutoffs, p4_found, p4_sample, p4_report, p5_found, p5_splits,
    p6_found, p6_neighbors, p7_ids, p8_found, p8_mixture, p8_report, p9_found, p9_composition,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
