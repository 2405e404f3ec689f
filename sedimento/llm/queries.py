"""Queries of the training-data operators: name -> f(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimento.llm import cross_split, keep_together, leakage, mixing, pii, quota_sample, survivors
from sedimento.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "samples"), table(spark, d, "origin_trust")).select("group_id", "field_name", "sample_id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "samples"), table(spark, d, "origin_trust")).select("group_id", "field_name", "sample_id", "value")


def p1_retained(spark: SparkSession, d: str) -> DataFrame:
    return survivors.retained(table(spark, d, "samples"), table(spark, d, "origin_trust"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return keep_together.torn(table(spark, d, "samples"))


def p3_assignment(spark: SparkSession, d: str) -> DataFrame:
    return keep_together.assign(table(spark, d, "samples"), table(spark, d, "split_targets"))


def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "split_targets")
    return keep_together.checked(p3_assignment(spark, d), targets)


def p3_balance(spark: SparkSession, d: str) -> DataFrame:
    return keep_together.balance(p3_assignment(spark, d), table(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    report = quota_sample.draw_to_targets(table(spark, d, "samples"), table(spark, d, "category_targets"))[1]
    return report.where("short").select("modality", "class_name")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.drawn_report(table(spark, d, "samples"), table(spark, d, "category_targets"))


def p4_drawn(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.draw_to_targets(table(spark, d, "samples"), table(spark, d, "category_targets"))[0]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split.overlaps(table(spark, d, "samples"))
    return pairs.select(F.least("evaluation_id", "train_id").alias("sample_id_a"), F.greatest("evaluation_id", "train_id").alias("sample_id_b"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlap_report(table(spark, d, "samples"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), errors=1)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p8_found(spark, d), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets")).where("short").select("source_name")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    return mixing.checked(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents")).select("doc_id", "pii_type", "pii_text").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents")).select("doc_id", "text", "replaced")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_survivors, p1_retained, p3_found, p3_assignment, p3_balance, p3_checked, p4_found, p4_report, p4_drawn, p7_found, p7_report, p8_found, p8_near, p8_report, p9_found, p9_report, p9_mix, p9_shares, p9_checked, p10_found, p10_redacted)
}
