"""The pN_ queries: every operator of this package over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import consensus, ledger, lookalike, mixing, overlap, proportions, sentences, tokenizer, truncation
from tallyweave.session import cut_lineage, table, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlaps(table(spark, d, "mission_sample"), "sample_id", "mission_text", "EIN2", "split")
    return pairs.select(F.col("id_a").alias("sample_id_a"), F.col("id_b").alias("sample_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    sample = table(spark, d, "mission_sample")
    pairs = cut_lineage(overlap.overlaps(sample, "sample_id", "mission_text", "EIN2", "split"))
    return overlap.report(sample, pairs, "sample_id", "split", "data_source")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    got = ledger.replay(table(spark, d, "mission_sample"), "EIN2", "load_batch")
    return got.select(F.col("key").alias("EIN2"), "priority", "generation")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(table(spark, d, "mission_sample"), "sample_id", "mission_text")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mission_sample").select("sample_id", "mission_text")
    return lookalike.with_form(rows, "mission_text").select("sample_id", "form", (~F.col("form").eqNullSafe(F.col("mission_text"))).alias("changed"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return proportions.units(table(spark, d, "mission_sample")), table(spark, d, "draw_target")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).filter("not met").select("target_id")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    frame, targets = _cells(spark, d)
    frame = written(frame, "draw-frame")
    return proportions.report(frame, targets, written(proportions.draw(frame, targets), "draw-sample"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    drawn = proportions.draw(*_cells(spark, d))
    return drawn.select("draw_id", "ein", F.col("cell_group").alias("ntee_major_group"), F.col("cell_tier").alias("tier"), F.round("inclusion_prob", 9).alias("inclusion_prob"), "how")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).select("target_id", "draw_id", F.col("cell_group").alias("ntee_major_group"), F.col("cell_tier").alias("tier"), "need", "available", "met", "drawn", F.round("drawn_share", 9).alias("drawn_share"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "label_record")).labels.filter("label = 1").select("EIN2")


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "label_record")).labels


def p5_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "label_record")).annotators


def _truncation(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation(table(spark, d, "mission_frame"), "rec_id", "LONGEST_MISSION", "data_source", "LONGEST_MISSION_SOURCE_YEAR", "EIN2")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncation(spark, d).filter("cut").select(F.col("id").alias("rec_id"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.report(_truncation(spark, d)).withColumnRenamed("source", "data_source")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tokens = mixing.token_table(table(spark, d, "documents"), "doc_id", "text", "source")
    return tokens, mixing.plan(tokens, table(spark, d, "mix_target"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).filter("falls_short").select("mix_id", "source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.realise(*_mix(spark, d)).withColumnRenamed("doc", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    tokens, planned = _mix(spark, d)
    return mixing.actual(planned, mixing.realise(tokens, planned))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"), "doc_id", "text")


NAMES = "p1_found p1_report p2_sample p3_found p3_forms p4_found p4_sample p4_report p5_found p5_labels p5_annotators p6_found p6_report p7_ids p8_found p8_mix p8_report p9_found"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES.split()}
