"""Roles of the tables: corpus, votes, evaluation rows and predictions, built by the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.ids import priority, standard_ein
from tallyweave.functions.text import group_letter
from tallyweave.operators.relations import dedup_last
from tallyweave.session import table
from tallyweave.sources.io import corpus


def frame(spark: SparkSession, d: str, deduplicate: bool = False) -> DataFrame:
    return corpus(table(spark, d, "mission_frame"), table(spark, d, "registry"), "EIN2", "LONGEST_MISSION", "NTEE_IRS", "rec_id", deduplicate=deduplicate)


def answer(col) -> F.Column:
    """The label word of a stored answer: spellings of the two labels are brought together, others are abstentions."""
    w = F.regexp_replace(F.lower(col), "[^a-z]", "")
    return F.when(w == "religious", 1).when(w.isin("nonreligious", "notreligious"), 0)


def votes(spark: SparkSession, d: str) -> DataFrame:
    """The latest row per organization and source of runs without an error; percent confidences are brought to [0, 1]."""
    c = F.col("confidence")
    s = table(spark, d, "label_record").filter("error is null").select(
        standard_ein("EIN2").alias("EIN2"), F.concat_ws("__", "model_id", "prompt_id").alias("source_id"), "source_type", "model_id", "prompt_id",
        answer(F.col("binary_label")).alias("label"), F.when(c > 1, c / 100).otherwise(c).alias("confidence"), "run_timestamp", "binary_label", "evidence_spans", "domains_present", "system_fingerprint",
    ).filter("EIN2 is not null")
    return dedup_last(s, ["EIN2", "source_id"], "run_timestamp", "label", "confidence", "binary_label", "evidence_spans", "domains_present", "system_fingerprint")


def groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "registry").select(standard_ein("EIN2").alias("EIN2"), group_letter("NTEE_IRS").alias("grp")).filter("EIN2 is not null")


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """``EIN2, y, p, pred, grp, sample_prob``: the rule's label as truth, the share of positive model votes as score; the
    inclusion probability is 1/4, 1/2 or 3/4 by a hash of the id, whatever the label."""
    v = votes(spark, d)
    p = v.filter("source_type = 'llm_prompt' and label is not null").groupBy("EIN2").agg(F.round(F.avg(F.col("label").cast("double")), 6).alias("p"))
    y = v.filter("source_type = 'rule' and label is not null").groupBy("EIN2").agg(F.max("label").alias("y"))
    j = p.join(y, "EIN2").join(groups(spark, d), "EIN2", "left").withColumn("grp", F.coalesce("grp", F.lit("?")))
    return j.withColumn("pred", (F.col("p") >= 0.5).cast("int")).withColumn("sample_prob", (priority(3, F.col("EIN2")) % 3 + 1) / 4)


def scored(spark: SparkSession, d: str) -> DataFrame:
    """``EIN2, p, grp``: every organization with a score."""
    v = votes(spark, d)
    p = v.filter("source_type = 'llm_prompt' and label is not null").groupBy("EIN2").agg(F.round(F.avg(F.col("label").cast("double")), 6).alias("p"))
    return p.join(groups(spark, d), "EIN2", "left").withColumn("grp", F.coalesce("grp", F.lit("?")))


def sample(spark: SparkSession, d: str) -> DataFrame:
    """mission_sample with ids, group and tier in one spelling and a seeded pseudo score ``p``."""
    s = table(spark, d, "mission_sample")
    tier = F.upper(F.trim("tier"))
    return s.select(
        "sample_id", standard_ein("EIN2").alias("EIN2"), "mission_text", group_letter("ntee_major_group").alias("grp"), F.coalesce(F.when(tier != "", tier), F.lit("UNKNOWN")).alias("tier"),
        "Q", "split", "data_source", ((priority(5, F.col("sample_id")) % 1000) / 1000).alias("p"),
    )
