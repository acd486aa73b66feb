"""Compound stages, each one plan from tables to a table."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import lexicon as L
from tallyweave.functions import text as T
from tallyweave.functions.scores import platt, temperature
from tallyweave.operators import metrics, prevalence, sampling
from tallyweave.operators.relations import dedup_first, expand_back
from tallyweave.session import cut_lineage


@dataclass(frozen=True)
class Calibrated:
    """A calibrator with its three thresholds."""

    method: str
    params: dict
    threshold: float
    threshold_maxf1: float
    threshold_baserate: float

    def apply(self, p):
        return platt(p, self.params["a"], self.params["b"]) if self.method == "platt" else temperature(p, self.params["T"])

    def hash(self) -> str:
        return hashlib.sha256(json.dumps({"method": self.method, "params": self.params}, sort_keys=True).encode()).hexdigest()


def build_sample(df: DataFrame, gold_per_group: int, silver_total: int) -> DataFrame:
    """``sample_id, pool, split``: gold rows with their human splits, then a silver pool from all other rows."""
    religious = T.has_any("mission_text", L.RELIGIOUS)
    frame = df.filter(F.col("grp").rlike("^[A-Z]$"))
    gold = cut_lineage(sampling.gold_set(frame, "sample_id", "grp", T.boundary_class("mission_text") != "none", religious, gold_per_group))
    rest = df.join(gold.select("sample_id"), "sample_id", "left_anti")
    silver = sampling.silver_pool(rest, "sample_id", "grp", "tier", religious, silver_total)
    split = sampling.human_splits(gold.drop("split"), "sample_id", "grp", 1, 1)
    return split.select("sample_id", F.lit("gold").alias("pool"), "split").unionByName(silver.select("sample_id", F.lit("silver").alias("pool"), F.lit("train").alias("split")))


def default_scorer(df: DataFrame) -> DataFrame:
    """A stand-in score for texts: the share of their words in the religious lexicon, smoothed. Any scorer with this shape fits."""
    words = T.tokens("mission_text")
    known = sorted({w for t in L.RELIGIOUS for w in t.split()})
    hits = F.size(F.filter(words, lambda x: x.isin(known)))
    return df.withColumn("prob_raw", (hits + 0.1) / (F.size(words) + 1.0))


def inference(raw: DataFrame, calibrated: Calibrated, scorer=default_scorer) -> DataFrame:
    """Every raw row with quality, tier, route, score and three labels. Distinct texts are scored once and joined back on the text;
    rule rows have no score and the same label three times."""
    q = T.quality("mission_text")["q"]
    one = dedup_first(raw, "mission_text", "rec_id").withColumn("q", q).withColumn("tier", T.tier("q")).withColumn("rt", T.route("mission_text", "tier"))
    ruled = F.col("rt.source").startswith("rule_")
    s = scorer(one).withColumn("prob_raw", F.when(~ruled, F.col("prob_raw"))).withColumn("prob_calibrated", calibrated.apply("prob_raw"))
    s = s.withColumn("prob_calibrated", F.when(~ruled, F.col("prob_calibrated")))
    label = lambda t: F.when(ruled, F.col("rt.label")).otherwise((F.col("prob_calibrated") >= t).cast("int"))
    s = s.withColumn("decision_source", F.col("rt.source")).withColumn("pred_label", label(calibrated.threshold)).withColumn("pred_label_maxf1", label(calibrated.threshold_maxf1)).withColumn("pred_label_baserate", label(calibrated.threshold_baserate))
    columns = ["decision_source", "q", "tier", "prob_raw", "prob_calibrated", "pred_label", "pred_label_maxf1", "pred_label_baserate"]
    return expand_back(raw, s, "mission_text", "rec_id", columns).select("rec_id", "EIN2", "ntee_major_group", *columns)


def evaluation_report(df: DataFrame) -> DataFrame:
    """Long report ``section, metric, value`` of one labelled set."""
    parts = {
        "metrics": metrics.metric_bundle(df, "y", "pred"), "calibration": metrics.calibration_errors(df, "y", "p"),
        "ranking": metrics.average_precision(df, "y", "p").crossJoin(metrics.roc_auc(df, "y", "p")), "threshold": metrics.pick_threshold(df, "y", "p").drop("floor_met"),
    }
    out = None
    for name, part in parts.items():
        cast = part.select(*[F.col(c).cast("double").alias(c) for c in part.columns])
        long = cast.unpivot([], cast.columns, "metric", "value").withColumn("section", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out.select("section", "metric", "value")


def low_estimate(anchor: DataFrame, routed: DataFrame, rules: DataFrame, se: float | None, n_se: float, sp: float | None, n_sp: float) -> DataFrame:
    """The share in the LOW tier: rows routed to the classifier by the prediction-powered mean, rule rows by their corrected share,
    put together by their numbers of rows; one row per part and one for the whole."""
    a = prevalence.ppi(anchor, routed, "y", "p").select(F.lit("classifier").alias("part"), F.col("n_corpus").alias("n"), "estimate", "variance")
    b = prevalence.rule_share(rules, "label", se, n_se, sp, n_sp).select(F.lit("rules").alias("part"), "n", "estimate", "variance")
    parts = cut_lineage(a.unionByName(b))
    whole = prevalence.composite(parts).select(F.lit("composite").alias("part"), "n", "estimate", "variance")
    return parts.unionByName(whole)


def decomposition(parts: DataFrame) -> DataFrame:
    """What each part adds to the whole: its share of rows times its estimate."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return parts.withColumn("share", share).withColumn("contribution", F.col("share") * F.col("estimate"))


def acceptance(df: DataFrame, least_ap: float = 0.85, most_ece: float = 0.1, least_f1: float = 0.7) -> DataFrame:
    """``criterion, value, passed``: the gate before a model is released. F1 is judged by the lower end of its bootstrap interval."""
    c = metrics.confusion(df, "y", "pred").first()
    low, _ = sampling.bootstrap_ci((c["tp"], c["fp"], c["fn"], c["tn"]), lambda tp, fp, fn, tn: 2 * tp / max(1, 2 * tp + fp + fn))
    ap, ece = metrics.average_precision(df, "y", "p").first()[0] or 0.0, metrics.calibration_errors(df, "y", "p").first()["ece"]
    rows = [("average_precision", float(ap), bool(ap >= least_ap)), ("ece", None if ece is None else float(ece), ece is not None and bool(ece <= most_ece)), ("f1_lower", None if low != low else float(low), bool(low >= least_f1))]
    return df.sparkSession.createDataFrame(rows, "criterion string, value double, passed boolean")


def prevalence_report(anchor: DataFrame, corpus: DataFrame) -> DataFrame:
    """Unweighted and design-weighted estimates and their composite with equal shares, one row each."""
    w = anchor.withColumn("w", 1 / F.col("sample_prob"))
    rows = prevalence.ppi(w, corpus, "y", "p").withColumn("estimator", F.lit("ppi")).unionByName(prevalence.ppi(w, corpus, "y", "p", anchor_weight="w").withColumn("estimator", F.lit("ppi_weighted")))
    keep = ["estimator", "n_anchor", "n_corpus", "estimate", "variance", "ci_lower", "ci_upper"]
    return rows.select(*keep)


def gates(sample: DataFrame, votes: DataFrame, labelled: DataFrame) -> DataFrame:
    """``gate, problems``: what would stop the next stage; 0 lets it pass."""
    shared = sample.filter("split = 'train' and EIN2 is not null").select("EIN2").distinct().join(sample.filter("split = 'anchor'").select("EIN2"), "EIN2", "left_semi")
    checks = {
        "train_anchor_disjoint": shared.agg(F.count("*").alias("problems")),
        "sample_id_unique": sample.groupBy("sample_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("problems")),
        "tiers_known": sample.agg(F.count_if(~F.col("tier").isin("HIGH", "MEDIUM", "LOW")).alias("problems")),
        "votes_in_range": votes.agg(F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)).alias("problems")),
        "labels_binary": labelled.agg(F.count_if(~F.col("y").isin(0, 1)).alias("problems")),
    }
    out = None
    for name, c in checks.items():
        part = c.select(F.lit(name).alias("gate"), "problems")
        out = part if out is None else out.unionByName(part)
    return out


def run_manifest(tables: dict[str, DataFrame], config: dict) -> DataFrame:
    """Rows per input and the hash of the configuration."""
    h = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    out = None
    for name, t in sorted(tables.items()):
        part = t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(h).alias("config_hash"))
        out = part if out is None else out.unionByName(part)
    return out
