"""One query per operator over the driver's tables. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import lexicon as L
from tallyweave.functions import scores as S
from tallyweave.functions import text as T
from tallyweave.functions.ids import standard_ein
from tallyweave.operators import calibrate, keyness, metrics, ml, names, prevalence, relations, sampling
from tallyweave.operators import votes as V
from tallyweave.plans import gating, stages, views
from tallyweave.session import cut_lineage, table
from tallyweave.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(c, digits: int = 6):
    """A rounded double, so that the order of a sum does not show."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Corpus, keys, text


@query
def corpus_rows(spark, d):
    return views.frame(spark, d).select("rec_id", "EIN2", "code", "ntee_major_group", "is_truncated", "data_source")


@query
def corpus_dedup(spark, d):
    return views.frame(spark, d, deduplicate=True).select("rec_id", "EIN2", "ntee_major_group")


@query
def text_multiplicity(spark, d):
    m = relations.text_multiplicity(views.frame(spark, d), "mission_text")
    return m.select(F.md5("text_key").alias("text_md5"), "n_rows")


@query
def expand_back(spark, d):
    raw = views.frame(spark, d)
    pred = relations.dedup_first(raw, "mission_text", "rec_id").withColumn("tier", T.tier(T.quality("mission_text")["q"])).withColumn("from_rec", F.col("rec_id"))
    return relations.expand_back(raw, pred, "mission_text", "rec_id", ["tier", "from_rec"]).select("rec_id", "tier", "from_rec")


@query
def quality_components(spark, d):
    return views.frame(spark, d).select("rec_id", T.quality("mission_text").alias("s")).select("rec_id", "s.*")


@query
def quality_tier_by_group(spark, d):
    x = views.frame(spark, d).withColumn("q", T.quality("mission_text")["q"]).withColumn("tier", T.tier("q"))
    return x.groupBy("ntee_major_group", "tier").agg(F.count("*").alias("n"), r(F.avg("q")).alias("mean_q"))


@query
def rule_label_route(spark, d):
    x = views.sample(spark, d).withColumn("rt", T.route("mission_text", "tier"))
    return x.groupBy("tier", F.col("rt.source").alias("source"), F.col("rt.label").alias("label")).agg(F.count("*").alias("n"))


@query
def rule_labels(spark, d):
    return views.sample(spark, d).select("sample_id", T.rule_label("mission_text").alias("label"))


@query
def lexicon_hits(spark, d):
    x = views.sample(spark, d)
    return x.select("sample_id", T.has_any("mission_text", L.RELIGIOUS).alias("religious"), T.has_any("mission_text", L.STRONG).alias("strong"), T.has_any("mission_text", L.VERBS).alias("verb"))


@query
def positive_rescue(spark, d):
    """The sample, and three rows on both sides of the rule's edges, as the tables may hold no such text."""
    edges = spark.createDataFrame([(-1, "We provide church meals for children weekly"), (-2, "We provide warm meals for children weekly"), (-3, "We provide church meals for children weekly and monthly")], "sample_id long, mission_text string")
    x = views.sample(spark, d).select("sample_id", "mission_text").unionByName(edges).withColumn("q", T.quality("mission_text")["q"])
    return x.filter(T.positive_rescue("mission_text", "q")).select("sample_id", "q")


@query
def boundary_classes(spark, d):
    return views.sample(spark, d).groupBy(T.boundary_class("mission_text").alias("boundary")).agg(F.count("*").alias("n"))


@query
def length_bins(spark, d):
    return views.sample(spark, d).groupBy(T.length_bin(T.word_count("mission_text")).alias("length_bin")).agg(F.count("*").alias("n"))


@query
def scope_filter(spark, d):
    x = gating.in_scope(table(spark, d, "mission_frame"), "COMMON_LEVEL1", ["501C3 CHARITY", "501C3 PRIVATE FOUNDATION"]).filter(F.trim("LONGEST_MISSION") != "")
    return x.groupBy("data_source", "COMMON_LEVEL1").agg(F.count("*").alias("n"))


@query
def group_labels(spark, d):
    n = views.frame(spark, d).groupBy(prevalence.fold_missing_group("ntee_major_group").alias("grp")).agg(F.count("*").alias("n"))
    t = spark.createDataFrame(sorted(L.GROUPS.items()), "grp string, label string")
    return t.join(F.broadcast(n), "grp", "left").select("grp", "label", F.coalesce("n", F.lit(0)).alias("n"))


@query
def id_spellings(spark, d):
    x = table(spark, d, "mission_sample").select(F.col("EIN2").alias("raw"), standard_ein("EIN2").alias("EIN2"))
    return x.filter("raw is not null").groupBy("EIN2").agg(F.count_distinct("raw").alias("n_spellings"), F.count("*").alias("n_rows")).filter("n_spellings > 1")


@query
def completeness(spark, d):
    return relations.completeness(views.sample(spark, d), views.frame(spark, d), "EIN2")


@query
def overlapping_ids(spark, d):
    s = views.sample(spark, d).filter("EIN2 is not null")
    return relations.overlap(s.filter("split = 'train'"), s.filter("split != 'train'"), "EIN2")


@query
def repeated_ids(spark, d):
    return relations.duplicates(views.frame(spark, d), ["EIN2"])


@query
def varying_fields(spark, d):
    x = table(spark, d, "mission_frame").select(standard_ein("EIN2").alias("EIN2"), "COMMON_LEVEL1", "data_source")
    return relations.varying_fields(x, "EIN2", ["COMMON_LEVEL1", "data_source"])


@query
def ids_not_annotated(spark, d):
    return io.manifest_ids([views.sample(spark, d), views.frame(spark, d)], "EIN2").join(views.votes(spark, d).select("EIN2"), "EIN2", "left_anti")


@query
def ids_annotated(spark, d):
    return io.manifest_ids([views.sample(spark, d), views.frame(spark, d)], "EIN2").join(views.votes(spark, d).select("EIN2"), "EIN2", "left_semi")


@query
def longest_value(spark, d):
    x = table(spark, d, "mission_frame").select(standard_ein("EIN2").alias("EIN2"), "LONGEST_MISSION", F.col("LONGEST_MISSION_SOURCE_YEAR").alias("year"))
    return names.longest_name(x, "EIN2", "LONGEST_MISSION", "year").select("EIN2", "year", F.md5(F.coalesce("LONGEST_MISSION", F.lit(""))).alias("text_md5"))


@query
def strict_binary(spark, d):
    x = table(spark, d, "label_record").select(io.strict_binary("label").alias("v"), F.col("label").isNull().alias("missing"))
    return x.groupBy("v", "missing").agg(F.count("*").alias("n"))


@query
def domain_checks(spark, d):
    """Counts behind the validity gates: labels, confidences, tiers, splits, scores out of their domains."""
    v = table(spark, d, "label_record").agg(F.count("*").alias("n_votes"), F.count_if(F.col("confidence") > 1).alias("n_percent"), F.count_if(F.col("EIN2").isNull()).alias("n_no_id"), F.count_if(F.col("error").isNotNull()).alias("n_failed"))
    s = views.sample(spark, d).agg(F.count_if(~F.col("tier").isin("HIGH", "MEDIUM", "LOW")).alias("n_bad_tier"), F.count_if(F.col("grp") == "?").alias("n_no_group"), F.count_if(F.col("Q").isNull()).alias("n_no_q"))
    return v.crossJoin(F.broadcast(s))


@query
def source_counts_before(spark, d):
    n = views.frame(spark, d).groupBy("ntee_major_group").agg(F.count("*").alias("n"))
    return relations.cumulative(n, "n", ["ntee_major_group"])


@query
def term_slugs(spark, d):
    return table(spark, d, "label_record").select(F.concat_ws("__", "model_id", "prompt_id").alias("source_id")).distinct().select("source_id", T.slug(F.concat("source_id", F.lit(" / x"))).alias("slug"), T.source_parts("source_id")["model_id"].alias("model_id"), T.source_parts("source_id")["prompt_id"].alias("prompt_id"))


# Votes


@query
def latest_votes(spark, d):
    return views.votes(spark, d).select("EIN2", "source_id", "label", "confidence", F.unix_micros("run_timestamp").alias("run_us"))


@query
def majority_vote(spark, d):
    m = V.majority_vote(views.votes(spark, d), "EIN2", "label", "confidence")
    return rounded(m)


@query
def vote_share(spark, d):
    return rounded(V.vote_share(views.votes(spark, d), "EIN2", "label"))


@query
def label_matrix(spark, d):
    v = views.votes(spark, d)
    return V.label_matrix(v, "EIN2", "source_id", "label", V.sources(v, "source_id"))


@query
def label_stack(spark, d):
    return V.stack(label_matrix(spark, d), "EIN2").groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("n_positive"))


@query
def consensus_agreement(spark, d):
    v = views.votes(spark, d)
    return rounded(V.agreement_with_consensus(v, V.majority_vote(v, "EIN2", "label", "confidence"), "EIN2", "label"))


@query
def pairwise_agreement(spark, d):
    return rounded(V.pairwise_agreement(views.votes(spark, d), "EIN2", "source_id", "label"))


@query
def source_summary(spark, d):
    return rounded(V.source_summary(views.votes(spark, d), "source_id", "label"))


@query
def vote_histogram(spark, d):
    return V.vote_histogram(V.majority_vote(views.votes(spark, d), "EIN2", "label", "confidence"))


@query
def pending_pairs(spark, d):
    v = views.votes(spark, d)
    return V.pending(v, v.select("source_id"), v, "EIN2", "source_id").groupBy("source_id").agg(F.count("*").alias("n_pending"))


@query
def fingerprints(spark, d):
    f = V.fingerprints(views.votes(spark, d).filter("system_fingerprint is not null"), "source_id", "system_fingerprint")
    return f.select("source_id", F.array_join("fingerprints", ",").alias("fingerprints"))


@query
def drift(spark, d):
    v = views.votes(spark, d)
    return rounded(V.drift(v.filter("source_id = 'aspen-large__v1'"), v.filter("source_id = 'aspen-large__v2'"), "EIN2", "label"))


@query
def set_hash(spark, d):
    return V.set_hash(views.votes(spark, d), "EIN2", ["source_id"])


@query
def first_audit(spark, d):
    a = views.votes(spark, d).select("model_id", "source_id", "EIN2", F.unix_micros("run_timestamp").alias("us"))
    return V.first_match(a, "model_id", "us", "source_id", "EIN2")


@query
def arms_against_rule(spark, d):
    y = views.evaluation(spark, d)
    return rounded(V.vote_arms(views.votes(spark, d), y, "EIN2", "source_id", "label", "y"))


@query
def parse_answers(spark, d):
    """Answers are put into JSON as an annotator would send them, some broken, and parsed again."""
    s = table(spark, d, "label_record").select("EIN2", "binary_label", "confidence", "reason", "evidence_spans", F.col("seed"))
    whole = F.to_json(F.struct("binary_label", "confidence", F.array().cast("array<string>").alias("domains_present"), F.from_json("evidence_spans", "array<string>").alias("evidence_spans"), F.lit("x").alias("boundary_notes"), F.coalesce("reason", F.lit("")).alias("reason")), {"ignoreNullFields": "false"})
    raw = F.when(F.col("confidence") > 1, F.lit("{broken")).when(F.col("confidence") > 0.9, F.lit('{"binary_label": "religious"}')).otherwise(F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    p = V.parse_answers(s.withColumn("raw", raw), "raw")
    return p.groupBy("label", "parse_error").agg(F.count("*").alias("n"))


def _texts(spark, d):
    f = table(spark, d, "mission_frame").select(standard_ein("EIN2").alias("EIN2"), F.col("LONGEST_MISSION").alias("t"))
    s = table(spark, d, "mission_sample").select(standard_ein("EIN2").alias("EIN2"), F.col("mission_text").alias("t"))
    return f.unionByName(s).filter("EIN2 is not null")


@query
def evidence_spans(spark, d):
    e = V.verify_evidence(V.evidence_spans(views.votes(spark, d), "EIN2", "source_id", "evidence_spans"), _texts(spark, d), "EIN2", "t")
    return e.groupBy("source_id").agg(F.count("*").alias("n_spans"), F.count_if("verbatim").alias("n_verbatim"), F.count_if(F.col("verbatim").isNull()).alias("n_no_text"), r(F.try_divide(F.count_if("verbatim"), F.count("verbatim"))).alias("verbatim_rate"))


@query
def abstain_fabricated(spark, d):
    v = views.votes(spark, d)
    e = V.verify_evidence(V.evidence_spans(v, "EIN2", "source_id", "evidence_spans"), _texts(spark, d), "EIN2", "t").filter("not verbatim")
    return V.abstain_fabricated(v, e, "EIN2", "source_id", "label").groupBy("source_id", "label").agg(F.count("*").alias("n"))


@query
def domains(spark, d):
    x = views.votes(spark, d).select("source_type", F.explode(F.from_json("domains_present", "array<string>")).alias("domain"))
    return x.groupBy("source_type", "domain").agg(F.count("*").alias("n"))


@query
def backfilled_text(spark, d):
    lookup = _texts(spark, d).filter("t is not null").groupBy("EIN2").agg(F.min("t").alias("t"))
    v = table(spark, d, "label_record").select(standard_ein("EIN2").alias("EIN2"), F.col("text").alias("t")).filter("EIN2 is not null")
    return io.backfill_text(v, lookup, "EIN2", "t").groupBy("EIN2").agg(F.count("*").alias("n_rows"), F.count("t").alias("n_with_text"))


@query
def dawid_skene(spark, d):
    return rounded(V.dawid_skene(views.votes(spark, d), "EIN2", "source_id", "label"), 4)


@query
def crowdlab(spark, d):
    v = views.votes(spark, d)
    return rounded(V.crowdlab(v, views.scored(spark, d), "EIN2", "source_id", "label", "p"), 6)


# Evaluation


@query
def confusion_matrix(spark, d):
    return metrics.confusion(views.evaluation(spark, d), "y", "pred")


@query
def threshold_confusion(spark, d):
    return metrics.threshold_confusion(views.evaluation(spark, d), "y", "p", {"operating": 0.3, "base_rate": 0.5, "max_f1": 0.7})


@query
def metric_bundle(spark, d):
    return rounded(metrics.metric_bundle(views.evaluation(spark, d), "y", "pred"))


@query
def metric_bundle_by_source(spark, d):
    v = views.votes(spark, d).filter("label is not null").join(views.evaluation(spark, d).select("EIN2", "y"), "EIN2")
    return rounded(metrics.metric_bundle(v, "y", "label", ["source_id"]))


@query
def subgroup_report(spark, d):
    t = _texts(spark, d).filter("t is not null").groupBy("EIN2").agg(F.max("t").alias("text"))
    return rounded(metrics.subgroups(views.evaluation(spark, d).join(t, "EIN2", "left"), "y", "pred", ["grp"], "text", min_n=10))


@query
def reliability_curve(spark, d):
    return rounded(metrics.reliability(views.evaluation(spark, d), "y", "p"))


@query
def calibration_errors(spark, d):
    return rounded(metrics.calibration_errors(views.evaluation(spark, d), "y", "p"))


@query
def pr_curve(spark, d):
    return rounded(metrics.pr_curve(views.evaluation(spark, d), "y", "p"))


@query
def roc_curve(spark, d):
    return rounded(metrics.roc_curve(views.evaluation(spark, d), "y", "p"))


@query
def average_precision(spark, d):
    return rounded(metrics.average_precision(views.evaluation(spark, d), "y", "p"))


@query
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(views.evaluation(spark, d), "y", "p"))


@query
def pick_threshold_floor(spark, d):
    return rounded(metrics.pick_threshold(views.evaluation(spark, d), "y", "p", "precision_floor", 0.8))


@query
def pick_threshold_f1(spark, d):
    return rounded(metrics.pick_threshold(views.evaluation(spark, d), "y", "p", "max_f1"))


@query
def base_rate_points(spark, d):
    x = views.evaluation(spark, d).withColumn("w", 1 / F.col("sample_prob"))
    return rounded(metrics.base_rate_points(x, "y", "p", 0.2, "w"))


@query
def base_rate_threshold(spark, d):
    x = views.evaluation(spark, d).withColumn("w", 1 / F.col("sample_prob"))
    return rounded(metrics.base_rate_threshold(x, "y", "p", 0.2, 0.9, "w"))


@query
def rule_validation(spark, d):
    v = views.votes(spark, d).filter("source_id = 'aspen-large__v1'").select("EIN2", F.col("label").alias("rule"))
    return rounded(metrics.rule_validation(views.evaluation(spark, d).join(v, "EIN2", "left"), "y", "rule"))


@query
def threshold_sweep(spark, d):
    return rounded(metrics.threshold_sweep(views.sample(spark, d), "p", "tier"))


@query
def score_histogram(spark, d):
    return rounded(metrics.score_histogram(views.sample(spark, d), "p", ["tier", "split"]))


@query
def pearson(spark, d):
    x = views.votes(spark, d).groupBy("EIN2").agg(F.avg(F.col("label").cast("double")).alias("a"), F.avg("confidence").alias("b"))
    return rounded(metrics.pearson(x, "a", "b"))


@query
def pearson_constant(spark, d):
    return rounded(metrics.pearson(views.evaluation(spark, d).withColumn("one", F.lit(1.0)), "p", "one"))


@query
def summary_ci(spark, d):
    return rounded(metrics.summary_ci(views.votes(spark, d).filter("confidence is not null"), ["source_id"], "confidence"))


# Sampling


@query
def seeded_priority(spark, d):
    return views.sample(spark, d).select("sample_id", sampling.seeded_priority(7, "sample_id").alias("priority"))


@query
def stratified_take(spark, d):
    s = sampling.take(views.sample(spark, d).filter("grp != '?'"), ["grp", "tier"], "sample_id", 5, 7)
    return rounded(s.select("sample_id", "grp", "tier", "inclusion_prob"), 9)


@query
def human_splits(spark, d):
    return sampling.human_splits(views.sample(spark, d), "sample_id", "grp", 2, 1).select("sample_id", F.col("split").alias("new_split"))


@query
def nested_subset(spark, d):
    return sampling.nested_subset(views.sample(spark, d), "tier", "sample_id", 0.25).select("sample_id", "tier")


@query
def dev_split(spark, d):
    return sampling.dev_split(views.sample(spark, d), "tier", "sample_id", 0.15).select("sample_id", "is_dev")


@query
def stratified_folds(spark, d):
    return sampling.folds(views.sample(spark, d), "tier", "sample_id").select("sample_id", "fold")


@query
def design_weights(spark, d):
    return rounded(sampling.design_weights(views.evaluation(spark, d), "sample_prob").select("EIN2", "weight"), 9)


@query
def silver_pool(spark, d):
    x = views.sample(spark, d)
    return rounded(sampling.silver_pool(x, "sample_id", "grp", "tier", T.has_any("mission_text", L.RELIGIOUS), 300, floors={"X"}, floor_size=40, caps={"B"}, cap_size=60).select("sample_id", "grp", "is_positive_enriched", "inclusion_prob"))


@query
def gold_set(spark, d):
    x = views.sample(spark, d).filter("grp != '?'")
    return rounded(sampling.gold_set(x, "sample_id", "grp", T.boundary_class("mission_text") != "none", T.has_any("mission_text", L.RELIGIOUS), 12).select("sample_id", "grp", "cell", "first_pass", "quota_cell_rate"))


@query
def anchor_sample(spark, d):
    x = views.sample(spark, d).filter("grp != '?' and tier != 'UNKNOWN'")
    return rounded(sampling.anchor_sample(x, "sample_id", "tier", "grp", 200).select("sample_id", "stratum", "sample_prob"))


# Calibration and prevalence


@query
def apply_calibration(spark, d):
    x = views.scored(spark, d)
    return rounded(x.select("EIN2", S.platt("p", 0.417, 0.841).alias("platt"), S.temperature("p", 1.7).alias("temperature"), S.logit("p").alias("logit")))


@query
def thresholded_labels(spark, d):
    rt = T.route("mission_text", "tier")
    x = views.sample(spark, d).withColumn("rt", rt)
    pick = lambda t: F.when(F.col("rt.source").startswith("rule_"), F.col("rt.label")).otherwise((F.col("p") >= t).cast("int"))
    return x.select("sample_id", F.col("rt.source").alias("decision_source"), pick(0.5).alias("pred_label"), pick(0.7).alias("pred_label_maxf1"), pick(0.9).alias("pred_label_baserate"))


@query
def rogan_gladen_by_group(spark, d):
    x = views.sample(spark, d).withColumn("rule", T.rule_label("mission_text"))
    return rounded(prevalence.rule_share(x, "rule", 0.8462, 13, 0.95, 54, by=["tier"]))


@query
def ppi_overall(spark, d):
    x = views.evaluation(spark, d).withColumn("w", 1 / F.col("sample_prob"))
    return rounded(prevalence.ppi(x, views.scored(spark, d), "y", "p", anchor_weight="w"))


@query
def ppi_by_group(spark, d):
    return rounded(prevalence.ppi(views.evaluation(spark, d), views.scored(spark, d), "y", "p", by=["grp"]))


@query
def prevalence_by_group(spark, d):
    return rounded(prevalence.prevalence_by_group(views.evaluation(spark, d), views.scored(spark, d), "y", "p", "grp", min_n=8))


@query
def composite_prevalence(spark, d):
    x = views.sample(spark, d).withColumn("rule", T.rule_label("mission_text"))
    return rounded(prevalence.composite(prevalence.rule_share(x, "rule", None, 0, None, 0, by=["tier"])))


@query
def group_descriptives(spark, d):
    x = views.sample(spark, d).withColumn("grp", prevalence.fold_missing_group("grp")).withColumn("a", (F.col("p") >= 0.5).cast("int")).withColumn("b", (F.col("p") >= 0.9).cast("int"))
    return rounded(prevalence.group_descriptives(x, "grp", "p", ["a", "b"]))


@query
def emq(spark, d):
    e = views.evaluation(spark, d)
    prior = e.agg(F.avg(F.col("y").cast("double"))).first()[0]
    share, rounds = prevalence.emq(views.scored(spark, d), "p", prior or 0.5)
    return spark.createDataFrame([(round(share, 6), rounds)], "share double, rounds int")


@query
def kdey(spark, d):
    return spark.createDataFrame([(prevalence.kdey(views.scored(spark, d), views.evaluation(spark, d), "y", "p"),)], "share double")


@query
def crossfit_calibration(spark, d):
    x = sampling.folds(views.evaluation(spark, d), "y", "EIN2")
    out, winner, fit, _ = calibrate.crossfit(cut_lineage(x), "y", "p")
    return rounded(out.select("EIN2", "prob_calibrated_oof", F.lit(winner).alias("method")), 4)


# Keyness


@query
def term_counts(spark, d):
    x = views.sample(spark, d)
    return rounded(keyness.term_counts(x, "mission_text", (F.col("tier") == "HIGH").cast("double")))


@query
def bigram_counts(spark, d):
    return rounded(keyness.term_counts(views.sample(spark, d), "mission_text", (F.col("tier") == "HIGH").cast("double"), 2, 2).filter("document_frequency >= 5"))


@query
def keyness_terms(spark, d):
    return rounded(keyness.keyness(keyness.term_counts(views.sample(spark, d), "mission_text", (F.col("tier") == "HIGH").cast("double")), min_df=5), 5)


@query
def keyness_by_probability(spark, d):
    x = views.sample(spark, d).withColumn("w", F.when(T.has_any("mission_text", L.RELIGIOUS), 0.75).otherwise(0.25))
    return rounded(keyness.keyness(keyness.term_counts(x, "mission_text", F.col("w")), min_df=5), 5)


@query
def top_terms(spark, d):
    x = views.sample(spark, d).withColumn("w", F.when(T.has_any("mission_text", L.RELIGIOUS), 1.0).otherwise(0.0))
    k = rounded(keyness.keyness(keyness.term_counts(x, "mission_text", F.col("w")), min_df=5), 5)
    return keyness.top_terms(k).select("term", "side", "z_score")


@query
def top_absolute_terms(spark, d):
    x = views.sample(spark, d).withColumn("w", F.when(T.has_any("mission_text", L.RELIGIOUS), 1.0).otherwise(0.0))
    k = rounded(keyness.keyness(keyness.term_counts(x, "mission_text", F.col("w")), min_df=5), 5)
    return keyness.top_absolute(k).select("term", "z_score")


@query
def keyness_sensitivity(spark, d):
    x = cut_lineage(views.sample(spark, d).select("mission_text", "p", "tier"))
    one = lambda w: rounded(keyness.keyness(keyness.term_counts(x, "mission_text", w), min_df=5), 5)
    return keyness.sensitivity({"tier": one((F.col("tier") == "HIGH").cast("double")), "score": one((F.col("p") >= 0.5).cast("double"))})


# Names


@query
def name_populations(spark, d):
    panel = views.frame(spark, d).select("EIN2")
    reg = table(spark, d, "registry").select(standard_ein("EIN2").alias("EIN2"))
    has = views.frame(spark, d).filter("trim(mission_text) != ''").select("EIN2")
    return names.populations(panel, reg, has, "EIN2").groupBy("population", "in_registry").agg(F.count("*").alias("n"))


@query
def registry_flags(spark, d):
    x = names.external_flags(table(spark, d, "registry"), "NTEE_IRS", "BMF_FOUNDATION_CODE").withColumn("stratum", names.flag_stratum())
    return x.groupBy("stratum", "is_flagged").agg(F.count("*").alias("n"))


GREEDY = ("ministries", "church", "temple", "fellowship")


def _named(spark, d):
    return names.cleaned(names.external_flags(table(spark, d, "registry"), "NTEE_IRS", "BMF_FOUNDATION_CODE"), "ORG_NAME_CURRENT")


@query
def clean_names(spark, d):
    return _named(spark, d).select("EIN2", "name_cleaned", "name_with_suffix")


@query
def name_variants(spark, d):
    return names.variants(_named(spark, d), "EIN2").groupBy("input_variant").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query
def name_token_loss(spark, d):
    """The audit of a cleaner that goes too far: it takes denominational words for legal suffixes."""
    x = names.cleaned(table(spark, d, "registry"), "ORG_NAME_CURRENT", suffixes=(*L.SUFFIXES, *GREEDY))
    return names.token_loss(x, "ORG_NAME_CURRENT", "name_cleaned").select("EIN2", F.array_join("lost_tokens", ",").alias("lost"))


@query
def name_token_difference(spark, d):
    m = views.frame(spark, d).filter("mission_text is not null").groupBy("EIN2").agg(F.min("mission_text").alias("mission"))
    x = table(spark, d, "registry").select(standard_ein("EIN2").alias("EIN2"), "ORG_NAME_CURRENT").join(m, "EIN2")
    return names.token_difference(x, "ORG_NAME_CURRENT", "mission").select("EIN2", F.array_join("a_only", ",").alias("a_only"), F.array_join("b_only", ",").alias("b_only"), "direction")


@query
def name_conflicts(spark, d):
    x = names.with_conflicts(_named(spark, d), "ORG_NAME_CURRENT").select(F.explode("conflict_categories").alias("cue"))
    return x.groupBy("cue").agg(F.count("*").alias("n"))


@query
def name_gold_draw(spark, d):
    """Rows per stratum and cue that meet the quotas, drawn by seeded priority inside each cell."""
    x = names.with_conflicts(_named(spark, d), "ORG_NAME_CURRENT").withColumn("stratum", names.flag_stratum()).withColumn("cues", F.array_join(F.array_sort("conflict_categories"), "|"))
    n = {(q["stratum"], frozenset(c for c in q["cues"].split("|") if c)): q["n"] for q in x.groupBy("stratum", "cues").agg(F.count("*").alias("n")).collect()}
    have = {}
    cues = {}
    for (s, cs), k in n.items():
        have[s] = have.get(s, 0) + k
        for c in cs:
            cues[c] = cues.get(c, 0) + k
    given = sampling.quota_draw(n, {s: min(20, k) for s, k in have.items()}, {c: min(3, k // 4) for c, k in cues.items()})
    t = spark.createDataFrame([(s, "|".join(sorted(cs)), k) for (s, cs), k in given.items()], "stratum string, cues string, n int")
    return sampling.take(x, ["stratum", "cues"], "EIN2", t, 41).select("EIN2", "stratum", "cues", r("inclusion_prob").alias("inclusion_prob"))


@query
def topk_matched(spark, d):
    x = views.sample(spark, d).withColumn("base", (F.col("tier") == "HIGH").cast("int"))
    return names.top_k_matched(x, "p", "sample_id", "split", "base").select("sample_id", "predicted")


@query
def base_rate_shift(spark, d):
    return rounded(names.base_rate_shift(views.sample(spark, d), "p", ["split", "tier"], 0.5))


@query
def construct_offset(spark, d):
    x = views.evaluation(spark, d).withColumn("flag", (F.col("grp") == "X").cast("int"))
    return rounded(names.construct_offset(x, "flag", "y"))


@query
def weighted_accuracy(spark, d):
    return rounded(names.weighted_accuracy(views.evaluation(spark, d), "y", "pred", "sample_prob"))


# Learning


@query
def class_weights(spark, d):
    return rounded(ml.class_weights(views.evaluation(spark, d), "y").groupBy("y").agg(F.count("*").alias("n"), F.min("class_weight").alias("class_weight")))


@query
def soft_targets(spark, d):
    return rounded(ml.soft_targets(views.scored(spark, d), "p").groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))


@query
def label_issues(spark, d):
    return ml.label_issues(views.evaluation(spark, d), "y", "p").filter("is_issue").select("EIN2")


@query
def pruned_arm(spark, d):
    return ml.pruned(views.evaluation(spark, d), "y", "p", "p").groupBy("y").agg(F.count("*").alias("n"))


@query
def arm_selection(spark, d):
    c = views.votes(spark, d).filter("confidence is not null").select("source_id", F.concat_ws("", F.lit("arm_"), "model_id").alias("arm"), "confidence").groupBy("arm", "source_id").agg(r(F.avg("confidence"), 4).alias("score"))
    return rounded(ml.select_arm(c, "arm", "score", ["arm_lexicon-rule", "arm_dogwood-nano", "arm_birch-mini", "arm_elder-flash", "arm_cedar-27b", "arm_aspen-large"]))


def _labelled_texts(spark, d):
    t = _texts(spark, d).filter("trim(t) != ''").groupBy("EIN2").agg(F.max("t").alias("text"))
    return sampling.folds(views.evaluation(spark, d), "y", "EIN2").join(t, "EIN2")


@query
def tfidf_scores(spark, d):
    x = cut_lineage(_labelled_texts(spark, d))
    out = ml.out_of_fold(x, ml.TextFit("text", "y"), lambda m, q: ml.score_tfidf(m, q, "text"))
    return rounded(out.select("EIN2", "fold", "y", "prob_raw"), 3)


@query
def embedding_scores(spark, d):
    x = sampling.folds(table(spark, d, "embeddings").withColumn("y", (F.col("label") < 5).cast("int")), "y", "vec_id", 3)
    out = ml.out_of_fold(cut_lineage(x), lambda tr: ml.fit_embedding(tr, "embedding", "y"), lambda m, q: ml.score_embedding(m, q, "embedding"))
    return rounded(out.select("vec_id", "fold", "y", "prob_raw"), 3)


# Stages


@query
def stage_sample(spark, d):
    return stages.build_sample(views.sample(spark, d), gold_per_group=6, silver_total=200)


@query
def stage_inference(spark, d):
    return rounded(stages.inference(views.frame(spark, d), stages.Calibrated("platt", {"a": 0.417, "b": 0.841}, 0.5, 0.7, 0.9)))


@query
def stage_evaluation(spark, d):
    return rounded(stages.evaluation_report(views.evaluation(spark, d)))


@query
def stage_prevalence(spark, d):
    return rounded(stages.prevalence_report(views.evaluation(spark, d), views.scored(spark, d)))


@query
def training_frame(spark, d):
    from tallyweave.plans.more_queries import _frame

    return rounded(_frame(spark, d).select("EIN2", F.md5("text").alias("text_md5"), "p_pos", "hard_label"))


@query
def annotator_slate(spark, d):
    v = views.votes(spark, d).filter("label is not null").join(views.evaluation(spark, d).select("EIN2", "y"), "EIN2")
    m = metrics.metric_bundle(v, "y", "label", ["source_id"])
    low = S.wilson((F.col("tp") * 2).cast("double"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))["low"]
    m = rounded(m.withColumn("f1_low", low)).select("source_id", "f1", "kappa", "f1_low")
    return ml.slate(m, "source_id", "f1", "kappa", "f1_low", 0.6)


@query
def high_confidence(spark, d):
    x = gating.confident(views.scored(spark, d), "p")
    return x.groupBy("grp").agg(F.count("*").alias("n"), r(F.avg("p")).alias("mean_p"))


@query
def low_estimate(spark, d):
    rules = views.sample(spark, d).filter("tier = 'LOW'").withColumn("label", T.rule_label("mission_text"))
    e = stages.low_estimate(views.evaluation(spark, d), views.scored(spark, d), rules, 0.8462, 13, 0.95, 54)
    return rounded(e)


@query
def prevalence_decomposition(spark, d):
    rules = views.sample(spark, d).withColumn("label", T.rule_label("mission_text"))
    return rounded(stages.decomposition(prevalence.rule_share(rules, "label", None, 0, None, 0, by=["tier"]).select("tier", "n", "estimate")))


@query
def acceptance(spark, d):
    return rounded(stages.acceptance(views.evaluation(spark, d)), 3)


@query
def stage_gates(spark, d):
    return stages.gates(views.sample(spark, d), views.votes(spark, d), views.evaluation(spark, d))


@query
def run_manifest(spark, d):
    return stages.run_manifest({t: table(spark, d, t) for t in ("mission_frame", "mission_sample", "label_record", "registry")}, {"seed": 42})


def queries() -> dict[str, Query]:
    from tallyweave.plans import more_queries  # noqa: F401  adds its queries

    return dict(QUERIES)
