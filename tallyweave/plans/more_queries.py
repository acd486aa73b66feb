"""Queries of the stages: gates, training, prevalence with multiplicities, names, annotation runs and shards. Each runs over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import lexicon as L
from tallyweave.functions import text as T
from tallyweave.functions.ids import priority, standard_ein
from tallyweave.operators import annotate, metrics, ml, sampling
from tallyweave.operators import votes as V
from tallyweave.plans import estimation, gating, naming, stages, training, views
from tallyweave.plans.queries import _texts, query, r, rounded
from tallyweave.session import cut_lineage, shared_folder, table
from tallyweave.sources import io


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Gates


@query
def probability_problems(spark, d):
    return gating.probability_problems(views.scored(spark, d).withColumn("q", F.when(F.col("grp") == "X", 0.5).otherwise(1 - F.col("p"))), "p", "q")


def _template(spark, d) -> DataFrame:
    label = F.when(F.col("tier") == "HIGH", "1").when(F.col("tier") == "MEDIUM", "0.0").when(F.col("tier") == "LOW", "1").otherwise("maybe")
    return views.sample(spark, d).filter("split != 'train' and EIN2 is not null").select("EIN2", "split", label.alias("human_label"))


@query
def label_gate(spark, d):
    return gating.label_problems(_template(spark, d), views.frame(spark, d).filter("EIN2 is not null"), ["validation", "test", "no_such_split"])


@query
def coding_changes(spark, d):
    reg = table(spark, d, "registry").select("EIN2", F.col("ORG_NAME_CURRENT").alias("name"), F.col("NTEE_IRS").alias("code"))
    digit = F.substring("EIN2", -1, 1)
    coded = reg.filter(digit != "7").select("EIN2", F.when(digit == "3", "changed").otherwise(F.col("name")).alias("name"), "code", F.when(digit == "4", " ").otherwise(digit).alias("human_label"))
    return gating.coding_changes(coded, reg, ["name", "code"])


@query
def positive_scores(spark, d):
    v = views.votes(spark, d).withColumn("score", gating.positive_score("label", "confidence"))
    return rounded(v.groupBy("source_id").agg(F.count("score").alias("n"), F.avg("score").alias("mean_score")))


@query
def label_agreement(spark, d):
    v = views.votes(spark, d)
    m = V.majority_vote(v.filter("source_type = 'llm_prompt'"), "EIN2", "label", "confidence")
    rep = gating.agreement_report(m, views.evaluation(spark, d), truth="y")
    keep = ["n", "n_abstain", "agreement", "minority_class", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "mcc", "kappa"]
    row = tuple(float(rep[k]) if k in ("agreement", "precision", "recall", "f1", "mcc", "kappa") else rep[k] for k in keep)
    return rounded(spark.createDataFrame([row], "n long, n_abstain long, agreement double, minority_class int, tp long, fp long, fn long, tn long, precision double, recall double, f1 double, mcc double, kappa double"))


@query
def frozen_labels(spark, d):
    held = views.sample(spark, d).filter("split != 'train' and EIN2 is not null")
    labels, _ = gating.freeze(views.votes(spark, d), views.evaluation(spark, d).withColumnRenamed("y", "human_label"), held, least_kappa=-1.0, least_f1=0.0)
    return rounded(labels)


@query
def aggregation_compare(spark, d):
    v, y = cut_lineage(views.votes(spark, d)), cut_lineage(views.evaluation(spark, d))
    return rounded(gating.compare_aggregations(v, y.withColumnRenamed("y", "human_label"), ["majority", "dawid_skene", "crowdlab", "unknown"], views.scored(spark, d), "p"), 4)


@query
def sample_checks(spark, d):
    x = views.sample(spark, d).select("sample_id", F.when(F.col("split") == "train", "silver").otherwise("gold").alias("pool"), "split", "grp", T.has_any("mission_text", L.RELIGIOUS).alias("is_positive"))
    return gating.sample_problems(x)


@query
def arms_scored(spark, d):
    return rounded(gating.score_against_labels(views.votes(spark, d), views.evaluation(spark, d), "y"))


@query
def classifier_rows(spark, d):
    x = views.sample(spark, d).withColumn("decision_source", T.route("mission_text", "tier")["source"])
    return gating.classifier_rows(x).groupBy("decision_source").agg(F.count("*").alias("n"))


@query
def smoke_rows(spark, d):
    """The first rows by key, as a smoke run takes them: the limit is the feature."""
    return gating.first_rows(views.sample(spark, d).select("sample_id", "EIN2"), "sample_id", 100)


# Training


def _frame(spark, d) -> DataFrame:
    v = views.votes(spark, d)
    held = views.sample(spark, d).filter("split != 'train' and EIN2 is not null").select("EIN2").distinct()
    labels = V.majority_vote(v, "EIN2", "label", "confidence").join(held, "EIN2", "left_anti")
    t = _texts(spark, d).filter("trim(t) != ''").groupBy("EIN2").agg(F.min("t").alias("text"))
    return training.training_frame(v, labels, t, held)


@query
def training_arms(spark, d):
    x = cut_lineage(_frame(spark, d))
    out = None
    for name in ("hard", "soft", "class_weighted", "pruned"):
        part = training.arm(x, name).groupBy("label").agg(F.count("*").alias("n"), r(F.sum("weight"), 4).alias("weight")).withColumn("arm", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("arm", "label", "n", "weight")


@query
def embedding_frame(spark, d):
    t = _texts(spark, d).filter("trim(t) != ''").groupBy("EIN2").agg(F.min("t").alias("text"))
    a, b = (t.join(views.sample(spark, d).filter(c).select("EIN2"), "EIN2", "left_semi") for c in ("split = 'train'", "split != 'train'"))
    return training.one_text_per_id([a, b]).select("EIN2", F.md5("text").alias("text_md5"))


@query
def run_matrix(spark, d):
    runs = training.run_matrix(["small", "large"], ["soft", "hard", "pruned"], [0.25, 1.0], [1, 2], best={"model": "small", "arm": "hard"}, final_seeds=[1, 2, 3])
    return spark.createDataFrame([(x.run_id, x.phase, x.model, x.arm, x.fraction, x.seed) for x in runs], "run_id string, phase string, model string, arm string, fraction double, seed int")


@query
def documentation_curve(spark, d):
    v = views.votes(spark, d).filter("confidence is not null").groupBy("model_id", "prompt_id").agg(F.avg("confidence").alias("metric"))
    return rounded(training.documentation_curve(v, ["model_id"]))


def _vectors(spark, d) -> DataFrame:
    return sampling.folds(table(spark, d, "embeddings").withColumn("y", (F.col("label") < 5).cast("int")), "y", "vec_id", 3)


@query
def resumed_folds(spark, d):
    """Out-of-fold scores written fold by fold; the second call finds all folds done."""
    x, at = cut_lineage(_vectors(spark, d)), _fresh(spark, "folds")
    run = lambda: training.resumed_out_of_fold(x, lambda tr: ml.fit_embedding(tr, "embedding", "y"), lambda m, q: ml.score_embedding(m, q, "embedding"), at, "vec_id")
    run()
    return run().select("vec_id", "fold", r("p1", 3).alias("p1"))


@query
def stage_training(spark, d):
    """A matrix of runs over the vectors: each run's average precision on the rows its seed sets aside."""
    x = cut_lineage(table(spark, d, "embeddings").withColumn("y", (F.col("label") < 5).cast("int")))

    def run(spec: training.Run) -> float:
        split = sampling.dev_split(x, "y", "vec_id", 0.2, spec.seed)
        rows = sampling.nested_subset(split.filter("not is_dev"), "y", "vec_id", spec.fraction, spec.seed)
        got = ml.score_embedding(ml.fit_embedding(rows, "embedding", "y"), split.filter("is_dev"), "embedding")
        return metrics.average_precision(got, "y", "prob_raw").first()[0]

    results = training.execute(spark, training.run_matrix(["vectors"], ["hard"], [0.5, 1.0], [1, 2]), run, _fresh(spark, "runs"))
    return rounded(training.documentation_curve(results, ["phase", "fraction"]), 3)


# Prevalence


def _predictions(spark, d) -> DataFrame:
    """mission_sample as predictions: tier, score, rule label of LOW rows, and how many rows share the text."""
    x = views.sample(spark, d).withColumn("tier", F.when(F.col("tier").isin(estimation.TIERS), F.col("tier")).otherwise("LOW"))
    x = x.withColumn("rule", F.when(F.col("tier") == "LOW", T.rule_label("mission_text")))
    n = x.groupBy(T.text_key("mission_text").alias("k")).agg(F.count("*").alias("multiplicity"))
    return x.withColumn("k", T.text_key("mission_text")).join(n, "k").drop("k")


def _anchor(spark, d) -> DataFrame:
    x = _predictions(spark, d).filter("split != 'train'")
    y = ((priority(9, F.col("sample_id")) % 1000) / 1000 < F.col("p")).cast("int")
    return x.withColumn("y", y).withColumn("sample_prob", (priority(3, F.col("sample_id")) % 3 + 1) / 4)


@query
def common_columns(spark, d):
    x = estimation.common_columns(table(spark, d, "mission_sample"))
    return x.groupBy("tier", "ntee_major_group").agg(F.count("*").alias("n"))


@query
def anchor_groups(spark, d):
    a = views.evaluation(spark, d).select("EIN2", "y")
    m = views.scored(spark, d).select("EIN2", F.col("grp").alias("ntee_major_group"))
    return estimation.anchor_with_group(a, m).groupBy("ntee_major_group").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("n_positive"))


@query
def multiplicities(spark, d):
    raw = views.frame(spark, d)
    x = estimation.with_multiplicity(views.frame(spark, d, deduplicate=True), raw, "mission_text", "rec_id")
    return x.groupBy("multiplicity").agg(F.count("*").alias("n"))


@query
def anchor_multiplicities(spark, d):
    p = _predictions(spark, d).filter("sample_id % 3 != 0").select("sample_id", "multiplicity")
    a = estimation.anchor_multiplicity(_anchor(spark, d).select("sample_id"), p, "sample_id")
    return a.groupBy("multiplicity").agg(F.count("*").alias("n"))


@query
def hm_estimate(spark, d):
    return rounded(estimation.hm_estimate(_anchor(spark, d), _predictions(spark, d)))


@query
def multiplicity_sensitivity(spark, d):
    return rounded(estimation.multiplicity_sensitivity(_anchor(spark, d), _predictions(spark, d)))


@query
def group_composites(spark, d):
    return rounded(estimation.group_composites(_anchor(spark, d), _predictions(spark, d), 0.8462, 13, 0.95, 54))


@query
def cross_checks(spark, d):
    return rounded(estimation.cross_checks(_anchor(spark, d), _predictions(spark, d), ["emq", "kdey", "other"]), 4)


@query
def quantifier_rows(spark, d):
    a, p = cut_lineage(_anchor(spark, d)), cut_lineage(_predictions(spark, d))
    return rounded(estimation.quantifier_rows(estimation.hm_estimate(a, p), estimation.cross_checks(a, p, ["emq", "kdey"]), estimation.multiplicity_sensitivity(a, p)), 4)


@query
def anchor_routes(spark, d):
    return estimation.with_route(_anchor(spark, d)).groupBy("tier", "decision_source").agg(F.count("*").alias("n"))


@query
def monitored_scores(spark, d):
    s = views.sample(spark, d)
    return estimation.scores_of(s.filter("split = 'monitor'"), s, "sample_id", ["p", "tier"])


@query
def group_order(spark, d):
    n = views.sample(spark, d).filter("grp != '?'").groupBy("grp").agg(F.count("*").alias("n"))
    return estimation.ordered_groups(n, "grp", "n", L.GROUPS).select("grp", "label", "n", "place")


@query
def text_with_fallback(spark, d):
    f = views.frame(spark, d).filter("trim(mission_text) != ''").groupBy("EIN2").agg(F.min("mission_text").alias("text"))
    s = views.sample(spark, d).filter("trim(mission_text) != ''").groupBy("EIN2").agg(F.min("mission_text").alias("text"))
    ids = views.votes(spark, d).select("EIN2")
    return estimation.first_text([f, s], ids).select("EIN2", F.md5("text").alias("text_md5"))


@query
def population_language(spark, d):
    x = views.sample(spark, d).withColumn("label", T.rule_label("mission_text"))
    return gating.both_classes(x, "label").groupBy("label").agg(F.count("*").alias("n"))


@query
def equal_parts(spark, d):
    return rounded(sampling.stratified_by_group(views.sample(spark, d).filter("grp != '?'"), "grp", "sample_id", 130).select("sample_id", "grp", "inclusion_prob"), 9)


# Names


def _name_frame(spark, d) -> DataFrame:
    reg = table(spark, d, "registry").select(standard_ein("EIN2").alias("EIN2"), F.col("ORG_NAME_CURRENT").alias("name"), "NTEE_IRS", "BMF_FOUNDATION_CODE")
    f = views.frame(spark, d).select("EIN2", F.col("mission_text").alias("text"))
    held = views.sample(spark, d).filter("split != 'train' and EIN2 is not null").select("EIN2")
    bare = reg.select("EIN2", F.lower("name").alias("bare_name"))
    return naming.name_frame(reg.select("EIN2", "name", F.lit(2020).alias("year")), bare, reg, f, held)


def _name_scores(spark, d) -> DataFrame:
    return naming.score_names(_name_frame(spark, d), stages.default_scorer)


def _pairs(spark, d) -> DataFrame:
    return naming.paired(cut_lineage(_name_scores(spark, d)), _name_frame(spark, d), _missions(spark, d))[0]


def _missions(spark, d) -> DataFrame:
    return views.scored(spark, d).select("EIN2", F.col("p").alias("prob_calibrated"), (F.col("p") >= 0.5).cast("int").alias("pred_label"))


@query
def name_frame_counts(spark, d):
    return naming.frame_counts(_name_frame(spark, d))


@query
def name_scores(spark, d):
    return rounded(_name_scores(spark, d).select("EIN2", "input_variant", "prob_raw", "lexicon_rule_label"))


@query
def name_pair_counts(spark, d):
    n = naming.paired(cut_lineage(_name_scores(spark, d)), _name_frame(spark, d), _missions(spark, d))[1]
    return spark.createDataFrame(sorted(n.items()), "name string, n long")


@query
def name_variant_report(spark, d):
    return rounded(naming.variant_report(_pairs(spark, d)))


@query
def name_external_report(spark, d):
    flags = _name_frame(spark, d).withColumn("is_flagged", F.col("is_ntee_x") | F.col("is_church_foundation"))
    return rounded(naming.external_report(_name_scores(spark, d), flags, 0.05))


@query
def name_gold_offset(spark, d):
    flags = _name_frame(spark, d).withColumn("is_flagged", F.col("is_ntee_x") | F.col("is_church_foundation"))
    gold = views.evaluation(spark, d).select("EIN2", F.lit("validation").alias("split"), F.col("y").alias("human_label"))
    return rounded(naming.gold_offset(gold, flags, _pairs(spark, d), ["prompt_dev", "validation"]))


@query
def second_names(spark, d):
    m = views.frame(spark, d).filter("mission_text is not null").groupBy("EIN2").agg(F.min("mission_text").alias("second_name"))
    x = _name_frame(spark, d).join(m, "EIN2")
    c = naming.second_names(x, stages.default_scorer)
    return c.select("EIN2", F.array_join("first_only", ",").alias("first_only"), F.array_join("second_only", ",").alias("second_only"), "direction", r("first_prob").alias("first_prob"))


@query
def name_probes(spark, d):
    return rounded(naming.probes(spark, stages.default_scorer))


# Annotation and shards


def _says_church():
    def answer(texts: list[str]) -> list[str]:
        form = '{"binary_label": "%s", "confidence": 0.9, "domains_present": [], "evidence_spans": [], "boundary_notes": null, "reason": "word"}'
        return [form % ("religious" if "church" in t.lower() else "nonreligious") for t in texts]

    return answer


@query
def annotation_run(spark, d):
    """Two annotators over all texts; the run is repeated, and the repetition asks for nothing."""
    t = cut_lineage(_texts(spark, d).filter("t is not null").groupBy("EIN2").agg(F.min("t").alias("text")))
    store = _fresh(spark, "store")
    who = [annotate.Annotator("words", p, _says_church) for p in ("v1", "v2")]
    annotate.run(t, who, store)
    again = annotate.run(t, who, store).count()
    return spark.read.parquet(store).groupBy("source_id", "label").agg(F.count("*").alias("n")).withColumn("n_again", F.lit(again))


@query
def shard_scores(spark, d):
    """Rows scored shard by shard; the second call finds all shards valid."""
    x = table(spark, d, "mission_sample").select("sample_id", "mission_text")
    at = _fresh(spark, "shards")
    run = lambda: io.score_shards(x, at, "sample_id", lambda q: q.withColumn("score", F.length(F.coalesce("mission_text", F.lit("")))), "v1", 16)
    run()
    return run().select("sample_id", "score")
