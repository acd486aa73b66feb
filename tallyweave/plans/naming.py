"""The names arm: frames of names, their scores, and how far a text model carries over to names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import lexicon as L
from tallyweave.functions.text import clean_name, lexicon_tokens, rule_label
from tallyweave.operators import metrics, names
from tallyweave.operators.relations import assert_unique
from tallyweave.plans.gating import assert_counts, count_report, in_scope

VARIANTS = ("suffix_stripped", "suffix_retaining")


def name_frame(panel: DataFrame, bare: DataFrame, registry: DataFrame, missions: DataFrame, manifests: DataFrame, scope: list[str] | None = None, expected: dict[str, int] | None = None) -> DataFrame:
    """One row per organization of the panel with its longest name, bare name, registry flags, whether it has a mission and whether a manifest holds it.

    ``panel``: EIN2, year, name (and scope); ``bare``: EIN2, bare_name; ``registry``: EIN2, NTEE_IRS, BMF_FOUNDATION_CODE; ``missions``: EIN2, text;
    ``manifests``: EIN2. Rows without a name are left out. Counts that differ from the expected ones are an error.
    """
    rows = in_scope(panel, "scope", scope) if scope else panel
    one = names.longest_name(rows.select("EIN2", "name", "year"), "EIN2", "name", "year").filter("trim(name) != ''")
    flags = names.external_flags(registry, "NTEE_IRS", "BMF_FOUNDATION_CODE").groupBy("EIN2").agg(F.max("is_ntee_x").alias("is_ntee_x"), F.max("is_church_foundation").alias("is_church_foundation"))
    has = missions.filter("trim(text) != ''").select("EIN2").distinct().withColumn("has_mission", F.lit(True))
    held = manifests.select("EIN2").distinct().withColumn("is_manifest_contaminated", F.lit(True))
    b = bare.groupBy("EIN2").agg(F.min("bare_name").alias("bare_name"))
    out = one.join(b, "EIN2", "left").join(flags.withColumn("has_registry", F.lit(True)), "EIN2", "left").join(has, "EIN2", "left").join(held, "EIN2", "left")
    yes = [F.coalesce(c, F.lit(False)).alias(c) for c in ("has_registry", "is_ntee_x", "is_church_foundation", "has_mission", "is_manifest_contaminated")]
    out = out.select("EIN2", F.lit("panel_scoped").alias("population"), "name", "year", "bare_name", *yes)
    return assert_counts(out, FRAME_COUNTS(), expected) if expected else out


def FRAME_COUNTS() -> dict:
    """What is counted of a name frame."""
    flagged = F.col("is_ntee_x") | F.col("is_church_foundation")
    return {"rows": F.lit(True), "with mission": F.col("has_mission"), "name only": ~F.col("has_mission"), "flagged": flagged, "flagged, name only": flagged & ~F.col("has_mission"), "contaminated": F.col("is_manifest_contaminated")}


def frame_counts(frame: DataFrame) -> DataFrame:
    return count_report(frame, FRAME_COUNTS(), {}).select("name", "n")


def score_names(frame: DataFrame, scorer, name_col: str = "name") -> DataFrame:
    """``EIN2, population, input_variant, text, prob_raw, lexicon_rule_label``: every name with and without its legal suffix, scored by the text model.

    Names that are blank when cleaned are left out. ``scorer`` takes rows with ``mission_text`` and gives them back with ``prob_raw``.
    """
    rows = names.variants(names.cleaned(frame, name_col), "EIN2").join(frame.select("EIN2", "population"), "EIN2")
    scored = scorer(rows.withColumnRenamed("text", "mission_text")).withColumnRenamed("mission_text", "text")
    return scored.select("EIN2", "population", "input_variant", "text", "prob_raw", rule_label("text").alias("lexicon_rule_label"))


def paired(scores: DataFrame, frame: DataFrame, missions: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Name scores beside the mission's score and label, without contaminated organizations, and the counts of what was left out.

    ``missions``: EIN2, prob_calibrated, pred_label, one row per id. Organizations without a mission score are left out; each variant must be there for every
    organization.
    """
    assert_unique(scores, ["EIN2", "input_variant"])
    assert_unique(missions, ["EIN2"])
    j = scores.drop("population").join(frame.filter("has_mission").select("EIN2", "population", "is_manifest_contaminated"), "EIN2").join(missions.select("EIN2", "prob_calibrated", "pred_label"), "EIN2")
    per = j.groupBy("EIN2").agg(F.count_distinct("input_variant").alias("k"), F.count("*").alias("rows"), F.max(F.col("prob_calibrated").isNull()).alias("no_score"), F.max("is_manifest_contaminated").alias("held"))
    n = per.agg(
        F.count_if("no_score").alias("n_without_mission_score"), F.count_if(~F.col("no_score")).alias("n_paired"), F.count_if(~F.col("no_score") & F.col("held")).alias("n_contaminated"),
        F.count_if(~F.col("no_score") & ~F.col("held")).alias("n_evaluated"), F.count_if(~F.col("no_score") & (F.col("k") != len(VARIANTS))).alias("n_incomplete"),
    ).first().asDict()
    if n.pop("n_incomplete"):
        raise ValueError(f"every organization needs the variants {VARIANTS}")
    return j.filter("prob_calibrated is not null and not is_manifest_contaminated"), n


def variant_report(pairs: DataFrame) -> DataFrame:
    """Per variant: agreement of name and mission scores, and precision of as many top names as the lexicon rule marks, against the mission's label, beside the
    rule's own precision."""
    x = pairs.withColumn("lexicon", F.coalesce("lexicon_rule_label", F.lit(0)))
    top = names.top_k_matched(x, "prob_raw", "EIN2", "input_variant", "lexicon")
    d, y = F.col("prob_raw") - F.col("prob_calibrated"), F.col("pred_label")
    a, b = F.col("prob_raw"), F.col("prob_calibrated")
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    hit = lambda c: F.try_divide(F.count_if((F.col(c) == 1) & (y == 1)), F.count_if(F.col(c) == 1))
    bins = F.least(F.floor(a * 10), F.lit(9))
    ece = top.groupBy("input_variant", bins.alias("b")).agg(F.abs(F.avg("prob_raw") - F.avg(F.col("pred_label").cast("double"))).alias("g"), F.count("*").alias("k"))
    ece = ece.groupBy("input_variant").agg((F.sum(F.col("g") * F.col("k")) / F.sum("k")).alias("ece"))
    out = top.groupBy("input_variant").agg(
        F.count("*").alias("n"), F.sum(F.col("lexicon").cast("long")).alias("n_positive"), F.try_divide(cov, F.sqrt(F.var_pop(a) * F.var_pop(b))).alias("pearson"),
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.avg((F.col("predicted") == y).cast("double")).alias("label_agreement"),
        hit("predicted").alias("transfer_precision"), hit("lexicon").alias("lexicon_precision"),
    )
    return out.join(ece, "input_variant").withColumn("transfer_wins", F.coalesce(F.col("transfer_precision") > F.col("lexicon_precision"), F.lit(False)))


def external_report(scores: DataFrame, flags: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per population and variant: rows, share with an external flag, share the model marks at the threshold, and metrics of the one against the other. A score
    whose population is not that of its flag fails the job."""
    f = flags.select("EIN2", F.col("population").alias("__p"), F.col("is_flagged").cast("int").alias("y"))
    same = F.when(F.col("population") == F.col("__p"), F.col("y")).otherwise(F.raise_error(F.lit("a score's population is not its frame's")))
    j = scores.join(f, "EIN2").withColumn("y", same).withColumn("pred", (F.col("prob_raw") >= threshold).cast("int"))
    m = metrics.metric_bundle(j, "y", "pred", ["population", "input_variant"])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return m.withColumn("flag_rate", (F.col("tp") + F.col("fn")) / n).withColumn("model_rate", (F.col("tp") + F.col("fp")) / n)


def gold_offset(gold: DataFrame, flags: DataFrame, pairs: DataFrame, splits: list[str]) -> DataFrame:
    """One row: on coded gold rows with a flag and a mission label, the rates of flag, human label and mission label, and the offset of the first two."""
    labels = pairs.groupBy("EIN2").agg(F.max("pred_label").alias("pred_label"))
    j = gold.filter(F.col("split").isin(splits) & F.col("human_label").isNotNull()).select("EIN2", "human_label").join(flags.select("EIN2", F.col("is_flagged").cast("int").alias("flag")), "EIN2").join(labels, "EIN2")
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return j.agg(F.count("*").alias("n"), rate("flag").alias("flag_rate"), rate("human_label").alias("human_rate"), rate("pred_label").alias("mission_rate"), (rate("flag") - rate("human_label")).alias("offset"))


def second_names(df: DataFrame, scorer, first: str = "name", second: str = "second_name", words=L.RELIGIOUS) -> DataFrame:
    """Organizations with two names whose lexicon words differ: the words each adds, the direction, and the score of both names.

    Null second names are no names. Both names are scored in one pass.
    """
    x = df.filter(F.col(second).isNotNull()).select("EIN2", F.col(first).alias("first_raw"), F.col(second).alias("second_raw"))
    x = x.withColumn("first_name", clean_name("first_raw")).withColumn("second_name", clean_name("second_raw"))
    cases = names.token_difference(x, "first_name", "second_name", words)
    cases = cases.withColumn("first_tokens", lexicon_tokens("first_name", words)).withColumn("second_tokens", lexicon_tokens("second_name", words))
    both = cases.select("EIN2", F.explode(F.array(F.struct(F.lit("first").alias("which"), F.col("first_name").alias("mission_text")), F.struct(F.lit("second").alias("which"), F.col("second_name").alias("mission_text")))).alias("v")).select("EIN2", "v.*")
    s = scorer(both).groupBy("EIN2").agg(F.max(F.when(F.col("which") == "first", F.col("prob_raw"))).alias("first_prob"), F.max(F.when(F.col("which") == "second", F.col("prob_raw"))).alias("second_prob"))
    return cases.join(s, "EIN2").select("EIN2", "first_name", "second_name", "first_tokens", "second_tokens", F.col("a_only").alias("first_only"), F.col("b_only").alias("second_only"), "direction", "first_prob", "second_prob")


#: Probes: pairs of names that differ in one respect. Their scores are a diagnosis, not an accuracy.
PROBES = (
    ("p1", "plain", "Riverside Community Church", 1),
    ("p2", "saint in a place name", "Saint Clair County Library Friends", None),
    ("p3", "faith without religion", "Good Faith Credit Counselors Inc", None),
    ("p4", "suffix", "Riverside Community Church Inc", 1),
    ("p5", "temple of another kind", "Temple University Alumni Club", None),
    ("p6", "plain", "Riverside Community Garden", 2),
    ("p7", "suffix", "Riverside Community Garden LLC", 2),
    ("p8", "capitals", "RIVERSIDE COMMUNITY CHURCH", 1),
)


def probes(spark, scorer, table=PROBES) -> DataFrame:
    """``probe_id, category, pair_id, text_raw, text_cleaned, prob_raw, lexicon_rule_label`` of a few literal names."""
    x = spark.createDataFrame(list(table), "probe_id string, category string, text_raw string, pair_id int").withColumn("mission_text", clean_name("text_raw"))
    s = scorer(x).withColumn("lexicon_rule_label", rule_label("mission_text"))
    return s.select("probe_id", "category", "pair_id", "text_raw", F.col("mission_text").alias("text_cleaned"), "prob_raw", "lexicon_rule_label")
