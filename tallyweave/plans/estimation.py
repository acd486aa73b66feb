"""The prevalence stage: predictions with the number of rows each stands for, labelled anchor rows, and estimates of the parts, groups and the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.scores import clip01, rogan_gladen, rogan_gladen_variance, z_value
from tallyweave.functions.text import text_key
from tallyweave.operators import prevalence
from tallyweave.plans.gating import assert_values
from tallyweave.session import cut_lineage

TIERS = ["HIGH", "MEDIUM", "LOW"]


def common_columns(df: DataFrame, tier: str = "tier", group: str = "ntee_major_group") -> DataFrame:
    """Tier and group in one spelling; blank and null groups are ``UNKNOWN``."""
    g = F.trim(group)
    return df.withColumn(tier, F.upper(F.trim(tier))).withColumn(group, F.when(F.coalesce(g, F.lit("")) != "", g).otherwise("UNKNOWN"))


def anchor_with_group(anchor: DataFrame, manifest: DataFrame, key: str = "EIN2", group: str = "ntee_major_group") -> DataFrame:
    """Anchor rows with the group of their manifest row; an anchor row that the manifest lacks, or has twice, fails the job that reads it."""
    m = manifest.groupBy(key).agg(F.count("*").alias("__n"), F.min(group).alias("__g"))
    ok = F.when(F.col("__n").isNull(), F.raise_error(F.lit("an anchor row is not in the manifest"))).when(F.col("__n") > 1, F.raise_error(F.lit("the manifest repeats an id"))).otherwise(F.col("__g"))
    return anchor.drop(group).join(m, key, "left").withColumn(group, ok).drop("__n", "__g")


def with_multiplicity(predictions: DataFrame, raw: DataFrame, text: str, key: str = "EIN2") -> DataFrame:
    """Predictions of distinct texts with ``multiplicity``: how many raw rows have the text. A prediction whose text no raw row has fails the job."""
    n = raw.groupBy(text_key(text).alias("__k")).agg(F.count("*").alias("multiplicity"))
    out = predictions.withColumn("__k", text_key(text)).join(n, "__k", "left").drop("__k")
    return out.withColumn("multiplicity", F.when(F.col("multiplicity").isNull(), F.raise_error(F.lit("a predicted text is in no raw row"))).otherwise(F.col("multiplicity")))


def anchor_multiplicity(anchor: DataFrame, predictions: DataFrame, key: str = "EIN2") -> DataFrame:
    """Anchor rows with their prediction's multiplicity, 1 where there is none."""
    return anchor.join(predictions.groupBy(key).agg(F.max("multiplicity").alias("multiplicity")), key, "left").withColumn("multiplicity", F.coalesce("multiplicity", F.lit(1).cast("long")))


def high_medium(df: DataFrame) -> DataFrame:
    return df.filter(F.col("tier").isin("HIGH", "MEDIUM"))


def hm_estimate(anchor: DataFrame, predictions: DataFrame, y: str = "y", anchor_p: str = "p", p: str = "p", prob: str = "sample_prob") -> DataFrame:
    """``estimator, n_anchor, n_corpus, estimate, variance, ci_lower, ci_upper`` of the HIGH and MEDIUM rows: unweighted and design-weighted; predictions count
    as often as their multiplicity. No rows at all give 0 without variance; rows without scores are left out."""
    a, c = high_medium(anchor).withColumn("__p", F.col(anchor_p)), high_medium(predictions).withColumn("__p", F.col(p))
    w = a.withColumn("__dw", 1 / F.col(prob))
    rows = None
    for name, weight in (("ppi", None), ("ppi_weighted", "__dw")):
        part = prevalence.ppi(w, c, y, "__p", anchor_weight=weight, corpus_weight="multiplicity").withColumn("estimator", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    zero = c.agg(F.count("*").alias("__n")).filter("__n = 0").select(F.explode(F.array(F.lit("ppi"), F.lit("ppi_weighted"))).alias("estimator"))
    keep = ["estimator", "n_anchor", "n_corpus", "estimate", "variance", "ci_lower", "ci_upper"]
    empty = zero.select("estimator", F.lit(0).cast("long").alias("n_anchor"), *[F.lit(0.0).alias(k) for k in keep[2:]])
    return rows.select(*keep).filter("estimate is not null").unionByName(empty)


def multiplicity_sensitivity(anchor: DataFrame, predictions: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: the HIGH and MEDIUM estimate with anchor rows weighted by multiplicity, and how far it is from the unweighted one; null without rows."""
    a, c = high_medium(anchor), high_medium(predictions)
    one = prevalence.ppi(a, c, y, p, anchor_weight="multiplicity", corpus_weight="multiplicity").select(F.col("estimate").alias("estimate"))
    base = prevalence.ppi(a, c, y, p, corpus_weight="multiplicity").select(F.col("estimate").alias("baseline"))
    return one.crossJoin(F.broadcast(base)).select("estimate", (F.col("estimate") - F.col("baseline")).alias("delta"), F.when(F.col("estimate").isNull(), "skipped").otherwise("ok").alias("status"))


def group_composites(anchor: DataFrame, predictions: DataFrame, se: float | None, n_se: float, sp: float | None, n_sp: float, group: str = "grp", y: str = "y", p: str = "p", min_n: int = 10, weighted: bool = True, alpha: float = 0.05) -> DataFrame:
    """Per group: the HIGH and MEDIUM rows by the prediction-powered mean, the LOW rows by their rule labels corrected for the rule's errors, put together by
    their shares of raw rows. Groups with fewer than min_n labelled rows are kept but not estimated; a group without LOW or without other
    rows is its other part. ``predictions``: group, tier, p, rule (label or null), multiplicity; ``anchor``: group, tier, y, p, sample_prob.
    """
    assert_values(predictions, "tier", TIERS)
    a = high_medium(anchor).withColumn("__dw", 1 / F.col("sample_prob"))
    hm = prevalence.ppi(a, high_medium(predictions), y, p, anchor_weight="__dw" if weighted else None, corpus_weight="multiplicity", by=[group]).select(group, F.col("estimate").alias("e_hm"), F.col("variance").alias("v_hm"))
    low = predictions.filter((F.col("tier") == "LOW") & F.col("rule").isNotNull()).groupBy(group).agg(
        F.sum("multiplicity").cast("double").alias("n_rule"), (F.sum(F.col("multiplicity") * F.col("rule")) / F.sum("multiplicity")).alias("observed")
    )
    if se is None or sp is None:
        low = low.select(group, F.col("observed").alias("e_low"), (F.col("observed") * (1 - F.col("observed")) / F.col("n_rule")).alias("v_low"))
    else:
        s, q = F.lit(float(se)), F.lit(float(sp))
        low = low.select(group, rogan_gladen(F.col("observed"), s, q).alias("e_low"), rogan_gladen_variance(F.col("observed"), F.col("n_rule"), s, F.lit(float(n_se)), q, F.lit(float(n_sp))).alias("v_low"))
    is_low = F.col("tier") == "LOW"
    sizes = predictions.groupBy(group).agg(F.sum("multiplicity").alias("n"), F.sum(F.when(is_low, F.col("multiplicity")).otherwise(0)).alias("n_low"))
    seen = anchor.filter(F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("n_anchor"))
    j = sizes.join(seen, group, "left").join(hm, group, "left").join(low, group, "left").withColumn("n_anchor", F.coalesce("n_anchor", F.lit(0).cast("long")))
    share = F.col("n_low") / F.col("n")
    part = lambda e, w: F.when(w == 0, 0.0).otherwise(F.col(e))
    e = part("e_hm", 1 - share) * (1 - share) + part("e_low", share) * share
    v = part("v_hm", 1 - share) * (1 - share) * (1 - share) + part("v_low", share) * share * share
    half = z_value(alpha) * F.sqrt(F.col("__v"))
    j = j.withColumn("__e", e).withColumn("__v", v).withColumn("suppressed", F.col("n_anchor") < min_n)
    keep = lambda c: F.when(~F.col("suppressed"), c)
    return j.select(group, "n", "n_low", "n_anchor", "suppressed", keep(clip01(F.col("__e"))).alias("estimate"), keep(F.col("__v")).alias("variance"), keep(clip01(F.col("__e") - half)).alias("ci_lower"), keep(clip01(F.col("__e") + half)).alias("ci_upper"))


def cross_checks(anchor: DataFrame, predictions: DataFrame, requested: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """``name, status, estimate, reason``: other quantifiers on the HIGH and MEDIUM rows. One that fails is reported and stops no other; unknown names
    are skipped, and all are where no usable rows are left."""
    a = cut_lineage(high_medium(anchor).filter(F.col(y).isNotNull() & F.col(p).isNotNull()))
    c = cut_lineage(high_medium(predictions).filter(F.col(p).isNotNull()))
    rows = []
    usable = bool(a.limit(1).count() and c.limit(1).count())
    for name in requested:
        if not usable:
            rows.append((name, "skipped", None, "no usable rows"))
        elif name not in ("emq", "kdey"):
            rows.append((name, "skipped", None, "unknown cross-check"))
        else:
            try:
                if name == "emq":
                    prior = a.agg(F.avg(F.col(y).cast("double"))).first()[0]
                    got = prevalence.emq(c, p, prior, "multiplicity")[0]
                else:
                    got = prevalence.kdey(c, a, y, p)
                rows.append((name, "ok", float(got), None))
            except Exception as e:  # noqa: BLE001  a failed cross-check is a row of the report
                rows.append((name, "failed", None, str(e)[:300]))
    return anchor.sparkSession.createDataFrame(rows, "name string, status string, estimate double, reason string")


def quantifier_rows(hm: DataFrame, checks: DataFrame, sensitivity: DataFrame) -> DataFrame:
    """``estimator, estimate, ci_lower, ci_upper`` of all estimators that gave a figure."""
    none = F.lit(None).cast("double")
    out = hm.select("estimator", "estimate", "ci_lower", "ci_upper")
    out = out.unionByName(checks.filter("status = 'ok'").select(F.col("name").alias("estimator"), "estimate", none.alias("ci_lower"), none.alias("ci_upper")))
    return out.unionByName(sensitivity.filter("status = 'ok'").select(F.lit("multiplicity_weighted").alias("estimator"), "estimate", none.alias("ci_lower"), none.alias("ci_upper")))


def with_route(anchor: DataFrame, text: str = "mission_text", tier: str = "tier") -> DataFrame:
    """Anchor scores with the route that inference would give each row."""
    from tallyweave.functions.text import route

    return anchor.withColumn("decision_source", route(text, tier)["source"])


def scores_of(ids: DataFrame, predictions: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The predictions of a set of ids, monitored ones for instance; an id without a prediction fails the job that reads it."""
    p = predictions.groupBy(key).agg(F.first(F.struct(*columns)).alias("__p"))
    out = ids.select(key).distinct().join(p, key, "left")
    out = out.withColumn("__p", F.when(F.col("__p").isNull(), F.raise_error(F.lit("an id has no prediction"))).otherwise(F.col("__p")))
    return out.select(key, *[F.col(f"__p.{c}").alias(c) for c in columns])


def ordered_groups(df: DataFrame, group: str, by: str, names: dict[str, str], ascending: bool = False) -> DataFrame:
    """A report of few groups with their labels and ``place`` in order of a column, ties by group; an unknown group is an error."""
    from pyspark.sql import Window

    assert_values(df, group, list(names))
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(group)]
    order = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.withColumn("label", label).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(order, group)))


def first_text(frames: list[DataFrame], ids: DataFrame, key: str = "EIN2", text: str = "text") -> DataFrame:
    """Ids with their text from the first frame that has one; frames hold one row per id. Ids without any keep a null."""
    out = ids.select(key).distinct().withColumn(text, F.lit(None).cast("string"))
    for f in frames:
        out = out.join(f.select(key, F.col(text).alias("__t")), key, "left").withColumn(text, F.coalesce(text, "__t")).drop("__t")
    return out
