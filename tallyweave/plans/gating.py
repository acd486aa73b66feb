"""What must hold before a stage may run. Checks are one aggregation each; those that refuse raise an error naming at most 20 offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.scores import confusion_metrics
from tallyweave.operators import metrics, sampling
from tallyweave.operators import votes as V
from tallyweave.operators.relations import require
from tallyweave.sources.io import strict_binary

SHOWN = 20


def probability_problems(df: DataFrame, p1: str, p0: str | None = None, tolerance: float = 1e-6) -> DataFrame:
    """One row: ``n``, ``n_missing``, ``n_outside`` of [0, 1] or not finite, ``n_not_one``: pairs of probabilities that do not add up to 1."""
    p = F.col(p1)
    bad = lambda c: p.isNotNull() & (F.isnan(c) | ~c.between(0, 1))
    other = F.coalesce(bad(F.col(p0)), F.lit(False)) if p0 else F.lit(False)
    apart = F.coalesce(F.abs(F.col(p0) + p - 1) > tolerance, F.lit(False)) if p0 else F.lit(False)
    return df.agg(F.count("*").alias("n"), F.count_if(p.isNull()).alias("n_missing"), F.count_if(F.coalesce(bad(p), F.lit(False)) | other).alias("n_outside"), F.count_if(apart).alias("n_not_one"))


def assert_probabilities(df: DataFrame, p1: str, p0: str | None = None) -> DataFrame:
    r = probability_problems(df, p1, p0).first()
    if r["n_missing"] or r["n_outside"] or r["n_not_one"]:
        raise ValueError(f"{p1}: {r['n_missing']} missing, {r['n_outside']} outside [0, 1], {r['n_not_one']} pairs that do not add up to 1")
    return df


def assert_values(df: DataFrame, col: str, known: list[str]) -> DataFrame:
    """Every value is one of the known; nulls are unknown."""
    strange = df.filter(~F.coalesce(F.col(col).isin(known), F.lit(False))).select(col).distinct().limit(SHOWN).collect()
    if strange:
        raise ValueError(f"unknown {col}: {sorted(str(r[0]) for r in strange)}")
    return df


def assert_disjoint(a: DataFrame, b: DataFrame, key: str, what: str = "tables") -> None:
    """No key stands on both sides."""
    both = a.filter(F.col(key).isNotNull()).select(key).distinct().join(b.select(key), key, "left_semi")
    n = both.count()
    if n:
        raise ValueError(f"{what} share {n} {key}, for instance {sorted(r[0] for r in both.orderBy(key).limit(SHOWN).collect())}")


def count_report(df: DataFrame, counts: dict[str, Column], expected: dict[str, int]) -> DataFrame:
    """``name, n, expected, ok`` of conditional counts, all in one pass; a count without an expectation is fine."""
    row = df.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    long = row.unpivot([], list(counts), "name", "n")
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("name")].cast("long") if expected else F.lit(None).cast("long")
    return long.withColumn("expected", want).withColumn("ok", F.coalesce(F.col("n") == F.col("expected"), F.lit(True)))


def assert_counts(df: DataFrame, counts: dict[str, Column], expected: dict[str, int]) -> DataFrame:
    wrong = [r for r in count_report(df, counts, expected).collect() if not r["ok"]]
    if wrong:
        raise ValueError("; ".join(f"{r['name']}: {r['n']} rows, {r['expected']} expected" for r in sorted(wrong)))
    return df


def label_problems(template: DataFrame, manifest: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """``problem, split, n`` of a coding template: ids that the manifest lacks or has too many, asked splits without rows, labels that are not 0 or 1.

    Without splits every row must be coded. A template that passes has no row here.
    """
    t = require(template, ["EIN2", "human_label", *(["split"] if splits else [])], "template").withColumn("__split", F.col("split") if splits else F.lit("all"))
    a, b = t.select(F.trim("EIN2").alias("k")).distinct(), manifest.select(F.trim("EIN2").alias("k")).distinct()
    out = None
    for name, left, right in (("extra ids", a, b), ("missing ids", b, a)):
        part = left.join(right, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), F.lit(None).cast("string").alias("split"), "n")
        out = part if out is None else out.unionByName(part)
    wanted = t.sparkSession.createDataFrame([(s,) for s in (splits or ["all"])], "split string")
    seen = t.groupBy(F.col("__split").alias("split")).agg(F.count("*").alias("rows"), F.count_if(strict_binary("human_label").isNull()).alias("bad"))
    per = wanted.join(F.broadcast(seen), "split", "left")
    empty = per.select(F.lit("split without rows").alias("problem"), "split", F.when(F.col("rows").isNull(), 1).otherwise(0).cast("long").alias("n"))
    bad = per.select(F.lit("labels not 0 or 1").alias("problem"), "split", F.coalesce("bad", F.lit(0)).alias("n"))
    return out.unionByName(empty).unionByName(bad).filter("n > 0")


def coding_changes(template: DataFrame, manifest: DataFrame, fixed: list[str], key: str = "EIN2") -> DataFrame:
    """``change, n``: what coders changed although only labels may change: ids, any fixed column, labels that are neither blank nor 0 or 1."""
    require(template, [key, "human_label", *fixed], "template")
    a = template.select(key, "human_label", F.struct(*[F.col(c).cast("string").alias(c) for c in fixed]).alias("a"), F.lit(True).alias("in_a"))
    b = manifest.select(F.col(key).alias("__k"), F.struct(*[F.col(c).cast("string").alias(c) for c in fixed]).alias("b"), F.lit(True).alias("in_b"))
    j = a.join(b, a[key].eqNullSafe(b["__k"]), "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    blank = F.coalesce(F.trim(F.col("human_label").cast("string")), F.lit("")) == ""
    counts = {"id added": F.col("in_b").isNull(), "id lost": F.col("in_a").isNull(), "label not 0 or 1": F.col("in_a").isNotNull() & ~blank & strict_binary("human_label").isNull()}
    counts |= {f"{c} changed": both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in fixed}
    return count_report(j, counts, {}).filter("n > 0").select(F.col("name").alias("change"), "n")


def minority_class(n1: int, n0: int, tie: int = 1) -> int:
    """The rarer class; equal classes give ``tie``: the positive one where annotators are compared, the negative one where labels are frozen."""
    return tie if n1 == n0 else int(n1 < n0)


def positive_score(label: Column | str, confidence: Column | str) -> Column:
    """A vote's confidence as a score of the positive class; null where either is null."""
    v, c = (F.col(x) if isinstance(x, str) else x for x in (label, confidence))
    return F.when(v == 1, c).when(v == 0, 1 - c)


def agreement_report(aggregated: DataFrame, human: DataFrame, key: str = "EIN2", label: str = "label", truth: str = "human_label", tie: int = 0, resamples: int = 2000, seed: int = 42) -> dict[str, float | int | None]:
    """Labels against human ones: rows in common, abstentions, raw agreement, metrics of the rarer human class and bootstrap ends of its F1. Only
    the four cells and three counts leave the executors."""
    j = aggregated.select(key, F.col(label).alias("__p")).join(human.select(key, F.col(truth).cast("int").alias("__y")), key)
    r = j.agg(F.count("*").alias("n"), F.count_if(F.col("__p").isNull()).alias("n_abstain"), *[F.count_if((F.col("__y") == a) & (F.col("__p") == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]).first()
    n = sum(r[f"n{a}{b}"] for a in (0, 1) for b in (0, 1))
    if not n:
        raise ValueError("no record has both a label and a human label")
    c = minority_class(r["n10"] + r["n11"], r["n00"] + r["n01"], tie)
    tp, fp, fn, tn = r[f"n{c}{c}"], r[f"n{1 - c}{c}"], r[f"n{c}{1 - c}"], r[f"n{1 - c}{1 - c}"]
    low, high = sampling.bootstrap_ci((tp, fp, fn, tn), lambda a, b, d, _: 2 * a / max(1, 2 * a + b + d), resamples, seed)
    m = j.sparkSession.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long").select(*[v.alias(k) for k, v in confusion_metrics(*(F.col(k) for k in ("tp", "fp", "fn", "tn"))).items()]).first()
    return {"n": n, "n_abstain": r["n_abstain"], "agreement": (tp + tn) / n, "minority_class": c, "tp": tp, "fp": fp, "fn": fn, "tn": tn, **m.asDict(), "f1_low": low, "f1_high": high}


def freeze(votes: DataFrame, human: DataFrame, held_out: DataFrame, least_kappa: float = 0.7, least_f1: float = 0.7, fabricated: DataFrame | None = None, confidence: str = "confidence") -> tuple[DataFrame, dict]:
    """The majority labels to train on, and the report that let them pass.

    Positive votes with invented evidence abstain first, if given. Kappa against the human labels and the lower end of the rarer class's F1 must reach
    their floors, else nothing is frozen and an error tells the figures. Held-out records take part in the check and are taken out afterwards.
    """
    v = V.abstain_fabricated(votes, fabricated, "EIN2", "source_id", "label") if fabricated is not None else votes
    labels = V.majority_vote(v, "EIN2", "label", confidence)
    report = agreement_report(labels, human)
    if not (report["kappa"] >= least_kappa and report["f1_low"] >= least_f1):
        raise ValueError(f"labels not frozen: kappa {report['kappa']:.3f} of {least_kappa:.3f}, lower F1 {report['f1_low']:.3f} of {least_f1:.3f}, raw agreement {report['agreement']:.3f}")
    return labels.join(held_out.select("EIN2").distinct(), "EIN2", "left_anti"), report


ARMS = "method string, status string, n long, n_abstain long, agreement double, kappa double, minority_class int, f1 double, f1_low double, f1_high double, clears_majority boolean, best boolean, reason string"


def compare_aggregations(votes: DataFrame, human: DataFrame, methods: list[str], predictions: DataFrame | None = None, p_col: str = "p") -> DataFrame:
    """One row per aggregation method scored on human labels. A method other than the majority clears the screen if its lower F1 is above the
    majority's F1; the one with the highest such bound is the best. A method that can't run has the status ``skipped`` and its reason."""
    found: dict[str, dict] = {}
    for m in methods:
        try:
            labels = V.aggregate_labels(votes, m, "EIN2", "source_id", "label", "confidence", predictions, p_col)
            if "label" not in labels.columns:
                labels = labels.withColumn("label", F.when(F.col("posterior") > 0.5, 1).when(F.col("posterior") < 0.5, 0))
            found[m] = agreement_report(labels, human, tie=1) | {"status": "ok", "reason": None}
        except (NotImplementedError, ValueError) as e:
            found[m] = {"status": "skipped", "reason": str(e)}
    base = found.get("majority", {}).get("f1")
    for m, r in found.items():
        r["clears_majority"] = None if m == "majority" or base is None or "f1_low" not in r else bool(r["f1_low"] > base)
    clear = [m for m in found if found[m]["clears_majority"]]
    best = max(clear, key=lambda m: found[m]["f1_low"], default=None)
    fields = [f.split(" ")[0] for f in ARMS.split(", ")]
    return votes.sparkSession.createDataFrame([tuple({"method": m, "best": m == best, **r}.get(f) for f in fields) for m, r in found.items()], ARMS)


def sample_problems(pool: DataFrame, groups: int = 26, low: float = 0.25, high: float = 0.5) -> DataFrame:
    """``check, n, ok`` of a drawn sample (``sample_id, pool, split, grp, is_positive``): repeated ids, ids in both pools, groups in the gold set,
    share of likely positives in the training pool (in whole per cent)."""
    per = pool.groupBy("sample_id").agg(F.count("*").alias("k"), F.count_distinct("pool").alias("pools"))
    a = per.agg(F.count_if(F.col("k") > 1).alias("repeated ids"), F.count_if(F.col("pools") > 1).alias("ids in both pools"))
    silver, gold = F.col("pool") == "silver", F.col("pool") == "gold"
    share = F.floor(100 * F.try_divide(F.count_if(silver & F.col("is_positive")), F.count_if(silver)))
    b = pool.agg(F.count_distinct(F.when(gold, F.col("grp"))).alias("groups in gold"), F.coalesce(share, F.lit(0)).cast("long").alias("positive per cent"))
    long = a.crossJoin(F.broadcast(b)).unpivot([], ["repeated ids", "ids in both pools", "groups in gold", "positive per cent"], "check", "n")
    c, n = F.col("check"), F.col("n")
    ok = F.when(c == "groups in gold", n == groups).when(c == "positive per cent", n.between(int(100 * low), int(100 * high))).otherwise(n == 0)
    return long.withColumn("ok", ok)


def score_against_labels(predicted: DataFrame, human: DataFrame, truth: str = "human_label") -> DataFrame:
    """Metrics of every source in a store of predictions against human labels; sources without a record in common have null metrics."""
    got = V.vote_arms(predicted, human, "EIN2", "source_id", "label", truth)
    return predicted.select("source_id").distinct().join(got, "source_id", "left").withColumn("overlap", F.col("n").isNotNull())


def classifier_rows(df: DataFrame, source_col: str = "decision_source") -> DataFrame:
    """Rows that the classifier decided; all rows where no row names it, as older prediction tables do not say."""
    is_it = F.coalesce(F.col(source_col).contains("classifier"), F.lit(False))
    some = df.agg(F.coalesce(F.max(is_it), F.lit(False)).alias("__some"))
    return df.crossJoin(F.broadcast(some)).filter(is_it | ~F.col("__some")).drop("__some")


def in_scope(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """Rows whose trimmed value is in scope; no such row at all is an error."""
    out = df.filter(F.trim(col).isin(values))
    if not out.limit(1).count():
        raise ValueError(f"no row with {col} in {values}")
    return out


def confident(df: DataFrame, p: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Rows whose score is at or beyond either end."""
    return df.filter((F.col(p) <= low) | (F.col(p) >= high))


def both_classes(df: DataFrame, label: str) -> DataFrame:
    """Rows with a strict 0 or 1; fewer than two classes are an error."""
    out = df.withColumn(label, strict_binary(label)).filter(F.col(label).isNotNull())
    if out.agg(F.count_distinct(label)).first()[0] < 2:
        raise ValueError(f"{label} needs both classes")
    return out


def first_rows(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    """A smoke run's rows: the first by key, so that every run takes the same; all without a limit."""
    return df if limit is None else df.orderBy(key).limit(limit)


def variance_report(cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs per cell: mean, deviation, range, interval (see ``metrics.summary_ci``)."""
    return metrics.summary_ci(cells, by, value)
