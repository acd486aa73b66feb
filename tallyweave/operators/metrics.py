"""Classifier evaluation. Curves come from one aggregation per distinct score, so ranking work follows the
number of scores, and running totals are windows over that small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.scores import EPS, confusion_metrics, precision_at_base_rate, ratio, wilson
from tallyweave.functions.text import length_bin, word_count

ALL = Window.unboundedPreceding


def confusion(df: DataFrame, y: str, pred: Column | str, by: list[str] = ()) -> DataFrame:
    p = F.col(pred) if isinstance(pred, str) else pred
    cell = lambda a, b, n: F.count_if((F.col(y) == a) & (p == b)).alias(n)
    return df.groupBy(*by).agg(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))


def threshold_confusion(df: DataFrame, y: str, p: str, thresholds: dict[str, float]) -> DataFrame:
    """One confusion matrix per named threshold, all in one pass over the rows."""
    parts = []
    for name, t in thresholds.items():
        hit, true = F.col(p) >= t, F.col(y) == 1
        parts.append(F.struct(F.lit(name).alias("name"), F.lit(float(t)).alias("threshold"), F.count_if(~hit & ~true).alias("tn"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(hit & true).alias("tp")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("m")).select("m.*")


def metric_bundle(df: DataFrame, y: str, pred: str, by: list[str] = ()) -> DataFrame:
    c = confusion(df, y, pred, list(by))
    m = confusion_metrics(*(F.col(k) for k in ("tp", "fp", "fn", "tn")))
    return c.select(*by, "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in m.items()])


def subgroups(df: DataFrame, y: str, pred: str, columns: list[str], text_col: str | None = None, min_n: int = 10) -> DataFrame:
    """F1, false-positive and false-negative rate per value of each column and per length bin.

    All groupings in one pass: the row is exploded to its (column, value) pairs. Groups under min_n
    are kept with null rates; null values form the group ``<missing>``.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("value")) for c in columns]
    if text_col:
        pairs.append(F.struct(F.lit("length_bin").alias("column"), length_bin(word_count(text_col)).alias("value")))
    long = df.select(F.col(y), F.col(pred), F.explode(F.array(*pairs)).alias("g")).select(y, pred, "g.*")
    c = confusion(long, y, pred, ["column", "value"])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    low = n < min_n
    keep = lambda x: F.when(~low, x)
    return c.select("column", "value", n.alias("n"), low.alias("suppressed"), keep(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"), keep(ratio(fp, fp + tn)).alias("fpr"), keep(ratio(fn, fn + tp)).alias("fnr"))


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Every bin of [0, 1] with its rows, mean prediction, observed rate and gap; empty bins have nulls."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    got = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("observed"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(got), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_pred", "observed", (F.col("mean_pred") - F.col("observed")).alias("gap"))


def calibration_errors(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """One row: expected calibration error, Brier score, log-loss (clipped)."""
    r = reliability(df, y, p, bins)
    ece = r.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))
    q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    loss = df.agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))
    return loss.crossJoin(F.broadcast(ece))


def score_counts(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives; the base of all curves."""
    return df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))


#: Blocks of the score range: running totals are taken over the blocks first and then inside each.
BLOCKS = 1024


def running(c: DataFrame, values: list[str], by: list[str] = (), down: bool = True) -> DataFrame:
    """c (one row per ``threshold`` and group) with ``{v}_upto``, the running total of each value from the highest score down (or from the lowest up),
    the row's own included, and ``{v}_all``. Blocks of scores are summed first, at most BLOCKS rows per group, so no task ever orders
    all scores; equal blocks are ordered in parallel. Scores outside [0, 1] belong to the end blocks."""
    rows = c.withColumn("__b", F.floor(F.least(F.greatest(F.col("threshold"), F.lit(0.0)), F.lit(1.0)) * BLOCKS).cast("int"))
    order = (lambda x: F.desc(x)) if down else F.asc
    key = [F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"__g{i}") for i, g in enumerate(by)]
    names = [f"__g{i}" for i in range(len(by))]
    rows = rows.select("*", *key)
    sums = rows.groupBy(*names, "__b").agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    before, every = Window.partitionBy(*names).orderBy(order("__b")).rowsBetween(ALL, -1), Window.partitionBy(*names)
    sums = sums.select(*names, "__b", *[F.coalesce(F.sum(f"__s_{v}").over(before), F.lit(0)).alias(f"__before_{v}") for v in values], *[F.sum(f"__s_{v}").over(every).alias(f"{v}_all") for v in values])
    inside = Window.partitionBy(*names, "__b").orderBy(order("threshold")).rowsBetween(ALL, 0)
    rows = rows.select("*", *[F.sum(v).over(inside).alias(f"__in_{v}") for v in values]).join(sums, [*names, "__b"])
    out = rows.select("*", *[(F.col(f"__before_{v}") + F.col(f"__in_{v}")).alias(f"{v}_upto") for v in values])
    return out.drop("__b", *names, *[f"__before_{v}" for v in values], *[f"__in_{v}" for v in values])


def pr_curve(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 at every distinct score as threshold."""
    c = running(score_counts(df, y, p, by), ["pos", "neg"], by)
    tp, fp, fn = F.col("pos_upto"), F.col("neg_upto"), F.col("pos_all") - F.col("pos_upto")
    return c.select(*by, "threshold", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """False and true positive rate at every distinct score, and the start (0, 0)."""
    c = running(score_counts(df, y, p), ["pos", "neg"])
    points = c.select("threshold", ratio(F.col("neg_upto"), F.col("neg_all")).alias("fpr"), ratio(F.col("pos_upto"), F.col("pos_all")).alias("tpr"))
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(start)


def average_precision(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Precision at each score, weighted by the share of positives that the score adds."""
    c = running(score_counts(df, y, p, by), ["pos", "neg"], by)
    gain = ratio(F.col("pos"), F.col("pos_all"))
    return c.groupBy(*by).agg(F.sum(gain * ratio(F.col("pos_upto"), F.col("pos_upto") + F.col("neg_upto"))).alias("average_precision"))


def roc_auc(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties as halves; null without both classes."""
    c = running(score_counts(df, y, p, by), ["neg"], by, down=False)
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return c.groupBy(*by).agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def pick_threshold(df: DataFrame, y: str, p: str, policy: str = "precision_floor", floor: float = 0.8) -> DataFrame:
    """The best point of the curve: highest recall with precision at the floor (else highest precision, flagged), or highest F1.

    Ties go to the higher recall, then precision, then threshold.
    """
    c = pr_curve(df, y, p)
    point = F.struct("recall", "precision", "threshold", "f1")
    if policy == "max_f1":
        return c.agg(F.max_by(point, F.struct("f1", "recall", "precision", "threshold")).alias("b")).select("b.threshold", "b.precision", "b.recall", "b.f1", F.lit(True).alias("floor_met"))
    ok = F.col("precision") >= floor
    best = c.agg(F.max_by(point, F.when(ok, F.struct("recall", "precision", "threshold"))).alias("a"), F.max_by(point, F.struct("precision", "recall", "threshold")).alias("b"))
    b = F.coalesce("a", "b")
    return best.select(b["threshold"].alias("threshold"), b["precision"].alias("precision"), b["recall"].alias("recall"), b["f1"].alias("f1"), F.col("a").isNotNull().alias("floor_met"))


def base_rate_points(df: DataFrame, y: str, p: str, pi: float, w: str | None = None) -> DataFrame:
    """At every score: weighted true and false positive rate, and precision if the class made up pi of the population."""
    weight = F.col(w) if w else F.lit(1.0)
    c = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("threshold")).agg(F.sum(F.when(F.col(y) == 1, weight).otherwise(0.0)).alias("wp"), F.sum(F.when(F.col(y) == 0, weight).otherwise(0.0)).alias("wn"))
    c = running(c, ["wp", "wn"]).select("threshold", ratio(F.col("wp_upto"), F.col("wp_all")).alias("tpr"), ratio(F.col("wn_upto"), F.col("wn_all")).alias("fpr"))
    return c.withColumn("precision", precision_at_base_rate(F.col("tpr"), F.col("fpr"), pi))


def base_rate_threshold(df: DataFrame, y: str, p: str, pi: float, target: float, w: str | None = None) -> DataFrame:
    """The lowest threshold whose precision at pi reaches the target, else the one of highest precision."""
    c = base_rate_points(df, y, p, pi, w)
    low = F.min(F.when(F.col("precision") >= target, F.col("threshold")))
    best = c.agg(low.alias("low"), F.max_by("threshold", F.struct("precision", "tpr", "threshold")).alias("best"))
    return best.select(F.coalesce("low", "best").alias("threshold"), F.col("low").isNotNull().alias("target_met"))


def rule_validation(df: DataFrame, y: str, rule: str) -> DataFrame:
    """One row: how a rule that may abstain does against labels, with Wilson intervals of its sensitivity and specificity."""
    c = df.agg(
        F.count("*").alias("n"), F.count_if(F.col(rule).isNull()).alias("n_abstain"), *[F.count_if((F.col(y) == a) & (F.col(rule) == b)).alias(k) for a, b, k in ((1, 1, "tp"), (0, 1, "fp"), (1, 0, "fn"), (0, 0, "tn"))]
    )
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    se, sp = wilson(tp, tp + fn), wilson(tn, tn + fp)
    return c.select("n", "n_abstain", "tp", "fp", "fn", "tn", F.try_divide(tp, tp + fn).alias("sensitivity"), se["low"].alias("sensitivity_low"), se["high"].alias("sensitivity_high"), F.try_divide(tn, tn + fp).alias("specificity"), sp["low"].alias("specificity_low"), sp["high"].alias("specificity_high"))


def threshold_sweep(df: DataFrame, p: str, by: str, points: int = 200) -> DataFrame:
    """Share of rows at or over each of ``points`` thresholds on [0, 1], per value of ``by``.

    Scores are counted per grid cell first; the grid is joined with these counts, never with rows.
    """
    cell = F.floor(F.col(p) * points).cast("int")
    c = df.filter(F.col(p).isNotNull()).groupBy(by, cell.alias("k")).agg(F.count("*").alias("n"))
    grid = c.select(by).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points))))
    full = grid.join(c, [by, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    up = Window.partitionBy(by).orderBy(F.desc("k")).rowsBetween(ALL, 0)
    return full.select(by, (F.col("k") / points).alias("threshold"), F.try_divide(F.sum("n").over(up), F.sum("n").over(Window.partitionBy(by))).alias("share"))


def score_histogram(df: DataFrame, p: str, by: list[str], bins: int = 30) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    c = df.filter(F.col(p).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    return c.withColumn("density", F.col("n") * bins / F.sum("n").over(Window.partitionBy(*by)))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation from sums; null where a side is constant."""
    x, y = F.col(a), F.col(b)
    s = df.filter(x.isNotNull() & y.isNotNull()).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * y).alias("xy"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.avg(F.abs(x - y)).alias("mae"), F.avg((x - y) * (x - y)).alias("mse"))
    return s.select("n", F.try_divide(F.col("xy") - F.col("mx") * F.col("my"), F.sqrt(F.col("vx") * F.col("vy"))).alias("pearson"), "mae", "mse")


def summary_ci(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, range and the mean's 95 % interval per cell; one row per cell has no deviation."""
    half = 1.96 * F.col("sd") / F.sqrt("n")
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    s = s.withColumn("sd", F.when(F.col("n") > 1, F.col("sd")))
    return s.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)
