"""From scores and few human labels to population shares. Estimators need first and second moments only, so each is one
aggregation and a formula over its single row (or one row per group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.lexicon import GROUPS
from tallyweave.functions.scores import clip01, rogan_gladen, rogan_gladen_variance, z_value

W = "__w"


def _weighted(df: DataFrame, w: str | None) -> DataFrame:
    return df.withColumn(W, F.col(w).cast("double") if w else F.lit(1.0))


def _wmean(x: Column) -> Column:
    return F.try_divide(F.sum(F.when(x.isNotNull(), F.col(W) * x)), F.sum(F.when(x.isNotNull(), F.col(W))))


def corpus_moments(df: DataFrame, p: str, w: str | None = None, by: list[str] = ()) -> DataFrame:
    """Rows, weighted mean and variance of the scores; w: how many rows a distinct text stands for."""
    x = F.col(p)
    m = _weighted(df.filter(x.isNotNull()), w).groupBy(*by).agg(F.sum(W).alias("n_corpus"), _wmean(x).alias("mean_p"), _wmean(x * x).alias("sq"))
    return m.select(*by, "n_corpus", "mean_p", F.greatest(F.col("sq") - F.col("mean_p") * F.col("mean_p"), F.lit(0.0)).alias("var_p"))


def anchor_moments(df: DataFrame, y: str, p: str, w: str | None = None, by: list[str] = ()) -> DataFrame:
    """Weighted moments of labels and scores on the labelled rows, with the effective sample size."""
    x, t = F.col(p), F.col(y).cast("double")
    m = _weighted(df.filter(x.isNotNull() & t.isNotNull()), w).groupBy(*by).agg(
        F.count("*").alias("n_anchor"), F.try_divide(F.sum(W) * F.sum(W), F.sum(F.col(W) * F.col(W))).alias("n_eff"),
        _wmean(t).alias("my"), _wmean(x).alias("mx"), _wmean(t * x).alias("yx"), _wmean(x * x).alias("xx"), _wmean(t * t).alias("yy"),
    )
    pos = lambda c: F.greatest(c, F.lit(0.0))
    return m.select(*by, "n_anchor", "n_eff", F.col("my").alias("mean_y"), F.col("mx").alias("mean_x"), (F.col("yx") - F.col("my") * F.col("mx")).alias("cov"), pos(F.col("xx") - F.col("mx") * F.col("mx")).alias("var_x"), pos(F.col("yy") - F.col("my") * F.col("my")).alias("var_y"))


def ppi(anchor: DataFrame, corpus: DataFrame, y: str, p: str, *, anchor_weight: str | None = None, corpus_weight: str | None = None, by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Prediction-powered mean with the tuned weight of the predictions, per group if asked.

    estimate = lambda x mean(corpus scores) + mean(label - lambda x score); lambda = cov / ((1 + n/N) var) in [0, 1]; the interval is normal, cut to [0, 1].
    Groups without labelled rows have no row.
    """
    a = anchor_moments(anchor, y, p, anchor_weight, list(by))
    c = corpus_moments(corpus, p, corpus_weight, list(by))
    j = a.join(c, list(by)) if by else a.crossJoin(c)
    n, big = F.col("n_eff"), F.col("n_corpus")
    lam = F.coalesce(clip01(F.try_divide(F.col("cov"), (1 + n / big) * F.col("var_x"))), F.lit(0.0))
    j = j.withColumn("lam", lam).withColumn("estimate", F.col("lam") * F.col("mean_p") + F.col("mean_y") - F.col("lam") * F.col("mean_x"))
    var = F.col("lam") * F.col("lam") * F.col("var_p") / big + F.greatest(F.col("var_y") - 2 * F.col("lam") * F.col("cov") + F.col("lam") * F.col("lam") * F.col("var_x"), F.lit(0.0)) / n
    j = j.withColumn("variance", var)
    z = z_value(alpha)
    half = z * F.sqrt("variance")
    return j.select(*by, "n_anchor", "n_corpus", F.col("lam").alias("tuning"), clip01(F.col("estimate")).alias("estimate"), "variance", clip01(F.col("estimate") - half).alias("ci_lower"), clip01(F.col("estimate") + half).alias("ci_upper"))


def rule_share(df: DataFrame, label: str, se: float | None, n_se: float, sp: float | None, n_sp: float, w: str | None = None, by: list[str] = ()) -> DataFrame:
    """Share of positive rule labels corrected for the rule's errors; uncorrected where sensitivity or specificity is unknown."""
    d = _weighted(df.filter(F.col(label).isNotNull()), w).groupBy(*by).agg(F.sum(W).alias("n"), _wmean(F.col(label).cast("double")).alias("observed"))
    if se is None or sp is None:
        return d.select(*by, "n", "observed", F.col("observed").alias("estimate"), (F.col("observed") * (1 - F.col("observed")) / F.col("n")).alias("variance"), F.lit(False).alias("corrected"))
    s, q = F.lit(float(se)), F.lit(float(sp))
    return d.select(*by, "n", "observed", rogan_gladen(F.col("observed"), s, q).alias("estimate"), rogan_gladen_variance(F.col("observed"), F.col("n"), s, F.lit(float(n_se)), q, F.lit(float(n_sp))).alias("variance"), F.lit(True).alias("corrected"))


def composite(parts: DataFrame, by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Parts (estimate, variance, n) to one estimate weighted by their shares of n."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*(list(by) or [F.lit(0)])))
    s = parts.withColumn("share", share).groupBy(*by).agg(F.sum(F.col("share") * F.col("estimate")).alias("estimate"), F.sum(F.col("share") * F.col("share") * F.col("variance")).alias("variance"), F.sum("n").alias("n"))
    half = z_value(alpha) * F.sqrt("variance")
    return s.select(*by, "n", "estimate", "variance", clip01(F.col("estimate") - half).alias("ci_lower"), clip01(F.col("estimate") + half).alias("ci_upper"))


def variance_from_ci(low: Column, high: Column, alpha: float = 0.05) -> Column:
    half = (high - low) / (2 * z_value(alpha))
    return half * half


def sensitivity_band(observed: float, se: tuple[float, float], sp: tuple[float, float]) -> tuple[float, float] | None:
    """Smallest and largest corrected share over the corners of both intervals that carry information."""
    got = [min(1.0, max(0.0, (observed + q - 1) / (s + q - 1))) for s in se for q in sp if s + q > 1]
    return (min(got), max(got)) if got else None


def emq(corpus: DataFrame, p: str, prior: float, w: str | None = None, rounds: int = 1000, tolerance: float = 1e-6, digits: int = 6) -> tuple[float, int]:
    """Share of positives under a shifted prior, by expectation-maximisation over score counts (scores rounded to ``digits``).

    At most 10^digits + 1 counts reach the driver, however many rows there are. Returns the share and the rounds.
    """
    import numpy as np

    d = _weighted(corpus.filter(F.col(p).isNotNull()), w).groupBy(F.round(p, digits).alias("p")).agg(F.sum(W).alias("n")).collect()
    if not d:
        return prior, 0
    x, n = np.array([r["p"] for r in d], float), np.array([r["n"] for r in d], float)
    prior = min(max(prior, 1e-9), 1 - 1e-9)
    share = prior
    for k in range(1, rounds + 1):
        up, down = x * share / prior, (1 - x) * (1 - share) / (1 - prior)
        new = float((n * np.divide(up, up + down, out=np.zeros_like(up), where=up + down > 0)).sum() / n.sum())
        if abs(new - share) < tolerance:
            return new, k
        share = min(max(new, 1e-9), 1 - 1e-9)
    return share, rounds


def kdey(corpus: DataFrame, labelled: DataFrame, y: str, p: str, bandwidth: float = 0.05, cells: int = 200) -> float:
    """Share of positives whose mixture of the two classes' score densities is nearest to the corpus density (Hellinger), on a grid."""
    import numpy as np

    cell = F.least(F.floor(F.col(p) * cells), F.lit(cells - 1)).cast("int").alias("k")

    def histogram(df: DataFrame) -> np.ndarray:
        h = np.zeros(cells)
        for r in df.filter(F.col(p).isNotNull()).groupBy(cell).agg(F.count("*").alias("n")).collect():
            h[r["k"]] = r["n"]
        return h

    at = (np.arange(cells) + 0.5) / cells
    kernel = np.exp(-((at[:, None] - at[None, :]) ** 2) / (2 * bandwidth**2))
    smooth = lambda h: (d := kernel @ h + 1e-12) / d.sum()
    q = smooth(histogram(corpus))
    pos, neg = (smooth(histogram(labelled.filter(F.col(y) == v))) for v in (1, 0))
    shares = np.linspace(0, 1, 1001)
    fit = [np.sqrt(q * (s * pos + (1 - s) * neg)).sum() for s in shares]
    return float(shares[int(np.argmax(fit))])


def group_descriptives(df: DataFrame, group: str, p: str, labels: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """All known groups with rows, scored rows, mean score and positives per label column; unknown groups raise an error."""
    names = names or GROUPS
    spark = df.sparkSession
    table = spark.createDataFrame(sorted(names.items()), "grp string, label string")
    agg = df.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"), F.count(p).alias("n_scored"), F.avg(p).alias("mean_p"), *[F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in labels])
    strange = agg.join(F.broadcast(table), "grp", "left_anti").limit(5).collect()
    if strange:
        raise ValueError(f"unknown groups {[r['grp'] for r in strange]}")
    out = table.join(F.broadcast(agg), "grp", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_scored", *[f"n_{c}" for c in labels])]
    shares = [F.try_divide(F.col(f"n_{c}"), F.col("n")).alias(f"share_{c}") for c in labels]
    return out.select(F.col("grp").alias(group), "label", *zero, "mean_p").select("*", *shares)


def prevalence_by_group(anchor: DataFrame, corpus: DataFrame, y: str, p: str, group: str, min_n: int = 10, **kw) -> DataFrame:
    """ppi() per group of the corpus; groups with fewer than min_n labelled rows are kept but not estimated."""
    est = ppi(anchor, corpus, y, p, by=[group], **kw)
    n = anchor.filter(F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("__n"))
    every = corpus.select(group).distinct().join(n, group, "left").withColumn("n_anchor", F.coalesce("__n", F.lit(0))).drop("__n")
    j = every.join(est.drop("n_anchor"), group, "left").withColumn("suppressed", F.col("n_anchor") < min_n)
    keep = lambda c: F.when(~F.col("suppressed"), F.col(c)).alias(c)
    return j.select(group, "n_anchor", F.when(F.col("suppressed"), "not estimated").otherwise("ppi").alias("estimator"), keep("estimate"), keep("ci_lower"), keep("ci_upper"), "suppressed")


def fold_missing_group(group: Column | str) -> Column:
    """The missing group ``?`` as ``Z``, for reports only."""
    g = F.col(group) if isinstance(group, str) else group
    return F.when(g == "?", "Z").otherwise(g)
