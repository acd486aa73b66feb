"""Arithmetic of scores, calibration and rates as Column expressions; divisions by zero have defined results."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def z_value(alpha: float = 0.05) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def clip01(x: Column) -> Column:
    """x cut to [0, 1]; null stays null, which the least and greatest of values alone would not keep."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def logit(p: Column | str) -> Column:
    q = F.least(F.greatest(_col(p), F.lit(EPS)), F.lit(1 - EPS))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(p: Column | str, a: float, b: float) -> Column:
    return sigmoid(a * logit(p) + b)


def temperature(p: Column | str, t: float) -> Column:
    return sigmoid(logit(p) / t)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(den == 0, 0.0).otherwise(num / F.when(den == 0, 1).otherwise(den))


def precision_at_base_rate(tpr: Column, fpr: Column, pi: float | Column) -> Column:
    p = F.lit(pi) if isinstance(pi, float) else pi
    return ratio(tpr * p, tpr * p + fpr * (1 - p))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Struct (low, high) of Wilson's interval; null for no trials."""
    p, zz = successes / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.struct(clip01(mid - half).alias("low"), clip01(mid + half).alias("high")))


def rogan_gladen(p: Column, se: Column, sp: Column) -> Column:
    """Share corrected for sensitivity and specificity, in [0, 1]; null if the test carries no information."""
    den = se + sp - 1
    return F.when(den > 0, clip01((p + sp - 1) / F.when(den > 0, den)))


def rogan_gladen_variance(p: Column, n: Column, se: Column, n_se: Column, sp: Column, n_sp: Column) -> Column:
    """Delta-method variance of rogan_gladen from three independent samples."""
    den = F.when(se + sp - 1 > 0, se + sp - 1)
    at = (p + sp - 1) / den
    return (p * (1 - p) / n + at * at * se * (1 - se) / n_se + (1 - at) * (1 - at) * sp * (1 - sp) / n_sp) / (den * den)


def confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, Matthews, balanced accuracy, kappa and nominal alpha from four counts."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    n = tp + fp + fn + tn
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    po = ratio(tp + tn, n)
    pe = ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    pos = ratio(2 * tp + fp + fn, 2 * n)
    de = 2 * pos * (1 - pos)
    return {
        "precision": precision, "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "balanced_accuracy": (recall + specificity) / 2,
        "kappa": F.when(pe == 1, 1.0).otherwise((po - pe) / F.when(pe == 1, 1.0).otherwise(1 - pe)),
        "alpha": F.when(n == 0, F.lit(None)).when(de == 0, F.when(po == 1, 1.0).otherwise(0.0)).otherwise(1 - (1 - po) / F.when(de == 0, 1.0).otherwise(de)),
    }
