"""Fits of a few parameters over aggregated scores: the rows stay on the executors, counts per rounded score reach the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.scores import EPS, platt, temperature

#: Scores are rounded to so many digits for fits: at most 10^DIGITS + 1 counts per label leave the executors.
DIGITS = 5


@dataclass(frozen=True)
class Fit:
    method: str
    params: dict[str, float]

    def apply(self, p):
        return platt(p, self.params["a"], self.params["b"]) if self.method == "platt" else temperature(p, self.params["T"])


def score_table(df: DataFrame, y: str, p: str, by: list[str] = ()) -> list:
    rows = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by, F.round(p, DIGITS).alias("p"), F.col(y).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()


def _arrays(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.clip(np.array([r["p"] for r in rows], float), EPS, 1 - EPS)
    return np.log(p / (1 - p)), np.array([r["y"] for r in rows], float), np.array([r["n"] for r in rows], float)


def fit_platt(rows, ridge: float = 1e-6) -> Fit:
    """Logistic regression on the logit by Newton steps, with a negligible ridge on the slope."""
    x, y, n = _arrays(rows)
    a, b = 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([np.sum(n * (y - q) * x) - ridge * a, np.sum(n * (y - q))])
        w = n * q * (1 - q)
        h = np.array([[np.sum(w * x * x) + ridge, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-12]])
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        step = np.clip(step, -5, 5)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-10:
            break
    return Fit("platt", {"a": float(a), "b": float(b)})


def _loss(t: float, x, y, n) -> float:
    z = np.clip(x / t, -40, 40)
    return float(np.sum(n * (np.logaddexp(0, z) - y * z)) / max(1.0, n.sum()))


def fit_temperature(rows, low: float = 0.05, high: float = 20.0) -> Fit:
    """The temperature of least log-loss, by golden section on its logarithm."""
    x, y, n = _arrays(rows)
    g = (math.sqrt(5) - 1) / 2
    a, b = math.log(low), math.log(high)
    for _ in range(120):
        c, d = b - g * (b - a), a + g * (b - a)
        if _loss(math.exp(c), x, y, n) < _loss(math.exp(d), x, y, n):
            b = d
        else:
            a = c
    return Fit("temperature", {"T": float(math.exp((a + b) / 2))})


FITS = {"platt": fit_platt, "temperature": fit_temperature}


def crossfit(df: DataFrame, y: str, p: str, fold: str = "fold", methods: tuple[str, ...] = ("platt", "temperature")) -> tuple[DataFrame, str, Fit, dict[str, tuple[float, float]]]:
    """Out-of-fold calibrated scores of the winning method, its name, its fit on all rows, and (Brier, log-loss) per method.

    One aggregation gives the score counts of all folds; every fit leaves one fold out. The winner has the least mean
    Brier score over folds, then log-loss, then comes first.
    """
    rows = score_table(df, y, p, [fold])
    ks = sorted({r[fold] for r in rows})
    fits, loss = {}, {}
    for m in methods:
        per_fold = []
        for k in ks:
            f = fits[m, k] = FITS[m]([r for r in rows if r[fold] != k])
            x, t, n = _arrays([r for r in rows if r[fold] == k])
            q = 1 / (1 + np.exp(-np.clip(f.params["a"] * x + f.params["b"] if m == "platt" else x / f.params["T"], -40, 40)))
            q = np.clip(q, EPS, 1 - EPS)
            per_fold.append((np.sum(n * (q - t) ** 2) / n.sum(), -np.sum(n * (t * np.log(q) + (1 - t) * np.log(1 - q))) / n.sum()))
        loss[m] = tuple(float(v) for v in np.mean(per_fold, axis=0))
    winner = min(methods, key=lambda m: (*loss[m], methods.index(m)))
    out = F.lit(None).cast("double")
    for k in ks:
        out = F.when(F.col(fold) == k, fits[winner, k].apply(p)).otherwise(out)
    return df.withColumn("prob_calibrated_oof", out), winner, FITS[winner](rows), loss
