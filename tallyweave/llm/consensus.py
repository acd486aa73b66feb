"""Consensus of annotators who disagree: labels, agreement and reliabilities from one latent model.

An annotator j has a skill a_j and a leaning b_j, an item i an ease e_i > 0 and a hidden label z_i = +1
or -1. The annotator says +1 with probability sigmoid(b_j + a_j e_i z_i). Gradient expectation-
maximisation learns all of them together: posteriors of the labels and ascent steps on the eases
inside each item, then one ascent step per annotator on the sums over all items. Skills may be
negative (an annotator who is mostly wrong is evidence for the contrary).

Items enter as patterns: which annotators voted how. Equal patterns are one row with a count, so an
iteration costs as much as there are different patterns, and all that leaves the executors is
one row of sums per annotator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.ids import standard_ein
from tallyweave.session import written

#: Label words after lower-casing and removing all but letters.
WORDS = {"religious": 1, "nonreligious": 0, "notreligious": 0}


@dataclass(frozen=True)
class Settings:
    rounds: int = 40
    inner: int = 8
    tolerance: float = 1e-4
    #: Spread of the prior of log ease; 0 makes all items equally easy.
    ease_sd: float = 0.1
    #: Priors of skill and leaning: mean and spread.
    skill_mean: float = 1.5
    skill_sd: float = 2.0
    lean_sd: float = 2.0


def votes(df: DataFrame, ein_col: str = "EIN2", model_col: str = "model_id", prompt_col: str = "prompt_id", label_col: str = "binary_label", error_col: str = "error") -> DataFrame:
    """``item, annotator, yes, cast``: one row per organization and annotator.

    Failed runs, abstentions and rows without an organization, model or prompt are no votes. However
    often an annotator's vote on an item was delivered or run again, it is one vote; where the runs
    disagree, ``yes`` is the share of +1. The partial sums are taken before the shuffle, so a control item with
    a third of all rows arrives as a few rows per task.
    """
    votes_of = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    vote = F.transform(F.array(F.regexp_replace(F.lower(label_col), "[^a-z]", "")), lambda w: votes_of[w])[0]
    rows = df.filter(F.col(error_col).isNull()).select(
        standard_ein(ein_col).alias("item"), F.when(F.col(model_col).isNotNull() & F.col(prompt_col).isNotNull(), F.concat_ws("__", model_col, prompt_col)).alias("annotator"), vote.alias("v")
    ).dropna()
    return rows.groupBy("item", "annotator").agg((F.sum("v") / F.count("*")).alias("yes"), F.count("*").alias("cast"))


def items(voted: DataFrame, annotators: list[str]) -> DataFrame:
    """``item, who array<int>, said array<double>``: the votes on each item, by the annotators' numbers."""
    number = F.create_map(*[F.lit(x) for kv in enumerate(annotators) for x in kv[::-1]])
    pairs = F.sort_array(F.collect_list(F.struct(number[F.col("annotator")].alias("k"), "yes")))
    return voted.groupBy("item").agg(pairs.alias("p")).select("item", F.col("p.k").alias("who"), F.col("p.yes").alias("said"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _log_sigmoid(x: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0.0, -x)


def infer(who: np.ndarray, said: np.ndarray, ends: np.ndarray, skill: np.ndarray, lean: np.ndarray, prior: float, s: Settings) -> tuple[np.ndarray, ...]:
    """(posterior of +1, ease, log likelihood) of items, given the annotators. Items are who[ends[i]:ends[i+1]], none empty."""
    at, starts = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), ends[:-1]
    a, b = skill[who], lean[who]
    total = lambda x: np.add.reduceat(x, starts)
    log_ease = np.zeros(len(starts))
    for k in range(s.inner + 1):
        ease = np.exp(log_ease)
        plus, minus = b + a * ease[at], b - a * ease[at]
        lp = total(said * _log_sigmoid(plus) + (1 - said) * _log_sigmoid(-plus)) + np.log(prior)
        lm = total(said * _log_sigmoid(minus) + (1 - said) * _log_sigmoid(-minus)) + np.log1p(-prior)
        posterior = _sigmoid(lp - lm)
        if k == s.inner or not s.ease_sd:
            break
        # Ascent on log ease, scaled by the expected curvature; the prior keeps it bounded.
        sp, sm = _sigmoid(plus), _sigmoid(minus)
        r = posterior[at]
        slope = total(a * ease[at] * (r * (said - sp) - (1 - r) * (said - sm))) - log_ease / s.ease_sd**2
        curve = total((a * ease[at]) ** 2 * (r * sp * (1 - sp) + (1 - r) * sm * (1 - sm))) + 1 / s.ease_sd**2
        log_ease = np.clip(log_ease + slope / curve, -3, 3)
    return posterior, np.exp(log_ease), np.logaddexp(lp, lm)


SUMS = "k int, n double, ga double, gb double, haa double, hab double, hbb double, ey double, ny double, em double, nm double"


def _pass(batches: Iterator[pa.RecordBatch], skill, lean, prior: float, s: Settings) -> Iterator[pa.RecordBatch]:
    """Sums over a partition's patterns: per annotator slopes, curvatures and expected confusion; at k = -1 the label mass."""
    n_annotators = len(skill)
    out = np.zeros((n_annotators + 1, 10))
    for batch in batches:
        if not batch.num_rows:
            continue
        who, said, ends = batch.column("who"), batch.column("said"), batch.column("who").offsets.to_numpy()
        flat, yes = who.flatten().to_numpy(), said.flatten().to_numpy()
        ends = ends - ends[0]
        times = batch.column("times").to_numpy().astype(float)
        posterior, ease, fit = infer(flat, yes, ends, skill, lean, prior, s)
        at = np.repeat(np.arange(len(times)), np.diff(ends))
        r, w, e = posterior[at], times[at], ease[at]
        sp, sm = _sigmoid(lean[flat] + skill[flat] * e), _sigmoid(lean[flat] - skill[flat] * e)
        up, um = r * (yes - sp), (1 - r) * (yes - sm)
        cp, cm = r * sp * (1 - sp), (1 - r) * sm * (1 - sm)
        for c, x in enumerate((np.ones(len(w)), e * (up - um), up + um, e * e * (cp + cm), e * (cp - cm), cp + cm, r * yes, r, (1 - r) * (1 - yes), 1 - r)):
            out[:-1, c] += np.bincount(flat, w * x, n_annotators)
        out[-1, :3] += times.sum(), (times * posterior).sum(), (times * fit).sum()
    ks = np.r_[np.arange(n_annotators), -1].astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(ks), *(pa.array(out[:, c]) for c in range(10))], names=[f.split(" ")[0] for f in SUMS.split(", ")])


@dataclass(frozen=True)
class Model:
    annotators: list[str]
    skill: np.ndarray
    lean: np.ndarray
    prior: float
    sums: np.ndarray
    rounds: int


def fit(voted_items: DataFrame, annotators: list[str], settings: Settings = Settings()) -> Model:
    """Learns the model from items(); stops when no annotator moves by more than the tolerance."""
    patterns = written(voted_items.groupBy("who", "said").agg(F.count("*").alias("times")), "consensus-patterns")
    skill, lean, prior = np.full(len(annotators), settings.skill_mean), np.zeros(len(annotators)), 0.5
    sums, done = np.zeros((len(annotators), 10)), 0
    for done in range(1, settings.rounds + 1):
        one = lambda b, a=skill, l=lean, p=prior: _pass(b, a, l, p, settings)  # noqa: E731, E741
        cols = [f.split(" ")[0] for f in SUMS.split(", ")[1:]]
        got = patterns.mapInArrow(one, SUMS).groupBy("k").agg(*[F.sum(c).alias(c) for c in cols]).collect()
        by = {r["k"]: np.array([r[c] for c in cols]) for r in got}
        if -1 not in by or not by[-1][0]:
            break
        sums = np.array([by[k] for k in range(len(annotators))])
        _, ga, gb, haa, hab, hbb = sums.T[:6]
        ga, gb = ga - (skill - settings.skill_mean) / settings.skill_sd**2, gb - lean / settings.lean_sd**2
        haa, hbb = haa + 1 / settings.skill_sd**2, hbb + 1 / settings.lean_sd**2
        det = np.maximum(haa * hbb - hab * hab, 1e-9)
        da, db = np.clip((hbb * ga - hab * gb) / det, -1, 1), np.clip((haa * gb - hab * ga) / det, -1, 1)
        skill, lean = skill + da, lean + db
        new = float(np.clip((by[-1][1] + 1) / (by[-1][0] + 2), 1e-6, 1 - 1e-6))
        moved = max(float(np.abs(np.r_[da, db]).max()), abs(new - prior))
        prior = new
        if moved < settings.tolerance:
            break
    return Model(annotators, skill, lean, prior, sums, done)


def _label_rows(voted_items: DataFrame, m: Model, settings: Settings) -> DataFrame:
    skill, lean, prior = m.skill, m.lean, m.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            who, said, ends = batch.column("who"), batch.column("said"), batch.column("who").offsets.to_numpy()
            ends = ends - ends[0]
            yes = said.flatten().to_numpy()
            posterior, ease, _ = infer(who.flatten().to_numpy(), yes, ends, skill, lean, prior, settings)
            n, up = np.diff(ends), np.add.reduceat(yes, ends[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(posterior), pa.array(1 / ease), pa.array(n.astype(np.int64)), pa.array(up)], names=["item", "posterior", "difficulty", "n_votes", "yes_votes"])

    return voted_items.select("item", "who", "said").mapInArrow(run, "item string, posterior double, difficulty double, n_votes long, yes_votes double")


@dataclass(frozen=True)
class Consensus:
    labels: DataFrame
    annotators: DataFrame


def consensus(df: DataFrame, settings: Settings = Settings(), **columns: str) -> Consensus:
    """Labels per organization and reliabilities per annotator.

    labels: ``EIN2`` (standard spelling), ``label`` (1 if the posterior is over one half), ``posterior``,
    ``difficulty``, ``n_votes``, ``agreement`` (share of votes for the label) and ``kappa`` (agreement of the item's votes
    in pairs beyond chance; null for one vote). annotators: ``annotator, n_votes, skill, leaning,
    sensitivity, specificity, reliability`` (the mean of the two). Organizations without a vote have no row; an empty table gives two
    empty ones.
    """
    spark = df.sparkSession
    voted = written(votes(df, **columns), "consensus-votes")
    # As many rows as there are annotators: models x prompts.
    names = [r["annotator"] for r in voted.select("annotator").distinct().orderBy("annotator").collect()]
    if not names:
        return Consensus(spark.createDataFrame([], "EIN2 string, label int, posterior double, difficulty double, n_votes long, agreement double, kappa double"), spark.createDataFrame([], ANNOTATORS))
    by_item = written(items(voted, names), "consensus-items")
    m = fit(by_item, names, settings)
    rate = float(voted.agg(F.avg("yes")).first()[0])
    chance = rate**2 + (1 - rate) ** 2
    n, y = F.col("n_votes"), F.col("yes_votes")
    observed = F.try_divide(y * (y - 1) + (n - y) * (n - y - 1), n * (n - 1))
    label = (F.col("posterior") > 0.5).cast("int")
    labels = _label_rows(by_item, m, settings).select(
        F.col("item").alias("EIN2"), label.alias("label"), "posterior", "difficulty", "n_votes",
        F.when(F.col("posterior") > 0.5, y / n).otherwise(1 - y / n).alias("agreement"),
        F.when(n > 1, F.lit(1.0) if chance >= 1 else (observed - chance) / (1 - chance)).alias("kappa"),
    )
    rows = []
    for name, a, b, x in zip(m.annotators, m.skill, m.lean, m.sums, strict=True):
        sensitivity, specificity = float(x[6] / x[7]) if x[7] else None, float(x[8] / x[9]) if x[9] else None
        both = [v for v in (sensitivity, specificity) if v is not None]
        rows.append((name, int(round(x[0])), float(a), float(b), sensitivity, specificity, float(sum(both) / len(both)) if both else None))
    return Consensus(labels, spark.createDataFrame(rows, ANNOTATORS))


ANNOTATORS = "annotator string, n_votes long, skill double, leaning double, sensitivity double, specificity double, reliability double"
