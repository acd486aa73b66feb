"""Training runs: the frame, arms of it, out-of-fold scores and a matrix of runs that can be taken up again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators import metrics, ml, sampling
from tallyweave.operators.votes import vote_share
from tallyweave.plans.gating import assert_disjoint, assert_probabilities
from tallyweave.session import delete, exists


def training_frame(votes: DataFrame, consensus: DataFrame, texts: DataFrame, held_out: DataFrame) -> DataFrame:
    """``EIN2, text, p_pos, hard_label``: records with a consensus label, their vote share and text.

    A labelled record that is also held out is an error, not a row left out: the labels must have been frozen without it. Records without a text or a
    label are left out; texts must be one per record.
    """
    labelled = consensus.filter("label is not null").select("EIN2", F.col("label").alias("hard_label"))
    assert_disjoint(labelled, held_out, "EIN2", "training and held-out records")
    share = vote_share(votes, "EIN2", "label").select("EIN2", "p_pos")
    return labelled.join(share, "EIN2").join(texts.select("EIN2", "text"), "EIN2").select("EIN2", "text", "p_pos", "hard_label")


def arm(frame: DataFrame, name: str, scores: DataFrame | None = None) -> DataFrame:
    """The frame as one arm trains on it, with ``label`` and ``weight``.

    hard: the consensus label. soft: each row twice, weighted by its vote share. class_weighted: balanced weights. pruned: without the
    label issues inside the disputed band, by out-of-fold scores (``EIN2, p1``); where a row has none, all rows are judged by their vote share.
    """
    if name == "soft":
        return ml.soft_targets(frame, "p_pos")
    hard = frame.withColumn("label", F.col("hard_label").cast("double"))
    if name == "hard":
        return hard.withColumn("weight", F.lit(1.0))
    if name == "class_weighted":
        return ml.class_weights(hard, "hard_label").withColumnRenamed("class_weight", "weight")
    if name != "pruned":
        raise ValueError(f"unknown arm {name!r}")
    if scores is not None:
        hard = hard.join(scores.select("EIN2", F.col("p1").alias("__p")), "EIN2", "left")
    else:
        hard = hard.withColumn("__p", F.lit(None).cast("double"))
    gaps = hard.agg(F.count_if(F.col("__p").isNull()).alias("__gaps"))
    hard = hard.crossJoin(F.broadcast(gaps)).withColumn("__p", F.when(F.col("__gaps") > 0, F.col("p_pos")).otherwise(F.col("__p")))
    return ml.pruned(hard, "hard_label", "__p", "p_pos").withColumn("weight", F.lit(1.0)).drop("__p", "__gaps")


def one_text_per_id(frames: list[DataFrame], id_col: str = "EIN2", text_col: str = "text") -> DataFrame:
    """The distinct ids of several frames with their text; an id with different texts is an error."""
    out = frames[0].select(id_col, text_col)
    for f in frames[1:]:
        out = out.unionByName(f.select(id_col, text_col))
    per = out.groupBy(id_col).agg(F.min(text_col).alias(text_col), (F.count_distinct(text_col) + F.max(F.col(text_col).isNull().cast("int"))).alias("__n"))
    bad = per.filter("__n > 1").limit(20).collect()
    if bad:
        raise ValueError(f"different texts of {id_col} {sorted(str(r[id_col]) for r in bad)}")
    return per.drop("__n")


def resumed_out_of_fold(df: DataFrame, fit, score, path: str, id_col: str = "EIN2", fold: str = "fold") -> DataFrame:
    """``id, fold, p0, p1`` of every row, scored by a model that has not seen its fold. Each fold is a table of its own under ``path``; a run that goes on
    after a failure keeps the folds that are complete: the same ids, and probabilities that add up to 1."""
    spark = df.sparkSession
    parts = []
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        held = df.filter(F.col(fold) == k)
        at = f"{path}/fold={k}"
        if not _complete(spark, at, held, id_col):
            delete(spark, at)
            out = score(fit(df.filter(F.col(fold) != k)), held)
            out.select(F.col(id_col), (1 - F.col("prob_raw")).alias("p0"), F.col("prob_raw").alias("p1")).write.parquet(at)
            assert_probabilities(spark.read.parquet(at), "p1", "p0")
        parts.append(spark.read.parquet(at).withColumn(fold, F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(id_col, fold, "p0", "p1")


def _complete(spark, at: str, held: DataFrame, id_col: str) -> bool:
    if not exists(spark, f"{at}/_SUCCESS"):
        return False
    got = spark.read.parquet(at)
    if set(got.columns) != {id_col, "p0", "p1"}:
        return False
    key = lambda d, n: d.groupBy(F.col(id_col).alias("k")).agg(F.count("*").alias(n))
    j = key(got, "a").join(key(held, "b"), "k", "full_outer").filter("a is null or b is null or a != b").limit(1).count()
    bad = got.filter(~F.coalesce(F.col("p1").between(0, 1) & (F.abs(F.col("p0") + F.col("p1") - 1) <= 1e-6), F.lit(False))).limit(1).count()
    return not j and not bad


@dataclass(frozen=True)
class Run:
    """One training run of the matrix."""

    phase: str
    model: str
    arm: str
    fraction: float
    seed: int

    @property
    def run_id(self) -> str:
        return f"{self.phase}-{self.model}-{self.arm}-{self.fraction:g}-{self.seed}"


def run_matrix(models: list[str], arms: list[str], fractions: list[float], seeds: list[int], seed: int = 42, best: dict | None = None, final_seeds: list[int] = ()) -> list[Run]:
    """The runs in their order: a learning curve of every model, every arm of the first model over all seeds, the other models with soft targets, and the
    final runs of the best cell once it is known. Equal runs come once; fractions must be in (0, 1]."""
    if bad := [f for f in fractions if not 0 < f <= 1]:
        raise ValueError(f"fractions must be in (0, 1]: {bad}")
    out = [Run("curve", m, "soft", f, seed) for m in models for f in fractions]
    out += [Run("sweep", models[0], a, 1.0, s) for a in arms for s in seeds]
    out += [Run("sweep", m, "soft", 1.0, s) for m in models[1:] for s in seeds]
    if best:
        out += [Run("final", best["model"], best["arm"], 1.0, s) for s in final_seeds]
    return list(dict.fromkeys(out))


RESULT = "run_id string, phase string, model string, arm string, fraction double, seed int, metric double"


def execute(spark, runs: list[Run], run: Callable[[Run], float], path: str) -> DataFrame:
    """The result rows of all runs; those whose result stands under ``path`` are not run again. Each result is written when its run ends, so a failed
    matrix goes on where it stopped. Runs are as few as the matrix has cells."""
    frames = []
    for r in runs:
        at = f"{path}/{hashlib.sha256(json.dumps(asdict(r), sort_keys=True).encode()).hexdigest()[:24]}"
        if not exists(spark, f"{at}/_SUCCESS"):
            delete(spark, at)
            row = (r.run_id, r.phase, r.model, r.arm, float(r.fraction), r.seed, float(run(r)))
            spark.createDataFrame([row], RESULT).coalesce(1).write.json(at)
        frames.append(at)
    return spark.read.schema(RESULT).json(frames) if frames else spark.createDataFrame([], RESULT)


def documentation_curve(results: DataFrame, by: list[str] = ("model", "fraction"), value: str = "metric") -> DataFrame:
    """Mean, least, greatest and number of runs per model and share of the training rows."""
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))


def train_text_model(frame: DataFrame, run: Run, scores: DataFrame | None = None, dev_fraction: float = 0.15, **kw) -> float:
    """A run of the text model: average precision on the development rows that the seed sets aside, trained on the run's share of the others."""
    split = sampling.dev_split(frame, "hard_label", "EIN2", dev_fraction, run.seed)
    train = split.filter("not is_dev").drop("is_dev")
    if run.fraction < 1:
        train = sampling.nested_subset(train, "hard_label", "EIN2", run.fraction, run.seed)
    rows = arm(train, run.arm, scores)
    total = rows.agg(F.sum("weight")).first()[0] or 1.0
    model = ml.fit_stages(ml.tfidf_pipeline("label", weight="weight", reg=ml.penalty(total), **kw), ml.with_terms(rows, "text"), "label", "weight")
    got = ml.score_tfidf(model, split.filter("is_dev"), "text")
    return metrics.average_precision(got, "hard_label", "prob_raw").first()[0] or 0.0
