"""Text and embedding classifiers with Spark ML, out-of-fold scores, and label noise."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, Normalizer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import ngrams, tokens
from tallyweave.operators import folded
from tallyweave.session import cut_lineage


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """df with ``class_weight`` = n / (classes present x rows of the class); the two counts are all that is gathered."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    w = F.lit(None).cast("double")
    for k, v in n.items():
        w = F.when(F.col(label) == k, total / (len(n) * v)).otherwise(w)
    return df.withColumn("class_weight", w)


def soft_targets(df: DataFrame, p: str) -> DataFrame:
    """Each row twice, labelled 1 with weight p and 0 with weight 1 - p: weighted log-loss on these is soft cross-entropy."""
    both = F.array(F.struct(F.lit(1.0).alias("label"), F.col(p).alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col(p)).alias("weight")))
    return df.withColumn("__t", F.explode(both)).select(*df.columns, "__t.*").filter("weight > 0")


def char_grams(col: Column | str, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside blank-padded words."""
    words = F.transform(tokens(col), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        return F.when(F.length(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*[of(w, n) for n in range(low, high + 1)]))))


def with_terms(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__words", ngrams(tokens(text), 1, 2)).withColumn("__chars", char_grams(text))


class SmoothIdf(Estimator):
    """Term frequencies times ln((1 + n) / (1 + df)) + 1, each row brought to length 1."""

    def __init__(self, inputCol: str, outputCol: str):
        super().__init__()
        self.inputCol, self.outputCol = inputCol, outputCol

    def _fit(self, df: DataFrame) -> PipelineModel:
        idf = IDF(inputCol=self.inputCol, outputCol="__idf").fit(df).idf.toArray() + 1.0
        weighted = f"{self.outputCol}_raw"
        return PipelineModel([ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=self.inputCol, outputCol=weighted), Normalizer(p=2.0, inputCol=weighted, outputCol=self.outputCol)])


def penalty(total_weight: float, c: float = 1.0) -> float:
    """Spark's penalty for the inverse strength c: Spark averages the loss over the rows' weights, others sum it."""
    return 1.0 / (c * max(1.0, total_weight))


def tfidf_pipeline(label: str, weight: str = "class_weight", features: int = 1 << 18, max_iter: int = 2000, reg: float = 1e-4) -> Pipeline:
    """Word and character TF-IDF, each of length 1, and logistic regression on unscaled features."""
    stages = []
    for c in ("words", "chars"):
        stages += [HashingTF(inputCol=f"__{c}", outputCol=f"__tf_{c}", numFeatures=features), SmoothIdf(f"__tf_{c}", f"__x_{c}")]
    # Hash buckets that no training row uses would only lengthen every gradient.
    stages += [VectorAssembler(inputCols=["__x_words", "__x_chars"], outputCol="__all"), VarianceThresholdSelector(featuresCol="__all", outputCol="features", varianceThreshold=0.0), LogisticRegression(labelCol=label, weightCol=weight, maxIter=max_iter, regParam=reg, standardization=False)]
    return Pipeline(stages=stages)


def fit_tfidf(df: DataFrame, text: str, label: str, c: float = 1.0, **kw) -> PipelineModel:
    """Word and character TF-IDF with balanced logistic regression of inverse penalty c."""
    weighted = class_weights(df, label)
    total = weighted.agg(F.sum("class_weight")).first()[0] or 1.0
    return fit_stages(tfidf_pipeline(label, reg=penalty(total, c), **kw), with_terms(weighted, text), label, "class_weight")


def fit_stages(pipeline: Pipeline, df: DataFrame, label: str, weight: str) -> PipelineModel:
    """Fits a pipeline whose last stage is the classifier. The features are written out before it, as each of its iterations would work them out anew."""
    *front, last = pipeline.getStages()
    made = Pipeline(stages=front).fit(df)
    x = cut_lineage(made.transform(df).select("features", label, weight))
    return PipelineModel([*made.stages, last.fit(x)])


def score_tfidf(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    out = model.transform(with_terms(df, text))
    return out.withColumn("prob_raw", vector_to_array("probability")[1]).select(*df.columns, "prob_raw")


class TextFit:
    """``fit_tfidf`` as the fit of ``out_of_fold``, which has the models of all folds from one reading of the texts."""

    def __init__(self, text: str, label: str, c: float = 1.0, **kw):
        self.text, self.label, self.c, self.kw = text, label, c, kw

    def __call__(self, train: DataFrame) -> PipelineModel:
        return fit_tfidf(train, self.text, self.label, self.c, **self.kw)

    def scores(self, df: DataFrame, fold: str) -> DataFrame:
        return folded.scores(df, self.text, self.label, fold, self.c, **self.kw)


def fit_embedding(df: DataFrame, vector: str, label: str, c: float = 1.0):
    weighted = class_weights(df, label)
    total = weighted.agg(F.sum("class_weight")).first()[0] or 1.0
    x = weighted.withColumn("features", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    return LogisticRegression(labelCol=label, weightCol="class_weight", regParam=penalty(total, c), maxIter=2000, standardization=False).fit(cut_lineage(x.select("features", label, "class_weight")))


def score_embedding(model, df: DataFrame, vector: str) -> DataFrame:
    out = model.transform(df.withColumn("features", array_to_vector(F.transform(vector, lambda v: v.cast("double")))))
    return out.withColumn("prob_raw", vector_to_array("probability")[1]).select(*df.columns, "prob_raw")


def out_of_fold(df: DataFrame, fit, score, fold: str = "fold") -> DataFrame:
    """Every row scored by a model that has not seen its fold. fit(train) -> model, score(model, rows) -> rows with prob_raw; a fit that has ``scores`` fits and scores all folds itself."""
    if hasattr(fit, "scores"):
        return fit.scores(df, fold)
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        part = score(fit(df.filter(F.col(fold) != k)), df.filter(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def label_issues(df: DataFrame, label: str, p: str) -> DataFrame:
    """``is_issue``: rows whose score for the other class reaches that class's mean self-confidence, and is above their own's."""
    t = df.agg(F.avg(F.when(F.col(label) == 1, F.col(p))).alias("t1"), F.avg(F.when(F.col(label) == 0, 1 - F.col(p))).alias("t0"))
    j = df.crossJoin(F.broadcast(t))
    issue = ((F.col(label) == 0) & (F.col(p) >= F.col("t1")) & (F.col(p) > 0.5)) | ((F.col(label) == 1) & (1 - F.col(p) >= F.col("t0")) & (F.col(p) < 0.5))
    return j.withColumn("is_issue", F.coalesce(issue, F.lit(False))).drop("t1", "t0")


def pruned(df: DataFrame, label: str, p: str, share: str, low: float = 0.34, high: float = 0.66) -> DataFrame:
    """The rows left when label issues inside the open band of disputed vote shares are taken out."""
    return label_issues(df, label, p).filter(~(F.col("is_issue") & (F.col(share) > low) & (F.col(share) < high))).drop("is_issue")


def select_arm(cells: DataFrame, name: str, value: str, order: list[str]) -> DataFrame:
    """One row: the arm kept when arms are compared from the simplest on; a later one wins only by more than the larger deviation.

    ``order`` lists the arms from simplest to most complex; runs per arm are few.
    An arm that is not in it raises an error.
    """
    s = {r[name]: (r["m"], r["sd"] or 0.0, r["n"]) for r in cells.groupBy(name).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n")).collect()}
    if unknown := sorted(str(k) for k in s if k not in order):
        raise ValueError(f"no place in the order for {', '.join(unknown)}")
    best = None
    for k in order:
        if k in s and (best is None or s[k][0] - s[best][0] > max(s[k][1], s[best][1])):
            best = k
    return cells.sparkSession.createDataFrame([(best, *s[best])] if best else [], "arm string, mean double, sd double, n long")


def rank_within(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``place`` in a ranked slate, nulls last; for tables of candidates."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))


def slate(scores: DataFrame, name: str, f1: str, kappa: str, f1_low: str, least: float = 0.7) -> DataFrame:
    """Candidates in ranked order with ``selected``: kappa and the lower bound of F1 at the floor; if none reaches it, the best by F1."""
    ok = (F.col(kappa) >= least) & (F.col(f1_low) >= least)
    placed = rank_within(scores, [], [F.desc_nulls_last(f1), F.desc_nulls_last(kappa), F.asc(name)])
    some = F.max(F.coalesce(ok, F.lit(False))).over(Window.partitionBy(F.lit(0)))
    return placed.withColumn("selected", F.when(some, F.coalesce(ok, F.lit(False))).otherwise(F.col("place") == 1))
