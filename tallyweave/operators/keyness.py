"""Which terms set two groups of texts apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.text import ngrams, tokens

# A short English stop list for reports.
STOPWORDS = tuple("a an and are as at be by for from has have in is it its of on or our that the their this to we were will with".split())


def term_counts(df: DataFrame, text_col: str, positive_weight: Column, low: int = 1, high: int = 1, stopwords=STOPWORDS) -> DataFrame:
    """Per n-gram: weighted counts in the positive and the negative group and its document frequency.

    A row's terms are sorted, so the first of equal terms stands for the document; the shuffle
    carries partial sums per term only. Null texts have no terms.
    """
    grams = ngrams(tokens(text_col, stopwords), low, high)
    rows = df.filter(F.col(text_col).isNotNull()).select(positive_weight.cast("double").alias("w"), F.array_sort(grams).alias("g"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("g", F.lit(1), F.greatest(F.size("g") - 1, F.lit(0))))
    each = rows.filter(F.size("g") > 0).select("w", F.explode(F.zip_with("g", before, lambda x, y: F.struct(x.alias("term"), (~x.eqNullSafe(y)).alias("first")))).alias("e")).select("w", "e.*")
    return each.groupBy("term").agg(F.sum("w").alias("positive_count"), F.sum(1 - F.col("w")).alias("negative_count"), F.count_if("first").alias("document_frequency"))


def keyness(counts: DataFrame, min_df: int = 1) -> DataFrame:
    """z of the weighted log-odds with the pooled counts as prior, log2 of the smoothed rate ratio, and naive log-odds."""
    c = counts.filter(F.col("document_frequency") >= min_df).withColumn("total_count", F.col("positive_count") + F.col("negative_count"))
    t = c.agg(F.sum("positive_count").alias("pt"), F.sum("negative_count").alias("nt"), F.count("*").alias("v"))
    j = c.crossJoin(F.broadcast(t))
    p, n, pt, nt, v = (F.col(k) for k in ("positive_count", "negative_count", "pt", "nt", "v"))
    a = (p + n) * v / (pt + nt)
    odds = lambda x, xt: F.log((x + a) / (xt + v - x - a))
    z = (odds(p, pt) - odds(n, nt)) / F.sqrt(1 / (p + a) + 1 / (n + a))
    ratio = F.log2(((p + 0.5) / (pt + 0.5 * v)) / ((n + 0.5) / (nt + 0.5 * v)))
    naive = F.log((p + 1) / (pt + v)) - F.log((n + 1) / (nt + v))
    return j.select("term", z.alias("z_score"), ratio.alias("log2_rate_ratio"), naive.alias("log_odds"), "positive_count", "negative_count", "total_count", "document_frequency", F.try_divide(p, pt).alias("positive_rate"), F.try_divide(n, nt).alias("negative_rate"))


def top_terms(scored: DataFrame, k: int = 10, by: str = "z_score") -> DataFrame:
    """The k highest and k lowest terms; ties by term. A top-k report, so k bounds the result."""
    up = scored.orderBy(F.desc(by), "term").limit(k).withColumn("side", F.lit("positive"))
    down = scored.orderBy(F.asc(by), "term").limit(k).withColumn("side", F.lit("negative"))
    return up.unionByName(down)


def top_absolute(scored: DataFrame, k: int = 20, by: str = "z_score") -> DataFrame:
    return scored.orderBy(F.desc(F.abs(by)), "term").limit(k)


def sensitivity(scores: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """The z-scores, under every label definition, of all terms that are among the top or bottom k under any."""
    named = [s.select("term", "z_score").withColumn("definition", F.lit(d)) for d, s in scores.items()]
    long = named[0]
    for n in named[1:]:
        long = long.unionByName(n)
    tops = None
    for s in scores.values():
        t = top_terms(s, k).select("term")
        tops = t if tops is None else tops.union(t)
    return long.join(tops.distinct(), "term", "left_semi").groupBy("term").pivot("definition", list(scores)).agg(F.first("z_score"))
