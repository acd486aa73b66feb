"""Keys, duplicates, set checks and the join back from distinct texts to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.text import text_key


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    found = duplicates(df, keys).limit(20).collect()
    if found:
        raise ValueError(f"keys {keys} repeat: {[tuple(r[k] for k in keys) for r in found]}")
    return df


def pick(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order: a partial maximum per task, then one shuffle of the winners.

    The order must be total. Rows are compared as structs, so no sort of a group is needed and a hot key is reduced before the shuffle.
    """
    cols = [F.col(c) for c in df.columns]
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    best = F.min_by(F.struct(*cols), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("__r")
    return df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(named)]).agg(best).select("__r.*")


def dedup_first(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The row of smallest id per text; null and the empty text are two texts."""
    return pick(df, [text_key(text_col)], [F.col(id_col)])


def dedup_last(df: DataFrame, keys: list[str], time_col: str, *ties: str) -> DataFrame:
    """The latest row per key; rows without a time come first, ties are broken by the other columns."""
    stamp = F.coalesce(F.unix_micros(F.col(time_col)), F.lit(-(1 << 62)))
    return pick(df, list(keys), [-stamp, *[F.coalesce(F.col(t).cast("string"), F.lit("")) for t in ties]])


def text_multiplicity(df: DataFrame, text_col: str) -> DataFrame:
    """Rows per text, with the null text as one of them."""
    return df.groupBy(text_key(text_col).alias("text_key")).agg(F.count("*").alias("n_rows"))


def expand_back(raw: DataFrame, predictions: DataFrame, text_col: str, id_col: str, columns: list[str]) -> DataFrame:
    """Every raw row with the prediction of its text. Predictions must have one row per text and miss none; a text with several or
    without any fails the job that reads the result, in which this is checked as rows pass, so predictions are worked out once."""
    keyed = predictions.groupBy(text_key(text_col).alias("__k")).agg(F.count("*").alias("__n"), F.first(F.struct(*columns)).alias("__p"))
    rows = raw.withColumn("__k", text_key(text_col)).drop(*columns).join(keyed, "__k", "left")
    one = F.when(F.col("__n").isNull(), F.raise_error(F.lit("a row has no prediction of its text"))).when(F.col("__n") > 1, F.raise_error(F.lit("a text has several predictions"))).otherwise(F.col("__p"))
    return rows.withColumn("__p", one).select(*[c for c in raw.columns if c not in columns], *[F.col(f"__p.{c}").alias(c) for c in columns])


def completeness(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct keys of both sides, keys missing on the right and keys too many there."""
    a, b = left.groupBy(key).agg(F.count("*").alias("na")), right.groupBy(key).agg(F.count("*").alias("nb"))
    both = a.join(b, a[key].eqNullSafe(b[key]), "full_outer")
    return both.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("n_left"), F.coalesce(F.sum("nb"), F.lit(0)).alias("n_right"),
        F.count_if(F.col("nb").isNull()).alias("n_missing"), F.count_if(F.col("na").isNull()).alias("n_extra"),
        F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("n_repeated"),
    )


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys on both sides."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def varying_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key the number of different values of each field, null counted as a value; only keys where some field varies."""
    n = [F.count_distinct(F.struct(f)).alias(f"n_{f}") for f in fields]
    return df.groupBy(key).agg(*n).filter(F.greatest(*[F.col(f"n_{f}") for f in fields]) > 1 if len(fields) > 1 else F.col(f"n_{fields[0]}") > 1)


def cumulative(df: DataFrame, value: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """Running total before each row, 0 for the first; for reports of few rows per ``by``."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("total_before", F.coalesce(F.sum(value).over(w), F.lit(0)))
