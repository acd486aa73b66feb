"""Names of organizations: one name per id out of several years, populations, cleaning and transfer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import lexicon as L
from tallyweave.functions.text import clean_name, conflict_categories, lexicon_tokens, name_tokens
from tallyweave.operators.relations import pick


def longest_name(df: DataFrame, id_col: str, name_col: str, year_col: str) -> DataFrame:
    """Per id the row of longest trimmed name, latest year, first name in order; a null name is shorter than any."""
    n = F.coalesce(F.length(F.trim(name_col)), F.lit(-1))
    return pick(df, [id_col], [-n, -F.coalesce(F.col(year_col), F.lit(-1)), F.coalesce(F.col(name_col), F.lit(""))])


def populations(panel: DataFrame, registry: DataFrame, missions: DataFrame, id_col: str) -> DataFrame:
    """Ids of panel and registry with their population: mission, name_only or registry_only."""
    p = panel.select(id_col).distinct().withColumn("in_panel", F.lit(True))
    r = registry.select(id_col).distinct().withColumn("in_registry", F.lit(True))
    m = missions.select(id_col).distinct().withColumn("has_mission", F.lit(True))
    j = p.join(r, id_col, "full_outer").join(m, id_col, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.select(id_col, F.when(yes("in_panel") & yes("has_mission"), "mission").when(yes("in_panel"), "name_only").otherwise("registry_only").alias("population"), yes("in_registry").alias("in_registry"))


def external_flags(registry: DataFrame, code_col: str, foundation_col: str) -> DataFrame:
    """``is_ntee_x``, ``is_church_foundation`` (numeric code 10) and either of them; codes that are no numbers are not 10."""
    x = F.coalesce(F.upper(F.trim(F.col(code_col))).startswith("X"), F.lit(False))
    c = F.coalesce(F.expr(f"try_cast(trim(`{foundation_col}`) as double)") == 10, F.lit(False))
    return registry.withColumn("is_ntee_x", x).withColumn("is_church_foundation", c).withColumn("is_flagged", x | c)


def flag_stratum(x: str = "is_ntee_x", c: str = "is_church_foundation") -> Column:
    return F.when(F.col(x) & F.col(c), "both_external_flags").when(F.col(x), "ntee_x_only").when(F.col(c), "church_foundation_only").otherwise("neither_external_flag")


def cleaned(df: DataFrame, name_col: str, suffixes=L.SUFFIXES) -> DataFrame:
    """Names with and without legal suffix; rows whose cleaned name is blank are left out."""
    return df.withColumn("name_cleaned", clean_name(name_col, suffixes=suffixes)).withColumn("name_with_suffix", clean_name(name_col, strip_suffix=False)).filter("name_cleaned != ''")


def token_loss(df: DataFrame, raw_col: str, clean_col: str, words=L.RELIGIOUS) -> DataFrame:
    """Rows whose cleaned name lost a lexicon token or an acronym of the raw one."""
    lost = F.array_except(lexicon_tokens(raw_col, words), F.transform(name_tokens(clean_col), F.lower))
    acronyms = F.array_except(F.array_intersect(F.transform(name_tokens(raw_col), F.upper), F.array(*map(F.lit, L.ACRONYMS))), name_tokens(clean_col))
    return df.withColumn("lost_tokens", lost).withColumn("lost_acronyms", acronyms).filter((F.size("lost_tokens") > 0) | (F.size("lost_acronyms") > 0))


def token_difference(df: DataFrame, a_col: str, b_col: str, words=L.STRONG) -> DataFrame:
    """Lexicon tokens that only one of two names has, and which name adds them; rows without a difference are left out."""
    a, b = lexicon_tokens(a_col, words), lexicon_tokens(b_col, words)
    out = df.withColumn("a_only", F.array_except(a, b)).withColumn("b_only", F.array_except(b, a)).filter((F.size("a_only") > 0) | (F.size("b_only") > 0))
    return out.withColumn("direction", F.when((F.size("a_only") > 0) & (F.size("b_only") > 0), "both_names_add_token").when(F.size("b_only") > 0, "second_name_adds_token").otherwise("first_name_adds_token"))


def with_conflicts(df: DataFrame, name_col: str) -> DataFrame:
    return df.withColumn("conflict_categories", conflict_categories(name_col, ~F.col("is_ntee_x") & ~F.col("is_church_foundation")))


def variants(df: DataFrame, id_col: str) -> DataFrame:
    """Two rows per id: the name without and with its legal suffix."""
    v = F.array(F.struct(F.lit("suffix_stripped").alias("input_variant"), F.col("name_cleaned").alias("text")), F.struct(F.lit("suffix_retaining").alias("input_variant"), F.col("name_with_suffix").alias("text")))
    return df.select(id_col, F.explode(v).alias("v")).select(id_col, "v.*")


def top_k_matched(df: DataFrame, p: str, id_col: str, by: str, baseline: str) -> DataFrame:
    """``predicted`` is 1 for as many highest scores per ``by`` as the baseline column has positives there; ties by id.

    The cut score comes from counts per score; rows are ranked among equal scores only.
    """
    c = df.groupBy(by, F.col(p).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(baseline).cast("long")).alias("b"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = F.sum("b").over(Window.partitionBy(by))
    cut = c.select(by, "s", above.alias("above"), k.alias("k"), "n")
    # Only the score at which k is passed is ranked; all others lie wholly above or below it.
    split = (F.col("above") < F.col("k")) & (F.col("above") + F.col("n") > F.col("k"))
    j = df.join(cut, (df[by] == cut[by]) & (df[p] == cut["s"])).drop(cut[by]).drop("s").withColumn("__split", split)
    whole = j.filter("not __split").withColumn("predicted", (F.col("above") < F.col("k")).cast("int"))
    place = F.row_number().over(Window.partitionBy(by, p).orderBy(id_col))
    some = j.filter("__split").withColumn("predicted", (F.col("above") + place <= F.col("k")).cast("int"))
    return whole.unionByName(some).drop("above", "k", "n", "__split")


def base_rate_shift(df: DataFrame, p: str, by: list[str], threshold: float) -> DataFrame:
    """Positive rate per population and variant, and its ratio to the overall rate of the variant."""
    r = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(p) >= threshold).cast("double")).alias("rate"))
    w = Window.partitionBy(by[-1])
    return r.withColumn("ratio", F.try_divide(F.col("rate"), F.try_divide(F.sum(F.col("rate") * F.col("n")).over(w), F.sum("n").over(w))))


def construct_offset(df: DataFrame, flag: str, human: str) -> DataFrame:
    d = df.filter(F.col(flag).isNotNull() & F.col(human).isNotNull())
    return d.agg(F.count("*").alias("n"), (F.avg(F.col(flag).cast("double")) - F.avg(F.col(human).cast("double"))).alias("offset"))


def weighted_accuracy(df: DataFrame, y: str, pred: str, prob: str) -> DataFrame:
    w = 1 / F.col(prob)
    return df.agg(F.count("*").alias("n"), F.try_divide(F.sum(w * (F.col(y) == F.col(pred)).cast("double")), F.sum(w)).alias("weighted_accuracy"))
