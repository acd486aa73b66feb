"""Samples whose cells match target shares, with floors for small cells and a report of what cannot be met.

Systematic unequal-probability sampling: the units of a draw are ordered by cell and, inside a cell,
at random; inclusion probabilities are summed along this order, and a unit is drawn where the sum
passes an integer counted from one random start. Sums are whole millionths, so no rounding can lose
or double a unit. Floors are repaired afterwards: a cell with fewer drawn units than its floor takes the next ones of its
random order. As the order is random and the cell then holds its floor in every draw, each of its units has the
probability floor / units.

A cell that falls short leaves its part of the draw open; other cells keep their own targets and don't take it over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.ids import nine_digits, priority

MICRO = 1_000_000
#: Blocks of a cell's random order: a cell's ranks are counted per block and put together by prefix sums.
BLOCKS = 1024


def clean_cell(col) -> F.Column:
    """Group or tier in one spelling: trimmed, upper case; blank is null."""
    c = F.upper(F.trim(col))
    return F.when(c != "", c)


def units(df: DataFrame, ein_col: str = "EIN2", group_col: str = "ntee_major_group", tier_col: str = "tier") -> DataFrame:
    """Distinct ``ein, cell_group, cell_tier``; rows without an organization, group or tier are no units.

    An organization that stands in several cells is a unit of each.
    """
    cells = df.select(nine_digits(ein_col).alias("ein"), clean_cell(F.col(group_col)).alias("cell_group"), clean_cell(F.col(tier_col)).alias("cell_tier"))
    return cells.dropna().distinct()


def needs(frame: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with ``available`` units, ``need`` (the larger of min_rows and share x size, to the nearest whole number) and ``met``."""
    have = frame.groupBy("cell_group", "cell_tier").agg(F.count("*").alias("available"))
    wanted = targets.select("target_id", "draw_id", clean_cell(F.col("ntee_major_group")).alias("cell_group"), clean_cell(F.col("tier")).alias("cell_tier"), "target_share", "min_rows", "draw_size")
    out = wanted.join(have, ["cell_group", "cell_tier"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    out = out.withColumn("need", F.greatest(F.col("min_rows").cast("long"), F.round(F.col("target_share") * F.col("draw_size")).cast("long")))
    return out.withColumn("met", F.col("available") >= F.col("need"))


def draw(frame: DataFrame, targets: DataFrame, seed: int = 23) -> DataFrame:
    """``draw_id, ein, cell_group, cell_tier, inclusion_prob, how``: the sample of each draw.

    ``how`` is systematic or floor. A cell with fewer units than its share is taken whole; its floor
    is its number of units then. Cells not named in a draw are not drawn from; an empty frame or an
    empty target table gives an empty sample.
    """
    key = ["draw_id", "cell_group", "cell_tier"]
    plan = needs(frame, targets).filter("available > 0")
    expected = F.least(F.round(F.col("target_share") * MICRO).cast("long") * F.col("draw_size"), F.col("available") * MICRO)
    along = Window.partitionBy("draw_id").orderBy("cell_group", "cell_tier", "target_id").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("e", expected).withColumn("offset", F.coalesce(F.sum("e").over(along), F.lit(0)) + priority(seed, F.col("draw_id")) % MICRO)
    plan = plan.select(*key, "available", "min_rows", "e", "offset")
    order = priority(seed, F.col("draw_id"), F.col("ein"))
    rows = frame.join(F.broadcast(plan), ["cell_group", "cell_tier"]).withColumn("order", order).withColumn("block", F.expr(f"cast(order div {(1 << 60) // BLOCKS} as int)"))
    sizes = rows.groupBy(*key, "block").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key, "block").orderBy("order", "ein")))
    rows = rows.join(sizes, [*key, "block"]).withColumn("rank", F.col("before") + F.col("place"))
    reach = lambda r: F.floor(F.expr(f"cast(cast({r} as decimal(19,0)) * cast(e as decimal(18,0)) as decimal(37,0)) div cast(available as decimal(19,0))")) + F.col("offset")
    rows = rows.withColumn("crossed", F.floor(reach("rank") / MICRO) > F.floor(reach("rank - 1") / MICRO))
    size = F.greatest(F.col("e") / MICRO, F.least(F.col("min_rows").cast("long"), F.col("available")).cast("double"))
    rows = rows.withColumn("inclusion_prob", size / F.col("available"))
    drawn = rows.filter("crossed").select(*key, "ein", "inclusion_prob", F.lit("systematic").alias("how"))
    # A cell below its floor has fewer than min_rows drawn units, so twice min_rows ranks hold enough others.
    low = rows.filter(F.col("rank") <= 2 * F.col("min_rows"))
    got = rows.groupBy(*key).agg(F.count_if("crossed").alias("drawn"))
    spare = low.filter("not crossed").join(F.broadcast(got), key).withColumn("spare", F.row_number().over(Window.partitionBy(*key).orderBy("rank")))
    floor = spare.filter("spare <= least(min_rows, available) - drawn").select(*key, "ein", "inclusion_prob", F.lit("floor").alias("how"))
    return drawn.unionByName(floor)


def report(frame: DataFrame, targets: DataFrame, sample: DataFrame) -> DataFrame:
    """needs() with the rows drawn per target and their share of the draw. ``met`` is judged by the sample: a target is not met
    if the draw took all units of its cell, or there are none, and they are fewer than its need."""
    key = ["draw_id", "cell_group", "cell_tier"]
    got = sample.groupBy(*key).agg(F.count("*").alias("drawn"))
    out = needs(frame, targets).join(got, key, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    out = out.withColumn("met", (F.col("drawn") >= F.col("need")) | (F.col("drawn") < F.col("available")))
    return out.withColumn("drawn_share", F.try_divide(F.col("drawn"), F.sum("drawn").over(Window.partitionBy("draw_id"))))
