"""Mixing sources to target weights with a budget of tokens and a limit of repetitions.

Shares are tempered: a source's weight is its token share to the power of an exponent, normalised. An
exponent of 1 keeps the natural shares, 0 makes all sources equal. The exponent is bisected so that the tempered
shares have the entropy of the targets; where these would repeat a source beyond its limit, it is bisected on towards the natural
shares until none is. A source whose limit allows its target gets the target; what short sources leave open is
spread by the tempered shares. The budgets are realised as block permutations, and whether a source falls
short is read from the documents that were used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.ids import priority
from tallyweave.llm.tokenizer import count_tokens
from tallyweave.session import written

#: Blocks of a source's permutation; a block is sorted in one task.
BLOCKS = 4096


def source_name(col) -> F.Column:
    """A source in one spelling: lower case, words joined by underscores; blank is null."""
    c = F.regexp_replace(F.regexp_replace(F.lower(col), r"^[\s ]+|[\s ]+$", ""), r"[\s \-]+", "_")
    return F.when(c != "", c)


def tempered(tokens: list[float], exponent: float) -> list[float]:
    """Normalised token shares to the power of an exponent; sources without tokens have no weight."""
    top = max(tokens, default=0)
    powers = [(t / top) ** exponent if t > 0 else 0.0 for t in tokens]
    return [p / (sum(powers) or 1.0) for p in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect(rising, low: float, high: float, steps: int = 80) -> float:
    """Where a rising condition turns true between low and high (high if it never does)."""
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if rising(middle) else (middle, high)
    return high


def entropy_exponent(tokens: list[float], weights: list[float]) -> float:
    """The exponent in [0, 8] whose tempered shares have the entropy of ``weights``, or the nearest end."""
    goal = entropy([w / (sum(weights) or 1.0) for w in weights])
    return bisect(lambda e: entropy(tempered(tokens, e)) <= goal, 0.0, 8.0)


def plan_mix(rows: list[dict], budget: int) -> list[dict]:
    """Tokens to give per source. rows: source, target_weight, max_repeats, tokens.

    A source asks for target_weight x budget and gets it unless max_repeats x tokens is less: it then gives all it has.
    What is left open goes to the sources with room, by tempered shares of the targets' entropy if these overfill none,
    else of the nearest exponent towards 1 that overfills none; where 1 does too, the overfilled sources
    give all they have and the rest is spread again.
    """
    out = [r | {"capacity": r["max_repeats"] * r["tokens"], "asked": r["target_weight"] * budget} for r in rows]
    for r in out:
        r["given"] = float(min(r["capacity"], r["asked"]))
        r["spread_exponent"] = None
    sizes = [float(r["tokens"]) for r in out]
    exponent = entropy_exponent(sizes, [r["target_weight"] for r in out])
    wanted = min(float(budget), sum(r["asked"] for r in out))
    while True:
        open_ = wanted - sum(r["given"] for r in out)
        room = [r for r in out if r["capacity"] - r["given"] > 1e-6]
        if open_ <= 1e-6 or not room:
            break
        of = [float(r["tokens"]) for r in room]
        fits = lambda e: all(open_ * w <= r["capacity"] - r["given"] for w, r in zip(tempered(of, e), room, strict=True))  # noqa: B023, E731
        # along the way from the entropy's exponent to the natural shares
        chosen = exponent + (1 - exponent) * (0.0 if fits(exponent) else bisect(lambda v: fits(exponent + (1 - exponent) * v), 0.0, 1.0))  # noqa: B023
        for w, r in zip(tempered(of, chosen), room, strict=True):
            r["given"] = min(float(r["capacity"]), r["given"] + open_ * w)
            r["spread_exponent"] = chosen
    for r in out:
        r["entropy_exponent"] = exponent
    return out


def token_table(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str | None = None) -> DataFrame:
    """``doc, source, n_tokens`` of every document, written once; sources in one spelling, null where they have none."""
    rows = docs.select(F.col(id_col).alias("doc"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    return written(count_tokens(rows, ["doc", "source"], "text", path), "mix-tokens")


PLAN = "mix_id int, source string, target_weight double, max_repeats int, budget_tokens long, tokens long, capacity long, asked double, given long, entropy_exponent double, spread_exponent double"


def plan(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: the source's tokens, what it asks, what it gives, and the exponents.

    A target source without documents has 0 tokens. The target table is as small as
    the number of sources named in it, so it is planned on the driver over one sum per source; an
    empty target table gives an empty plan. Null target sources are kept as sources without documents.
    """
    spark = targets.sparkSession
    wanted = targets.select("mix_id", "source", "target_weight", "max_repeats", "budget_tokens", source_name(F.col("source")).alias("__s"))
    names = wanted.select(F.col("__s").alias("source")).distinct()
    sums = tokens.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = [r.asDict() for r in wanted.join(sums.withColumnRenamed("source", "__s"), "__s", "left").orderBy("mix_id", "source").collect()]
    planned = []
    for mix in sorted({r["mix_id"] for r in rows}):
        own = [r | {"tokens": r["tokens"] or 0} for r in rows if r["mix_id"] == mix]
        for r in plan_mix(own, own[0]["budget_tokens"]):
            planned.append((r["mix_id"], r["source"], r["target_weight"], r["max_repeats"], r["budget_tokens"], r["tokens"], r["capacity"], float(r["asked"]), int(r["given"] + 1e-6), r["entropy_exponent"], r["spread_exponent"]))
    return spark.createDataFrame(planned, PLAN)


def realise(tokens: DataFrame, planned: DataFrame, seed: int = 7, blocks: int = BLOCKS) -> DataFrame:
    """``mix_id, source, doc, n_tokens, repeats, block``: the documents of each mix and how often each is used.

    A source's documents are in a seeded permutation, cut into blocks. Whole passes use every
    document once; the last pass takes documents in order while the source's tokens last, found by
    prefix sums over the blocks and then inside the one block that is cut. A document longer than
    what is left is where its source stops, so each source stays below its tokens by less than one document.
    Documents without tokens are left out.
    """
    small = planned.filter("tokens > 0 and given > 0").select("mix_id", source_name(F.col("source")).alias("source"), "max_repeats", (F.expr("given div tokens")).alias("passes"), F.expr("given % tokens").alias("rest"))
    rows = tokens.filter("n_tokens > 0").join(F.broadcast(small), "source")
    order = priority(seed, F.col("mix_id"), F.col("doc"))
    rows = rows.withColumn("order", order).withColumn("block", F.expr(f"cast(order div {(1 << 60) // blocks} as int)"))
    key = ["mix_id", "source"]
    sums = rows.groupBy(*key, "block").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    before = F.sum("t").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    cut = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    edge = F.broadcast(cut.filter("before <= rest and before + t > rest").select(*key, F.col("block").alias("edge"), "before"))
    rows = rows.join(edge, key, "left").withColumn("edge", F.coalesce("edge", F.lit(blocks)))
    inside = F.sum("n_tokens").over(Window.partitionBy(*key, "block").orderBy("order", "doc").rowsBetween(Window.unboundedPreceding, 0))
    cutting = rows.filter("block = edge").withColumn("upto", inside + F.col("before"))
    last = F.when(F.col("block") < F.col("edge"), 1).when(F.col("block") == F.col("edge"), F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).otherwise(0)
    both = rows.filter("block != edge").withColumn("upto", F.lit(None).cast("long")).unionByName(cutting)
    used = both.withColumn("repeats", (F.col("passes") + last).cast("int")).filter("repeats > 0")
    return used.select("mix_id", "source", "doc", "n_tokens", "repeats", "block")


def actual(planned: DataFrame, mixed: DataFrame) -> DataFrame:
    """The plan with each source's actual tokens and its actual share of the mix, and ``falls_short``: whether the mix used all
    its documents max_repeats times and still holds less than it asks. A source without documents falls short."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.max("repeats").alias("most_repeats"))
    full = planned.withColumn("__s", source_name(F.col("source"))).join(F.broadcast(got.withColumnRenamed("source", "__s")), ["mix_id", "__s"], "left").drop("__s")
    full = full.withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0))).withColumn("most_repeats", F.coalesce("most_repeats", F.lit(0)))
    full = full.withColumn("falls_short", (F.col("actual_tokens") >= F.col("capacity")) & (F.col("actual_tokens") < F.col("asked")))
    return full.withColumn("actual_share", F.try_divide(F.col("actual_tokens"), F.sum("actual_tokens").over(Window.partitionBy("mix_id"))))
