"""Stratified samples with known inclusion probabilities.

Order inside a stratum is a seeded hash of the key, so a sample is the same in every run and
partitioning. The n lowest keys of a stratum are found in two steps: counts per block of the hash give the block
in which the n-th key lies, and only that block is ranked; no stratum is ever sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.ids import priority

BLOCKS = 1024


def seeded_priority(seed: int, col: Column | str) -> Column:
    return priority(seed, F.col(col) if isinstance(col, str) else col)


def ranked(df: DataFrame, strata: list[str], id_col: str, seed: int, blocks: int = BLOCKS) -> DataFrame:
    """df with ``priority``, ``rank`` in its stratum (from 1) and ``stratum_size``; ids must be distinct per stratum."""
    keys = strata or ["__all"]
    df = df if strata else df.withColumn("__all", F.lit(0))
    rows = df.withColumn("priority", seeded_priority(seed, id_col)).withColumn("__b", F.expr(f"cast(priority div {(1 << 60) // blocks} as int)"))
    sizes = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__b", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("stratum_size"))
    place = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("priority", id_col))
    rows = rows.withColumn("__p", place)
    # eqNullSafe join, so that a null stratum keeps its rows
    s = sizes.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col("__b").alias("__sb"), "__before", "stratum_size")
    cond = rows["__b"] == s["__sb"]
    for k in keys:
        cond = cond & rows[k].eqNullSafe(s[f"__s_{k}"])
    out = rows.join(s, cond).withColumn("rank", F.col("__p") + F.col("__before"))
    return out.drop("__b", "__sb", "__before", "__p", "__all", *[f"__s_{k}" for k in keys])


def take(df: DataFrame, strata: list[str], id_col: str, n: int | DataFrame, seed: int) -> DataFrame:
    """The n lowest keys per stratum with ``inclusion_prob``; n may be a table of strata and ``n``."""
    r = ranked(df, strata, id_col, seed)
    if isinstance(n, int):
        r = r.withColumn("n", F.lit(n))
    else:
        r = r.join(F.broadcast(n), strata)
    return r.filter(F.col("rank") <= F.col("n")).withColumn("inclusion_prob", F.least(F.col("n").cast("long"), F.col("stratum_size")) / F.col("stratum_size")).drop("n")


# Allocation: arithmetic over as many numbers as there are strata, on the driver.


def largest_remainder(weights: dict[str, float], lower: dict[str, int], capacity: dict[str, int], total: int) -> dict[str, int]:
    """Whole numbers near the weights' shares of the total, between lower bounds and capacities; ties by name."""
    if total > sum(capacity.values()):
        raise ValueError("the total exceeds the capacity")
    given = dict(lower)
    while (left := total - sum(given.values())) > 0:
        room = {k: capacity[k] - given[k] for k in given if capacity[k] > given[k] and weights[k] > 0}
        if not room:
            raise ValueError("no stratum has capacity left")
        scale = left / sum(weights[k] for k in room)
        ideal = {k: weights[k] * scale for k in room}
        whole = {k: min(math.floor(ideal[k]), room[k]) for k in room}
        for k, v in whole.items():
            given[k] += v
        left = total - sum(given.values())
        for k in sorted(room, key=lambda k: (-(ideal[k] - math.floor(ideal[k])), k)):
            if left > 0 and given[k] < capacity[k]:
                given[k] += 1
                left -= 1
    if sum(given.values()) != total:
        raise ValueError("lower bounds exceed the total")
    return given


def proportional(pool: dict[str, int], total: int, floors: set[str] = frozenset(), caps: set[str] = frozenset(), floor_size: int = 200, cap_size: int = 2500) -> dict[str, int]:
    """Proportional targets with caps and floors for named strata; what these leave goes to the other strata in proportion."""
    n = sum(pool.values())
    out = {k: round(v / n * total) for k, v in sorted(pool.items())} if n else dict.fromkeys(pool, 0)
    for k in out:
        if k in caps:
            out[k] = min(out[k], cap_size)
        if k in floors:
            out[k] = min(max(out[k], floor_size), pool[k])
    free = [k for k in out if k not in floors and k not in caps]
    open_ = total - sum(out.values())
    if open_ and free and (mass := sum(pool[k] for k in free)):
        for k in free:
            out[k] = max(0, out[k] + round(open_ * pool[k] / mass))
        out[max(free, key=lambda k: out[k])] += total - sum(out.values())
    return {k: max(0, min(v, pool[k])) for k, v in out.items()}


def _counts(df: DataFrame, cols: list[str]) -> dict:
    """Rows per stratum; strata are few (groups x tiers)."""
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]: r["n"] for r in df.groupBy(*cols).agg(F.count("*").alias("n")).collect()}


def silver_pool(df: DataFrame, id_col: str, group_col: str, tier_col: str, positive: Column, total: int, seed: int = 7, positive_share: float = 0.35, **bounds) -> DataFrame:
    """A training pool from HIGH and MEDIUM rows of lettered groups, enriched with likely positives.

    Each group's target is proportional (see ``proportional``); inside a group floor(share x n) come
    from the positive cell and the rest from the other, either filling up for the other's lack.
    """
    frame = df.filter(F.col(tier_col).isin("HIGH", "MEDIUM") & F.col(group_col).rlike("^[A-Z]$")).withColumn("is_positive_enriched", F.coalesce(positive, F.lit(False)))
    cells = _counts(frame, [group_col, "is_positive_enriched"])
    pool = {}
    for (g, _), n in cells.items():
        pool[g] = pool.get(g, 0) + n
    rows = []
    for g, n in proportional(pool, min(total, sum(pool.values())), **bounds).items():
        has_pos, has_neg = cells.get((g, True), 0), cells.get((g, False), 0)
        pos = min(math.floor(positive_share * n), has_pos)
        neg = min(n - pos, has_neg)
        pos = min(n - neg, has_pos)
        rows += [(g, True, pos), (g, False, neg)]
    n = df.sparkSession.createDataFrame(rows, f"{group_col} string, is_positive_enriched boolean, n int")
    return take(frame, [group_col, "is_positive_enriched"], id_col, n, seed)


def gold_set(df: DataFrame, id_col: str, group_col: str, boundary: Column, positive: Column, per_group: int, seed: int = 13) -> DataFrame:
    """Equal numbers per group, from disjoint cells: boundary cases (.35, rounded up), likely positives and others
    (.25 each, rounded down, one at least), then a filler from the group's remaining rows."""
    cell = F.when(boundary, "boundary").when(positive, "positive").otherwise("negative")
    frame = df.withColumn("cell", cell)
    quota = {"boundary": max(1, math.ceil(per_group * 0.35)), "positive": max(1, math.floor(per_group * 0.25)), "negative": max(1, math.floor(per_group * 0.25))}
    r = ranked(frame, [group_col, "cell"], id_col, seed)
    limit = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])[F.col("cell")]
    r = r.withColumn("first_pass", F.col("rank") <= limit).withColumn("quota_cell_rate", F.least(limit.cast("long"), F.col("stratum_size")) / F.col("stratum_size")).drop("rank", "priority", "stratum_size")
    order = ranked(r.withColumn("__k", F.concat(F.when(F.col("first_pass"), "0").otherwise("1"), F.lit(":"), F.col(id_col).cast("string"))), [group_col, "first_pass"], "__k", seed + 1)
    firsts = order.filter("first_pass").groupBy(F.col(group_col).alias("__g")).agg(F.count("*").alias("__have"))
    out = order.join(F.broadcast(firsts), order[group_col].eqNullSafe(F.col("__g")), "left").filter(F.col("first_pass") | (F.col("rank") <= per_group - F.coalesce("__have", F.lit(0))))
    return out.drop("__k", "__g", "__have", "rank", "priority", "stratum_size")


def human_splits(df: DataFrame, id_col: str, group_col: str, prompt_dev: int, monitor: int, seed: int = 17) -> DataFrame:
    """``split`` per row: prompt_dev and monitor rows per group first, the rest in turn to validation and test."""
    r = ranked(df, [group_col], id_col, seed)
    k = F.col("rank")
    return r.withColumn("split", F.when(k <= prompt_dev, "prompt_dev").when(k <= prompt_dev + monitor, "monitor").when((k - prompt_dev - monitor) % 2 == 1, "validation").otherwise("test")).drop("rank", "priority", "stratum_size")


def anchor_sample(df: DataFrame, id_col: str, tier_col: str, group_col: str, total: int, low_factor: float = 1.5, min_stratum: int = 1, seed: int = 19) -> DataFrame:
    """Tier x group strata, at least one row of each stratum of min_stratum rows, LOW tiers oversampled; ``sample_prob`` = n_h / N_h."""
    frame = df.withColumn("stratum", F.concat_ws("|", tier_col, group_col))
    cap = _counts(frame, ["stratum"])
    lower = {k: int(n >= min_stratum) for k, n in cap.items()}
    weights = {k: n * (low_factor if k.startswith("LOW|") else 1.0) for k, n in cap.items()}
    given = largest_remainder(weights, lower, cap, min(total, sum(cap.values())))
    n = df.sparkSession.createDataFrame(list(given.items()), "stratum string, n int")
    return take(frame, ["stratum"], id_col, n, seed).withColumnRenamed("inclusion_prob", "sample_prob")


def nested_subset(df: DataFrame, label_col: str, id_col: str, fraction: float, seed: int = 29) -> DataFrame:
    """The first ceil(n x fraction) rows per label; subsets of smaller fractions are inside larger ones."""
    r = ranked(df, [label_col], id_col, seed)
    return r.filter(F.col("rank") <= F.ceil(F.col("stratum_size") * F.lit(fraction) - 1e-9)).drop("rank", "priority", "stratum_size")


def dev_split(df: DataFrame, label_col: str, id_col: str, fraction: float, seed: int = 31) -> DataFrame:
    """``is_dev``: per label round-half-even(n x fraction) rows, at least one and not all."""
    r = ranked(df, [label_col], id_col, seed)
    n = F.greatest(F.lit(1), F.least(F.bround(F.col("stratum_size") * F.lit(fraction)).cast("long"), F.col("stratum_size") - 1))
    return r.withColumn("is_dev", F.col("rank") <= n).drop("rank", "priority", "stratum_size")


def folds(df: DataFrame, label_col: str, id_col: str, k: int = 5, seed: int = 37) -> DataFrame:
    """``fold`` from 0 to k - 1, balanced inside each label."""
    return ranked(df, [label_col], id_col, seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "priority", "stratum_size")


def design_weights(df: DataFrame, prob_col: str, normalize: bool = True) -> DataFrame:
    """``weight`` = 1 / probability, by default divided by its mean; null, zero and negative probabilities raise an error."""
    bad = df.filter(F.col(prob_col).isNull() | (F.col(prob_col) <= 0)).limit(1).count()
    if bad:
        raise ValueError(f"{prob_col} must be positive")
    out = df.withColumn("weight", 1 / F.col(prob_col))
    if not normalize:
        return out
    mean = df.agg(F.avg(1 / F.col(prob_col)).alias("__m"))
    return out.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("__m")).drop("__m")


def bootstrap_ci(counts: tuple[int, int, int, int], metric, resamples: int = 2000, seed: int = 42, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of a metric of (tp, fp, fn, tn): resampling rows is a multinomial draw of the four cells."""
    import numpy as np

    n = sum(counts)
    if not n:
        return (float("nan"), float("nan"))
    draws = np.random.default_rng(seed).multinomial(n, np.array(counts) / n, size=resamples)
    values = np.array([metric(*d) for d in draws], float)
    return tuple(float(v) for v in np.quantile(values, [(1 - level) / 2, (1 + level) / 2]))


def bootstrap_scores(rows, metric, resamples: int = 2000, seed: int = 42, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of a metric of scored labels, from their counts: rows with ``p, y, n`` (see ``calibrate.score_table``, which bounds their number).

    Resampling rows is a multinomial draw of the counts, so nothing but counts is needed. metric(p, y, n) gets arrays in descending order of p.
    """
    import numpy as np

    rows = sorted(rows, key=lambda r: (-r["p"], r["y"]))
    p, y, n = (np.array([r[c] for r in rows], float) for c in ("p", "y", "n"))
    if not len(rows):
        return (float("nan"), float("nan"))
    rng = np.random.default_rng(seed)
    values = np.array([metric(p, y, rng.multinomial(int(n.sum()), n / n.sum()).astype(float)) for _ in range(resamples)], float)
    return tuple(float(v) for v in np.quantile(values[~np.isnan(values)], [(1 - level) / 2, (1 + level) / 2])) if not np.isnan(values).all() else (float("nan"), float("nan"))


def counted_average_precision(p, y, n) -> float:
    """Average precision of scores in descending order with their counts; equal scores are one step. NaN without positives."""
    import numpy as np

    _, at = np.unique(-p, return_inverse=True)
    pos, every = np.bincount(at, n * y), np.bincount(at, n)
    tp, seen = np.cumsum(pos), np.cumsum(every)
    return float((pos * np.divide(tp, seen, out=np.zeros_like(tp), where=seen > 0)).sum() / tp[-1]) if tp[-1] else float("nan")


def stratified_by_group(df: DataFrame, group_col: str, id_col: str, n: int, seed: int = 43) -> DataFrame:
    """n rows in equal parts per group: the remainder goes to the first groups in order, and no group gives more than it has."""
    groups = sorted(_counts(df.filter(F.col(group_col).isNotNull()), [group_col]))
    if not groups:
        return df.withColumn("inclusion_prob", F.lit(None).cast("double")).limit(0)
    each, extra = divmod(n, len(groups))
    quota = df.sparkSession.createDataFrame([(g, each + int(k < extra)) for k, g in enumerate(groups)], f"{group_col} string, n int")
    return take(df, [group_col], id_col, quota, seed)


def quota_draw(cells: dict[tuple[str, frozenset], int], quotas: dict[str, int], at_least: dict[str, int]) -> dict[tuple[str, frozenset], int]:
    """Rows per (stratum, cues) cell so that each stratum has its quota and each cue at least its number of rows.

    Exact search over the few cells (strata x sets of cues): cells with wanted cues first, going back
    where a quota or a bound cannot be met. Raises an error if nothing fits.
    """
    order = sorted(cells, key=lambda c: (-len([q for q in c[1] if q in at_least]), c[0], sorted(c[1])))
    left_room: list[dict[str, int]] = [{} for _ in range(len(order) + 1)]
    cue_room: list[dict[str, int]] = [{} for _ in range(len(order) + 1)]
    for i in range(len(order) - 1, -1, -1):
        s, cues = order[i]
        left_room[i] = left_room[i + 1] | {s: left_room[i + 1].get(s, 0) + cells[order[i]]}
        cue_room[i] = dict(cue_room[i + 1])
        for q in cues:
            cue_room[i][q] = cue_room[i].get(q, 0) + cells[order[i]]
    out: dict[tuple[str, frozenset], int] = {}
    seen: set = set()

    def go(i: int, quota: dict[str, int], need: dict[str, int]) -> bool:
        if any(v > left_room[i].get(s, 0) for s, v in quota.items()) or any(v > cue_room[i].get(q, 0) for q, v in need.items()):
            return False
        if i == len(order):
            return not any(quota.values()) and not any(v > 0 for v in need.values())
        state = (i, tuple(sorted(quota.items())), tuple(sorted((q, max(0, v)) for q, v in need.items())))
        if state in seen:
            return False
        seen.add(state)
        s, cues = order[i]
        most = min(cells[order[i]], quota.get(s, 0))
        wanted = max((need[q] for q in cues if q in need), default=0)
        options = sorted(range(most + 1), key=lambda k: abs(k - max(0, min(most, wanted if wanted > 0 else most))))
        for k in options:
            if go(i + 1, quota | {s: quota.get(s, 0) - k}, {q: v - (k if q in cues else 0) for q, v in need.items()}):
                out[order[i]] = k
                return True
        return False

    if not go(0, dict(quotas), dict(at_least)):
        raise ValueError("no draw meets all quotas")
    return out
