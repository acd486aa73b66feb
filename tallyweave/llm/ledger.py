"""A sample that is the same in every run and keeps its members as data grow.

Selected keys stand in a persisted ledger. At each delivery the ledger's keys stay, found again by a
join, and the growth quota is filled with the unseen keys of lowest hash priority. Priorities depend
on seed and key only, so neither partitioning nor order matters.

Several deliveries are drawn in one pass: counts per priority bucket and delivery show how many keys of each bucket
every delivery takes, and then each bucket hands out its own keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.ids import priority, standard_ein
from tallyweave.session import exists, shared_folder, written

#: Priorities are counted in so many buckets to find the last one that is taken; at most so many rows reach the driver.
BUCKETS = 1 << 14
LEDGER = "key string, priority long, generation int"


def lowest(keys: DataFrame, k: int, buckets: int = BUCKETS) -> DataFrame:
    """The k rows of lowest ``priority`` (then ``key``), exactly, without sorting all rows.

    Counts per priority bucket show the bucket in which the k-th row lies; only that bucket is
    ordered. Fewer rows than k: all. Keys must be distinct.
    """
    if k <= 0:
        return keys.limit(0)
    shift = (1 << 60) // buckets
    bucketed = keys.withColumn("__b", F.expr(f"priority div {shift}"))
    counts = {r["__b"]: r["n"] for r in bucketed.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    taken, edge = 0, None
    for b in sorted(counts):
        if taken + counts[b] > k:
            edge = b
            break
        taken += counts[b]
    if edge is None:
        return keys
    place = F.row_number().over(Window.partitionBy("__b").orderBy("priority", "key"))
    cut = bucketed.filter(F.col("__b") == edge).withColumn("__place", place).filter(F.col("__place") <= k - taken)
    return bucketed.filter(F.col("__b") < edge).drop("__b").unionByName(cut.drop("__b", "__place"))


def quota(n: int, per_mille: int) -> int:
    return -(-n * per_mille // 1000)


def grow(ledger: DataFrame | None, keys: DataFrame, generation: int, per_mille: int = 100, seed: int = 11) -> DataFrame:
    """The keys to add to the ledger now that ``keys`` (column ``key``, distinct) are known.

    The sample shall hold per_mille of all known keys, rounded up. Earlier keys count towards it
    whether or not they are still in the data; null keys are never drawn.
    """
    keys = keys.filter("key is not null").select("key", priority(seed, F.col("key")).alias("priority"))
    held = 0
    unseen = keys
    if ledger is not None:
        held = ledger.count()
        unseen = keys.join(ledger.select("key"), "key", "left_anti")
    want = quota(keys.count(), per_mille) - held
    return lowest(unseen, want).select("key", "priority", F.lit(generation).alias("generation"))


def schedule(sizes: dict[tuple[int, int], int], batches: list[int], held: int, per_mille: int, known: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """{bucket: [(batch, keys it takes), ...]} for deliveries in order.

    ``sizes``: unseen keys per (bucket, batch they came with); ``known``: all keys per batch; ``held``: keys in the ledger before.
    A delivery takes the lowest unseen keys of all that have come by then, up to its quota; how many of a bucket it takes follows from counts.
    """
    came: dict[int, list[tuple[int, int]]] = {}
    for (bucket, b), n in sorted(sizes.items()):
        came.setdefault(bucket, []).append((b, n))
    order, taken = sorted(came), dict.fromkeys(came, 0)
    out: dict[int, list[tuple[int, int]]] = {}
    for g in batches:
        want = quota(sum(n for b, n in known.items() if b <= g), per_mille) - held
        for bucket in order:
            if want <= 0:
                break
            k = min(want, sum(n for b, n in came[bucket] if b <= g) - taken[bucket])
            if k > 0:
                out.setdefault(bucket, []).append((g, k))
                taken[bucket] += k
                want -= k
                held += k
    return out


def replay(df: DataFrame, key_col: str, batch_col: str, path: str | None = None, per_mille: int = 100, seed: int = 11) -> DataFrame:
    """``key, priority, generation`` after all deliveries in df, in their order; the ledger is kept at ``path``.

    Keys are organizations in standard spelling. Rows without a batch belong to the first delivery, rows without a
    key to none. A ledger found at ``path`` is continued: its keys stay and its generations are not drawn again. Without a path the ledger
    is a new one in the shared folder. Only a path that is not there is an empty ledger; one that can't be read is an error.
    The driver holds one count per bucket and delivery.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    first = df.select(standard_ein(key_col).alias("key"), F.coalesce(F.col(batch_col), F.lit(-(1 << 31))).alias("b")).filter("key is not null")
    first = first.groupBy("key").agg(F.min("b").alias("b")).withColumn("priority", priority(seed, F.col("key")))
    first = written(first.withColumn("bucket", F.expr(f"cast(priority div {(1 << 60) // BUCKETS} as int)")), "ledger-keys")
    done = _read(spark, path)
    held, last = done.agg(F.count("*"), F.max("generation")).first() if done is not None else (0, None)
    known = {r["b"]: r["n"] for r in first.groupBy("b").agg(F.count("*").alias("n")).collect()}
    batches = [b for b in sorted(known) if last is None or b > last]
    if batches:
        unseen = first.join(done.select("key"), "key", "left_anti") if held else first
        sizes = {(r["bucket"], r["b"]): r["n"] for r in unseen.groupBy("bucket", "b").agg(F.count("*").alias("n")).collect()}
        _hand_out(unseen, schedule(sizes, batches, held, per_mille, known)).write.mode("append").parquet(path)
    got = _read(spark, path)
    return got if got is not None else spark.createDataFrame([], LEDGER)


def _hand_out(unseen: DataFrame, plan: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """The keys that each bucket gives to each delivery of its plan: the lowest that have come by then and are left."""
    spark = unseen.sparkSession
    takes = spark.createDataFrame([(b, [g for g, _ in v], [k for _, k in v]) for b, v in plan.items()], "bucket int, generations array<int>, takes array<long>")

    def run(key, table):
        import pyarrow as pa

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("priority", "key", "b")), strict=True))
        generations, counts = table.column("generations")[0].as_py(), table.column("takes")[0].as_py()
        out: list[tuple[str, int, int]] = []
        for g, k in zip(generations, counts, strict=True):
            left = []
            for row in rows:
                if k > 0 and row[2] <= g:
                    out.append((row[1], row[0], g))
                    k -= 1
                else:
                    left.append(row)
            rows = left
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"key": pa.array(columns[0], pa.string()), "priority": pa.array(columns[1], pa.int64()), "generation": pa.array(columns[2], pa.int32())})

    # At most one row per bucket, so BUCKETS rows.
    return unseen.join(F.broadcast(takes), "bucket").groupBy("bucket").applyInArrow(run, LEDGER)


def _read(spark, path: str) -> DataFrame | None:
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else None
