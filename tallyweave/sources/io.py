"""Tables in and out: explicit schemas, idempotent writes, no inference."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.ids import nine_digits, standard_ein
from tallyweave.functions.text import group_letter, truncation_flag
from tallyweave.operators.relations import dedup_first, pick, require
from tallyweave.session import delete, exists, rename, written

STORE = (
    "EIN2 string, text string, source_id string, source_type string, label double, confidence double, model_id string, prompt_id string, temperature double, seed long, "
    "run_timestamp timestamp, reason string, domains_present string, evidence_spans string, boundary_notes string, binary_label string, system_fingerprint string, raw_response string, error string"
)
MANIFEST = "EIN2 string, stratum string, tier string, inclusion_prob double, is_positive_enriched boolean, split string"
TEMPLATE = "EIN2 string, split string, text string, human_label string"


def corpus(missions: DataFrame, registry: DataFrame, id_col: str, text_col: str, code_col: str, row_col: str, source: str = "corpus", deduplicate: bool = True) -> DataFrame:
    """Missions with their registry code, group letter and truncation flag; optionally one row per text (smallest row id).

    The registry joins on the nine digits of the id, one row per id (the smallest code); ids not in it keep group ``?``.
    """
    codes = registry.select(nine_digits(id_col).alias("__k"), F.col(code_col).alias("code")).filter("__k is not null").groupBy("__k").agg(F.min("code").alias("code"))
    m = require(missions, [id_col, text_col, row_col], "missions").select(F.col(row_col), standard_ein(id_col).alias("EIN2"), F.col(text_col).alias("mission_text"), nine_digits(id_col).alias("__k"))
    out = m.join(codes, "__k", "left").drop("__k")
    out = out.withColumn("ntee_major_group", group_letter("code")).withColumn("is_truncated", truncation_flag("mission_text")).withColumn("data_source", F.lit(source))
    return dedup_first(out, "mission_text", row_col) if deduplicate else out


def synthetic_corpus(spark: SparkSession, n: int, seed: int = 42, positive_share: float = 0.15) -> DataFrame:
    """n template sentences with weighted groups and injected positives, the same for a seed in every partitioning."""
    h = lambda k: F.abs(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")))
    from_list = lambda k, words: F.element_at(F.array(*map(F.lit, words)), (h(k) % len(words) + 1).cast("int"))
    who, what = ["children", "families", "veterans", "students", "animals"], ["housing", "counseling", "meals", "music lessons", "research"]
    text = F.concat(F.lit("To "), from_list("v", ["provide", "support", "promote", "fund"]), F.lit(" "), from_list("a", what), F.lit(" for "), from_list("b", who), F.lit("."))
    pos = (h("p") % 10_000) < int(positive_share * 10_000)
    group = F.when(pos, "X").otherwise(from_list("g", list("AABBBCDEEFGHIJKLLMNNOPPPPQRSSTTUVWYZ")))
    return spark.range(n).select(F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("EIN2"), F.when(pos, F.concat(text, F.lit(" We share the gospel in church."))).otherwise(text).alias("mission_text"), group.alias("ntee_major_group"), pos.cast("int").alias("label"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The annotation store with all its columns; older files that lack some get nulls, ids are brought to one spelling."""
    have = spark.read.parquet(path)
    empty = spark.createDataFrame([], STORE)
    out = empty.unionByName(have, allowMissingColumns=True).select(*empty.columns)
    return out.withColumn("EIN2", F.coalesce(standard_ein("EIN2"), F.trim("EIN2")))


def append_store(df: DataFrame, path: str, keys: tuple[str, ...] = ("EIN2", "source_id", "run_timestamp")) -> None:
    """Appends the records whose key the store lacks, each key once, so that a delivery that is repeated adds nothing.

    A record and source may have several runs; the latest counts when the store is read (see ``votes.latest_votes``).
    """
    require(df, ["EIN2", "source_id"], "records")
    spark = df.sparkSession
    full = spark.createDataFrame([], STORE).unionByName(df, allowMissingColumns=True)
    full = pick(full, list(keys), [F.to_json(F.struct("*"))])
    if exists(spark, path):
        held = spark.read.parquet(path)
        held = spark.createDataFrame([], STORE).unionByName(held, allowMissingColumns=True).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [full[k].eqNullSafe(held[f"__{k}"]) for k in keys])
        full = full.join(held, same, "left_anti")
    full.write.mode("append").parquet(path)


def replace_store(df: DataFrame, path: str) -> None:
    """Puts df in place of the store. The new files are written beside it first and then renamed, so a failed write leaves the store as it was;
    df may be read from the store itself."""
    spark = df.sparkSession
    require(df, ["EIN2", "source_id"], "records")
    full = spark.createDataFrame([], STORE).unionByName(df, allowMissingColumns=True)
    new, old = (f"{path.rstrip('/')}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    full.write.parquet(new)
    there = exists(spark, path)
    if there:
        rename(spark, path, old)
    rename(spark, new, path)
    if there:
        delete(spark, old)


def write_shards(df: DataFrame, path: str, shard_col: str = "shard_id") -> None:
    """Rewrites only the shards in df; others stay. A resumed run overwrites its shards instead of doubling them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard_col).parquet(path)


STATE = "shard_id int, print string, n_rows long"


def score_shards(rows: DataFrame, path: str, id_col: str, score, settings: str, shards: int, delete_stale: bool = True) -> DataFrame:
    """Scores rows shard by shard into ``path`` and returns all scored rows; a run that goes on after a failure scores only what is missing.

    A row's shard follows from its id. A shard is valid if the stored fingerprint of its rows and of ``settings`` (model, thresholds, versions) is what
    it would be now; others are scored anew. Shards that no row belongs to are deleted, unless the run covers a part only. The state is
    written after the shards, so a shard without its state is simply scored again. ``score`` takes and returns rows with all their columns.
    """
    spark = rows.sparkSession
    data, state = f"{path}/data", f"{path}/state"
    keyed = rows.withColumn("shard_id", F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards)).cast("int"))
    row_hash = F.xxhash64(*[F.col(c).cast("string") for c in sorted(rows.columns)]).cast("decimal(38,0)")
    now = keyed.groupBy("shard_id").agg(F.count("*").alias("n_rows"), F.sum(row_hash).alias("h"))
    now = written(now.select("shard_id", F.sha2(F.concat_ws("|", F.lit(settings), F.col("h").cast("string"), F.col("n_rows")), 256).alias("print"), "n_rows"), "shard-prints")
    known = written(spark.read.schema(STATE).parquet(state), "shard-state") if exists(spark, state) and exists(spark, data) else spark.createDataFrame([], STATE)
    todo = now.join(known, ["shard_id", "print", "n_rows"], "left_anti")
    # One row per shard.
    pending = keyed.join(F.broadcast(todo.select("shard_id")), "shard_id", "left_semi")
    if todo.limit(1).count():
        write_shards(score(pending), data)
    stale = [r["shard_id"] for r in known.join(now, "shard_id", "left_anti").select("shard_id").collect()] if delete_stale else []
    for k in stale:
        delete(spark, f"{data}/shard_id={k}")
    kept = now if delete_stale else now.unionByName(known.join(now, "shard_id", "left_anti"))
    written(kept, "shard-state").write.mode("overwrite").parquet(state)
    return spark.read.parquet(data).join(F.broadcast(now.select("shard_id")), "shard_id", "left_semi").drop("shard_id")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def coding_template(df: DataFrame, path: str, force: bool = False) -> None:
    """A template with blank labels; one that already holds labels is not overwritten unless forced.
    A template that is there and can't be read is an error."""
    spark = df.sparkSession
    if exists(spark, path) and not force and read_csv(spark, path, TEMPLATE).filter("human_label is not null and trim(human_label) != ''").limit(1).count():
        raise FileExistsError(f"{path} holds labels")
    write_csv(df.withColumn("human_label", F.lit(None).cast("string")), path, ["EIN2", "split", "text", "human_label"])


def strict_binary(col) -> F.Column:
    """0 or 1 from any spelling of these numbers, else null."""
    v = F.expr(f"try_cast(trim(cast(`{col}` as string)) as double)") if isinstance(col, str) else col
    return F.when(v == 1, 1).when(v == 0, 0)


def human_labels(template: DataFrame, split: str | None = None, drop_uncoded: bool = False) -> DataFrame:
    """Coded rows of a split; uncoded ones are dropped or raise an error. The split ``test`` stays closed."""
    if split == "test":
        raise PermissionError("the test split is read by the final evaluation only")
    t = template if split is None else template.filter(F.col("split") == split)
    t = t.withColumn("label", strict_binary("human_label"))
    if drop_uncoded:
        return t.filter("label is not null")
    bad = t.filter("label is null").limit(5).collect()
    if bad:
        raise ValueError(f"uncoded or invalid labels, for instance {[r['EIN2'] for r in bad]}")
    return t


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def batch_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of batch output and error files: ``custom_id, content, error``."""
    schema = "custom_id string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>, error struct<message: string>"
    rows = spark.read.text(paths).select(F.from_json("value", schema).alias("r"))
    return rows.select("r.custom_id", F.try_element_at(F.col("r.response.body.choices"), F.lit(1))["message"]["content"].alias("content"), F.col("r.error.message").alias("error")).filter("custom_id is not null")


def backfill_text(store: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The store with null texts taken from a lookup of one text per id."""
    t = texts.select(F.col(id_col), F.col(text_col).alias("__t"))
    return store.join(t, id_col, "left").withColumn(text_col, F.coalesce(text_col, "__t")).drop("__t")


def manifest_ids(frames: list[DataFrame], id_col: str) -> DataFrame:
    """Distinct ids of several manifests."""
    out = frames[0].select(id_col)
    for f in frames[1:]:
        out = out.union(f.select(id_col))
    return out.filter(F.col(id_col).isNotNull()).distinct()


def to_json_report(df: DataFrame) -> str:
    """A report table of few rows as JSON with sorted keys; NaN becomes null."""
    rows = [{k: (None if isinstance(v, float) and v != v else v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]
    return json.dumps(rows, sort_keys=True, default=str)


def read_calibrator(text: str) -> dict:
    """A calibrator's JSON, with its keys checked."""
    c = json.loads(text)
    need = {"platt": {"a", "b"}, "temperature": {"T"}}.get(c.get("method"))
    if need is None or not need <= set(c.get("params", {})) or "threshold" not in c:
        raise ValueError("a calibrator needs method, params and threshold")
    return c
