"""The annotation store as a stream: late and repeated deliveries, drift audits per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.votes import drift
from tallyweave.sources.io import STORE


def votes(spark: SparkSession, path: str, lateness: str = "14 days") -> DataFrame:
    """Records from a folder as they arrive, each (record, source, run) once within the lateness."""
    s = spark.readStream.schema(STORE).parquet(path)
    return s.withWatermark("run_timestamp", lateness).dropDuplicatesWithinWatermark(["EIN2", "source_id", "run_timestamp"])


def votes_per_window(stream: DataFrame, window: str = "1 day") -> DataFrame:
    """Votes and abstentions per source and window of run time."""
    return stream.groupBy(F.window("run_timestamp", window), "source_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label").isNull()).alias("n_abstain"), F.sum("label").alias("n_positive"))


def start(df: DataFrame, path: str, checkpoint: str, name: str = "votes"):
    """Writes all that is there and stops; a restart goes on after the last committed batch."""
    return df.writeStream.queryName(name).format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def audit(stream: DataFrame, baseline: DataFrame, path: str, checkpoint: str, id_col: str = "EIN2", label_col: str = "label"):
    """Per batch one row of drift against a baseline, kept by batch number so that a repeated batch replaces its row."""

    def each(batch: DataFrame, number: int) -> None:
        row = drift(baseline, batch.dropDuplicates([id_col]), id_col, label_col)
        row.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
