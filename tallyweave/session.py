"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallyweave", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine (tests).

    On a cluster an unset folder is an error, as no executor could see another machine's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return qualified(spark, folder)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, resolved against Spark's default file system, so that all that read it see the same place."""
    fs, at = _file(spark, path)
    found = fs.makeQualified(at).toString()
    return "file://" + found[len("file:") :] if found.startswith("file:/") and not found.startswith("file://") else found


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _file(spark, old)
    if not fs.rename(at, _file(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder with all it holds; one that is not there is no error."""
    fs, at = _file(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; failures of the file system are raised."""
    fs, at = _file(spark, path)
    return fs.exists(at)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Checkpoint to the shared folder: the result survives the loss of any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back (schema kept, lineage cut)."""
    path = written_path(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_path(df: DataFrame, name: str) -> str:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
