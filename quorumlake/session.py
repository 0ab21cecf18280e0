"""Session settings and staged tables shared by all operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master may leave it unset: driver and executors are one process there, so a
    temporary folder is set. On a cluster an unset folder is an error, never a guess.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, a lost
    executor costs no recomputation, and the size that Spark plans joins by is the real one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Discard tables, and have the driver collect its garbage: Spark deletes the shuffle files of
    finished jobs only when their plans are collected."""
    discard(*tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
