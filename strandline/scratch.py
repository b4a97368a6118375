"""Tables that a job writes for itself, in the shared folder that spark.checkpoint.dir names.

They cut lineage (an executor that is lost costs tasks, not the run) and are dropped when they
have been read, or else before the session stops.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder that all executors see; it goes before the session stops, or with its JVM.

    Where the setting is missing and Spark runs inside this one process, a local folder is used;
    on a cluster that is an error, for executors would write to disks of their own.
    """
    held = folders(spark)
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    held.add(path)
    return path


def _root(spark: SparkSession) -> str:
    """This session's own folder, made once; the file system removes it when the JVM ends."""
    context = spark.sparkContext
    if not hasattr(context, "_strandline_root"):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = f"{tempfile.gettempdir()}/strandline-checkpoints"
        root = f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"
        fs, at = _files(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        context._strandline_root = root
    return context._strandline_root


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder."""
    fs, at = _files(spark, path)
    fs.delete(at, True)
    folders(spark).discard(path)


def written(df: DataFrame, **options) -> DataFrame:
    """df as a table: every later read sees the same rows. `drop_table` removes it."""
    path = folder(df.sparkSession)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame, most: int) -> int:
    """As many tasks as a shuffle has, or more where each would get over `most` of df's rows; they are counted, which is cheap for a table (its footers tell)."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // most))


def spread(df: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """df over n tasks, else as many as a shuffle has, whatever its size, by columns if any are given: a small file is one task, however much work its rows make."""
    return df.repartition(n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def drop_table(df: DataFrame) -> None:
    """Remove the table that `written` made; df is that frame, or one that reads it alone."""
    held = folders(df.sparkSession)
    for path in {p for p in held for f in df.inputFiles() if p.split("/")[-1] in f.split("/")}:
        drop(df.sparkSession, path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession) -> set[str]:
    """The folders of this session's context; its stop() removes them all first."""
    context = spark.sparkContext
    if not hasattr(context, "_strandline_folders"):
        context._strandline_folders = set()
        stop = context.stop

        def clean_and_stop() -> None:
            try:
                if hasattr(context, "_strandline_root"):
                    drop(spark, context._strandline_root)
            finally:
                stop()

        context.stop = clean_and_stop
    return context._strandline_folders
