"""Scratch tables in the folder that the whole cluster shares, and small table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one is set on a local master; on a cluster,
    whose machines do not share one, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="clausework-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which cuts the lineage and survives lost executors.

    rows: the most rows of an Arrow batch that Python gets, where they are wide.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_ROWS)
    try:
        if rows:
            spark.conf.set(_ROWS, str(rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes materialised tables once everything made of them is written itself."""
    for df in tables:
        if df is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
