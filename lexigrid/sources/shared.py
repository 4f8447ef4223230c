"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one set for checkpoints; where neither is set, one in the warehouse, which is shared as well."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate").rstrip("/")


def cut(df: DataFrame, label: str = "table", by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage ends there, and a lost executor repeats nothing before.

    Rows that are the same in the columns `by` have a folder of their own, which is all that a filter on them reads.
    """
    path = f"{shared_dir(df.sparkSession)}/lexigrid-{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a shared store, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables that `cut` gave."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)
