"""What the operators of this subpackage share: inputs, shared storage, broadcast bounds."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.sources.shared import shared_dir

#: `[^\x20\x09-\x0D]+` is what bytes.split() returns: these are the six ASCII white-space bytes.
ASCII_SPACES = " \t\n\x0b\x0c\r"
#: Spark removes a query's shuffle files when the query ends, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (id long, text string), null texts as empty: other columns can't clash and aren't read."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: short lineage, and a size the planner knows.

    A join with a small stored table is broadcast by Spark if its files are under
    spark.sql.autoBroadcastJoinThreshold, and shuffled otherwise. The shuffle files of the write go when it
    is done: df is not run again, so nothing could use them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigrid-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(parts)


def rows_of(batches: Iterable, *columns: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, in small slices so that long texts don't pile up as Python objects."""
    for batch in batches:
        step = max(1, min(batch.num_rows, int(batch.num_rows * 4e6 / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(name).to_pylist() for name in columns), strict=True)
