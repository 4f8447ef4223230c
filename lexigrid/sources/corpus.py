"""Corpora as words and as long-form tokens: each physical line of a text is a document of its own for windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line) of a text file; malformed bytes become the replacement character."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("line"))


def dealt(df: DataFrame) -> DataFrame:
    """A table in fewer files than there are cores, dealt out to all of them once; any other as it is."""
    many = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(many) if len(df.inputFiles()) < many else df


def words(text: str | Column) -> Column:
    """Runs of non-white space, case kept."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(words) of every line that has any; null texts have no lines."""
    return docs.select(F.explode(F.split(text_col, "\n")).alias("line")).select(words("line").alias("words")).where(F.size("words") > 0)


def all_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token) of whole texts, for what needs no lines or places."""
    return docs.select(F.explode(F.split(text_col, r"\s+")).alias("token")).where("token <> ''")


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, line_no, pos, token); null texts have none. Rows of one doc_id, or without any, differ by `row`."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    split = texts.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.select("row", "doc_id", "line_no", F.posexplode(words("line")).alias("pos", "token"))
