"""Raw documents to packed training sequences: each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import stored, table
from lexigrid.llm.decontam import contaminated
from lexigrid.llm.packing import pack_documents
from lexigrid.llm.pii import redact
from lexigrid.llm.queries import tokenizer_path
from lexigrid.llm.simhash import near_duplicates
from lexigrid.llm.toxicity import fit, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with a number of its own for every row, stored, so that each reading gives the same numbers."""
    return stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def _only(rows: DataFrame, found: DataFrame, how: str, label: str) -> DataFrame:
    """Rows whose number is (left_semi) or isn't (left_anti) found; ids may be null or repeat.

    What is found grows with the table, so texts meet it by a shuffle at every size.
    """
    return rows.join(stored(found.distinct(), label).hint("merge"), "row", how).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    rows = _keyed(docs)
    scored = score(rows, fit(rows, table(spark, sf_dir, "labels")), id_col="row")
    return _only(rows, scored.where("predicted = 1").select(F.col("doc_id").alias("row")), "left_anti", "toxic")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays; one without an id only where none has any. Of equals, one."""
    rows = _keyed(docs)
    found = near_duplicates(rows, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    kept = found.join(rows.select("row", "doc_id"), "row").groupBy("group").agg(best.alias("best")).select("best.row")
    return _only(rows, kept, "left_semi", "kept")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    rows = _keyed(docs)
    leaks = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="row").select(F.col("doc_id").alias("row"))
    return _only(rows, leaks, "left_anti", "leaks")


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks."""
    return docs.withColumn("text", redact("text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as the packing operator returns them."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", privacy),
    ("packing", packing),
]
#: No SQL can express a trained classifier, fingerprint groups or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
