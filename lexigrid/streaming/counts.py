"""Cooccurrence counts that grow with a stream of texts, each micro-batch counted once however often it is delivered.

A folder of the shared store holds `base-<k>`, the counts of all batches up to k, and `delta-<b>`, those of batch b alone.
A batch that comes again writes its own delta anew, or nothing if it is part of the base, so no count is added twice.
`manifest-<k>` is written after the base, and names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrid.operators import cooccurrence as co
from lexigrid.sources.corpus import all_words, lines
from lexigrid.sources.shared import remove


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folder's whole tables of a kind."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    folder = at(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [f.getPath() for f in store.listStatus(folder)]
    return sorted(int(p.getName().split("-")[1]) for p in names if p.getName().startswith(f"{kind}-") and store.exists(at(p, "_SUCCESS")))


class GrowingCounts:
    """Counts of tokens and of cells in one folder; cells by tokens, so that a vocabulary may grow with the corpus."""

    def __init__(self, spark: SparkSession, path: str, right: list[float], left: list[float], compact_every: int = 16):
        self.spark, self.path, self.right, self.left, self.compact_every = spark, path.rstrip("/"), right, left, compact_every

    def batch_counts(self, docs: DataFrame) -> DataFrame:
        """(focal, context, n) of one batch: pairs of tokens, and with a null context how often a token came."""
        words = co.unigram(all_words(docs))
        vocab = co.vocabulary(words)
        cells = co.line_cooccurrences(lines(docs), vocab, self.right, self.left)
        name = lambda id_col, column: vocab.select(F.col("id").alias(id_col), F.col("token").alias(column))
        pairs = cells.join(name("i", "focal"), "i").join(name("j", "context"), "j").select("focal", "context", F.col("nij").alias("n"))
        return pairs.unionByName(words.select(F.col("token").alias("focal"), F.lit(None).cast("string").alias("context"), F.col("n").cast("double").alias("n")))

    def take(self, docs: DataFrame, batch: int) -> None:
        """Count one micro-batch; the same batch again changes nothing."""
        spark, base = docs.sparkSession, self._base()
        if batch <= base:
            return
        self.batch_counts(docs).write.mode("overwrite").parquet(f"{self.path}/delta-{batch}")
        deltas = [b for b in _numbers(spark, self.path, "delta") if b > base]
        if len(deltas) >= self.compact_every:
            self.compact()

    def start(self, texts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """A streaming query that counts a stream of (text); `trigger` as of DataStreamWriter.trigger."""
        writer = texts.writeStream.foreachBatch(lambda docs, batch: self.take(docs, batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def _base(self) -> int:
        return max(_numbers(self.spark, self.path, "manifest"), default=-1)

    def counts(self) -> DataFrame:
        """(focal, context, n) of all batches so far."""
        base = self._base()
        deltas = [f"{self.path}/delta-{b}" for b in _numbers(self.spark, self.path, "delta") if b > base]
        paths = ([f"{self.path}/base-{base}"] if base >= 0 else []) + deltas
        if not paths:
            return self.spark.createDataFrame([], "focal string, context string, n double")
        return self.spark.read.parquet(*paths).groupBy("focal", "context").agg(F.sum("n").alias("n"))

    def compact(self) -> None:
        """Merge the base and the deltas after it into a new base; the files that it replaces go once its manifest is written."""
        base = self._base()
        deltas = [b for b in _numbers(self.spark, self.path, "delta") if b > base]
        if not deltas:
            return
        last = deltas[-1]
        order = ["focal", "context"]
        self.counts().repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/base-{last}")
        self.spark.createDataFrame([(str(last),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{last}")
        for name in [*(f"delta-{b}" for b in deltas), *([f"base-{base}", f"manifest-{base}"] if base >= 0 else [])]:
            remove(self.spark, f"{self.path}/{name}")

    def unigram(self) -> DataFrame:
        """(token, n)."""
        return self.counts().where("context is null").select(F.col("focal").alias("token"), F.col("n").cast("long").alias("n"))

    def cells(self, vocab: DataFrame) -> DataFrame:
        """(i, j, nij) of a vocabulary (id, token); windows were formed before tokens are left out."""
        name = lambda id_col, column: vocab.select(F.col("id").alias(id_col), F.col("token").alias(column))
        pairs = self.counts().where("context is not null")
        return pairs.join(name("i", "focal"), "focal").join(name("j", "context"), "context").select("i", "j", F.col("n").alias("nij"))
