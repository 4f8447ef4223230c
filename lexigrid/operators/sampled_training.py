"""Training on drawn pairs: parameters of which an update rewrites only the ids it touched, kept as a base and later deltas.

A `ParameterTable` is a folder of the shared store: `base-<k>` holds a row an id, `delta-<t>` the rows that update t
rewrote, and `manifest-<t>` says which of them make the table after update t and what the losses were. A run that is
stopped goes on after its last manifest. Deltas are merged into a new base every so many updates, and what no
manifest needs any more is deleted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.runs import Diverged
from lexigrid.operators.embeddings import dot
from lexigrid.operators.training import LONGEST, OPTIMIZERS, mean_norms, stepped
from lexigrid.sources.shared import cut, remove, removed


class ParameterTable:
    """(id, v, w) and what the optimizer keeps, as of the last whole update."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path.rstrip("/"), state

    @classmethod
    def create(cls, params: DataFrame, path: str, optimizer: str = "adam") -> ParameterTable:
        """A new table with zeros for what the optimizer keeps; ValueError where a folder has one already."""
        if optimizer not in OPTIMIZERS:
            raise ValueError(f"no optimizer is named {optimizer}")
        table = cls(params.sparkSession, path, {"update": 0, "base": 0, "deltas": [], "losses": [], "optimizer": optimizer})
        if cls._found(table.spark, path):
            raise ValueError(f"{path} has a parameter table")
        zero = lambda name: F.transform(name, lambda x: F.lit(0.0))
        kept = {"adam": ("m", "s"), "adagrad": ("s",), "sgd": ()}[optimizer]
        start = params.select("id", "v", "w", *(zero(side).alias(f"{k}{side}") for side in "vw" for k in kept))
        start.write.mode("overwrite").parquet(f"{table.path}/base-0")
        table._told()
        return table

    @classmethod
    def resume(cls, spark: SparkSession, path: str) -> ParameterTable:
        """The table after its last whole update: what a stopped update left is written over when it is done again."""
        found = cls._found(spark, path)
        if not found:
            raise ValueError(f"{path} has no parameter table")
        line = spark.read.text(f"{path.rstrip('/')}/manifest-{max(found)}").first().value
        return cls(spark, path, json.loads(line))

    @staticmethod
    def _found(spark: SparkSession, path: str) -> list[int]:
        """Updates whose manifest is whole."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return []
        names = [f.getPath() for f in store.listStatus(folder)]
        whole = [p.getName() for p in names if p.getName().startswith("manifest-") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(name.split("-")[1]) for name in whole)

    def _told(self) -> None:
        """Write the manifest: one line, and only then is the update done."""
        line = self.spark.createDataFrame([(json.dumps(self.state),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.state['update']}")

    @property
    def optimizer(self) -> str:
        return self.state["optimizer"]

    @property
    def losses(self) -> list[float]:
        return [x for _, x in self.state["losses"]]

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """The rows of all ids, or of a table (id) of those asked for: of each the one of its last update."""
        read = lambda name, t: self.spark.read.parquet(f"{self.path}/{name}").withColumn("t_", F.lit(t))
        base, deltas = read(f"base-{self.state['base']}", -1), [read(f"delta-{t}", t) for t in self.state["deltas"]]
        if ids is not None:
            base, deltas = base.join(ids, "id", "left_semi"), [d.join(ids, "id", "left_semi") for d in deltas]
        if not deltas:
            return base.drop("t_")
        rows = base
        for d in deltas:
            rows = rows.unionByName(d)
        columns = [c for c in base.columns if c not in ("id", "t_")]
        return rows.groupBy("id").agg(F.max_by(F.struct(*columns), "t_").alias("row")).select("id", "row.*")

    def update(self, rows: DataFrame, loss: float | None = None, every: int = 8) -> None:
        """Write the rows that one update made, and the manifest after it; merge deltas where there are `every` of them."""
        old = dict(self.state)
        t = old["update"] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/delta-{t}")
        self.state = old | {"update": t, "deltas": [*old["deltas"], t], "losses": old["losses"] + ([[t, loss]] if loss is not None else [])}
        if len(self.state["deltas"]) >= every:
            self.current().write.mode("overwrite").parquet(f"{self.path}/base-{t}")
            self.state |= {"base": t, "deltas": []}
        self._told()
        if self.state["base"] != old["base"]:
            self._forget(old, [*old["deltas"], t])

    def replace(self, rows: DataFrame, loss: float | None = None) -> None:
        """Write what an update made that moved every id, as a new base, and the manifest after it."""
        old = dict(self.state)
        t = old["update"] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/base-{t}")
        self.state = old | {"update": t, "base": t, "deltas": [], "losses": old["losses"] + ([[t, loss]] if loss is not None else [])}
        self._told()
        self._forget(old, old["deltas"])

    def _forget(self, old: dict, deltas: list[int]) -> None:
        """Delete a base that was followed by a new one, its deltas and the manifests that name it."""
        before = (k for k in self._found(self.spark, self.path) if k < self.state["update"])
        for name in [f"base-{old['base']}", *(f"delta-{d}" for d in deltas), *(f"manifest-{k}" for k in before)]:
            remove(self.spark, f"{self.path}/{name}")


def pair_scores(pairs: DataFrame, params: DataFrame) -> DataFrame:
    """Pairs with x = v[i], y = w[j] and their product as score, of parameters whose biases are part of the vectors."""
    rows, columns = params.select(F.col("id").alias("i"), F.col("v").alias("x")), params.select(F.col("id").alias("j"), F.col("w").alias("y"))
    return pairs.join(rows, "i").join(columns, "j").withColumn("score", dot("x", "y"))


def pair_slopes(scored: DataFrame, slope: Column, dims: int) -> DataFrame:
    """(id, gv, gw): the gradients of scored pairs for v[i] and w[j]; an id may stand on both sides."""
    parts = scored.select(slope.alias("d"), F.explode(F.array(
        F.struct(F.col("i").alias("id"), F.lit("v").alias("side"), F.col("y").alias("x")), F.struct(F.col("j").alias("id"), F.lit("w").alias("side"), F.col("x").alias("x")),
    )).alias("p")).select("d", "p.*")
    sums = [F.array(*(F.sum(F.when(F.col("side") == side, F.col("d") * F.col("x")[k]).otherwise(0.0)) for k in range(dims))).alias(f"g{side}") for side in "vw"]
    return parts.groupBy("id").agg(*sums)


class SampledLoss:
    """A loss of drawn pairs (i, j, positive or exp_pmi): per pair, its share of the batch's loss and the slope by its score."""

    def __init__(self, pair: Callable[[int], Column], slope: Callable[[int], Column]):
        self.pair, self.slope = pair, slope


def sample_mle() -> SampledLoss:
    """-(sum of positive scores - sum of exp of the others) by the number of positive pairs."""
    positive = lambda: F.col("positive")
    return SampledLoss(lambda n: F.when(positive(), -F.col("score")).otherwise(F.exp("score")) / n, lambda n: F.when(positive(), F.lit(-1.0)).otherwise(F.exp("score")) / n)


def gibbs_mle() -> SampledLoss:
    """-(sum of positive scores - sum of the others) by the number of positive pairs."""
    return SampledLoss(lambda n: F.when(F.col("positive"), -F.col("score")).otherwise(F.col("score")) / n, lambda n: F.when(F.col("positive"), F.lit(-1.0)).otherwise(F.lit(1.0)) / n)


def balanced_mle() -> SampledLoss:
    """The mean of exp(score) - exp_pmi * score."""
    return SampledLoss(lambda n: (F.exp("score") - F.col("exp_pmi") * F.col("score")) / n, lambda n: (F.exp("score") - F.col("exp_pmi")) / n)


def train_sampled(
    table: ParameterTable, batch: Callable[[int, DataFrame | None], DataFrame], loss: SampledLoss, *, size: int, rate: Callable[[int], float], updates: int, accumulate: int = 1,
    clip: float | None = None, bias: bool = False, needs_params: bool = False, merge_every: int = 8,
) -> list[float]:
    """Go on with a table until it has had `updates` updates; the losses of all of them.

    batch(k, params) gives the pairs of the k-th batch, `size` of them counting; params are the current ones where
    needs_params is set (as Gibbs samples need), else None. An update takes the gradients of `accumulate` batches
    together, each at the same parameters. Only ids of these batches move, and what Adam and Adagrad keep of the
    others stays as it was; Adam's correction goes by the update. Batches depend on k alone, so a run that is resumed
    gives the parameters of one that was never stopped. Raises Diverged where a loss is no number, or touched vectors
    grow too long; the table then is that before the update.
    """
    dims = table.current().select(F.size("v")).first()[0]
    frozen = {"v": dims - 1, "w": dims - 2} if bias else {}
    for t in range(table.state["update"] + 1, updates + 1):
        params = table.current() if needs_params else None
        pairs = None
        for k in range((t - 1) * accumulate, t * accumulate):
            one = batch(k, params)
            pairs = one if pairs is None else pairs.unionByName(one)
        pairs = cut(pairs, "pairs")
        ids = pairs.select(F.col("i").alias("id")).union(pairs.select(F.col("j").alias("id"))).distinct()
        now = cut(table.current(ids), "touched")
        scored = cut(pair_scores(pairs, now), "scored")
        slope = loss.slope(size)
        slope = slope if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), slope))
        after = cut(stepped(now, pair_slopes(scored, slope, dims), table.optimizer, rate(t - 1), t, frozen), "after")
        value = scored.agg(F.sum(loss.pair(size)).alias("loss")).first()["loss"]
        norms = mean_norms(after)
        if value is None or not math.isfinite(value) or max(norms["v"], norms["w"]) > LONGEST:
            raise Diverged(f"update {t}: loss {value}, mean norms {norms['v']} and {norms['w']}")
        table.update(after, value / accumulate, merge_every)
        removed(pairs, now, scored, after)
    return table.losses
