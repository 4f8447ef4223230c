"""Training on every pair of a vocabulary, shard by shard: losses that weigh pairs never counted, without a row for a pair.

A shard is a stride of rows and one of columns. Its loss and gradients come from one `tiles.dense_pass`, and the
parameters are a `ParameterTable`, so a run that is stopped goes on after its last whole update.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.runs import Diverged
from lexigrid.operators import tiles as ti
from lexigrid.operators.sampled_training import ParameterTable
from lexigrid.operators.training import LONGEST, mean_norms, stepped
from lexigrid.sources.shared import cut, removed


def shard_of(cells: DataFrame, sums: DataFrame, factor: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Cells and marginals of the k-th of factor^2 strided shards, row by row; after the last one the first again.

    The marginals are those of all cells, so a shard's loss is its part of the whole loss.
    """
    row, column = divmod(k % factor**2, factor)
    on = lambda name, stride: F.col(name) % factor == stride
    ends = (F.col("side") == "total") | ((F.col("side") == "row") & on("id", row)) | ((F.col("side") == "column") & on("id", column))
    return cells.where(on("i", row) & on("j", column)), sums.where(ends)


def train_dense(
    table: ParameterTable, cells: DataFrame, sums: DataFrame, form: ti.Form, *, rate: Callable[[int], float], updates: int, factor: int = 1, accumulate: int = 1,
    bias: bool = False, shares: DataFrame | None = None, side: int = ti.SIDE,
) -> list[float]:
    """Go on with a table until it has had `updates` updates; each one's loss, as it was before the update.

    An update takes the gradients of `accumulate` shards together, in the order of `shard_of`, all at the same
    parameters. With bias, vectors end as `training.with_biases` makes them. Every id of the table is written at each
    update: one without a counted row or column has gradient zero on that side. cells and sums are read once a shard, so
    they should be stored. Empty cells: loss 0, nothing moves. Raises Diverged where a loss is no number or the vectors'
    mean norm passes LONGEST; the table then is that before the update.
    """
    dims = table.current().select(F.size("v")).first()[0]
    frozen = {"v": dims - 1, "w": dims - 2} if bias else {}
    for t in range(table.state["update"] + 1, updates + 1):
        params = cut(table.current(), "params")
        plain = params.select("id", "v", "w", F.lit(0.0).alias("vb"), F.lit(0.0).alias("wb"))
        found = None
        for k in range((t - 1) * accumulate, t * accumulate):
            one = ti.dense_pass(*shard_of(cells, sums, factor, k), plain, form, slopes=("v", "w"), shares=shares, side=side)
            found = one if found is None else found.unionByName(one)
        found = cut(found, "slopes")
        of = lambda name: F.array(*(F.sum(F.when(F.col("side") == name, F.col("g")[k]).otherwise(0.0)) for k in range(dims))).alias(f"g{name}")
        after = cut(stepped(params, found.groupBy("id").agg(of("v"), of("w")), table.optimizer, rate(t - 1), t, frozen), "after")
        value = found.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss")).first()["loss"]
        norms = mean_norms(after)
        if not math.isfinite(value) or not max(norms["v"], norms["w"]) <= LONGEST:
            removed(params, found, after)
            raise Diverged(f"update {t}: loss {value}, mean norms {norms['v']} and {norms['w']}")
        table.replace(after, value)
        removed(params, found, after)
    return table.losses
