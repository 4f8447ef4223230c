"""Dense losses and gradients over every pair of a vocabulary, block by block, without a row for a pair.

A block holds the ids of one stride as rows and those of another as columns, with their vectors, and the cells between
them; it is one dense product in numpy, of which a strip of rows is held at a time. What leaves a block is one number
and one vector for each of its ids, summed over blocks by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a block's side, and how many scores are held at once.
SIDE, HELD = 8_192, 1 << 21


class Form(NamedTuple):
    """A dense model's loss: what follows from a strip of scores and counts, the rows' ni, the columns' nj and share, and n.

    The function gives the loss and its slope by the score for each pair, or None for the one that isn't asked for.
    """

    name: str
    pair: Callable


def mle(temperature: float = 1.0) -> Form:
    def pair(score, nij, ni, nj, share, n, want_loss, want_slope):
        import numpy as np

        independent = np.outer(ni / n, nj / n)
        weight = 1.0 if temperature == 1 else independent ** (1 / temperature - 1)
        expected = independent * np.exp(score)
        return (expected - nij / n * score) * weight if want_loss else None, (expected - nij / n) * weight if want_slope else None

    return Form("mle", pair)


def sgns(k: float = 15) -> Form:
    """Negatives by `share`, the columns' own part of n where none is given."""

    def pair(score, nij, ni, nj, share, n, want_loss, want_slope):
        import numpy as np

        negatives = (ni[:, None] - nij) * (k * share)
        loss = slope = None
        if want_loss:
            softplus = np.maximum(score, 0) + np.log1p(np.exp(-np.abs(score)))
            loss = (negatives + nij) * softplus - nij * score
        if want_slope:
            slope = (nij + negatives) / (1 + np.exp(-score)) - nij
        return loss, slope

    return Form("sgns", pair)


def _side(params: DataFrame, sums: DataFrame, side: str, vector: str, bias: str) -> DataFrame:
    marginal = sums.where(F.col("side") == side).select("id", F.col("n").alias("m"))
    return params.select("id", F.col(vector).alias("x"), F.col(bias).alias("b")).join(marginal, "id")


def _block(form: Form, total: float, bias: bool, loss: bool, slopes: tuple[str, ...], held: int):
    """One block: (side, id, loss, g) of its rows, of its columns, or both."""

    def run(key, cells: pa.Table, ends: pa.Table) -> pa.Table:
        import numpy as np

        def half(column: int):
            mine = ends.filter(pa.compute.equal(ends.column("column"), column)).sort_by("id")
            ids = mine.column("id").to_numpy()
            flat = mine.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            numbers = [mine.column(c).to_numpy() for c in ("m", "share", "b")]
            return ids, flat.reshape(len(ids), len(flat) // max(len(ids), 1)), *numbers

        (rows, w, ni, _, wb), (columns, v, nj, share, vb) = half(0), half(1)
        if not len(rows) or not len(columns):
            return _table([], [], [], [])
        i, j = np.searchsorted(rows, cells.column("i").to_numpy()), np.searchsorted(columns, cells.column("j").to_numpy())
        order = np.argsort(i, kind="stable")
        i, j, counted = i[order], j[order], cells.column("nij").to_numpy()[order]
        losses, gw, gv = np.zeros(len(rows)), np.zeros_like(w), np.zeros_like(v)
        step = max(1, held // len(columns))
        for a in range(0, len(rows), step):
            b = min(len(rows), a + step)
            score = w[a:b] @ v.T
            if bias:
                score += wb[a:b, None] + vb
            nij = np.zeros_like(score)
            inside = slice(*np.searchsorted(i, [a, b]))
            nij[i[inside] - a, j[inside]] = counted[inside]
            value, slope = form.pair(score, nij, ni[a:b], nj, share, total, loss, bool(slopes))
            if loss:
                losses[a:b] = value.sum(axis=1)
            if "w" in slopes:
                gw[a:b] = slope @ v
            if "v" in slopes:
                gv += slope.T @ w[a:b]
        parts = [("w", rows, losses, gw if "w" in slopes else None)] if loss or "w" in slopes else []
        if "v" in slopes:
            parts.append(("v", columns, np.zeros(len(columns)), gv))
        return _table(*(sum((list(p[k]) if k else [p[0]] * len(p[1]) for p in parts), []) for k in range(3)), [g for p in parts for g in (p[3] if p[3] is not None else [None] * len(p[1]))])

    return run


def _table(sides, ids, losses, gradients) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
    return pa.table([pa.array(c, k) for c, k in zip((sides, ids, losses, gradients), kinds, strict=True)], names=["side", "id", "loss", "g"])


def dense_pass(
    cells: DataFrame, sums: DataFrame, params: DataFrame, form: Form, *, loss: bool = True, slopes: tuple[str, ...] = (), bias: bool = False,
    shares: DataFrame | None = None, side: int = SIDE, held: int = HELD,
) -> DataFrame:
    """(side, id, loss, g) over every pair (i, j) of ids that have a row and a column sum: score = w[i] . v[j] (+ wb[i] + vb[j]).

    Side w has the loss summed over each row, and its gradient for w[i] if slopes has 'w'; side v has the gradients for
    v[j]. cells (i, j, nij), each pair once; sums as of `cooccurrence.marginals`; shares (id, share) give a column's part
    among negatives, instead of its part of all counts. The vocabulary's V ids are strided into V / side parts, so ids of
    any frequency are spread; each vector goes to V / side blocks, and a block's memory doesn't grow with V.
    Ids without parameters take no part. Biases are constants here; see `training.with_biases` for biases that learn.
    """
    total = sums.where("side = 'total'").select("n").first()
    many = sums.where("side <> 'total'").agg(F.max("id").alias("last")).first()["last"]
    if total is None or total.n is None or many is None:
        return params.sparkSession.createDataFrame([], "side string, id int, loss double, g array<double>")
    parts = -(-(many + 1) // side)
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = _side(params, sums, "row", "w", "wb").withColumn("share", F.lit(0.0))
    columns = _side(params, sums, "column", "v", "vb")
    columns = columns.withColumn("share", F.col("m") / total.n) if shares is None else columns.join(shares.select("id", "share"), "id")
    fields = ["bi", "bj", "column", "id", "x", "b", "m", "share"]
    ends = rows.withColumns({"column": F.lit(0), "bi": F.col("id") % parts, "bj": each}).select(*fields)
    ends = ends.unionByName(columns.withColumns({"column": F.lit(1), "bj": F.col("id") % parts, "bi": each}).select(*fields))
    inside = cells.select((F.col("i") % parts).alias("bi"), (F.col("j") % parts).alias("bj"), "i", "j", F.col("nij").cast("double").alias("nij"))
    # A cell of an id that takes no part has no place in a block.
    for name, own in (("i", rows), ("j", columns)):
        inside = inside.join(own.select(F.col("id").alias(name)), name, "left_semi")
    cast = {"x": F.col("x").cast("array<double>"), "b": F.col("b").cast("double"), "m": F.col("m").cast("double"), "share": F.col("share").cast("double")}
    groups = inside.select("bi", "bj", "i", "j", "nij").groupBy("bi", "bj").cogroup(ends.withColumns(cast).groupBy("bi", "bj"))
    found = groups.applyInArrow(_block(form, float(total.n), bias, loss, slopes, held), "side string, id int, loss double, g array<double>")
    if not slopes:
        return found.groupBy("side", "id").agg(F.sum("loss").alias("loss")).withColumn("g", F.lit(None).cast("array<double>"))
    dims = params.select(F.size("v")).first()[0]
    summed = F.array(*(F.sum(F.col("g")[k]) for k in range(dims)))
    return found.groupBy("side", "id").agg(F.sum("loss").alias("loss"), summed.alias("g"))
