from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import cooccurrence as co
from lexigrid.operators import tiles as ti
from lexigrid.plans import models, whole


def case(spark, size=37, dims=5, seed=4):
    """Counts with empty rows and columns, vectors, biases; ids in no order."""
    rng = np.random.default_rng(seed)
    n = rng.integers(0, 6, (size, size)) * (rng.random((size, size)) < 0.2) * 1.0
    n[[3, 11]] = 0
    n[:, [5, 11]] = 0
    v, w = rng.normal(0, 0.4, (2, size, dims))
    vb, wb = rng.normal(0, 0.2, (2, size))
    cells = spark.createDataFrame([(int(i), int(j), float(n[i, j])) for i, j in np.argwhere(n)], "i int, j int, nij double").repartition(3)
    params = spark.createDataFrame([(k, v[k].tolist(), w[k].tolist(), float(vb[k]), float(wb[k])) for k in rng.permutation(size).tolist()], "id int, v array<double>, w array<double>, vb double, wb double")
    return n, v, w, vb, wb, cells, params


def losses(form, n, score, share=None):
    """Losses and slopes of all pairs, from the definitions."""
    ni, nj, total = n.sum(1), n.sum(0), n.sum()
    ind = np.outer(ni, nj) / total**2
    if form == "sgns":
        negatives = 15 * (ni[:, None] - n) * (nj / total if share is None else share)
        sigma = 1 / (1 + np.exp(-score))
        return -(n * np.log(sigma) + negatives * np.log(1 - sigma)), -n * (1 - sigma) + negatives * sigma
    t = {"mle": 1.0, "tempered": 2.0}[form]
    with np.errstate(divide="ignore"):
        weight = np.where(ind > 0, ind ** (1 / t - 1), 0)
    return weight * (ind * np.exp(score) - n / total * score), weight * (ind * np.exp(score) - n / total)


@pytest.mark.parametrize("name", ["mle", "tempered", "sgns"])
@pytest.mark.parametrize("side", [4, 13, 500])
def test_blocks_equal_numpy(spark, name, side):
    n, v, w, vb, wb, cells, params = case(spark)
    form = {"mle": ti.mle(), "tempered": ti.mle(2), "sgns": ti.sgns()}[name]
    loss, slope = losses(name, n, w @ v.T + wb[:, None] + vb)
    rows, columns = n.sum(1) > 0, n.sum(0) > 0
    got = ti.dense_pass(cells, co.marginals(cells), params, form, slopes=("v", "w"), bias=True, side=side, held=16).collect()
    by = {s: {r.id: r for r in got if r.side == s} for s in "vw"}
    assert set(by["w"]) == set(np.flatnonzero(rows)) and set(by["v"]) == set(np.flatnonzero(columns)) and len(got) == rows.sum() + columns.sum()
    slope = slope * rows[:, None] * columns
    for k, r in by["w"].items():
        assert r.loss == pytest.approx(loss[k][columns].sum()) and r.g == pytest.approx(slope[k] @ v)
    for k, r in by["v"].items():
        assert r.g == pytest.approx(slope[:, k] @ w)


def test_parts_of_the_vocabulary_and_nothing(spark):
    n, v, w, _, _, cells, params = case(spark)
    some = params.where("id % 3 <> 0")
    loss, _ = losses("mle", n, w @ v.T)
    kept = [k for k in range(len(n)) if k % 3 and n[:, k].sum() > 0]
    got = {r.id: r.loss for r in ti.dense_pass(cells, co.marginals(cells), some, ti.mle(), side=6).collect()}
    assert got == pytest.approx({k: loss[k, kept].sum() for k in range(len(n)) if k % 3 and n[k].sum() > 0})
    share = np.random.default_rng(1).random(len(n))
    shares = spark.createDataFrame([(k, float(x)) for k, x in enumerate(share)], "id int, share double")
    loss, _ = losses("sgns", n, w @ v.T, share)
    kept = n.sum(0) > 0
    got = {r.id: r.loss for r in ti.dense_pass(cells, co.marginals(cells), params, ti.sgns(), shares=shares, side=9).collect()}
    assert got == pytest.approx({k: loss[k, kept].sum() for k in np.flatnonzero(n.sum(1)).tolist()})
    assert ti.dense_pass(cells.limit(0), co.marginals(cells.limit(0)), params, ti.mle()).count() == 0


def test_no_row_for_a_pair(spark):
    """What reaches the shuffles grows as ids times blocks of a side, not as pairs."""
    *_, cells, params = case(spark, size=60)
    plan = ti.dense_pass(cells, co.marginals(cells), params, ti.mle(), side=20)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_whole_dense_queries_equal_numpy(spark, tmp_path):
    rng = np.random.default_rng(7)
    lines = [" ".join(f"w{int(x)}" for x in 330 * rng.random(12) ** 2) for _ in range(300)]
    texts = [(k, "\n".join(lines[k : k + 3])) for k in range(0, len(lines), 3)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    vectors = rng.normal(0, 0.3, (9, 4))
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(vectors)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    path = str(tmp_path)
    cells = models._model_cells(spark, path, None).collect()
    size = max(max(r.i, r.j) for r in cells) + 1
    n = np.zeros((size, size))
    for r in cells:
        n[r.i, r.j] = r.nij
    ids = np.arange(size)
    v, w = vectors[ids % 9], vectors[(7 * ids + 3) % 9]
    for name, query in (("mle", "loss_mle_whole"), ("sgns", "loss_sgns_whole")):
        want = losses(name, n, w @ v.T)[0].sum(1)
        got = {r.i: r.loss for r in whole.QUERIES[query](spark, path).collect()}
        assert len(got) == size > models.SIZE and got == pytest.approx(dict(enumerate(want)), abs=2e-5)
    want = losses("mle", n, w @ v.T)[1].T @ w
    got = np.zeros_like(want)
    for r in whole.QUERIES["grad_mle_v_whole"](spark, path).collect():
        got[r.id, r.dim] = r.g
    assert np.abs(got - want).max() < 1e-8
