from __future__ import annotations

import numpy as np
import pytest
from test_tiles import case, losses

from lexigrid.functions.runs import Diverged
from lexigrid.operators import cooccurrence as co
from lexigrid.operators import dense_training as dt
from lexigrid.operators import tiles as ti
from lexigrid.operators import training as tr
from lexigrid.operators.sampled_training import ParameterTable
from lexigrid.sources.shared import cut

UPDATES, RATE = 3, 0.05


@pytest.fixture(scope="module")
def stored(spark):
    n, v, w, vb, wb, cells, params = case(spark, size=17, dims=3)
    cells = cut(cells)
    return n, (v, w, vb, wb), cells, cut(co.marginals(cells)), params


def by_hand(n, v, w, name, optimizer, factor, accumulate, frozen):
    """Losses and both sides after each update, every pair from the definition."""
    size = len(n)
    sides, kept, found = {"v": v.copy(), "w": w.copy()}, {s: [np.zeros_like(v), np.zeros_like(v)] for s in "vw"}, []
    alive = np.outer(n.sum(1) > 0, n.sum(0) > 0)
    for t in range(1, UPDATES + 1):
        loss, slope = losses(name, n, sides["w"] @ sides["v"].T)
        share = np.zeros((size, size))
        for k in range((t - 1) * accumulate, t * accumulate):
            row, column = divmod(k % factor**2, factor)
            share[row::factor, column::factor] += 1
        share *= alive
        found.append((loss * share).sum())
        slopes = {"v": (slope * share).T @ sides["w"], "w": (slope * share) @ sides["v"]}
        for side, g in slopes.items():
            if side in frozen:
                g[:, frozen[side]] = 0
            m, s = kept[side]
            if optimizer == "sgd":
                step = g
            elif optimizer == "adagrad":
                s += g * g
                step = g / (np.sqrt(s) + 1e-10)
            else:
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                step = m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            sides[side] = sides[side] - RATE * step
    return found, sides["v"], sides["w"]


@pytest.mark.parametrize(
    ("name", "optimizer", "factor", "accumulate", "bias"),
    [("mle", "sgd", 1, 1, False), ("sgns", "adam", 1, 1, True), ("tempered", "adagrad", 2, 1, False), ("sgns", "adam", 2, 3, True)],
)
def test_steps_equal_numpy(spark, stored, tmp_path, name, optimizer, factor, accumulate, bias):
    n, (v, w, vb, wb), cells, sums, params = stored
    frozen = {}
    if bias:
        params, frozen = tr.with_biases(params), {"v": v.shape[1] + 1, "w": v.shape[1]}
        one = np.ones((len(v), 1))
        v, w = np.hstack([v, vb[:, None], one]), np.hstack([w, one, wb[:, None]])
    form = {"mle": ti.mle(), "tempered": ti.mle(2), "sgns": ti.sgns()}[name]
    table = ParameterTable.create(params, f"file://{tmp_path}/run", optimizer)
    got = dt.train_dense(table, cells, sums, form, rate=lambda t: RATE, updates=UPDATES, factor=factor, accumulate=accumulate, bias=bias, side=5)
    want, v, w = by_hand(n, v, w, name, optimizer, factor, accumulate, frozen)
    assert got == pytest.approx(want)
    rows = {r.id: r for r in table.current().collect()}
    assert sorted(rows) == list(range(len(v)))
    for k, r in rows.items():
        assert r.v == pytest.approx(v[k].tolist()) and r.w == pytest.approx(w[k].tolist())


def test_goes_on_after_a_stop(spark, stored, tmp_path):
    _, _, cells, sums, params = stored
    how = {"rate": lambda t: RATE, "factor": 2, "side": 9}
    at = {name: f"file://{tmp_path}/{name}" for name in ("whole", "stopped")}
    whole = ParameterTable.create(params, at["whole"])
    dt.train_dense(whole, cells, sums, ti.mle(), updates=3, **how)
    dt.train_dense(ParameterTable.create(params, at["stopped"]), cells, sums, ti.mle(), updates=1, **how)
    # A base without its manifest is what a driver leaves that was lost during an update.
    params.write.parquet(f"{at['stopped']}/base-2")
    stopped = ParameterTable.resume(spark, at["stopped"])
    dt.train_dense(stopped, cells, sums, ti.mle(), updates=3, **how)
    rows = [{r.id: r.v + r.w for r in t.current().collect()} for t in (whole, stopped)]
    assert stopped.losses == pytest.approx(whole.losses) and len(whole.losses) == 3
    assert rows[0].keys() == rows[1].keys() and all(rows[0][k] == pytest.approx(rows[1][k]) for k in rows[0])
    assert sorted(p.name for p in (tmp_path / "stopped").iterdir()) == ["base-3", "manifest-3"]


def test_loss_falls_and_diverges(spark, stored, tmp_path):
    _, _, cells, sums, params = stored
    table = ParameterTable.create(params, f"file://{tmp_path}/falls")
    found = dt.train_dense(table, cells, sums, ti.sgns(), rate=lambda t: 0.1, updates=4)
    assert found == sorted(found, reverse=True) and found[-1] < 0.9 * found[0]
    table = ParameterTable.create(params, f"file://{tmp_path}/grows", "sgd")
    with pytest.raises(Diverged):
        dt.train_dense(table, cells, sums, ti.sgns(), rate=lambda t: 1e6, updates=4)
    after = {r.id: r.v for r in ParameterTable.resume(spark, table.path).current().collect()}
    assert table.losses == [] and after == {r.id: r.v for r in params.collect()}


def test_shards_part_every_pair_and_empty_cells_move_nothing(spark, stored, tmp_path):
    _, _, cells, sums, params = stored
    parts = [dt.shard_of(cells, sums, 3, k) for k in range(9)]
    assert sorted(tuple(r) for one, _ in parts for r in one.collect()) == sorted(tuple(r) for r in cells.collect())
    whole = sum(r.loss for r in ti.dense_pass(cells, sums, params, ti.sgns()).collect())
    assert sum(r.loss for one in parts for r in ti.dense_pass(*one, params, ti.sgns(), side=4).collect()) == pytest.approx(whole)
    table = ParameterTable.create(params, f"file://{tmp_path}/nothing", "sgd")
    none = cells.limit(0)
    assert dt.train_dense(table, none, co.marginals(none), ti.mle(), rate=lambda t: 1.0, updates=1) == [0.0]
    assert {r.id: r.w for r in table.current().collect()} == {r.id: r.w for r in params.collect()}
