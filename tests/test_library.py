from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import runs
from lexigrid.functions.kernels import read_weights
from lexigrid.functions.shards import Shard, Stride, select, shards
from lexigrid.operators import cooccurrence as co
from lexigrid.operators import dependency as de
from lexigrid.operators import embeddings as em
from lexigrid.operators import models as mo
from lexigrid.operators import sampling as sa
from lexigrid.operators import training as tr
from lexigrid.sources import store


def matrix(spark, rows):
    return spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(rows) for j, x in enumerate(r) if x], "i int, j int, nij double")


def test_strides_and_shards(spark):
    inner, outer = Stride(2, 3), Stride(1, 4)
    assert list(range(1, 200, 4))[2::3] == list(range(inner.of(outer).start, 200, inner.of(outer).step))
    assert inner.of(outer).within(outer) == inner
    with pytest.raises(ValueError):
        Stride(0, 3).within(outer)
    assert [s.on_diagonal() for s in shards(2)] == [True, False, False, True]
    nested = Shard(Stride(1, 2), Stride(0, 2)).of(shards(3)[5])
    assert nested.within(shards(3)[5]) == Shard(Stride(1, 2), Stride(0, 2))
    ids = spark.range(30).select(F.col("id").alias("i"), F.lit(0).alias("j"))
    assert [r.i for r in ids.where(select(F.col("i"), F.col("j"), Shard(Stride(4, 6), Stride(0, 1)))).orderBy("i").collect()] == [4, 10, 16, 22, 28]


def test_weights_file():
    assert read_weights("# right\n1 0.5\n\n2 # left\n") == ([1.0, 0.5], [2.0])
    with pytest.raises(ValueError):
        read_weights("1 2\n")


def test_stored_tables(spark, tmp_path):
    cells = matrix(spark, [[0, 7, 2, 1], [3, 0, 0, 4], [0, 6, 0, 0], [2, 0, 5, 0]])
    vocab = spark.createDataFrame([(k, f"t{k}", 9 - k) for k in range(4)], "id int, token string, n long")
    path = str(tmp_path / "table")
    store.save_cooccurrences(cells, vocab, path, 2)
    assert store.sector_factor(spark, path) == 2
    assert {(r.i, r.j): r.nij for r in store.load_cells(spark, path, (1, 0)).collect()} == {(1, 0): 3, (3, 0): 2, (3, 2): 5}
    scan = store.load_cells(spark, path, (1, 0))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(si" in scan
    whole = {(r.i, r.j): (r.nij, r.ni, r.nj, r.n) for r in store.load_with_marginals(spark, path, (0, 1), above=1.5).collect()}
    assert whole == {(0, 1): (7, 10, 13, 30), (2, 1): (6, 6, 13, 30)}
    store.sectorize(spark, path, 3, str(tmp_path / "three"))
    assert store.sector_factor(spark, str(tmp_path / "three")) == 3
    assert store.load_cells(spark, str(tmp_path / "three")).count() == 8
    store.truncate(spark, path, 2, str(tmp_path / "two"))
    assert {r.n for r in store.load_marginals(spark, str(tmp_path / "two")).where("side = 'total'").collect()} == {10}
    store.save_dictionary(vocab, str(tmp_path / "words"))
    assert sorted((r.id, r.token) for r in store.load_dictionary(spark, str(tmp_path / "words")).collect()) == [(k, f"t{k}") for k in range(4)]
    assert store.dictionary_size(spark, str(tmp_path / "words")) == 4
    with pytest.raises(ValueError):
        co.merged_sectors(cells, cells, (0, 0, 2), (0, 1, 2))
    with pytest.raises(ValueError):
        co.Prepared(cells, vocab).smooth(0.5).undersample(1e-3)


def test_embedding_access(spark):
    v = spark.createDataFrame([(0, "a", [3.0, 4.0]), (1, "b", [0.0, 0.0]), (2, "c", [1.0, 0.0])], "id int, token string, v array<double>")
    assert {r.token: r.v for r in em.normalized(v).collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0], "c": [1.0, 0.0]}
    keys = spark.createDataFrame([("c",), ("z",)], "token string")
    found = {r.token: r.v for r in em.of_tokens(v, keys, "unk").collect()}
    assert found["c"] == [1.0, 0.0] and found["z"] == pytest.approx([4 / 3, 4 / 3])
    with pytest.raises(Exception, match="no vector of the token z"):
        em.of_tokens(v, keys, "err").collect()
    order = spark.createDataFrame([(0, "c"), (1, "z"), (2, "a")], "place int, token string")
    with pytest.raises(ValueError):
        em.reordered(v, order)
    kept = em.reordered(v, order, allow_missing_vectors=True, allow_missing_tokens=True)
    assert sorted((r.id, r.token) for r in kept.collect()) == [(0, "c"), (1, "a")]
    one, two = (em.random_vectors(spark, 300, 8, seed=4, distribution=d) for d in ("uniform", "normal"))
    assert one.collect() == one.repartition(7).orderBy("id").collect() and abs(np.array([r.v for r in one.collect()])).max() < 0.2
    assert np.array([r.v for r in two.collect()]).std() == pytest.approx(0.2, rel=0.1)


def test_samples_follow_their_distributions(spark):
    cells = matrix(spark, [[0, 70, 20, 10], [30, 0, 0, 40], [0, 60, 0, 0], [20, 0, 50, 0]])
    sums = co.marginals(cells)
    for spread in (sa.seeded, sa.even):
        drawn = sa.counted_pairs(spark, co.attach(cells, sums), 4000, 1, 3, spread).groupBy("i", "j").count().collect()
        share = {(r.i, r.j): r["count"] / 4000 for r in drawn}
        want = {(r.i, r.j): r.nij / 300 for r in cells.collect()}
        assert share.keys() == want.keys() and all(abs(share[k] - want[k]) < 0.03 for k in want)
    both = sa.batch(spark, co.attach(cells, sums), sums, 500, 2, 5)
    assert {(r.positive, r["count"]) for r in both.groupBy("positive").count().collect()} == {(True, 500), (False, 500)}
    params = em.random_vectors(spark, 4, 3, seed=2, scale=1.0)
    rows, columns = (sa.tempered_marginal(sums, s, 1) for s in ("row", "column"))
    start = both.where("positive").select("n", "i", "j")
    got = sa.gibbs(start, params, rows, columns, 1, 11)
    assert got.count() == 500 and got.where("i is null or j is null").count() == 0
    p = {r.id: r for r in params.collect()}
    weights = {j: columns.where(F.col("id") == j).first().p * math.exp(np.dot(p[0].v, p[j].w)) for j in range(4)}
    given = spark.range(3000).select(F.col("id").alias("n"), F.lit(0).alias("id"))
    drawn = sa.drawn_from_rows(sa.conditional(given, params, columns, "v", "w"), sa.draws(spark, 3000, 8))
    share = {r.id: r["count"] / 3000 for r in drawn.groupBy("id").count().collect()}
    assert all(abs(share[j] - w / sum(weights.values())) < 0.04 for j, w in weights.items())
    vocab = spark.createDataFrame([(k, f"t{k}") for k in range(4)], "id int, token string")
    assert {r.focal for r in sa.words_of(start, vocab).collect()} <= {f"t{k}" for k in range(4)}


@pytest.mark.parametrize("optimizer", tr.OPTIMIZERS)
@pytest.mark.parametrize("bias", [False, True])
def test_training_equals_brute_force(spark, optimizer, bias):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 5, (5, 5)).astype(float)
    start = em.random_vectors(spark, 5, 3, seed=6, scale=0.5)
    start = tr.with_biases(start) if bias else start
    table = {r.id: r for r in start.collect()}
    v, w = (np.array([table[k][s] for k in range(5)]) for s in "vw")
    state = {s: [np.zeros_like(v), np.zeros_like(v)] for s in "vw"}
    losses = []
    weight = 2 * np.minimum((n / 100) ** 0.75, 1)
    for t in range(1, 4):
        with np.errstate(divide="ignore"):
            delta = np.where(n > 0, weight * (w @ v.T - np.log(n)), 0)
        slope = {"w": delta @ v, "v": delta.T @ w}
        if bias:
            slope["v"][:, -1] = slope["w"][:, -2] = 0
        for s, x in (("v", v), ("w", w)):
            g, (m, q) = slope[s], state[s]
            if optimizer == "sgd":
                x -= 0.1 * g
            elif optimizer == "adagrad":
                q += g * g
                x -= 0.1 * g / (np.sqrt(q) + 1e-10)
            else:
                m[:], q[:] = 0.9 * m + 0.1 * g, 0.999 * q + 0.001 * g * g
                x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
        with np.errstate(divide="ignore"):
            losses.append(np.where(n > 0, weight / 2 * (w @ v.T - np.log(n)) ** 2, 0).sum())
    cells = co.with_marginals(matrix(spark, n.tolist()))
    params, got = tr.train(cells, start, mo.glove_loss(), mo.glove_delta(), rate=lambda t: 0.1, updates=3, optimizer=optimizer, bias=bias, every=1)
    assert got == pytest.approx(losses)
    found = {r.id: r for r in params.collect()}
    for k in range(5):
        assert found[k].v == pytest.approx(v[k].tolist()) and found[k].w == pytest.approx(w[k].tolist())
    if bias:
        back = {r.id: r for r in tr.without_biases(params).collect()}
        assert back[2].vb == pytest.approx(v[2][-2]) and back[2].wb == pytest.approx(w[2][-1]) and len(back[2].v) == 3


def test_an_update_shuffles_neither_cells_nor_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cells = matrix(spark, rng.integers(0, 4, (60, 60)).astype(float).tolist())
    cells = tr.cut(co.with_marginals(cells.unionByName(spark.createDataFrame([(0, 99, 3.0), (99, 1, 2.0)], cells.schema))))
    start = em.random_vectors(spark, 60, 3, seed=6, scale=0.5)
    plans, plain = [], tr.cut

    def seen(df, *args, **how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, *args, **how)

    monkeypatch.setattr(tr, "cut", seen)
    params, losses = tr.train(cells, start, mo.glove_loss(), mo.glove_delta(), rate=lambda t: 0.1, updates=2, optimizer="sgd", every=1)
    # Of the tables that are stored, an update's has one join, that of the parameters with the sums of their gradients.
    updates = [p for p in plans if "Join" in p]
    assert len(updates) == 2 and all(p.count("Join") == 1 for p in updates) and len(losses) == 2
    assert params.count() == 60
    monkeypatch.setattr(tr, "STRIDE", 7)
    narrow, again = tr.train(cells, start, mo.glove_loss(), mo.glove_delta(), rate=lambda t: 0.1, updates=2, optimizer="sgd", every=1)
    assert again == pytest.approx(losses)
    want = {r.id: r for r in params.collect()}
    assert all(r.v == pytest.approx(want[r.id].v) and r.w == pytest.approx(want[r.id].w) for r in narrow.collect())
    _, nothing = tr.train(cells, start, mo.glove_loss(), mo.glove_delta(), rate=lambda t: 0.1, updates=0)
    assert nothing == []


def test_training_that_diverges(spark):
    cells = co.with_marginals(matrix(spark, [[0, 50], [40, 0]]))
    with pytest.raises(runs.Diverged):
        tr.train(cells, tr.initial(spark, 2, 2), mo.glove_loss(), mo.glove_delta(), rate=lambda t: 1e4, updates=4, optimizer="sgd", every=2)
    with pytest.raises(ValueError):
        tr.train(cells, tr.initial(spark, 2, 2), mo.glove_loss(), mo.glove_delta(), rate=lambda t: 0.1, updates=1, optimizer="none")


def test_runs():
    assert [runs.rate_schedule("linear", 8, 4, end=2)(t) for t in (0, 2, 4, 9)] == [8, 5, 2, 2]
    assert [runs.rate_schedule("inverse", 6, 20, fraction=0.5)(t) for t in (0, 10, 20)] == [6, 6, 3]
    assert runs.rate_schedule(None, 3, 1)(7) == 3 and runs.significant(0.0123456) == 0.01235
    assert runs.is_rising([1, 2, 3]) and not runs.is_rising([3, 1, 2]) and runs.is_stationary([10, 9.5]) and not runs.is_stationary([10, 5])

    def run(rate):
        if rate > 0.3:
            raise runs.Diverged
        return [3.0, 2.0, 1.0]

    assert 0.1 <= runs.tuned_rate(run, 1000, goods=6) <= 0.3


PARSED = """1\tthe\t_\t_\t_\t_\t2\tdet
2\tcat\t_\t_\t_\t_\t4\tsubj
3\t,\t_\t_\t_\t_\t_\t_
4\tsat\t_\t_\t_\t_\t0\troot
"""


def test_dependency_corpus(spark):
    broken = PARSED.replace("\t4\tsubj", "\t3\tsubj")
    texts = spark.createDataFrame([(PARSED + "\n \n" + broken + "\n\n\n" + PARSED * 10,), (None,), ("",)], "text string")
    kept = de.rows(de.blocks(texts)).cache()
    arcs = de.arc_types(kept)
    assert sorted((r.id, r.token) for r in arcs.collect()) == [(0, "det"), (1, "root"), (2, "subj")]
    words = spark.createDataFrame([(0, "unknown"), (1, "[ROOT]"), (2, "cat"), (3, "sat")], "id int, token string")
    found = de.sentences(kept, words, arcs).collect()
    assert [(r.words, r.heads, r.arcs, r.n) for r in found] == [([1, 0, 2, 3], [None, 2, 3, 0], [None, 0, 2, 1], 4)]
    told = de.named(de.sentences(kept, words, arcs), words, arcs).orderBy("pos").collect()
    assert [(r.word, r.head, r.arc) for r in told] == [("[ROOT]", None, None), ("unknown", "cat", "det"), ("cat", "sat", "subj"), ("sat", "[ROOT]", "root")]


def test_cycles_of_long_sentences(spark):
    """Many sentences of 30 places, some with one cycle: found within seconds, not by nested expressions."""
    rng, rows, want = random.Random(3), [], {}
    for sent in range(2000):
        heads = [None, *(rng.randrange(m) for m in range(1, 30))]
        if sent % 3 == 0:
            ring = rng.sample(range(1, 30), rng.randint(2, 12))
            for a, b in zip(ring, ring[1:] + ring[:1]):
                heads[a] = b
            want[sent] = min(ring)
        rows.append((sent, heads))
    began = time.time()
    got = {r.sent: r.m for r in de.on_cycle(spark.createDataFrame(rows, "sent long, heads array<int>")).collect()}
    assert got == want and time.time() - began < 30


def test_parsing(spark):
    rows = [(1, [0, 1, 2], [None, 2, 0], 3), (2, [0, 3, 1, 2], [None, 2, 3, 1], 4), (3, [0, 2], [None, 0], 2)]
    found = spark.createDataFrame(rows, "sent long, words array<int>, heads array<int>, n int")
    assert [(r.sent, r.m) for r in de.on_cycle(found).collect()] == [(2, 1)]
    made = {r.sent: r for r in de.batches(found, 2).collect()}
    assert made[3].batch == 0 and made[3]["words"] == [0, 2, 0] and made[3]["mask"] == [False, False, True] and made[2]["batch"] == 1
    params = em.random_vectors(spark, 4, 3, seed=5, scale=1.0).withColumns({"vb": F.col("id") / 10.0, "wb": F.col("id") / -7.0})
    p = {r.id: r for r in params.collect()}
    link = lambda m, h: float(np.dot(p[m].w, p[h].v)) + p[m].wb + p[h].vb
    got = {r.sent: r.score for r in de.scores(found, params).collect()}
    assert got == pytest.approx({s: sum(link(w[m], w[h]) for m, h in enumerate(heads) if m) for s, w, heads, _ in rows})
    chances = de.head_chances(de.energies(found, params)).collect()
    for s, w, _, n in rows:
        for m in range(1, n):
            e = {h: math.exp(link(w[m], w[h])) for h in range(n) if h != m}
            assert {r.h: r.p for r in chances if (r.sent, r.m) == (s, m)} == pytest.approx({h: x / sum(e.values()) for h, x in e.items()})
    trees = de.tree_heads(de.head_chances(de.energies(found, params)), 3)
    assert trees.count() == 3 and de.on_cycle(trees).isEmpty()
    both = de.contrast(found, params, 2, 9).collect()
    assert len(both) == 3 and all(math.isfinite(r.negative_score) for r in both)
    loss = mo.negative_sample_loss(de.contrast(found, params, 1, 9), 3).first().loss
    assert math.isfinite(loss)
