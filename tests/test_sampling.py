from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import cooccurrence as co
from lexigrid.operators import embeddings as em
from lexigrid.operators import sampling as sa


def weights_of(spark, seed=3, size=150):
    """A key with a third of all weight, many small ones, some without any."""
    rng = np.random.default_rng(seed)
    w = rng.random(size) ** 4
    w[7] = w.sum() / 2
    w[[3, 40]] = 0
    return w, spark.createDataFrame([(k, k % 5, float(x)) for k, x in enumerate(w)], "i int, j int, p double").repartition(5)


def unlike(counts, shares):
    """Chi-square by its degrees of freedom."""
    total, kept = counts.sum(), shares > 0
    assert counts[~kept].sum() == 0
    return ((counts[kept] - total * shares[kept]) ** 2 / (total * shares[kept])).sum() / (kept.sum() - 1)


def test_walker_tables_hold_the_weights():
    rng = np.random.default_rng(1)
    for w in (rng.random(1), rng.random(50) ** 9, np.r_[np.ones(9), 1e6], np.full(7, 3.0)):
        chance, other = sa.walker(w)
        share = np.bincount(np.arange(len(w)), chance, len(w)) + np.bincount(other, 1 - chance, len(w))
        assert share / len(w) == pytest.approx(w / w.sum())


@pytest.mark.parametrize("bucket", [3, 10_000])
def test_alias_draws_follow_the_weights(spark, bucket):
    w, table = weights_of(spark)
    made = sa.alias_table(table, ["i", "j"], "p", bucket)
    assert len(made.sizes) == (1 if bucket > 1000 else 50)
    got = sa.alias_sampled(sa.draws(spark, 40_000, 5), made)
    assert got.where("j <> i % 5").isEmpty() and got.agg(F.count_distinct("n")).first()[0] == got.count() == 40_000
    counts = np.zeros(len(w))
    for r in got.groupBy("i").count().collect():
        counts[r.i] = r["count"]
    assert unlike(counts, w / w.sum()) < 1.4
    with pytest.raises(ValueError):
        sa.alias_table(table.where("p = 0"), ["i"], "p")


def test_cumulative_shares_and_even_draws(spark):
    w, table = weights_of(spark)
    shares = sa.distribution(table, ["i", "j"], "p")
    got = {r.i: (r.low, r.high) for r in shares.collect()}
    high = np.cumsum(w) / w.sum()
    assert [got[k][1] for k in range(len(w))] == pytest.approx(high.tolist())
    assert "Window" not in shares._jdf.queryExecution().toString()
    drawn = sa.sampled(sa.draws(spark, 5_000, 2, spread=sa.even), shares)
    counts = np.zeros(len(w))
    for r in drawn.groupBy("i").count().collect():
        counts[r.i] = r["count"]
    # Evenly spread draws miss a share by far less than chance would.
    assert counts.sum() == 5_000 and np.abs(np.cumsum(counts) / 5_000 - high).max() < 0.002
    assert sa.distribution(table.limit(0), ["i"], "p").count() == 0


def test_gibbs_steps_follow_the_conditional(spark):
    params = em.random_vectors(spark, 12, 4, seed=2, scale=1.2)
    marginal = spark.createDataFrame([(k, float((k % 4) ** 2)) for k in range(12)], "id int, p double")
    p = {r.id: r for r in params.collect()}
    want = np.array([(k % 4) ** 2 * np.exp(np.dot(p[5].v, p[k].w)) for k in range(12)])
    chances = {r.id: r.p for r in sa.conditional(spark.createDataFrame([(0, 5)], "n long, id int"), params, marginal, "v", "w").collect()}
    assert chances == pytest.approx({k: x / want.sum() for k, x in enumerate(want) if x})
    given = spark.range(20_000).select(F.col("id").alias("n"), F.lit(5).alias("id"))
    one = sa.gibbs_step(given, params, marginal, "v", "w", sa.hashed_noise(3))
    counts = np.zeros(12)
    for r in one.groupBy("id").count().collect():
        counts[r.id] = r["count"]
    assert counts.sum() == 20_000 and unlike(counts, want / want.sum()) < 2.5
    again = sa.gibbs_step(given.repartition(9), params, marginal, "v", "w", sa.hashed_noise(3))
    assert one.join(again.withColumnRenamed("id", "other"), "n").where("id = other").count() == 20_000
    other = sa.gibbs_step(given, params, marginal, "v", "w", sa.hashed_noise(4))
    assert one.join(other.withColumnRenamed("id", "other"), "n").where("id = other").count() < 19_000
    assert sa.gibbs_step(given.limit(0), params, marginal, "v", "w", sa.hashed_noise(3)).count() == 0


def test_chances_of_many_blocks_are_not_shuffled(spark, monkeypatch):
    params = em.random_vectors(spark, 50, 4, seed=2, scale=1.2)
    marginal = spark.createDataFrame([(k, float(1 + k % 4)) for k in range(50)], "id int, p double")
    given = spark.createDataFrame([(7 * k, k) for k in range(20)] + [(5000, 99)], "n long, id int")
    p = {r.id: r for r in params.collect()}
    want = {}
    for k in range(20):
        chances = np.array([(1 + j % 4) * np.exp(np.dot(p[k].v, p[j].w)) for j in range(50)])
        want |= {(7 * k, j): x for j, x in enumerate(chances / chances.sum())}
    plan = sa.conditional(given, params, marginal, "v", "w")._jdf.queryExecution().executedPlan().toString()
    # Nothing is shuffled after the rows of the result are there.
    assert "Exchange" not in plan[: plan.index("FlatMap")] and "Join" not in plan[: plan.index("FlatMap")]
    monkeypatch.setattr(sa, "ASKED", 6)
    monkeypatch.setattr(sa, "PARTNERS", 9)
    found = sa.conditional(given, params, marginal, "v", "w").collect()
    assert len(found) == 1_000 and {(r.n, r.id): r.p for r in found} == pytest.approx(want)
    assert sa.conditional(given.limit(0), params, marginal, "v", "w").count() == 0
    assert sa.conditional(given, params, marginal.limit(0), "v", "w").count() == 0


def test_a_sampler_of_pairs(spark):
    n = [[0, 70, 20, 10], [30, 0, 0, 40], [0, 60, 0, 0], [20, 0, 50, 0]]
    cells = spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(n) for j, x in enumerate(r) if x], "i int, j int, nij double")
    sums = co.marginals(cells)
    sampler = sa.PairSampler(co.attach(cells, sums), sums, 2.0)
    ni, nj, total = np.sum(n, 1), np.sum(n, 0), np.sum(n)
    want = np.array(n) * np.sqrt(np.outer(ni, nj) / total**2) ** -1
    for found, share in ((sampler.positives(20_000, 1), want / want.sum()), (sampler.independent(20_000, 1), np.outer(ni**0.5, nj**0.5) / np.outer(ni**0.5, nj**0.5).sum())):
        counts = np.zeros((4, 4))
        for r in found.groupBy("i", "j").count().collect():
            counts[r.i, r.j] = r["count"]
        assert unlike(counts.ravel(), share.ravel()) < 2.5
    both = sampler.batch(300, 4)
    assert {(r.positive, r["count"]) for r in both.groupBy("positive").count().collect()} == {(True, 300), (False, 300)}
    far = sampler.gibbs_batch(200, em.random_vectors(spark, 4, 3, seed=2), 2, 9)
    assert {(r.positive, r["count"]) for r in far.groupBy("positive").count().collect()} == {(True, 200), (False, 200)}
    assert far.where("i is null or j is null").isEmpty()
    for plan in (sampler.batch(9, 1), sampler.positives(9, 1)):
        assert "Window" not in plan._jdf.queryExecution().toString()
