from __future__ import annotations

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import dependency as de
from lexigrid.operators import embeddings as em
from lexigrid.operators import models as mo
from lexigrid.operators import sampled_training as st
from lexigrid.operators import training as tr


def is_tree(heads):
    for m in range(1, len(heads)):
        at, steps = m, 0
        while at and steps <= len(heads):
            at, steps = heads[at], steps + 1
        if at:
            return False
    return True


def test_trees_follow_the_product_of_chances(spark):
    """All trees of four words and the root, against as many draws: every sentence has the same chances."""
    rng = np.random.default_rng(8)
    p = rng.random((5, 5)) ** 2
    np.fill_diagonal(p, 0)
    p[1:] /= p[1:].sum(1, keepdims=True)
    trees = {(None, *h): math.prod(p[m + 1, x] for m, x in enumerate(h)) for h in product(range(5), repeat=4) if is_tree((None, *h)) and all(x != m + 1 for m, x in enumerate(h))}
    assert len(trees) == 125
    total = sum(trees.values())
    one = spark.createDataFrame([(m, h, float(p[m, h])) for m in range(1, 5) for h in range(5) if h != m], "m int, h int, p double")
    chances = spark.range(30_000).withColumnRenamed("id", "sent").crossJoin(one)
    drawn = de.tree_heads(chances, 4)
    assert "Window" not in drawn._jdf.queryExecution().toString()
    got = Counter(tuple(r.heads) for r in drawn.collect())
    assert sum(got.values()) == 30_000 and set(got) <= set(trees)
    unlike = sum((got[t] - 30_000 * w / total) ** 2 / (30_000 * w / total) for t, w in trees.items())
    assert unlike / 124 < 1.5


def test_trees_of_sentences_of_any_length(spark):
    rng = random.Random(2)
    rows = [(s, m, h, rng.random()) for s in range(300) for n in [rng.randint(1, 29)] for m in range(1, n + 1) for h in range(n + 1) if h != m]
    chances = spark.createDataFrame(rows, "sent long, m int, h int, p double").repartition(6)
    first, again, other = ({r.sent: r.heads for r in de.tree_heads(t, s).collect()} for t, s in ((chances, 1), (chances.repartition(2), 1), (chances, 2)))
    assert first == again != other and len(first) == 300 and all(h[0] is None and is_tree(h) for h in first.values())
    ring = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0)], "sent long, m int, h int, p double")
    with pytest.raises(Exception, match="cycles are left"):
        de.tree_heads(ring, 1, rounds=50).collect()
    assert de.tree_heads(ring.limit(0), 1).count() == 0


def planted(spark):
    """Word 1's head is 2, word 2's is 3 and word 3's is the root, in any order of a sentence."""
    rng, rows = random.Random(5), []
    for s in range(40):
        order = rng.sample([1, 2, 3], 3)
        place = {w: k + 1 for k, w in enumerate(order)} | {0: 0}
        rows.append((s, [0, *order], [None, *(place[{1: 2, 2: 3, 3: 0}[w]] for w in order)], 4))
    return spark.createDataFrame(rows, "sent long, words array<int>, heads array<int>, n int")


def test_parser_steps_equal_brute_force_and_heads_are_learned(spark, tmp_path):
    found = planted(spark)
    start = tr.with_biases(em.random_vectors(spark, 4, 3, seed=5, scale=0.3))
    rows = {r.id: r for r in start.collect()}
    v, w = (np.array([rows[k][s] for k in range(4)]) for s in "vw")
    table = st.ParameterTable.create(start, str(tmp_path / "run"), "sgd")
    make, seen = de.parser_batches(found, 2, 2, 11), []

    def batch(k, params):
        pairs = st.cut(make(k, params))
        seen.append(pairs.collect())
        return pairs

    losses = st.train_sampled(table, batch, de.parser_loss(), size=1, rate=lambda t: 3.0, updates=4, bias=True, needs_params=True)
    want = []
    for pairs in seen:
        gv, gw = np.zeros_like(v), np.zeros_like(w)
        want.append(sum(r.sign * float(v[r.i] @ w[r.j]) for r in pairs))
        for r in pairs:
            gv[r.i] += r.sign * w[r.j]
            gw[r.j] += r.sign * v[r.i]
        gv[:, -1] = gw[:, -2] = 0
        v, w = v - 3.0 * gv, w - 3.0 * gw
        # Each sentence has its heads once, and two drawn trees.
        signs = Counter((r.sent, r.sign > 0) for r in pairs)
        assert {n for (_, far), n in signs.items() if far} == {6} and {n for (_, far), n in signs.items() if not far} == {3}
        assert sum(r.sign for r in pairs) == pytest.approx(0)
    assert losses == pytest.approx(want)
    after = {r.id: r for r in table.current().collect()}
    assert all(after[k].v == pytest.approx(v[k].tolist()) and after[k].w == pytest.approx(w[k].tolist()) for k in range(4))
    right = []
    for params in (start, table.current()):
        plain = params.select("id", "v", "w", F.lit(0.0).alias("vb"), F.lit(0.0).alias("wb"))
        chances = de.head_chances(de.energies(found, plain))
        given = found.select("sent", F.posexplode("heads").alias("m", "h"))
        right.append(chances.join(given, ["sent", "m", "h"]).agg(F.avg("p").alias("p")).first().p)
    assert right[0] < 0.45 < 0.6 < right[1]


def test_sense_gradients_are_slopes(spark):
    rng = np.random.default_rng(3)
    v, w = rng.normal(0, 0.7, (2, 4, 3, 2))
    vb, wb = rng.normal(0, 0.5, (2, 4, 3))
    pairs = [(0, 1, 2.0), (0, 0, -1.0), (3, 1, 0.5), (2, 3, 1.0), (0, 1, 1.5)]

    def loss(v, w, vb, wb):
        return sum(c * math.log(np.exp(w[j] @ v[i].T + wb[j][:, None] + vb[i]).sum()) for i, j, c in pairs)

    params = spark.createDataFrame([(k, v[k].tolist(), w[k].tolist(), vb[k].tolist(), wb[k].tolist()) for k in range(4)], "id int, v array<array<double>>, w array<array<double>>, vb array<double>, wb array<double>")
    table = spark.createDataFrame(pairs, "i int, j int, c double")
    got = mo.sense_gradients(table, params, F.col("c"), 3, 2).collect()
    assert {(r.id, r.side) for r in got} == {(0, "v"), (2, "v"), (3, "v"), (0, "w"), (1, "w"), (3, "w")} and len(got) == 18
    step, kinds = 1e-6, {"v": (0, 2), "w": (1, 3)}
    for r in got:
        for at, value in [*(((kinds[r.side][0], (r.id, r.sense, k)), g) for k, g in enumerate(r.g)), ((kinds[r.side][1], (r.id, r.sense)), r.gb)]:
            up, down = ([x.copy() for x in (v, w, vb, wb)] for _ in range(2))
            up[at[0]][at[1]] += step
            down[at[0]][at[1]] -= step
            assert value == pytest.approx((loss(*up) - loss(*down)) / (2 * step), rel=1e-5, abs=1e-7)
