"""Counts of pairs in packed stripes, and the whole-vocabulary queries that read their cells in the task that makes them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import cooccurrence as co
from lexigrid.operators import models as mo
from lexigrid.plans import catalogue, models, more, whole
from lexigrid.sources.corpus import all_words, lines

FLAT = ([1.0] * 5, [1.0] * 5)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Texts with tokens that stand alone, and nine vectors that floats don't hold."""
    path = tmp_path_factory.mktemp("packed")
    rng = random.Random(3)
    rows = [" ".join(f"w{int(120 * rng.random() ** 2)}" for _ in range(rng.randrange(1, 14))) for _ in range(150)] + ["alone", "w3", "", "other"]
    pq.write_table(pa.table({"doc_id": range(len(rows) // 2), "text": ["\n".join(rows[k : k + 2]) for k in range(0, len(rows), 2)]}), path / "documents.parquet")
    pq.write_table(pa.table({"vec_id": range(9), "embedding": [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(9)]}), path / "embeddings.parquet")
    return str(path)


def texts_and_vocab(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return lines(docs), co.vocabulary(co.unigram(all_words(docs)))


def counts(spark, folder):
    texts, vocab = texts_and_vocab(spark, folder)
    ids = {r.token: r.id for r in vocab.collect()}
    n = np.zeros((len(ids), len(ids)))
    for line in ([ids[w] for w in r.words] for r in texts.collect()):
        for p, i in enumerate(line):
            for q in range(max(0, p - 5), min(len(line), p + 6)):
                n[i, line[q]] += q != p
    return n


def scores(spark, folder, size):
    e = np.array([r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()])
    return e[np.arange(size) % 9], e[(7 * np.arange(size) + 3) % 9]


@pytest.mark.parametrize("right, left", [FLAT, ([1.0, 0.5], [1.0, 0.5]), ([0.75, 0.0, 2.5, 0.5], [0.0, 1.5]), ([1.0], [])])
def test_cells_of_every_side_are_alike(spark, folder, right, left, monkeypatch):
    """By lesser ids, rows or columns, whole or in ranges of ids: the same cells, whatever a task holds."""
    texts, vocab = texts_and_vocab(spark, folder)
    want = {(r.i, r.j): r.nij for r in co.cooccurrences(co.encoded(catalogue_tokens(spark, folder), vocab), right, left).collect()}
    assert len(want) > 500
    monkeypatch.setattr(co, "CHUNK_WORDS", 200)
    monkeypatch.setattr(co, "FREQUENT_IDS", 20)
    for side in (None, "i", "j"):
        packed = co.packed_pairs(texts, vocab, right, left, side=side, most=50)
        found = packed.cells().collect()
        assert len(found) == len(want) and {(r.i, r.j): r.nij for r in found} == pytest.approx(want)
        if side:
            two = packed.cells(between=(0, 30)).collect(), packed.cells(between=(30, None)).collect()
            assert {getattr(r, side) for r in two[0]} <= set(range(30)) and sorted(map(tuple, two[0] + two[1])) == sorted(map(tuple, found))


def catalogue_tokens(spark, folder):
    from lexigrid.sources.corpus import tokens

    return tokens(spark.read.parquet(f"{folder}/documents.parquet"))


def test_ids_beside_no_other_have_a_row(spark, folder):
    texts, vocab = texts_and_vocab(spark, folder)
    n = counts(spark, folder)
    found = co.packed_pairs(texts, vocab, *FLAT, side="j", alone=True).cells().where("i < 0").collect()
    assert {r.j for r in found} >= set(np.flatnonzero(n.sum(0) == 0)) and len(n) > (n.sum(0) > 0).sum() and all(r.nij == 0 for r in found)


def test_a_pair_takes_few_bytes(spark):
    """packs of 200,000 distinct pairs, which were arrays of over nine bytes a pair."""
    rng = np.random.default_rng(2)
    words = [pa.array((6_000 * rng.random(45_000) ** 2).astype(np.int32).reshape(-1, 15).tolist(), pa.list_(pa.int32()))]
    kinds, halves = co._halves(*FLAT, None)
    batch = co._packs(halves, len(kinds), 8, False, None)(words[0])
    pairs = sum(batch.column("entries").to_pylist())
    assert pairs > 100_000 and sum(len(p) for p in batch.column("pack").to_pylist()) < 3 * pairs


@pytest.mark.parametrize("most", [1, 7, 50, 1000])
def test_marginals_held_by_id(spark, folder, most, monkeypatch):
    """The same cells as `attach` gives, whatever goes through the driver at once, and cells of ids without a marginal go."""
    texts, vocab = texts_and_vocab(spark, folder)
    sums = co.cut(co.line_marginals(texts, vocab, *FLAT).where("id is null or id <> 4"), "marginals")
    cells = co.line_cooccurrences(texts, vocab, *FLAT)
    want = sorted(tuple(r)[:5] for r in co.attach(cells, sums).collect())
    add, n = co.held_marginals(sums, most)
    got = co.packed_pairs(texts, vocab, *FLAT).cells(add, "i int, j int, nij double, ni double, nj double").collect()
    assert want and sorted(map(tuple, got)) == want and n == sums.where("side = 'total'").first().n


def no_cells_stored(monkeypatch):
    """Labels of what is stored meanwhile."""
    labels = []
    for module in (co, catalogue, models, more):
        keep = module.cut
        monkeypatch.setattr(module, "cut", lambda df, label="table", by=(), keep=keep, **how: labels.append(label) or keep(df, label, by, **how))
    return labels


@pytest.mark.parametrize("name", ["cooccurrence_pmi_whole", "cooccurrence_exp_pmi_whole"])
def test_scores_of_cells_store_no_cells(spark, folder, name, monkeypatch):
    """cells meet their marginals in the task that counts them."""
    labels = no_cells_stored(monkeypatch)
    n = counts(spark, folder)
    value = n * n.sum() / np.maximum(np.outer(n.sum(1), n.sum(0)), 1)
    found = whole.QUERIES[name](spark, folder)
    assert "cells" not in labels and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): r[2] for r in found.collect()}
    assert got == pytest.approx({(i, j): np.log(value[i, j]) if "exp" not in name else value[i, j] for i, j in zip(*np.nonzero(n))}, abs=2e-6)


def test_frequent_cells_are_kept_where_they_are_counted(spark, folder):
    """no cell but the kept ones leaves the task that counts it, and none is joined."""
    n = counts(spark, folder)
    found = more.cooccurrence_threshold_marginals(spark, folder)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    kept = zip(*np.nonzero(n > 10))
    assert sorted(map(tuple, found.collect())) == sorted((i, j, n[i, j], n[i].sum(), n[:, j].sum(), n.sum()) for i, j in kept)


def test_pairs_not_asked_for_are_not_shuffled(spark, folder):
    """of all pairs those asked for, and hardly any other, are packed."""
    texts, vocab = texts_and_vocab(spark, folder)
    cells = {(r.i, r.j): r.nij for r in co.line_cooccurrences(texts, vocab, *FLAT).collect()}
    chosen = random.Random(1).sample(sorted(cells), 40)
    asked = co.cut(spark.createDataFrame([*chosen, (0, 99_999)], "i int, j int"), "pairs")
    packed = co.packed_pairs(texts, vocab, *FLAT, asked=asked)
    found = {(r.i, r.j): r.nij for r in packed.cells().collect()}
    wanted = {*chosen, *((j, i) for i, j in chosen)}
    assert found.items() >= {(k, cells[k]) for k in wanted} and len(found) < len(wanted) + 0.05 * len(cells) and len(cells) > 1000


def test_balanced_loss_sums_where_cells_are(spark, folder, monkeypatch):
    """F1: neither cells nor their scores are stored, joined or handed on as rows."""
    labels = no_cells_stored(monkeypatch)
    n = counts(spark, folder)
    v, w = scores(spark, folder, len(n))
    p, s = n * n.sum() / np.maximum(np.outer(n.sum(1), n.sum(0)), 1), v @ w.T
    found = whole.QUERIES["loss_balanced_mle_whole"](spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cells" not in labels and "Join" not in plan and "score" not in plan
    assert found.first().loss == pytest.approx((np.exp(s) - p * s)[n > 0].mean(), abs=2e-6)


@pytest.mark.parametrize("name", ["dense_response_whole", "sample_response_bias_whole"])
def test_responses_are_scored_where_cells_are(spark, folder, name):
    """cells are handed on once, with their scores, and doubles aren't cut to floats."""
    n = counts(spark, folder)
    v, w = scores(spark, folder, len(n))
    ids = np.arange(len(n))
    want = w @ v.T if "dense" in name else v @ w.T + ((ids % 11 - 5) / 100)[:, None] + ((3 * ids % 11 - 5) / 100)[None]
    found = whole.QUERIES[name](spark, folder)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert {(r.i, r.j): r.score for r in found.collect()} == pytest.approx({(i, j): want[i, j] for i, j in zip(*np.nonzero(n))}, abs=5.1e-7)


def test_descent_step_broadcasts_no_rows(spark, folder, monkeypatch):
    """vectors move in the task that sums their slopes, those of tokens beside no other too; no table goes through the driver's heap as rows."""
    n = counts(spark, folder)
    v, w = scores(spark, folder, len(n))
    slope = np.where(n > 0, 2 * np.minimum((n / 100) ** 0.75, 1) * (w @ v.T - np.log(np.maximum(n, 1))), 0)
    want = v - 1e-4 * slope.T @ w
    monkeypatch.setattr(co, "FREQUENT_IDS", 10)
    found = whole.QUERIES["descent_step_glove_whole"](spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Join" not in plan
    assert {(r.id, r.dim): r.x for r in found.collect()} == pytest.approx({(i, k): want[i, k] for i in range(len(n)) for k in range(3)}, abs=6e-7)


def test_dense_gradient_joins_no_vectors(spark, folder, monkeypatch):
    """F8: vectors of sums are taken by the task that sums the cells of a column; neither is joined or shuffled, but of frequent ids."""
    n = counts(spark, folder)
    v, w = scores(spark, folder, len(n))
    part = np.outer(n.sum(1), n.sum(0)) / n.sum() ** 2
    want = (part * np.exp(w @ v.T) - n / n.sum()).T @ w
    monkeypatch.setattr(co, "FREQUENT_IDS", 10)
    found = whole.QUERIES["grad_mle_v_whole"](spark, folder)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.dim): r.g for r in found.collect()}
    assert got == pytest.approx({(j, k): want[j, k] for j in np.flatnonzero(n.sum(0)) for k in range(3)}, abs=2e-9)


def test_dense_passes_hold_a_block_of_scores(spark):
    """F8, F9: however many vectors there are, scores are made a block at a time, so that vectors are read once a block of rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.4, (700, 3))
    table = spark.createDataFrame([(k, y.tolist()) for k, y in enumerate(x)], "id long, v array<double>")
    masses = spark.createDataFrame([(k, float(k + 1)) for k in range(0, 700, 2)] + [(9_999, 1.0)], "number long, mass double")

    def bounded(score):
        assert score.size <= 256 * 64
        return np.exp(score)

    m = np.where(np.arange(700) % 2 == 0, np.arange(700) + 1.0, 0)
    got = {r.id: r for r in mo.numbered_sums(table, masses, bounded, vectors=True, block=256 * 64).collect()}
    want = np.exp(x @ x.T) * m
    assert got.keys() == set(range(700)) and [got[k].f for k in range(700)] == pytest.approx(want.sum(1)) and np.allclose([got[k].g for k in range(700)], want @ x)
    some = mo.numbered_sums(table, masses, bounded, of=spark.createDataFrame([(5,), (5,), (9_999,)], "number long"), block=256 * 64).collect()
    assert [r.id for r in some] == [5] and some[0].f == pytest.approx(want[5].sum())


def test_softplus_of_any_score():
    s = np.array([-800.0, -30.0, -1e-9, 0.0, 2.5, 40.0])
    assert models._softplus(s.copy()) == pytest.approx(np.logaddexp(0, s), abs=1e-15)
    s = np.array([-3.0, 900.0])
    assert models._softplus(s.copy()) == pytest.approx(np.logaddexp(0, s))


def test_sgns_loss_sums_by_row_where_cells_are(spark, folder):
    """cells are in the lots of their rows, and meet marginals and vectors there; only sums of rows are shuffled."""
    n = counts(spark, folder)
    v, w = scores(spark, folder, len(n))
    s, softplus = w @ v.T, np.logaddexp(0, w @ v.T)
    want = (n * (softplus - s) + 15 * (n.sum(1)[:, None] - n) * (n.sum(0) / n.sum())[None] * softplus)[:, n.sum(0) > 0].sum(1)
    found = whole.QUERIES["loss_sgns_whole"](spark, folder)
    assert "score" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.loss for r in found.collect()} == pytest.approx({i: want[i] for i in np.flatnonzero(n.sum(1))}, abs=6e-6)
