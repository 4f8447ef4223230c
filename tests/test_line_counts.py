from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import cooccurrence as co
from lexigrid.sources.corpus import all_words, lines
from lexigrid.sources.shared import cut

TEXTS = ["a b a c", "b b a\nd a c c b a", "e", "c d\n\nf a a a", None, "x a y b z c a b c d e f g"]


def counted(spark, right, left, most):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id int, text string")
    vocab = co.vocabulary(co.unigram(all_words(docs))).where("token <> 'y'")
    return lines(docs), vocab, co.line_cooccurrences(lines(docs), vocab, right, left, most=most)


@pytest.mark.parametrize("most", [1, 3, 100])
@pytest.mark.parametrize("right, left", [([1.0] * 5, [1.0] * 5), ([0.75, 0.0, 2.5, 0.5], [0.0, 1.5]), ([1.0], [])])
def test_marginals_need_no_cells(spark, right, left, most):
    """Equal to the marginals of the cells, plain and thinned, whichever part of the vocabulary is broadcast."""
    texts, vocab, cells = counted(spark, right, left, most)
    want = {(r.side, r.id): r.n for r in co.marginals(cells).collect()}
    found = co.line_marginals(texts, vocab, right, left, most=most)
    assert {(r.side, r.id): r.n for r in found.collect()} == pytest.approx(want)
    assert "hi" not in found._jdf.queryExecution().toString()
    thin = vocab.select("id", F.lit(0.5).alias("p")).where("id < 2")
    p = lambda x: F.when(F.col(x) < 2, 0.5).otherwise(1.0)
    want = {(r.side, r.id): r.n for r in co.marginals(cells.withColumn("nij", F.col("nij") * p("i") * p("j"))).collect()}
    assert {(r.side, r.id): r.n for r in co.line_marginals(texts, vocab, right, left, thin=thin, most=most).collect()} == pytest.approx(want)


def test_stripes_of_any_vocabulary_count_alike(spark):
    """Cells don't depend on how many tokens are broadcast; those of equal weights are shuffled once, a row a lesser id."""
    for right, left, kinds in (([1.0] * 5, [1.0] * 5, 1), ([1.0, 0.5], [1.0, 0.5], 2), ([0.75, 0.0, 2.5, 0.5], [0.0, 1.5], 8)):
        assert len(co._kinds(right, left)[0]) == kinds
        tables = [sorted(tuple(r) for r in counted(spark, right, left, most)[2].collect()) for most in (1, 4, 100)]
        assert tables[0] == tables[1] == tables[2] and tables[0]
    plan = counted(spark, [1.0] * 5, [1.0] * 5, 1)[2]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lo" in plan and "hashpartitioning(row" not in plan and "Window" not in plan


def test_marginals_meet_cells_by_broadcast(spark):
    """Cells are counted once; frequent ids are broadcast, others joined, with the same rows."""
    texts, vocab, cells = counted(spark, [1.0] * 5, [1.0] * 5, 100)
    sums = co.marginals(cells)
    want = sorted(tuple(r) for r in co.attach(cells, sums).collect())
    assert want and all(sorted(tuple(r) for r in co.attach(cells, sums, most=k).collect()) == want for k in (0, 1, 3))
    full = co.with_marginals(cells, co.line_marginals(texts, vocab, [1.0] * 5, [1.0] * 5))
    assert sorted(tuple(r) for r in full.collect()) == want
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange hashpartitioning" not in plan
    thinned = co.undersampled(cut(cells), cut(vocab), 1e-3)
    assert thinned.count() == len(want) and "SortMergeJoin" not in thinned._jdf.queryExecution().executedPlan().toString()


def test_numbered_scores_equal_joined_ones(spark, tmp_path):
    """Scores and gradients over all cells equal those of joined parameters, and no vector is shuffled."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lexigrid.operators import models as mo
    from lexigrid.plans import models

    pq.write_table(pa.table({"doc_id": range(len(TEXTS)), "text": TEXTS}), tmp_path / "documents.parquet")
    vectors = [[(k * d * 7 % 11 - 5) / 10 for d in (1, 2, 3)] for k in range(1, 6)]
    pq.write_table(pa.table({"vec_id": range(5), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    d, params = str(tmp_path), models._params(spark, str(tmp_path), None)
    cells = cut(models._model_cells(spark, d, None))
    for dense, joined in ((True, mo.dense_scores), (False, mo.sample_scores)):
        found = models._turns(spark, d, cells, dense, True)[0]
        assert "Join" not in found._jdf.queryExecution().toString()
        want = {(r.i, r.j): r.score for r in joined(cells, params, True).collect()}
        assert {(r.i, r.j): r.score for r in found.collect()} == pytest.approx(want)
    slope = mo.gradient(mo.dense_scores(cells, params), mo.glove_delta(), "v")
    want = {(r.id, r.dim): r.g for r in slope.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = {(r.id, k): g for r in models._whole_slopes(spark, d).collect() for k, g in enumerate(r.g)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == pytest.approx(want) and len(want) > 20
    after = mo.descend(params, slope, 1e-4, "v")
    moved = {(r.id, k): round(x, 6) for r in after.collect() for k, x in enumerate(r.v)}
    assert {(r.id, r.dim): r.x for r in models.descent_step_glove(spark, d, size=None).collect()} == pytest.approx(moved, abs=2e-6)


def test_dense_passes_over_shared_vectors(spark, tmp_path):
    """Losses and slopes over every pair equal those in blocks, though only pairs of vectors are scored."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lexigrid.operators import tiles as ti
    from lexigrid.plans import models

    pq.write_table(pa.table({"doc_id": range(len(TEXTS)), "text": TEXTS}), tmp_path / "documents.parquet")
    vectors = [[(k * d * 7 % 11 - 5) / 10 for d in (1, 2, 3)] for k in range(1, 6)]
    pq.write_table(pa.table({"vec_id": range(5), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    d = str(tmp_path)
    for form, run in ((ti.mle(), models.loss_mle), (ti.sgns(), models.loss_sgns)):
        want = {r.id: r.loss for r in models._dense(spark, d, form, None).collect()}
        assert {r.i: r.loss for r in run(spark, d, size=None).collect()} == pytest.approx(want, abs=2e-5) and len(want) > 8
    want = {(r.id, k): x for r in models._dense(spark, d, ti.mle(), None, loss=False, slopes=("v",)).collect() for k, x in enumerate(r.g)}
    found = models.grad_mle_v(spark, d, size=None)
    assert {(r.id, r.dim): r.g for r in found.collect()} == pytest.approx(want, abs=2e-9)
    assert "CoGroup" not in found._jdf.queryExecution().toString()


def test_sentences_meet_scores_of_word_pairs(spark):
    """Each distinct pair of words is scored once; sentences are shuffled, not their pairs or vectors."""
    from lexigrid.operators import dependency as de

    found = spark.createDataFrame([(s, [0, 3, 4, 3], [None, 0, 1, 1], 4) for s in range(40)] + [(99, [0, 5], [None, 0], 2)], "sent long, words array<int>, heads array<int>, n int")
    params = spark.createDataFrame([(k, [0.1 * k, 1.0], [1.0, 0.2 * k], 0.5 * k, -0.1 * k) for k in range(6)], "id int, v array<double>, w array<double>, vb double, wb double")
    pair = lambda m, h: 0.1 * h + 0.2 * m - 0.1 * m + 0.5 * h
    got = de.scores(found, params)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.sent: r.score for r in got.collect()} == pytest.approx({s: pair(3, 0) + pair(4, 3) + pair(3, 3) for s in range(40)} | {99: pair(5, 0)})
    pairs = spark.createDataFrame([(1, 2), (1, 2), (4, 4)], "mw int, hw int")
    assert sorted(r.energy for r in de.with_energy(pairs, params, most=0).collect()) == pytest.approx(sorted([pair(1, 2), pair(1, 2), pair(4, 4)]))
    chances = de.head_chances(de.energies(found, params)).groupBy("sent").agg(F.sum("p").alias("p"))
    plan = chances._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert {r.sent: r.p for r in chances.collect()} == pytest.approx({s: 3.0 for s in range(40)} | {99: 1.0})


def test_only_cells_of_asked_pairs_are_shuffled(spark, monkeypatch):
    """Of all cells only those of drawn pairs meet the marginals, and only those of asked pairs leave their partition."""
    from lexigrid.plans import more

    met, attach = [], co.attach
    monkeypatch.setattr(co, "attach", lambda cells, sums: met.append(cells.count()) or attach(cells, sums))
    drawn = more.sample_balanced(spark, "/root/testdata/sf0.001")
    assert 0 < met[0] <= drawn.select("i", "j").distinct().count()
    _, vocab, cells = counted(spark, [1.0] * 5, [1.0] * 5, 100)
    asked = spark.createDataFrame([("a", "b"), ("a", "never"), ("e", "a"), ("never", "e")], "focal string, context string")
    found = co.cell_count(cut(cells), cut(vocab), asked)
    assert "BroadcastHashJoin [i" in found._jdf.queryExecution().executedPlan().toString()
    ids = {r.token: r.id for r in vocab.collect()}
    nij = {(r.i, r.j): r.nij for r in cells.collect()}
    assert {(r.focal, r.context): r.nij for r in found.collect()} == {(a, b): nij.get((ids.get(a), ids.get(b)), 0.0) for a, b in (("a", "b"), ("a", "never"), ("e", "a"), ("never", "e"))}


def test_a_stored_table_is_counted_once(spark, tmp_path):
    from lexigrid.sources import store

    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    cells = spark.range(60).selectExpr("cast(id % 8 as int) i", "cast(id / 8 as int) j", "1.0D nij").mapInArrow(seen, "i int, j int, nij double")
    vocab = spark.range(8).selectExpr("cast(id as int) id", "concat('t', id) token", "1L n")
    store.save_cooccurrences(cells, vocab, str(tmp_path / "table"), 2)
    assert rows.value == 60 and store.load_cells(spark, str(tmp_path / "table")).count() == 60
