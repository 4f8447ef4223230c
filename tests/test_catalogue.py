from __future__ import annotations

import duckdb
import pytest

from lexigrid.functions.kernels import kernel
from lexigrid.operators import cooccurrence as co
from lexigrid.operators import embeddings as em
from lexigrid.plans import catalogue
from lexigrid.sources.corpus import lines, tokens

TEXT = "a b a\nb  c \n\n\ta"


def brute(lines, right, left):
    out = {}
    for line in lines:
        for p, focal in enumerate(line):
            for k, w in enumerate(right, 1):
                if p + k < len(line):
                    out[focal, line[p + k]] = out.get((focal, line[p + k]), 0) + w
            for k, w in enumerate(left, 1):
                if p >= k:
                    out[focal, line[p - k]] = out.get((focal, line[p - k]), 0) + w
    return {k: v for k, v in out.items() if v}


def test_tokens_and_vocabulary(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    found = tokens(docs)
    assert [(r.line_no, r.pos, r.token) for r in found.orderBy("line_no", "pos").collect()] == [
        (0, 0, "a"), (0, 1, "b"), (0, 2, "a"), (1, 0, "b"), (1, 1, "c"), (3, 0, "a"),
    ]
    vocab = co.vocabulary(co.unigram(found), size=2)
    assert [(r.id, r.token, r.n) for r in vocab.orderBy("id").collect()] == [(0, "a", 3), (1, "b", 2)]


@pytest.mark.parametrize("name,window,weights", [("flat", 2, None), ("harmonic", 3, None), ("dynamic", 2, None), ("custom", None, ([0.75, 0, 2.5, 0.5], [0, 1.5]))])
def test_windows_equal_brute_force(spark, name, window, weights):
    texts = [TEXT, "c a b b a c a", "z z a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = tokens(docs)
    vocab = co.vocabulary(co.unigram(words), size=3)
    token = {r.id: r.token for r in vocab.collect()}
    right, left = kernel(name, window, weights)
    got = {(token[r.i], token[r.j]): r.nij for r in co.cooccurrences(co.encoded(words, vocab), right, left).collect()}
    lines = [[w for w in line.split() if w in token.values()] for t in texts for line in t.split("\n")]
    assert got == pytest.approx(brute(lines, right, left))


def test_kernels_reject_what_does_not_go_together():
    for args in (("flat",), ("custom", 3), ("flat", 2, ([1], [1])), ("round", 2)):
        with pytest.raises(ValueError):
            kernel(*args)


def test_matrix(spark):
    """A table that is not symmetric, with row sums 7, 6, 5 and column sums 6, 8, 4."""
    rows = [[0, 5, 2], [4, 0, 2], [2, 3, 0]]
    cells = spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(rows) for j, x in enumerate(r) if x], "i int, j int, nij double")
    sums = {(r.side, r.id): r.n for r in co.marginals(cells).collect()}
    assert [sums["row", k] for k in range(3)] == [7, 6, 5] and [sums["column", k] for k in range(3)] == [6, 8, 4] and sums["total", None] == 18
    assert {(r.i, r.j): r.nij for r in co.truncated(cells, 2).collect()} == {(0, 1): 5, (1, 0): 4}
    assert {r.nij for r in co.merge(cells, cells).collect()} == {4.0, 6.0, 8.0, 10.0}
    kept = {(r.i, r.j): (r.nij, r.ni, r.nj, r.n) for r in co.attach(co.above(cells, 2), co.marginals(cells)).collect()}
    assert kept == {(0, 1): (5, 7, 8, 18), (1, 0): (4, 6, 6, 18), (2, 1): (3, 5, 8, 18)}


def test_both_plans_agree_and_repeated_ids_stay_apart(spark):
    """Lines of one doc_id, or of none, don't run into one another, whichever plan counts them."""
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (None, "a d\nb b"), (None, "c a"), (1, "a b")], "doc_id long, text string")
    vocab = co.vocabulary(co.unigram(tokens(docs)))
    token = {r.id: r.token for r in vocab.collect()}
    want = brute([t.split() for t in ("a b", "c d", "a d", "b b", "c a", "a b")], [1.0, 2.0], [0.5])
    for cells in (
        co.cooccurrences(co.encoded(tokens(docs), vocab), [1.0, 2.0], [0.5]), co.line_cooccurrences(lines(docs), vocab, [1.0, 2.0], [0.5]),
        co.line_cooccurrences(lines(docs), vocab, [1.0, 2.0], [0.5], most=2),
    ):
        assert {(token[r.i], token[r.j]): r.nij for r in cells.collect()} == pytest.approx(want)


@pytest.mark.parametrize("name", [f"embedding_{kind}_{score}" for kind in ("nearest", "neighbours") for score in ("product", "cosine")])
def test_neighbours_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    found = catalogue.QUERIES[name](spark, folder)
    want = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    got = sorted(tuple(r) for r in found.select("query_id", "rank", "id", "score").collect())
    assert got == sorted(want.select("query_id", "rank", "id", "score").fetchall())
    if "neighbours" in name:
        assert {r[0] for r in got} == {r[0] for r in db.sql("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}


def test_neighbours_in_blocks(spark):
    rows = [(k, [float(k * 7 % 11), float(k % 5), 1.0]) for k in range(90)]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    want = {}
    for q, x in rows[::20]:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in rows if c != q)[:4]
        want |= {(q, n): (c, -s) for n, (s, c) in enumerate(scored, 1)}
    for block, held in ((2, 7), (4, 1000), (100, 7)):
        got = em.nearest(v, v.where("id % 20 = 0"), 4, block=block, held=held).collect()
        assert {(r.query_id, r["rank"]): (r.id, r.score) for r in got} == want and len(got) == len(want)
