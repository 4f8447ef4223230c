"""Registered queries of embedding access, marginals after changes, samples, senses, dependencies and training."""

from __future__ import annotations

import uuid

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.kernels import kernel
from lexigrid.operators import cooccurrence as co
from lexigrid.operators import dependency as de
from lexigrid.operators import embeddings as em
from lexigrid.operators import models as mo
from lexigrid.operators import sampling as sa
from lexigrid.operators import tiles as ti
from lexigrid.plans.catalogue import _TOKENS, _cells_sql, _coded, _docs, _marginals, _rounded, _vectors, _vocab
from lexigrid.plans.models import _MODEL, SIZE, _dense, _sparse
from lexigrid.sources import store
from lexigrid.sources.corpus import all_words, lines, tokens
from lexigrid.sources.shared import cut, shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: The cells of every token, as the twins make them.
_WHOLE = _cells_sql("flat")[: _cells_sql("flat").index(" ORDER BY n DESC, token LIMIT")] + ")" + _cells_sql("flat")[_cells_sql("flat").index("),\nids AS") + 1 :]
#: The same cells, each unordered pair of places counted once: half the joined rows, and no marginals.
_CELLS = (
    _WHOLE[: _WHOLE.index("kernel(k, w)")]
    + "near AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM ids a CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS d) JOIN ids b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.p = a.p + d GROUP BY a.id, b.id), "
    "cells AS (SELECT i, j, sum(k)::DOUBLE AS nij FROM (SELECT x AS i, y AS j, k FROM near UNION ALL SELECT y, x, k FROM near) GROUP BY i, j)"
)
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_BOTH = (
    "many AS (SELECT count(*) AS many FROM embeddings), "
    "v AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS v, b.embedding::DOUBLE[] AS w, ((a.vec_id % 11 - 5) / 100.0)::DOUBLE AS vb, ((3 * a.vec_id % 11 - 5) / 100.0)::DOUBLE AS wb "
    "FROM embeddings a CROSS JOIN many JOIN embeddings b ON b.vec_id = (7 * a.vec_id + 3) % many)"
)


def _query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def _counted(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    return co.line_cooccurrences(lines(_docs(spark, sf_dir)), vocab, *kernel("flat", 5))


def _all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, cut(_vocab(spark, sf_dir, None), "vocabulary"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with the covector and biases that the model queries give it."""
    v = _vectors(spark, sf_dir)
    many = F.broadcast(v.agg(F.count("*").alias("many")))
    other = v.select(F.col("id").alias("source"), F.col("v").alias("w"))
    bias = {"vb": (F.col("id") % 11 - 5) / 100.0, "wb": (3 * F.col("id") % 11 - 5) / 100.0}
    return v.crossJoin(many).withColumn("source", (7 * F.col("id") + 3) % F.col("many")).join(other, "source").withColumns(bias).select("id", "v", "w", "vb", "wb")


@_query(f"WITH {_V} SELECT dim::INT AS dim, round(sum(abs(x)), 6) AS norm FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM v) GROUP BY dim")
def embedding_column_norms(spark, sf_dir):
    return _rounded(em.column_norms(_vectors(spark, sf_dir), 1), "norm")


@_query(f"WITH {_V} SELECT id, round(pow(list_sum(list_transform(v, lambda x: pow(abs(x), 3))), 1 / 3.0), 6) AS norm FROM v")
def embedding_p_norms(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.round(em.p_norm("v", 3), 6).alias("norm"))


@_query(
    f"WITH {_V}, m AS (SELECT v, sqrt(list_inner_product(v, v)) AS m FROM v), "
    "u AS (SELECT CASE WHEN m = 0 THEN v ELSE list_transform(v, lambda x: x / m) END AS u FROM m) "
    "SELECT 'given' AS kind, bool_and(abs(m - 1) <= 1.001e-5) AS normed FROM m "
    "UNION ALL SELECT 'unit', bool_and(abs(sqrt(list_inner_product(u, u)) - 1) <= 1.001e-5) FROM u"
)
def embedding_check_normalized(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    kinds = [em.check_normalized(t).select(F.lit(k).alias("kind"), "normed") for k, t in (("given", v), ("unit", em.normalized(v)))]
    return kinds[0].unionByName(kinds[1])


@_query(f"WITH {_V} SELECT id, dim::INT AS dim, round(x, 6) AS x FROM (SELECT id, unnest(v[4:7]) AS x, generate_subscripts(v[4:7], 1) + 2 AS dim FROM v)")
def embedding_dimensions(spark, sf_dir):
    part = _vectors(spark, sf_dir).select("id", F.posexplode(em.dimensions("v", 3, 4)).alias("dim", "x"))
    return _rounded(part.select("id", (F.col("dim") + 3).alias("dim"), "x"), "x")


@_query(f"WITH {_V}, many AS (SELECT count(*) AS many FROM v) SELECT (row_number() OVER (ORDER BY (7 * id + 3) % many) - 1)::INT AS id, 'v' || id AS token FROM v, many")
def embedding_reordered(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("token", F.concat(F.lit("v"), "id"))
    many = F.broadcast(v.agg(F.count("*").alias("many")))
    order = v.crossJoin(many).select("token", ((7 * F.col("id") + 3) % F.col("many")).alias("place"))
    return em.reordered(v, order).select("id", "token")


@_query(
    f"WITH {_V}, k AS (SELECT DISTINCT 'v' || (conv_id * (turn + 1)) AS token FROM conversations), m AS (SELECT avg(v[1]) AS unk FROM v) "
    "SELECT k.token, round(coalesce(v.v[1], unk), 6) AS x FROM k LEFT JOIN v ON k.token = 'v' || v.id CROSS JOIN m"
)
def embedding_of_tokens(spark, sf_dir):
    """Tokens made of conversations; those without a vector take the mean."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    keys = talk.select(F.concat(F.lit("v"), F.col("conv_id") * (F.col("turn") + 1)).alias("token")).distinct()
    v = _vectors(spark, sf_dir).withColumn("token", F.concat(F.lit("v"), "id"))
    return em.of_tokens(v, keys, "unk").select("token", F.round(F.col("v")[0], 6).alias("x"))


@_query(
    f"WITH {_BOTH}, s AS (SELECT q.id AS query_id, c.id, list_inner_product(q.v, c.w) AS score FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank = 1"
)
def embedding_nearest_covector(spark, sf_dir):
    """Of every row whose id is divisible by 20, the one covector of greatest product."""
    both = _both(spark, sf_dir)
    return _rounded(em.nearest(both.select("id", F.col("w").alias("v")), both.where("id % 20 = 0").select("id", "v"), 1), "score")


@_query(_WHOLE + "SELECT i, j, nij, ni, nj, n FROM full_cells WHERE nij > 10")
def cooccurrence_threshold_marginals(spark, sf_dir):
    """Frequent cells beside the marginals of all, kept and met by the task that counts them."""
    coded, sides = _coded(spark, sf_dir), kernel("flat", 5)
    add, n = co.held_marginals(cut(co.line_marginals(coded, None, *sides), "marginals"))
    frequent = lambda batches: add(b.filter(pc.greater(b.column("nij"), 10.0)) for b in batches)
    kept = co.packed_pairs(coded, None, *sides).cells(frequent, "i int, j int, nij double, ni double, nj double")
    return kept.withColumn("n", F.lit(n).cast("double"))


_KEEP = ", keep AS (SELECT id, f, least(1, 1e-3 / f + sqrt(1e-3 / f)) AS p FROM (SELECT id, n / (SELECT sum(n) FROM vocab) AS f FROM vocab))"


@_query(
    _WHOLE + _KEEP + ", u AS (SELECT i, j, nij * a.p * b.p AS nij FROM cells JOIN keep a ON a.id = i JOIN keep b ON b.id = j) "
    "SELECT 'row' AS side, i AS id, round(sum(nij), 4) AS n FROM u GROUP BY i UNION ALL SELECT 'column', j, round(sum(nij), 4) FROM u GROUP BY j UNION ALL SELECT 'total', NULL, round(sum(nij), 2) FROM u"
)
def undersampled_marginals_exact(spark, sf_dir):
    vocab = cut(_vocab(spark, sf_dir, None), "vocabulary")
    # Chances under 1 belong to at most 382 tokens, those of over 1e-3 / 0.382 of all.
    thin = co.keep_chances(vocab, 1e-3).where("p < 1").select("id", "p")
    sums = co.line_marginals(lines(_docs(spark, sf_dir)), vocab, *kernel("flat", 5), thin=thin)
    return sums.withColumn("n", F.when(F.col("side") == "total", F.round("n", 2)).otherwise(F.round("n", 4)))


@_query(
    _WHOLE + _KEEP + ", mean AS (SELECT sum(f * p) AS mean FROM keep), s AS (SELECT 'row' AS side, i AS id, ni * p * mean AS n FROM rows JOIN keep ON id = i CROSS JOIN mean "
    "UNION ALL SELECT 'column', j, nj * p * mean FROM cols JOIN keep ON id = j CROSS JOIN mean) SELECT side, id, round(n, 4) AS n FROM s UNION ALL SELECT 'total', NULL, round(sum(n), 2) FROM s WHERE side = 'row'"
)
def undersampled_marginals_of_sector(spark, sf_dir):
    """Marginals after undersampling as one sector can tell them from those of the whole."""
    vocab = cut(_vocab(spark, sf_dir, None), "vocabulary")
    sums = co.line_marginals(lines(_docs(spark, sf_dir)), vocab, *kernel("flat", 5))
    sums = co.undersampled_marginals(cut(sums, "marginals"), vocab, 1e-3)
    return sums.withColumn("n", F.when(F.col("side") == "total", F.round("n", 2)).otherwise(F.round("n", 4)))


@_query(
    _CELLS + ", w AS (SELECT list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM conversations), "
    "p AS (SELECT DISTINCT w[1] AS focal, w[2] AS context FROM w WHERE len(w) > 1) "
    "SELECT focal, context, coalesce(nij, 0)::DOUBLE AS nij FROM p LEFT JOIN vocab a ON a.token = focal LEFT JOIN vocab b ON b.token = context LEFT JOIN cells ON i = a.id AND j = b.id"
)
def cooccurrence_of_token_pairs(spark, sf_dir):
    """How often the first two words of a conversation's texts stand near each other in documents."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    pairs = talk.where(F.size("w") > 1).select(F.col("w")[0].alias("focal"), F.col("w")[1].alias("context")).distinct()
    vocab = cut(_vocab(spark, sf_dir, None))
    return co.cell_count(_counted(spark, sf_dir, vocab), vocab, pairs)


_WHOLE_VOCAB = f"{_TOKENS}, vocab AS (SELECT (row_number() OVER (ORDER BY n DESC, token) - 1)::INT AS id, token, n FROM unigram)"


@_query(
    f"WITH {_WHOLE_VOCAB}, o AS (SELECT n, lead(n) OVER (ORDER BY id) AS after, lead(n) OVER (ORDER BY id DESC) AS before FROM vocab) "
    "SELECT 'falling' AS kind, coalesce(bool_and(after <= n), TRUE) AS sorted FROM o UNION ALL SELECT 'rising', coalesce(bool_and(before <= n), TRUE) FROM o"
)
def unigram_is_sorted(spark, sf_dir):
    vocab = _vocab(spark, sf_dir, None)
    many = F.broadcast(vocab.agg(F.max("id").alias("last")))
    rising = vocab.crossJoin(many).select((F.col("last") - F.col("id")).alias("id"), "n")
    return co.is_sorted(vocab).select(F.lit("falling").alias("kind"), "sorted").unionByName(co.is_sorted(rising).select(F.lit("rising").alias("kind"), "sorted"))


@_query(
    f"WITH {_WHOLE_VOCAB}, c AS (SELECT unnest(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS token FROM conversations), "
    "o AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS place FROM c GROUP BY token) "
    "SELECT (row_number() OVER (ORDER BY place NULLS LAST, token) - 1)::INT AS id, token, coalesce(n, 0) AS n FROM vocab FULL JOIN o USING (token)"
)
def unigram_sorted_by_tokens(spark, sf_dir):
    """The counts of documents in the order of the tokens of conversations."""
    order = co.vocabulary(co.unigram(all_words(spark.read.parquet(f"{sf_dir}/conversations.parquet")))).withColumnRenamed("id", "place")
    return co.sorted_by(_vocab(spark, sf_dir, None), order)


@_query(
    f"WITH {_TOKENS}, f AS (SELECT token, count(*) AS n, min(struct_pack(a := doc_id, b := line_no, c := pos)) AS first FROM tokens GROUP BY token) "
    "SELECT (row_number() OVER (ORDER BY n DESC, first) - 1)::INT AS id, token, n FROM f"
)
def vocabulary_first_seen(spark, sf_dir):
    """Every token by falling count, ties in the order in which the documents have them."""
    found = co.seen_unigram(tokens(_docs(spark, sf_dir)), "doc_id", "line_no", "pos")
    return co.seen_vocabulary(found)


@_query(
    _CELLS + ", w AS (SELECT list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM conversations), p AS (SELECT w[1] AS focal, w[2] AS context, count(*) AS k FROM w WHERE len(w) > 1 GROUP BY ALL ORDER BY k DESC, focal, context LIMIT 20) "
    "SELECT focal, context, coalesce(nij, 0)::DOUBLE AS nij FROM p LEFT JOIN vocab a ON a.token = focal LEFT JOIN vocab b ON b.token = context LEFT JOIN cells ON i = a.id AND j = b.id"
)
def cooccurrence_found_in_store(spark, sf_dir):
    """Of the twenty commonest beginnings of a conversation's texts, what was counted, looked up in a stored table of sectors."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    asked = talk.where(F.size("w") > 1).groupBy(F.col("w")[0].alias("focal"), F.col("w")[1].alias("context")).agg(F.count("*").alias("k"))
    pairs = [(r.focal, r.context) for r in asked.orderBy(F.col("k").desc(), "focal", "context").limit(20).collect()]
    vocab, path = cut(_vocab(spark, sf_dir, None)), f"{shared_dir(spark)}/lexigrid-sectors-{uuid.uuid4().hex}"
    store.save_cooccurrences(_counted(spark, sf_dir, vocab), vocab, path, 4)
    return store.count(spark, path, pairs)


@_query(_WHOLE + "SELECT i, round(sum(ni) OVER (ORDER BY i) / n, 9) AS high FROM rows CROSS JOIN total")
def sample_distribution(spark, sf_dir):
    sums = cut(_marginals(spark, sf_dir, None), "marginals")
    shares = sa.distribution(sums.where("side = 'row'").select(F.col("id").alias("i"), "n"), ["i"], "n")
    return shares.select("i", F.round("high", 9).alias("high"))


def _draw_sql(stream: int) -> str:
    x = f"0.5::DOUBLE + 7 * 0.1::DOUBLE + k * {sa.STEPS[stream]!r}::DOUBLE"
    return f"({x}) - floor({x})"


@_query(
    _CELLS + ", rows AS (SELECT i, sum(nij) AS ni FROM cells GROUP BY i), cols AS (SELECT j, sum(nij) AS nj FROM cells GROUP BY j), total AS (SELECT sum(nij) AS n FROM cells), "
    "d AS (SELECT unnest(range(10 * (SELECT count(*) FROM documents))) AS k), "
    "ri AS (SELECT i, sum(sqrt(ni / n)) OVER (ORDER BY i) / sum(sqrt(ni / n)) OVER () AS high FROM rows CROSS JOIN total), "
    "cj AS (SELECT j, sum(sqrt(nj / n)) OVER (ORDER BY j) / sum(sqrt(nj / n)) OVER () AS high FROM cols CROSS JOIN total), "
    f"a AS (SELECT k, i FROM (SELECT k, {_draw_sql(0)} AS u FROM d) ASOF JOIN (SELECT i, coalesce(lag(high) OVER (ORDER BY i), 0) AS low FROM ri) ON u >= low), "
    f"b AS (SELECT k, j FROM (SELECT k, {_draw_sql(1)} AS u FROM d) ASOF JOIN (SELECT j, coalesce(lag(high) OVER (ORDER BY j), 0) AS low FROM cj) ON u >= low) "
    "SELECT k AS n, i, j, round(coalesce(nij * n / (ni * nj), 0), 6) AS exp_pmi FROM a JOIN b USING (k) LEFT JOIN cells USING (i, j) JOIN rows USING (i) JOIN cols USING (j) CROSS JOIN total"
)
def sample_balanced(spark, sf_dir):
    """Ten independent pairs a document from the tempered marginals, evenly spread, with what was counted of each pair."""
    coded, sides = _coded(spark, sf_dir), kernel("flat", 5)
    sums = cut(co.line_marginals(coded, None, *sides), "marginals")
    pairs = cut(sa.independent_pairs(spark, sums, 10 * _docs(spark, sf_dir).count(), 2, 7, sa.even), "pairs")
    # Other pairs go before they are shuffled, but for a few that only the join can tell; only cells of drawn ones meet the marginals.
    cells = co.packed_pairs(coded, None, *sides, asked=pairs).cells()
    drawn = cells.join(pairs.select("i", "j").distinct(), ["i", "j"], "left_semi")
    counted = co.attach(cut(drawn, "cells"), sums).withColumn("exp_pmi", mo.exp_pmi())
    return _rounded(co.looked_up(pairs, counted, "exp_pmi").select("n", "i", "j", "exp_pmi"), "exp_pmi")


@_query(
    f"WITH {_WHOLE_VOCAB}, {_BOTH}, s AS (SELECT q.id AS n, c.id, k.n * exp(list_inner_product(q.v, c.w)) AS p FROM v q JOIN v c ON q.id % 20 = 0 JOIN vocab k ON k.id = c.id) "
    "SELECT n, id, round(p / sum(p) OVER (PARTITION BY n), 9) AS p FROM s"
)
def sample_gibbs_conditional(spark, sf_dir):
    """Of every id divisible by 20, the chance of each partner: its count times exp(v . w)."""
    both = _both(spark, sf_dir)
    asked = both.where("id % 20 = 0").select(F.col("id").alias("n"), "id")
    return sa.conditional(asked, both, _vocab(spark, sf_dir, None).select("id", F.col("n").alias("p")), "v", "w").withColumn("p", F.round("p", 9))


@_query(
    f"WITH {_WHOLE_VOCAB}, {_BOTH}, s AS (SELECT q.id AS n, c.id, ln(k.n) + list_inner_product(q.v, c.w) - ln(-ln(u - floor(u))) AS e FROM (SELECT q.id, q.v FROM v q WHERE q.id % 20 = 0) q "
    f"JOIN v c ON true JOIN vocab k ON k.id = c.id, LATERAL (SELECT 0.5::DOUBLE + q.id * {sa.STEPS[0]!r}::DOUBLE + c.id * {sa.STEPS[1]!r}::DOUBLE AS u)) "
    "SELECT n, arg_max(id, e)::INT AS id FROM s GROUP BY n"
)
def sample_gibbs_step(spark, sf_dir):
    """Of every id divisible by 20, one partner drawn by its count times exp(v . w), with fixed noise."""
    both = cut(_both(spark, sf_dir))
    asked = both.where("id % 20 = 0").select(F.col("id").alias("n"), "id")
    marginal = _vocab(spark, sf_dir, None).select("id", F.col("n").alias("p"))
    return sa.gibbs_step(asked, both, marginal, "v", "w", sa.even_noise)


@_query(
    f"WITH {_BOTH}, p AS (SELECT id AS i, (5 * id + 1) % many AS j FROM v, many), n AS (SELECT len(v) // 2 AS h FROM v LIMIT 1), "
    "s AS (SELECT i, j, unnest([list_inner_product(b.w[:h], a.v[:h]) + b.wb + a.vb, list_inner_product(b.w[:h], a.v[h + 1:]) + b.wb - a.vb, "
    "list_inner_product(b.w[h + 1:], a.v[:h]) - b.wb + a.vb, list_inner_product(b.w[h + 1:], a.v[h + 1:]) - b.wb - a.vb]) AS e FROM p JOIN v a ON a.id = i JOIN v b ON b.id = j, n) "
    "SELECT i, j, round(ln(sum(exp(e))), 6) AS score FROM s GROUP BY i, j"
)
def multisense_response(spark, sf_dir):
    """Two senses of each id, the halves of its vectors, for one pair an id."""
    return _rounded(mo.sense_scores(*_sense_pairs(spark, sf_dir)).select("i", "j", "score"), "score")


def _sense_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    both = _both(spark, sf_dir)
    half = (F.size("v") / 2).cast("int")
    halves = lambda c: F.array(F.slice(c, F.lit(1), half), F.slice(c, half + 1, F.size(c) - half))
    senses = both.select("id", halves("v").alias("v"), halves("w").alias("w"), F.array(F.col("vb"), -F.col("vb")).alias("vb"), F.array(F.col("wb"), -F.col("wb")).alias("wb"))
    many = F.broadcast(both.agg(F.count("*").alias("many")))
    return both.crossJoin(many).select(F.col("id").alias("i"), ((5 * F.col("id") + 1) % F.col("many")).alias("j")), senses


@_query(
    f"WITH {_BOTH}, p AS (SELECT id AS i, (5 * id + 1) % many AS j FROM v, many), n AS (SELECT len(v) // 2 AS h FROM v LIMIT 1), "
    "a AS (SELECT id, [v[:h], v[h + 1:]] AS v, [w[:h], w[h + 1:]] AS w, [vb, -vb] AS vb, [wb, -wb] AS wb FROM v, n), "
    "e AS (SELECT i, j, s, r, list_inner_product(b.w[r], a.v[s]) + b.wb[r] + a.vb[s] AS e, a.v[s] AS x, b.w[r] AS y FROM p JOIN a ON a.id = i JOIN a b ON b.id = j, (VALUES (1), (2)) t(s), (VALUES (1), (2)) u(r)), "
    "q AS (SELECT *, exp(e) / sum(exp(e)) OVER (PARTITION BY i, j) AS q, ln(sum(exp(e)) OVER (PARTITION BY i, j)) AS d FROM e), "
    "g AS (SELECT i AS id, 'v' AS side, s AS sense, d * q AS f, y AS x FROM q UNION ALL SELECT j, 'w', r, d * q, x FROM q), "
    "m AS (SELECT id, side, sense, f, unnest(x) AS x, generate_subscripts(x, 1) AS dim FROM g) "
    "SELECT id, side, (sense - 1)::INT AS sense, (dim - 1)::INT AS dim, round(sum(f * x), 6) AS g FROM m GROUP BY ALL"
)
def grad_multisense(spark, sf_dir):
    """Gradients of half the sum of the squares of `multisense_response`, for both senses and sides."""
    pairs, senses = _sense_pairs(spark, sf_dir)
    dims = senses.select(F.size(F.col("v")[0]).alias("n")).first().n
    found = mo.sense_gradients(pairs, senses, F.col("score"), 2, dims)
    return _rounded(found.select("id", "side", "sense", F.posexplode("g").alias("dim", "g")), "g")


_SHARES = ", uni AS (SELECT id, pow(n, 0.75) AS n FROM vocab), ushare AS (SELECT id, n / (SELECT sum(n) FROM uni) AS share FROM uni) "


@_query(_MODEL + _SHARES + "SELECT i, round(sum(15 * (ni - nij) * share * ln(1 + exp(score)) + nij * (ln(1 + exp(score)) - score)), 5) AS loss FROM tile JOIN ushare ON id = j GROUP BY i")
def loss_sgns_unigram(spark, sf_dir):
    """Negatives by the smoothed counts of tokens."""
    counts = co.smoothed(_vocab(spark, sf_dir), 0.75)
    whole = F.broadcast(counts.agg(F.sum("n").alias("whole")))
    shares = counts.crossJoin(whole).select("id", (F.col("n") / F.col("whole")).alias("share"))
    return _dense(spark, sf_dir, ti.sgns(), SIZE, shares).select(F.col("id").alias("i"), F.round("loss", 5).alias("loss"))


@_query(_MODEL + "SELECT i AS id, round(sum(2 * least(pow(nij / 100, 0.75), 1) * (score + a.wb + b.vb - ln(nij))), 6) AS g FROM sparse JOIN params a ON a.id = i JOIN params b ON b.id = j GROUP BY i")
def grad_glove_bias(spark, sf_dir):
    return _rounded(mo.bias_gradient(_sparse(spark, sf_dir, bias=True), mo.glove_delta(), "wb"), "g")


#: Sentences of documents: each line of 2 to 29 words, a word's id its length, heads by a rule of places.
_SENTENCES = (
    "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), "
    "w AS (SELECT doc_id * 1000000 + line_no AS sent, list_filter(string_split_regex(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM lines), "
    "sentences AS (SELECT sent, [0] || list_transform(w, lambda x: least(len(x), 40)::INT) AS words, len(w) AS k FROM w WHERE len(w) BETWEEN 2 AND 29), "
    "heads AS (SELECT sent, m, words, k, CASE WHEN (7 * m + k) % (k + 1) = m THEN 0 ELSE (7 * m + k) % (k + 1) END AS h FROM (SELECT *, unnest(range(1, k + 1)) AS m FROM sentences))"
)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = docs.select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("sent"), F.filter(F.split("line", r"\s+"), lambda w: w != "").alias("w")).where(F.size("w").between(2, 29))
    n = F.size("w")
    head = lambda m: F.when((7 * m + n) % (n + 1) == m, 0).otherwise((7 * m + n) % (n + 1))
    words = F.concat(F.array(F.lit(0)), F.transform("w", lambda x: F.least(F.length(x), F.lit(40))))
    heads = F.concat(F.array(F.lit(None).cast("int")), F.transform(F.sequence(F.lit(1), n), head))
    return w.select("sent", words.alias("words"), heads.alias("heads"), (n + 1).alias("n"))


@_query(
    f"WITH {_SENTENCES}, {_BOTH} SELECT sent, round(sum(list_inner_product(a.w, b.v) + a.wb + b.vb), 5) AS score FROM heads JOIN v a ON a.id = words[m + 1] JOIN v b ON b.id = words[h + 1] GROUP BY sent"
)
def dependency_scores(spark, sf_dir):
    return _rounded5(de.scores(_sentences(spark, sf_dir), _both(spark, sf_dir)), "score")


def _rounded5(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.round(name, 5))


@_query(
    f"WITH {_SENTENCES}, {_BOTH}, e AS (SELECT sent, m, h2 AS h, exp(list_inner_product(a.w, b.v) + a.wb + b.vb) AS e FROM (SELECT sent, words, m, unnest(range(k + 1)) AS h2 FROM heads) "
    "JOIN v a ON a.id = words[m + 1] JOIN v b ON b.id = words[h2 + 1] WHERE m <> h2) "
    "SELECT sent, round(avg(p), 6) AS mean, round(max(p), 6) AS most FROM (SELECT sent, e / sum(e) OVER (PARTITION BY sent, m) AS p FROM e) GROUP BY sent"
)
def dependency_head_chances(spark, sf_dir):
    """Mean and largest chance of a head in each sentence."""
    chances = de.head_chances(de.energies(_sentences(spark, sf_dir), _both(spark, sf_dir)))
    return chances.groupBy("sent").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.max("p"), 6).alias("most"))


@_query(
    f"WITH RECURSIVE {_SENTENCES}, r(sent, m, p, t) AS (SELECT sent, m, h, 1 FROM heads UNION ALL SELECT r.sent, r.m, heads.h, t + 1 FROM r JOIN heads ON heads.sent = r.sent AND heads.m = r.p WHERE t < 32) "
    "SELECT sent, min(p)::INT AS m FROM r WHERE t = 32 AND p <> 0 GROUP BY sent"
)
def dependency_cycles(spark, sf_dir):
    """The least place on a cycle of heads, of each sentence that has one."""
    return de.on_cycle(_sentences(spark, sf_dir))


@_query(
    f"WITH {_SENTENCES}, p AS (SELECT sent, k + 1 AS n, ((row_number() OVER (ORDER BY k, sent) - 1) // 64)::INT AS batch FROM sentences) "
    "SELECT batch, count(*) AS sentences, max(n)::INT AS longest, (max(n) * count(*) - sum(n))::BIGINT AS filled FROM p GROUP BY batch"
)
def dependency_batches(spark, sf_dir):
    found = de.batches(_sentences(spark, sf_dir), 64)
    filled = F.aggregate("mask", F.lit(0), lambda s, x: s + x.cast("int"))
    return found.groupBy("batch").agg(F.count("*").alias("sentences"), F.max(F.size("mask")).alias("longest"), F.sum(filled).alias("filled"))


@_query()
def train_glove(spark, sf_dir):
    """Two updates on all cells of tokens seen 20 times and more: the vectors' norms."""
    from lexigrid.functions.runs import rate_schedule
    from lexigrid.operators import training as tr

    vocab = tr.cut(co.vocabulary(co.unigram(all_words(_docs(spark, sf_dir))), min_count=20))
    # GloVe reads no marginals.
    size = vocab.count()
    cells = tr.dealt(co.line_cooccurrences(lines(_docs(spark, sf_dir)), vocab, *kernel("flat", 5)), size)
    params, _ = tr.train(cells, tr.initial(spark, size, 16, bias=True), mo.glove_loss(), mo.glove_delta(), rate=rate_schedule("linear", 0.05, 2), updates=2, bias=True)
    return params.select("id", F.round(em.norm("v"), 6).alias("v"), F.round(em.norm("w"), 6).alias("w"))
