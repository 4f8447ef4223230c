"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.kernels import kernel
from lexigrid.operators import cooccurrence as co
from lexigrid.operators import embeddings as em
from lexigrid.operators import models as mo
from lexigrid.sources.corpus import all_words, dealt, lines
from lexigrid.sources.shared import cut

VOCABULARY, WINDOW = 500, 5


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _vocab(spark: SparkSession, sf_dir: str, size: int | None = VOCABULARY) -> DataFrame:
    return co.vocabulary(co.unigram(all_words(_docs(spark, sf_dir))), size=size)


def _stored_vocab(spark: SparkSession, sf_dir: str, size: int | None) -> DataFrame:
    """A whole vocabulary is stored, as it is read more than once to encode lines."""
    vocab = _vocab(spark, sf_dir, size)
    return cut(vocab, "vocabulary") if size is None else vocab


def _cells(spark: SparkSession, sf_dir: str, name: str = "dynamic", window: int | None = WINDOW, weights=None, size: int | None = VOCABULARY) -> DataFrame:
    return co.line_cooccurrences(lines(_docs(spark, sf_dir)), _stored_vocab(spark, sf_dir, size), *kernel(name, window, weights))


def _marginals(spark: SparkSession, sf_dir: str, size: int | None = VOCABULARY) -> DataFrame:
    """Marginals of the flat window, without its cells."""
    return co.line_marginals(lines(_docs(spark, sf_dir)), _stored_vocab(spark, sf_dir, size), *kernel("flat", WINDOW))


def _coded(spark: SparkSession, sf_dir: str, size: int | None = None, again: bool = True) -> co.Coded:
    """Lines encoded once, for marginals and cells if they are read `again`."""
    return co.coded_lines(lines(_docs(spark, sf_dir)), cut(_vocab(spark, sf_dir, size), "vocabulary"), again=again)


def _full_cells(spark: SparkSession, sf_dir: str, size: int | None = VOCABULARY, name: str = "flat") -> DataFrame:
    """Cells with their marginals, each counted once over the same vocabulary: a task that makes cells adds them, and cells are not stored."""
    coded, sides = _coded(spark, sf_dir, size), kernel(name, WINDOW)
    add, n = co.held_marginals(cut(co.line_marginals(coded, None, *sides), "marginals"))
    cells = co.packed_pairs(coded, None, *sides).cells(add, "i int, j int, nij double, ni double, nj double")
    return cells.withColumn("n", F.lit(n).cast("double"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return source.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _weights(name: str, weights=None) -> str:
    right, left = kernel(name, None if weights else WINDOW, weights)
    return ", ".join([f"({k}, {w!r}::DOUBLE)" for k, w in enumerate(right, 1)] + [f"({-k}, {w!r}::DOUBLE)" for k, w in enumerate(left, 1)])


_TOKENS = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
words AS (SELECT doc_id, line_no, list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM lines),
tokens AS (SELECT doc_id, line_no, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM words),
unigram AS (SELECT token, count(*) AS n FROM tokens GROUP BY token)"""
_VOCAB = f"""{_TOKENS},
vocab AS (SELECT (row_number() OVER (ORDER BY n DESC, token) - 1)::INT AS id, token, n FROM unigram ORDER BY n DESC, token LIMIT {VOCABULARY})"""


def _cells_sql(name: str = "dynamic", weights=None) -> str:
    return f"""WITH {_VOCAB},
ids AS (SELECT doc_id, line_no, id, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS p FROM tokens JOIN vocab USING (token)),
kernel(k, w) AS (VALUES {_weights(name, weights)}),
cells AS (SELECT a.id AS i, b.id AS j, sum(w) AS nij FROM ids a CROSS JOIN kernel JOIN ids b
          ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.p = a.p + k WHERE w <> 0 GROUP BY a.id, b.id),
rows AS (SELECT i, sum(nij) AS ni FROM cells GROUP BY i), cols AS (SELECT j, sum(nij) AS nj FROM cells GROUP BY j),
total AS (SELECT sum(nij) AS n FROM cells),
full_cells AS (SELECT i, j, nij, ni, nj, n FROM cells JOIN rows USING (i) JOIN cols USING (j) CROSS JOIN total)
"""


CUSTOM = ([0.75, 0.0, 2.5, 0.5], [0.0, 1.5])
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str):
    def add(run):
        QUERIES[run.__name__] = run
        ORACLE_SQL[run.__name__] = sql
        return run

    return add


@_query(f"WITH {_TOKENS} SELECT token, n FROM unigram")
def unigram_counts(spark, sf_dir):
    return co.unigram(all_words(_docs(spark, sf_dir)))


@_query(f"WITH {_VOCAB} SELECT id, token, n, round(n / (SELECT sum(n) FROM vocab), 9) AS freq FROM vocab")
def vocabulary_frequencies(spark, sf_dir, size=VOCABULARY):
    vocab = _vocab(spark, sf_dir, size=size)
    total = vocab.agg(F.sum("n").alias("total"))
    return vocab.crossJoin(F.broadcast(total)).select("id", "token", "n", F.round(F.col("n") / F.col("total"), 9).alias("freq"))


@_query(f"WITH {_TOKENS} SELECT token, n FROM unigram WHERE n >= 5")
def unigram_pruned(spark, sf_dir):
    return co.unigram(all_words(_docs(spark, sf_dir))).where(F.col("n") >= 5)


@_query(
    f"WITH {_TOKENS}, c AS (SELECT text FROM conversations), "
    r"t2 AS (SELECT unnest(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS token FROM c), "
    "u2 AS (SELECT token, count(*) AS n FROM t2 GROUP BY token) "
    "SELECT token, sum(n)::BIGINT AS n FROM (SELECT * FROM unigram UNION ALL SELECT * FROM u2) GROUP BY token"
)
def unigram_merged(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return co.merge_unigrams(co.unigram(all_words(_docs(spark, sf_dir))), co.unigram(all_words(talk)))


@_query(f"WITH {_VOCAB} SELECT id, token, round(pow(n, 0.75), 6) AS n FROM vocab")
def unigram_smoothed(spark, sf_dir, size=VOCABULARY):
    return _rounded(co.smoothed(_vocab(spark, sf_dir, size=size), 0.75), "n")


@_query(_cells_sql("flat") + "SELECT i, j, round(nij, 6) AS nij FROM cells")
def cooccurrence_flat(spark, sf_dir, size=VOCABULARY):
    return _rounded(_cells(spark, sf_dir, "flat", size=size), "nij")


@_query(_cells_sql("harmonic") + "SELECT i, j, round(nij, 6) AS nij FROM cells")
def cooccurrence_harmonic(spark, sf_dir, size=VOCABULARY):
    return _rounded(_cells(spark, sf_dir, "harmonic", size=size), "nij")


@_query(_cells_sql() + "SELECT i, j, round(nij, 6) AS nij FROM cells")
def cooccurrence_dynamic(spark, sf_dir, size=VOCABULARY):
    return _rounded(_cells(spark, sf_dir, size=size), "nij")


@_query(_cells_sql("custom", CUSTOM) + "SELECT i, j, round(nij, 6) AS nij FROM cells")
def cooccurrence_custom(spark, sf_dir, size=VOCABULARY):
    return _rounded(_cells(spark, sf_dir, "custom", None, CUSTOM, size=size), "nij")


@_query(
    _cells_sql("flat") + "SELECT 'row' AS side, i AS id, ni AS n FROM rows UNION ALL SELECT 'column', j, nj FROM cols UNION ALL SELECT 'total', NULL, n FROM total"
)
def cooccurrence_marginals(spark, sf_dir, size=VOCABULARY):
    return _marginals(spark, sf_dir, size)


@_query(_cells_sql("flat") + "SELECT i, j, round(ln(nij) + ln(n) - ln(ni) - ln(nj), 6) AS pmi FROM full_cells")
def cooccurrence_pmi(spark, sf_dir, size=VOCABULARY):
    return _full_cells(spark, sf_dir, size).select("i", "j", F.round(co.pmi(), 6).alias("pmi"))


@_query(_cells_sql("flat") + "SELECT i, j, nij FROM cells WHERE nij > 10")
def cooccurrence_threshold(spark, sf_dir, size=VOCABULARY):
    return co.above(_cells(spark, sf_dir, "flat", size=size), 10)


@_query(_cells_sql("flat") + "SELECT i, sum(nij) AS ni FROM cells WHERE i < 100 AND j < 100 GROUP BY i")
def cooccurrence_truncated(spark, sf_dir):
    return co.truncated(_cells(spark, sf_dir, "flat"), 100).groupBy("i").agg(F.sum("nij").alias("ni"))


@_query(_cells_sql("flat") + "SELECT i, j, nij, i // 4 AS li, j // 4 AS lj FROM cells WHERE i % 4 = 1 AND j % 4 = 3")
def cooccurrence_shard(spark, sf_dir, size=VOCABULARY):
    return co.shard(_cells(spark, sf_dir, "flat", size=size), 4, 1, 3)


@_query(
    _cells_sql("flat") + ", keep AS (SELECT id, least(1, 1e-3 / f + sqrt(1e-3 / f)) AS p FROM (SELECT id, n / (SELECT sum(n) FROM vocab) AS f FROM vocab)) "
    "SELECT i, j, round(nij * a.p * b.p, 6) AS nij FROM cells JOIN keep a ON a.id = i JOIN keep b ON b.id = j"
)
def cooccurrence_undersampled(spark, sf_dir, size=VOCABULARY):
    vocab = cut(_vocab(spark, sf_dir, size=size), "vocabulary")
    cells = co.line_cooccurrences(lines(_docs(spark, sf_dir)), vocab, *kernel("flat", WINDOW))
    return _rounded(co.undersampled(cells, vocab, 1e-3), "nij")


@_query(_cells_sql("flat") + "SELECT i, round(sum(least(1, pow(nij / 100, 0.75)) * pow(ln(nij), 2)), 4) AS loss FROM cells GROUP BY i")
def glove_loss_at_zero(spark, sf_dir, size=VOCABULARY):
    cells = _cells(spark, sf_dir, "flat", size=size)
    return cells.groupBy("i").agg(F.round(F.sum(mo.glove_weights() / 2 * F.pow(F.log("nij"), 2)), 4).alias("loss"))


@_query(
    "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) "
    "SELECT dim::INT AS dim, round(avg(x), 9) AS mean FROM v GROUP BY dim"
)
def embedding_centroid(spark, sf_dir):
    return em.centroid(_vectors(spark, sf_dir)).select("dim", F.round("mean", 9).alias("mean"))


@_query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def embedding_norms(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.round(em.norm("v"), 6).alias("norm"))


def _nearest_sql(score: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.id AS query_id, c.id, {score} AS score FROM v q JOIN v c ON q.id < 10 AND q.id <> c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s)
SELECT query_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10"""


@_query(_nearest_sql("list_inner_product(q.v, c.v)"))
def embedding_nearest_product(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _rounded(em.nearest(v, v.where("id < 10"), 10), "score")


@_query(_nearest_sql("list_cosine_similarity(q.v, c.v)"))
def embedding_nearest_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _rounded(em.nearest(v, v.where("id < 10"), 10, cosine=True), "score")


_ALL_NEIGHBOURS = "q.id % 20 = 0"


@_query(_nearest_sql("list_inner_product(q.v, c.v)").replace("q.id < 10", _ALL_NEIGHBOURS))
def embedding_neighbours_product(spark, sf_dir):
    """Every row whose id is divisible by 20 asks all rows."""
    v = _vectors(spark, sf_dir)
    return _rounded(em.nearest(v, v.where("id % 20 = 0"), 10), "score")


@_query(_nearest_sql("list_cosine_similarity(q.v, c.v)").replace("q.id < 10", _ALL_NEIGHBOURS))
def embedding_neighbours_cosine(spark, sf_dir):
    """Every row whose id is divisible by 20 asks all rows."""
    v = _vectors(spark, sf_dir)
    return _rounded(em.nearest(v, v.where("id % 20 = 0"), 10, cosine=True), "score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the dynamic window over the whole vocabulary, with its PMI."""
    return _full_cells(spark, sf_dir, None, "dynamic").select("i", "j", "nij", co.pmi().alias("pmi"))
