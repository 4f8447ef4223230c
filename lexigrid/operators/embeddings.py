"""Embedding tables (id, v): normalising, centroids, and neighbours of stated queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.cooccurrence import numbered

#: Queries scored at once against a batch of rows.
SLICE = 256


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: str) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def p_norm(v: str, p: float) -> Column:
    return F.pow(F.aggregate(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(p))), F.lit(0.0), lambda s, x: s + x), F.lit(1 / p))


def column_norms(vectors: DataFrame, p: float) -> DataFrame:
    """(dim, norm): of each dimension over all rows."""
    each = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim")
    return each.agg(F.pow(F.sum(F.pow(F.abs("x"), F.lit(p))), F.lit(1 / p)).alias("norm"))


def unit(v: str) -> Column:
    """A vector over its norm; a zero vector stays as it is."""
    m = norm(v)
    return F.when(m == 0, F.col(v)).otherwise(F.transform(v, lambda x: F.try_divide(x, m)))


def normalized(vectors: DataFrame, *columns: str) -> DataFrame:
    """Unit vectors in `columns`, `v` if none is named."""
    return vectors.withColumns({c: unit(c) for c in columns or ("v",)})


def check_normalized(vectors: DataFrame) -> DataFrame:
    """(normed): whether every vector has norm 1 to a hundred-thousandth."""
    return vectors.agg(F.coalesce(F.bool_and(F.abs(norm("v") - 1) <= 1e-8 + 1e-5), F.lit(True)).alias("normed"))


def random_vectors(spark, size: int, dims: int, *, seed: int = 1917, distribution: str = "uniform", scale: float = 0.2, covectors: bool = True, biases: bool = False) -> DataFrame:
    """(id, v[, w][, vb, wb]) of seeded numbers that depend on seed, id and dimension alone; biases are zero."""
    if distribution not in ("uniform", "normal"):
        raise ValueError(f"no distribution is named {distribution}")

    def number(stream: int, dim: Column) -> Column:
        share = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * stream + k), F.col("id"), dim), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        if distribution == "uniform":
            return (2 * share(0) - 1) * scale
        return F.sqrt(-2 * F.log(share(0))) * F.cos(2 * math.pi * share(1)) * scale

    rows = spark.range(size).select(F.col("id").cast("int").alias("id"))
    vector = lambda stream: F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda d: number(stream, d))
    columns = {name: vector(k) for k, name in enumerate(("v", "w")[: 1 + covectors])}
    return rows.withColumns(columns | ({"vb": F.lit(0.0), "wb": F.lit(0.0)} if biases else {}))


def centre(vectors: DataFrame, column: str = "v") -> DataFrame:
    """(unk): the mean vector, in one row."""
    each = vectors.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("unk"))


def of_tokens(vectors: DataFrame, keys: DataFrame, policy: str = "err", column: str = "v") -> DataFrame:
    """Keys (token, ...) with the vector of their token in `column`, of vectors (token, v, ...).

    A token without a vector gets the mean vector with the policy `unk`; with `err` the job fails, naming it.
    """
    found = keys.join(vectors.select("token", column), "token", "left")
    if policy == "unk":
        return found.crossJoin(F.broadcast(centre(vectors, column))).withColumn(column, F.coalesce(column, "unk")).drop("unk")
    if policy != "err":
        raise ValueError(f"no policy is named {policy}")
    return found.withColumn(column, F.coalesce(column, F.raise_error(F.concat(F.lit("no vector of the token "), "token"))))


def dimensions(v: str, start: int, count: int) -> Column:
    """Dimensions from `start`, counted from 0, of a vector."""
    return F.slice(v, start + 1, count)


def coverage(vectors: DataFrame, order: DataFrame) -> DataFrame:
    """(token, missing): tokens of the order without a vector, and tokens with a vector outside the order."""
    lost = order.select("token").join(vectors, "token", "left_anti").select("token", F.lit("vector").alias("missing"))
    return lost.unionByName(vectors.select("token").join(order, "token", "left_anti").select("token", F.lit("order").alias("missing")))


def reordered(vectors: DataFrame, order: DataFrame, *, allow_missing_vectors: bool = False, allow_missing_tokens: bool = False) -> DataFrame:
    """Vectors (token, v, ...) with ids in the order (place, token); tokens that either side lacks go, if allowed, else ValueError."""
    missing = {r.missing for r in coverage(vectors, order).select("missing").distinct().collect()}
    if "vector" in missing and not allow_missing_vectors:
        raise ValueError("tokens of the order have no vector")
    if "order" in missing and not allow_missing_tokens:
        raise ValueError("vectors belong to tokens outside the order")
    both = vectors.drop("id").join(order.select("token", "place"), "token")
    return numbered(both.withColumn("run", F.floor(F.col("place") / 10_000)), ["run", "place"], ["run"]).drop("run", "place")


def centroid(vectors: DataFrame) -> DataFrame:
    """(dim, mean): the stand-in for tokens outside the vocabulary."""
    return vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


class _Best:
    """The k best rows seen so far of each query (own ids, vectors); ties to the smaller id."""

    def __init__(self, own, asked, k: int):
        import numpy as np

        self.own, self.asked, self.k = own, asked, k
        by_width: dict[int, list[int]] = {}
        for i, q in enumerate(asked):
            by_width.setdefault(len(q), []).append(i)
        self.blocks = {w: [np.array(at[a : a + SLICE]) for a in range(0, len(at), SLICE)] for w, at in by_width.items()}
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(own)

    def add(self, batch: pa.RecordBatch) -> None:
        import numpy as np

        ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        for width in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == width)
            rows, who = flat[starts[mine][:, None] + np.arange(width)], ids[mine]
            for at in self.blocks.get(width, ()):
                q = np.stack([self.asked[i] for i in at])
                # One component after the other, so that every score adds up in the order of the vector.
                scores = np.zeros((len(at), len(who)))
                for d in range(width):
                    scores += q[:, d : d + 1] * rows[:, d]
                for i, found in zip(at.tolist(), scores, strict=True):
                    keep = who != self.own[i]
                    had_scores, had_ids = self.best[i]
                    if len(had_scores) >= self.k:
                        keep &= found >= had_scores[-1]
                    if keep.any():
                        found, near = np.concatenate([had_scores, found[keep]]), np.concatenate([had_ids, who[keep]])
                        order = np.lexsort((near, -found))[: self.k]
                        self.best[i] = found[order], near[order]

    def found(self) -> pa.Table:
        import numpy as np

        scores, ids = (np.concatenate([b[side] for b in self.best] or [np.zeros(0)]) for side in (0, 1))
        own = np.repeat(np.array(self.own, np.int64), [len(b[1]) for b in self.best])
        return pa.table({"query_id": pa.array(own), "id": pa.array(ids.astype(np.int64)), "score": pa.array(scores)})


def _of_task(held, k: int):
    """The k best rows of a task for each broadcast query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*held.value, k)
        for batch in batches:
            best.add(batch)
        yield from best.found().to_batches()

    return run


def _of_blocks(k: int):
    """The k best rows of a block of rows for each query of a block of queries."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        import numpy as np

        best = _Best(queries.column("id").to_pylist(), [np.array(v, np.float64) for v in queries.column("v").to_pylist()], k)
        for batch in rows.to_batches(max_chunksize=SLICE):
            best.add(batch)
        return best.found()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, cosine: bool = False, block: int = 20_000, held: int = 131_072) -> DataFrame:
    """The k largest products of each query with all others; ties to the smaller id.

    Up to `block` queries are broadcast and meet all rows where they are read. More are dealt to blocks of
    about that size, and rows to blocks of about `held`: each block of queries meets each block of rows in
    a task of its own, through one shuffle, and no query goes through the driver. Either way a task answers
    with k rows a query, which are ranked after one more shuffle.
    """
    import numpy as np

    base, asked = (normalized(vectors), normalized(queries)) if cosine else (vectors, queries)
    kind = vectors.schema["id"].dataType.simpleString()
    base, asked = (df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id is not null and v is not null") for df in (base, asked))
    n, schema = asked.count(), "query_id long, id long, score double"
    if n <= block:
        got = asked.collect()
        sent = vectors.sparkSession.sparkContext.broadcast(([r.id for r in got], [np.array(r.v, np.float64) for r in got]))
        found = base.mapInArrow(_of_task(sent, k), schema)
    else:
        query_blocks, row_blocks = math.ceil(n / block), max(1, math.ceil(base.count() / held))
        deal = lambda of, blocks: F.pmod(F.xxhash64(*of), F.lit(blocks)).cast("int")
        each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        rows = base.withColumn("r", deal(["id", "v"], row_blocks)).withColumn("q", each(query_blocks))
        asked = asked.withColumn("q", deal(["id"], query_blocks)).withColumn("r", each(row_blocks))
        found = rows.groupBy("r", "q").cogroup(asked.groupBy("r", "q")).applyInArrow(_of_blocks(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast(kind).alias("query_id"), F.col("id").cast(kind).alias("id"), "score", "rank")
