"""Samples by cumulative distributions and by alias tables: independent, counted, balanced and Gibbs pairs.

Draws are a table (n, u, t) of two numbers in [0, 1) each. A cumulative distribution is a table of keys with the interval
[low, high) of each one's share; a draw gets the key whose interval holds u, which keeps evenly spread draws even. An alias
table deals the keys to buckets, and a draw is one bucket, one slot in it and one comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.models import tempered_share
from lexigrid.sources.shared import cut

#: Steps of evenly spread draws in two dimensions: powers of the reciprocal of the root of x^3 = x + 1.
STEPS = (0.7548776662466927, 0.5698402909980532)
#: Keys of an alias bucket, and how many buckets there are at most: their weights, 5 MB, go to every task.
BUCKET, BUCKETS = 4_096, 1 << 18


def seeded(n: Column, seed: int, stream: int = 0) -> Column:
    """Pseudo-random numbers in [0, 1) by seed, stream and n alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), n), F.lit(1 << 52)) / float(1 << 52)


def even(n: Column, seed: int, stream: int = 0) -> Column:
    """Numbers in [0, 1) that fill it evenly, and with the other stream the square."""
    x = 0.5 + seed * 0.1 + n * STEPS[stream]
    return x - F.floor(x)


def draws(spark: SparkSession, size: int, seed: int, stream: int = 0, spread=seeded) -> DataFrame:
    """(n, u, t): u by `spread`, t a second number, of its own stream."""
    return spark.range(size).select(F.col("id").alias("n"), spread(F.col("id"), seed, stream).alias("u"), seeded(F.col("id"), seed, stream + 100).alias("t"))


def _running(keys: list[str], weight: str):
    """Sums of the weights from the start of a partition on: (part, keys, upto, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0.0
        for batch in batches:
            w = batch.column(weight).to_numpy(zero_copy_only=False)
            upto = before + np.cumsum(w)
            before = float(upto[-1]) if len(upto) else before
            columns = [pa.array(np.full(len(w), part, np.int32)), *(batch.column(k) for k in keys), pa.array(upto), batch.column(weight)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", *keys, "upto", "weight"])

    return run


def distribution(weights: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, low, high) in the order of the keys.

    Keys are range-partitioned and sorted, and their weights summed up within each partition, whatever the first key's
    share; one sum a partition goes through the driver.
    """
    kinds = {f.name: f.dataType.simpleString() for f in weights.schema.fields}
    ordered = weights.select(*keys, F.col(weight).cast("double").alias(weight)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = ", ".join(["part int", *(f"{k} {kinds[k]}" for k in keys), "upto double", "weight double"])
    sums = cut(ordered.mapInArrow(_running(keys, weight), schema), "cumulative")
    before, total = [], 0.0
    for r in sums.groupBy("part").agg(F.max("upto").alias("sum")).orderBy("part").collect():
        before.append((r.part, total))
        total += r.sum
    starts = weights.sparkSession.createDataFrame(before, "part int, before double")
    upto = F.col("before") + F.col("upto")
    # One row a partition.
    return sums.join(F.broadcast(starts), "part").select(*keys, ((upto - F.col("weight")) / total).alias("low"), (upto / total).alias("high")) if before else sums.select(*keys, F.col("upto").alias("low"), F.col("upto").alias("high"))


def sampled(drawn: DataFrame, shares: DataFrame, pieces: int | None = None) -> DataFrame:
    """(n, keys): the key of each draw.

    [0, 1) is cut into as many pieces as there are keys, unless `pieces` says otherwise, and each interval is dealt to
    those it overlaps: two rows a key at most, and a draw meets two intervals on average, however uneven the shares are.
    """
    keys = [c for c in shares.columns if c not in ("low", "high")]
    pieces = pieces or min(max(1, shares.count()), 1 << 31)
    piece = lambda c: F.least(F.floor(F.col(c) * pieces).cast("long"), F.lit(pieces - 1))
    dealt = shares.withColumn("piece", F.explode(F.sequence(piece("low"), piece("high"))))
    met = drawn.select("n", "u").withColumn("piece", piece("u")).join(dealt, "piece").where("u >= low and u < high")
    # Rounding may let two neighbours' intervals overlap or leave a gap of one last digit.
    return met.groupBy("n").agg(F.min(F.struct(*keys)).alias("k")).select("n", *(F.col(f"k.{c}").alias(c) for c in keys))


def walker(weights):
    """(chance, other) of each slot: a slot gives itself by its chance, else the other; all slots are drawn alike.

    Slots over the mean fill up those under it, one after the other.
    """
    import numpy as np

    scaled = np.asarray(weights, float) * (len(weights) / np.sum(weights))
    chance, other = np.ones(len(scaled)), np.arange(len(scaled))
    low, high = list(np.flatnonzero(scaled < 1)), list(np.flatnonzero(scaled >= 1))
    while low and high:
        small, great = low.pop(), high[-1]
        chance[small], other[small] = scaled[small], great
        scaled[great] -= 1 - scaled[small]
        if scaled[great] < 1:
            low.append(high.pop())
    # What rounding leaves over is a whole slot.
    return chance, other


class Alias(NamedTuple):
    """slots (bucket, slot, chance, keys, other_keys), and of each bucket its size and Walker's chance and other bucket."""

    slots: DataFrame
    keys: list[str]
    sizes: object
    chance: object
    other: object


def alias_table(weights: DataFrame, keys: list[str], weight: str, bucket: int = BUCKET) -> Alias:
    """An alias table of two levels: keys are dealt to buckets by hash, and each bucket has a table of its own.

    A key of any weight is one slot, so no bucket grows with the weights. Buckets' sums go through the driver, BUCKETS
    numbers at most: with more than BUCKET * BUCKETS keys, buckets get larger. Weights of zero and less take no part.
    """
    import numpy as np

    kept = weights.where(F.col(weight) > 0).select(*keys, F.col(weight).cast("double").alias("w_"))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    many = min(BUCKETS, max(1, -(-kept.count() // bucket)))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(k, "ascending") for k in keys])
        w = rows.column("w_").to_numpy()
        chance, other = walker(w)
        columns = {"bucket": rows.column("bucket"), "slot": pa.array(np.arange(len(w), dtype=np.int32)), "chance": pa.array(chance), "sum": pa.array(np.full(len(w), w.sum()))}
        columns |= {k: rows.column(k) for k in keys} | {f"other_{k}": rows.column(k).take(pa.array(other)) for k in keys}
        return pa.table(columns)

    schema = ", ".join(["bucket int, slot int, chance double, sum double", *(f"{k} {kinds[k]}" for k in keys), *(f"other_{k} {kinds[k]}" for k in keys)])
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(many)).cast("int"))
    slots = cut(dealt.groupBy("bucket").applyInArrow(build, schema), "alias")
    sizes, sums = np.zeros(many, np.int64), np.zeros(many)
    for r in slots.groupBy("bucket").agg(F.count("*").alias("n"), F.first("sum").alias("sum")).collect():
        sizes[r.bucket], sums[r.bucket] = r.n, r.sum
    if not sums.sum() > 0:
        raise ValueError("no key has a weight above zero")
    return Alias(slots.drop("sum"), keys, sizes, *walker(sums))


def alias_sampled(drawn: DataFrame, table: Alias) -> DataFrame:
    """(n, keys): the key of each draw (n, u, t), by u its bucket and by t its slot there. One equi-join, one row a draw."""
    held = drawn.sparkSession.sparkContext.broadcast((table.sizes, table.chance, table.other))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sizes, chance, other = held.value
        for batch in batches:
            u, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ut")
            at = np.minimum((u * len(sizes)).astype(np.int64), len(sizes) - 1)
            bucket = np.where(u * len(sizes) - at < chance[at], at, other[at])
            x = t * sizes[bucket]
            slot = np.minimum(x.astype(np.int64), sizes[bucket] - 1)
            columns = [batch.column("n"), pa.array(bucket.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(x - slot)]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "bucket", "slot", "rest"])

    met = drawn.select("n", "u", "t").mapInArrow(placed, "n long, bucket int, slot int, rest double").join(table.slots, ["bucket", "slot"])
    return met.select("n", *(F.when(F.col("rest") < F.col("chance"), F.col(k)).otherwise(F.col(f"other_{k}")).alias(k) for k in table.keys))


def drawn_keys(drawn: DataFrame, weights: DataFrame, keys: list[str], weight: str, spread=seeded) -> DataFrame:
    """(n, keys) by weight: pseudo-random draws by an alias table, evenly spread ones by the cumulative distribution."""
    if spread is even:
        return sampled(drawn, distribution(weights, keys, weight))
    return alias_sampled(drawn, alias_table(weights, keys, weight))


def tempered_marginal(sums: DataFrame, side: str, temperature: float) -> DataFrame:
    """(id, p): a marginal's shares to the power 1 / temperature, not normalised."""
    total = sums.where("side = 'total'").select(F.col("n").alias("total")).limit(1)
    rows = sums.where(F.col("side") == side).crossJoin(F.broadcast(total))
    return rows.select("id", tempered_share(F.col("n") / F.col("total"), temperature).alias("p"))


def independent_pairs(spark: SparkSession, sums: DataFrame, size: int, temperature: float, seed: int, spread=seeded) -> DataFrame:
    """(n, i, j): rows and columns drawn from the tempered marginals, each on its own."""
    sides = []
    for stream, (side, name) in enumerate((("row", "i"), ("column", "j"))):
        weights = tempered_marginal(sums, side, temperature).withColumnRenamed("id", name)
        sides.append(drawn_keys(draws(spark, size, seed, stream, spread), weights, [name], "p", spread))
    return sides[0].join(sides[1], "n")


def tempered_counts(full_cells: DataFrame, temperature: float) -> DataFrame:
    """(i, j, p): cells with marginals by their tempered counts."""
    share = lambda c: F.pow(F.col(c) / F.col("n"), F.lit(1 / temperature - 1))
    return full_cells.select("i", "j", (F.col("nij") * share("ni") * share("nj")).alias("p"))


def counted_pairs(spark: SparkSession, full_cells: DataFrame, size: int, temperature: float, seed: int, spread=seeded) -> DataFrame:
    """(n, i, j): cells drawn by their tempered counts, of cells with marginals."""
    return drawn_keys(draws(spark, size, seed, 0, spread), tempered_counts(full_cells, temperature), ["i", "j"], "p", spread)


class PairSampler:
    """Batches of pairs from tables that are made once: of counted pairs, and of independent ones by the tempered marginals."""

    def __init__(self, full_cells: DataFrame, sums: DataFrame, temperature: float = 1.0):
        self.spark = sums.sparkSession
        self.rows, self.columns = (cut(tempered_marginal(sums, side, temperature), side) for side in ("row", "column"))
        self.counted = alias_table(tempered_counts(full_cells, temperature), ["i", "j"], "p")
        self.sides = [alias_table(table.withColumnRenamed("id", name), [name], "p") for table, name in ((self.rows, "i"), (self.columns, "j"))]

    def positives(self, size: int, seed: int) -> DataFrame:
        return alias_sampled(draws(self.spark, size, seed), self.counted)

    def independent(self, size: int, seed: int) -> DataFrame:
        i, j = (alias_sampled(draws(self.spark, size, seed, k), table) for k, table in enumerate(self.sides))
        return i.join(j, "n")

    def batch(self, size: int, seed: int) -> DataFrame:
        """(n, i, j, positive): as many counted pairs as independent ones."""
        return self.positives(size, seed).withColumn("positive", F.lit(True)).unionByName(self.independent(size, seed + 1).withColumn("positive", F.lit(False)))

    def gibbs_batch(self, size: int, params: DataFrame, rounds: int, seed: int) -> DataFrame:
        """(n, i, j, positive): counted pairs, and where `rounds` of Gibbs steps lead from them."""
        start = cut(self.positives(size, seed), "start")
        far = gibbs(start, params, self.rows, self.columns, rounds, seed + 1)
        return start.withColumn("positive", F.lit(True)).unionByName(far.select("n", "i", "j").withColumn("positive", F.lit(False)))


def batch(spark: SparkSession, full_cells: DataFrame, sums: DataFrame, size: int, temperature: float, seed: int, spread=seeded) -> DataFrame:
    """(n, i, j, positive): as many counted pairs as independent ones."""
    good = counted_pairs(spark, full_cells, size, temperature, seed, spread).withColumn("positive", F.lit(True))
    return good.unionByName(independent_pairs(spark, sums, size, temperature, seed + 1, spread).withColumn("positive", F.lit(False)))


def conditional(given: DataFrame, params: DataFrame, marginal: DataFrame, row: str, column: str) -> DataFrame:
    """(n, id, p): for every stated row (n, id), the chance of each partner: its marginal times exp(row vector . column vector).

    A row a stated row and partner: for looking at, or for few stated rows. To draw, use `gibbs_step`. The blocks are
    gone through twice, first for what each stated row's chances are divided by and then for the chances, so that the
    rows of the result go from their block to where they are wanted and are never shuffled.
    """
    asked, partners = _ends(given, params, marginal, row, column)
    sums = _against(asked, partners, _block_sums, "n long, top double, sum double")
    # ln of the sum of exp(e), from each block's largest e and its sum of exp(e - top).
    kept = sums.groupBy("n").agg(F.max("top").alias("top"), F.sort_array(F.collect_list(F.struct("top", "sum"))).alias("blocks"))
    whole = F.aggregate("blocks", F.lit(0.0), lambda s, x: s + x["sum"] * F.exp(x["top"] - F.col("top")))
    met = cut(asked.drop("whole").join(kept.select("n", (F.col("top") + F.ln(whole)).alias("whole")), "n"), "asked")
    return _against(met, partners, _block_chances, "n long, id int, p double")


def _ends(given: DataFrame, params: DataFrame, marginal: DataFrame, row: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Stated rows (n, x, whole) and partners (id, x, lnp), both stored."""
    asked = given.join(params.select("id", F.col(row).cast("array<double>").alias("x")), "id").select(F.col("n").cast("long").alias("n"), "x", F.lit(0.0).alias("whole"))
    partners = params.select("id", F.col(column).cast("array<double>").alias("x")).join(marginal.where("p > 0"), "id").select(F.col("id").cast("int").alias("id"), "x", F.ln("p").alias("lnp"))
    return cut(asked, "asked"), cut(partners, "partners")


#: Stated rows and partners of a block, and scores that are held at once.
ASKED, PARTNERS, HELD = 16_384, 4_096, 1 << 20


def _against(asked: DataFrame, partners: DataFrame, of_strip: Callable, schema: str) -> DataFrame:
    """Stated rows against the partners, in blocks of both: each block of one side meets each of the other in one group.

    A block of stated rows goes to as many groups as there are blocks of partners, and the other way round, so what is
    shuffled are vectors, not pairs of them. `of_strip` (n, whole, ids, e) gives the columns of `schema` for some of a
    block's stated rows and all its partners, both in order; no more of a block than that is held at once.
    """
    na, nb = (max(1, -(-t.count() // most)) for t, most in ((asked, ASKED), (partners, PARTNERS)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # Partners of like ids, and so of like counts, have like chances, which Parquet then writes as few distinct ones.
    ends = sorted(set(partners.approxQuantile("id", [k / nb for k in range(1, nb)], 0.1 / nb))) if nb > 1 else []
    nb, after = len(ends) + 1, F.array(*map(F.lit, ends)) if ends else F.array().cast("array<double>")
    mine = asked.select(F.lit(True).alias("asked"), F.col("n").alias("key"), F.col("whole").alias("number"), "x", F.pmod(F.xxhash64("n"), F.lit(na)).cast("int").alias("a"), every(nb).alias("b"))
    theirs = partners.select(F.lit(False).alias("asked"), F.col("id").cast("long").alias("key"), F.col("lnp").alias("number"), "x", every(na).alias("a"), F.size(F.filter(after, lambda end: F.col("id") > end)).alias("b"))
    names = [field.split()[0] for field in schema.split(", ")]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows = pa.Table.from_batches(list(batches))
        sides = [rows.filter(one).sort_by("key") for one in (rows.column("asked"), pa.compute.invert(rows.column("asked")))]
        (n, whole), (ids, lnp) = ((t.column("key").to_numpy(), t.column("number").to_numpy()) for t in sides)
        if not len(n) or not len(ids):
            return
        x, y = (_vectors(t) for t in sides)
        ids, step = ids.astype(np.int32), max(1, HELD // len(ids))
        for k in range(0, len(n), step):
            s = slice(k, k + step)
            columns = of_strip(n[s], whole[s], ids, x[s] @ y.T + lnp)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return mine.unionByName(theirs).groupBy("a", "b").applyInArrow(block, schema)


def _vectors(table: pa.Table):
    return table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _block_sums(n, whole, ids, e):
    import numpy as np

    top = e.max(axis=1)
    return n, top, np.exp(e - top[:, None]).sum(axis=1)


def _block_chances(n, whole, ids, e):
    import numpy as np

    return np.repeat(n, len(ids)), np.tile(ids, len(n)), np.exp(e - whole[:, None]).ravel()


def hashed_noise(seed: int):
    """A function from rows n and partners id to numbers in (0, 1), by seed, n and id alone."""

    def numbers(n, ids):
        import numpy as np

        one, two, three = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
        start = np.uint64(seed * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)
        x = (n.astype(np.int64).view(np.uint64) * one + start)[:, None] ^ (ids.astype(np.int64).view(np.uint64) * three)[None, :]
        for shift, factor in ((30, two), (27, three), (31, one)):
            x = (x ^ (x >> np.uint64(shift))) * factor
        return ((x >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)

    return numbers


def even_noise(n, ids):
    """Fixed numbers in [0, 1) of rows and partners, for what must be the same anywhere."""
    import numpy as np

    x = 0.5 + n[:, None] * STEPS[0] + ids[None, :] * STEPS[1]
    return x - np.floor(x)


def gibbs_step(given: DataFrame, params: DataFrame, marginal: DataFrame, row: str, column: str, noise: Callable) -> DataFrame:
    """(n, id): one partner for every stated row (n, id), drawn by its marginal times exp(row vector . column vector).

    The largest of ln p + row . column + g is a draw by p exp(row . column), g = -ln(-ln u) being Gumbel's noise. Each
    block gives its rows' largest, and a partial aggregation the largest of all: no pair leaves a block.
    """

    def best(n, whole, ids, e):
        import numpy as np

        u = np.maximum(noise(n, ids), 1e-300)
        e = e - np.log(np.maximum(-np.log(u), 1e-300))
        at = e.argmax(axis=1)
        return n, ids[at], e[np.arange(len(at)), at]

    found = _against(*_ends(given, params, marginal, row, column), best, "n long, id int, e double")
    return found.groupBy("n").agg(F.max_by("id", F.struct("e", -F.col("id"))).alias("id"))


def drawn_from_rows(chances: DataFrame, drawn: DataFrame) -> DataFrame:
    """(n, id): one partner for each n of a table (n, id, p) of chances, by the largest of ln p + Gumbel's noise of u, n and id."""
    u = (F.pmod(F.xxhash64("u", "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    met = chances.where("p > 0").join(drawn.select("n", "u"), "n").select("n", "id", (F.ln("p") - F.ln(-F.ln(u))).alias("e"))
    return met.groupBy("n").agg(F.max_by("id", "e").alias("id"))


def gibbs(positives: DataFrame, params: DataFrame, rows: DataFrame, columns: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(n, i, j): from the positives (n, i, j), columns and rows drawn in turn given each other, `rounds` times both."""
    i = positives.select("n", F.col("i").alias("id"))
    j = positives.select("n", F.col("j").alias("id"))
    for k in range(rounds):
        j = cut(gibbs_step(i, params, columns, "v", "w", hashed_noise(seed + 2 * k)), "step")
        i = cut(gibbs_step(j, params, rows, "w", "v", hashed_noise(seed + 2 * k + 1)), "step")
    return i.withColumnRenamed("id", "i").join(j.withColumnRenamed("id", "j"), "n")


def words_of(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Pairs with the tokens of both ids."""
    name = lambda id_col, column: vocab.select(F.col("id").alias(id_col), F.col("token").alias(column))
    return pairs.join(name("i", "focal"), "i", "left").join(name("j", "context"), "j", "left")
