"""Dependency corpora and parsing scores: sentences as arrays of word ids, head positions and arc ids, the root at place 0."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.operators.cooccurrence import BROADCAST_TOKENS, numbered
from lexigrid.operators.embeddings import dot
from lexigrid.operators.sampled_training import SampledLoss
from lexigrid.sources.shared import cut

#: Words of a sentence, the root among them.
LONGEST = 30
ROOT = "[ROOT]"


def blocks(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(sent, block): what blank lines of a text stand between."""
    found = texts.select(F.explode(F.split(text_col, r"\n[ \t\r]*\n\s*")).alias("block")).where("trim(block) <> ''")
    return found.select(F.monotonically_increasing_id().alias("sent"), "block")


def rows(found: DataFrame) -> DataFrame:
    """(sent, kept): the lines of a block, tab-separated, whose head (field 6, from 0) isn't '_', with their old places from 1."""
    fields = F.transform(F.filter(F.split("block", "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, "\t"))
    each = F.transform(fields, lambda p, k: F.struct((k + 1).cast("long").alias("old"), F.get(p, 1).alias("word"), F.get(p, 6).alias("head"), F.get(p, 7).alias("arc")))
    return found.select("sent", F.filter(each, lambda x: x["head"].isNotNull() & (x["head"] != "_")).alias("kept"))


def arc_types(kept: DataFrame) -> DataFrame:
    """(id, token) of the arcs by name."""
    names = kept.select(F.explode("kept").alias("k")).select(F.col("k.arc").alias("token")).where("token is not null").distinct()
    return numbered(names.withColumn("head", F.substring("token", 1, 1)), ["head", "token"], ["head"]).select("id", "token")


def sentences(kept: DataFrame, words: DataFrame, arcs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(sent, words, heads, arcs, n) with the root first, its head and arc null; words outside the vocabulary are 0.

    Heads point to places after lines were left out. Sentences whose word hangs on a line that was left
    out go, as do those of more than `longest` words.
    """
    olds = F.transform("kept", lambda x: x["old"])
    place = lambda x: F.when(x["head"].try_cast("long") == 0, F.lit(0)).otherwise(F.nullif(F.array_position("olds", x["head"].try_cast("long")), F.lit(0)))
    heads = kept.where((F.size("kept") > 0) & (F.size("kept") < longest)).withColumn("olds", olds).withColumn("heads", F.transform("kept", place))
    whole = heads.where(~F.exists("heads", lambda x: x.isNull()))
    each = whole.select("sent", F.posexplode(F.arrays_zip("kept", "heads")).alias("pos", "t"))
    each = each.select("sent", (F.col("pos") + 1).alias("pos"), F.col("t.kept.word").alias("word"), F.col("t.heads").cast("int").alias("head"), F.col("t.kept.arc").alias("arc"))
    roots = whole.select("sent", F.lit(0).alias("pos"), F.lit(ROOT).alias("word"), F.lit(None).cast("int").alias("head"), F.lit(None).cast("string").alias("arc"))
    named = each.unionByName(roots).join(words.select(F.col("token").alias("word"), F.col("id").alias("wid")), "word", "left")
    named = named.join(arcs.select(F.col("token").alias("arc"), F.col("id").alias("aid")), "arc", "left")
    whole = named.groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("wid", F.lit(0)).alias("wid"), "head", "aid"))).alias("t"))
    return whole.select("sent", F.col("t.wid").alias("words"), F.col("t.head").alias("heads"), F.col("t.aid").alias("arcs"), F.size("t").alias("n"))


def named(found: DataFrame, words: DataFrame, arcs: DataFrame) -> DataFrame:
    """(sent, pos, word, head, arc) as tokens, for reading."""
    each = found.select("sent", F.posexplode(F.arrays_zip("words", "heads", "arcs")).alias("pos", "t"), F.col("words").alias("all"))
    each = each.select("sent", "pos", F.col("t.words").alias("wid"), F.get("all", F.col("t.heads")).alias("hid"), F.col("t.arcs").alias("aid"))
    name = lambda table, id_col, column: table.select(F.col("id").alias(id_col), F.col("token").alias(column))
    return each.join(name(words, "wid", "word"), "wid", "left").join(name(words, "hid", "head"), "hid", "left").join(name(arcs, "aid", "arc"), "aid", "left").select("sent", "pos", "word", "head", "arc")


def batches(found: DataFrame, size: int) -> DataFrame:
    """Sentences by length, `size` to a batch, filled up to the batch's longest: (batch, sent, words, heads, mask), mask true where filled."""
    placed = numbered(found, ["n", "sent"], ["n"]).withColumn("batch", F.floor(F.col("id") / size).cast("int"))
    longest = placed.groupBy("batch").agg(F.max("n").alias("longest"))
    fill = lambda name: F.concat(F.transform(name, lambda x: F.coalesce(x, F.lit(0))), F.array_repeat(F.lit(0), F.col("longest") - F.col("n")))
    mask = F.transform(F.sequence(F.lit(1), F.col("longest")), lambda k: k > F.col("n"))
    return placed.join(longest, "batch").select("batch", "sent", fill("words").alias("words"), fill("heads").alias("heads"), mask.alias("mask"))


def head_words() -> Column:
    """The word of each place's head; null for the root."""
    return F.transform("heads", lambda h: F.get("words", h))


def _sided(params: DataFrame, id_col: str, vector: str, bias: str, names: tuple[str, str]) -> DataFrame:
    return params.select(F.col("id").alias(id_col), F.col(vector).alias(names[0]), F.col(bias).alias(names[1]))


def with_energy(pairs: DataFrame, params: DataFrame, biases: bool = True, most: int = BROADCAST_TOKENS) -> DataFrame:
    """Pairs of words (mw, hw) with energy = w[mw] . v[hw] + wb[mw] + vb[hw].

    Words repeat, so each distinct pair is scored once; up to `most` scores are broadcast, and no vector meets a word's rows.
    """
    once = pairs.select("mw", "hw").distinct()
    both = once.join(_sided(params, "mw", "w", "wb", ("x", "xb")), "mw").join(_sided(params, "hw", "v", "vb", ("y", "yb")), "hw")
    energy = dot("x", "y") + F.col("xb") + F.col("yb") if biases else dot("x", "y")
    known = cut(both.select("mw", "hw", energy.alias("energy")), "energies")
    return pairs.join(F.broadcast(known) if known.count() <= most else known, ["mw", "hw"])


def scores(found: DataFrame, params: DataFrame) -> DataFrame:
    """(sent, score): over all words but the root, the sum of w[word] . v[head] + wb[word] + vb[head]."""
    each = found.select("sent", F.explode(F.slice(F.arrays_zip("words", head_words().alias("of")), 2, 1_000_000)).alias("t")).select("sent", F.col("t.words").alias("mw"), F.col("t.of").alias("hw"))
    return with_energy(each, params).groupBy("sent").agg(F.sum("energy").alias("score"))


def energies(found: DataFrame, params: DataFrame, biases: bool = True) -> DataFrame:
    """(sent, m, h, energy) of every word but the root with every other place, a sentence's rows in one partition.

    Sentences are dealt before their places are paired, so what follows by sentence shuffles no pair.
    """
    place = F.sequence(F.lit(0), F.col("n") - 1)
    found = found.select("sent", "words", "n").repartition("sent")
    pairs = found.select("sent", "words", "n", F.explode(F.slice(place, 2, 1_000_000)).alias("m")).where("n > 1").select("sent", "words", "m", F.explode(place).alias("h")).where("m <> h")
    pairs = pairs.select("sent", "m", "h", F.get("words", F.col("m")).alias("mw"), F.get("words", F.col("h")).alias("hw"))
    return with_energy(pairs, params, biases).select("sent", "m", "h", "energy")


def head_chances(energy: DataFrame) -> DataFrame:
    """(sent, m, h, p): the softmax of each word's energies."""
    word = Window.partitionBy("sent", "m")
    shifted = energy.withColumn("e", F.exp(F.col("energy") - F.max("energy").over(word)))
    return shifted.select("sent", "m", "h", (F.col("e") / F.sum("e").over(word)).alias("p"))


def drawn_heads(chances: DataFrame, seed: int) -> DataFrame:
    """(sent, m, h): one head a word by its chances, by a number in [0, 1) that seed, sentence and word give."""
    upto = F.sum("p").over(Window.partitionBy("sent", "m").orderBy("h"))
    u = F.pmod(F.xxhash64(F.lit(seed), "sent", "m"), F.lit(1 << 52)) / float(1 << 52)
    met = chances.withColumns({"high": upto, "u": u})
    return met.groupBy("sent", "m").agg(F.coalesce(F.min_by("h", F.when(F.col("u") < F.col("high"), F.col("high"))), F.max("h")).alias("h"))


def as_arrays(drawn: DataFrame) -> DataFrame:
    """(sent, heads): the root's head null."""
    pairs = F.array_sort(F.collect_list(F.struct("m", "h")))
    return drawn.groupBy("sent").agg(F.concat(F.array(F.lit(None).cast("int")), F.transform(pairs, lambda x: x["h"].cast("int"))).alias("heads"))


def on_cycle(heads: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(sent, m): the least place on a cycle of each sentence that has one: where `longest` jumps and more don't reach the root.

    The jumps are doubled by one fold, so that an optimizer that moves expressions can't nest them.
    """
    first = F.transform("heads", lambda h: F.coalesce(h, F.lit(0)))
    times = F.sequence(F.lit(1), F.lit(max(1, (longest - 1).bit_length())))
    jumped = F.aggregate(times, first, lambda p, _: F.transform(p, lambda x: F.get(p, x)))
    return heads.select("sent", F.array_min(F.filter(jumped, lambda x: x != 0)).alias("m")).where("m is not null")


def _numbers(seed: int, sents, words, times):
    """Numbers in [0, 1) by seed, sentence, word and how many times it was drawn before."""
    import numpy as np

    one, two, three = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
    x = sents.astype(np.int64).view(np.uint64) * one + np.uint64(seed * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(29))) * two + words.astype(np.uint64) * three + times.astype(np.uint64) * one
    for shift, factor in ((30, two), (27, three), (31, one)):
        x = (x ^ (x >> np.uint64(shift))) * factor
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def _popped(seed: int, rounds: int):
    """Heads of sentences (sent, chances) without cycles, some thousand sentences at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("chances")
            sents, sizes = batch.column("sent").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            m, h, p = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            row = np.repeat(np.arange(len(sents)), sizes)
            longest = int(max(m.max(initial=0), h.max(initial=0))) + 1
            words = np.zeros(len(sents), np.int64)
            np.maximum.at(words, row, np.maximum(m, h) + 1)
            upto = np.zeros((len(sents), longest, longest))
            upto[row, m, h] = p
            upto = upto.cumsum(axis=2)
            last = np.zeros((len(sents), longest), np.int64)
            np.maximum.at(last, (row[p > 0], m[p > 0]), h[p > 0])
            heads, times = np.zeros((len(sents), longest), np.int64), np.zeros((len(sents), longest), np.int64)
            who, at = np.nonzero((np.arange(longest) > 0) & (np.arange(longest) < words[:, None]))
            for _ in range(rounds):
                # The first head whose share reaches over the number; rounding may leave none but the last.
                u = _numbers(seed, sents[who], at, times[who, at]) * upto[who, at, -1]
                heads[who, at] = np.minimum((upto[who, at] <= u[:, None]).sum(axis=1), last[who, at])
                times[who, at] += 1
                some = np.unique(who)
                far = heads[some]
                for _ in range(longest.bit_length()):
                    far = np.take_along_axis(far, far, axis=1)
                # Whoever is reached after so many steps lies on a cycle.
                reached = np.zeros((len(some), longest), bool)
                np.put_along_axis(reached, far, True, axis=1)
                reached[:, 0] = False
                of, at = np.nonzero(reached)
                who = some[of]
                if not len(who):
                    break
            else:
                raise ValueError(f"cycles are left after {rounds} rounds in sentence {sents[who[0]]}")
            found = [[None, *heads[k, 1 : words[k]].tolist()] for k in range(len(sents))]
            yield pa.RecordBatch.from_arrays([pa.array(sents, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["sent", "heads"])

    return run


def tree_heads(chances: DataFrame, seed: int, rounds: int = 10_000) -> DataFrame:
    """(sent, heads) without cycles, in one pass over (sent, m, h, p): a tree by the product of its words' chances.

    All words draw a head; while some lie on cycles, those and only those draw again. That is cycle popping, whose
    trees have exactly the chance of a draw that happened to have no cycle. Sentences are short, so each is one row of
    a batch. Fails with ValueError after `rounds`, as where no chance leads to the root.
    """
    held = chances.groupBy(F.col("sent").cast("long").alias("sent")).agg(F.collect_list(F.struct(F.col("m").cast("int").alias("m"), F.col("h").cast("int").alias("h"), F.col("p").cast("double").alias("p"))).alias("chances"))
    return held.mapInArrow(_popped(seed, rounds), "sent long, heads array<int>")


def contrast(found: DataFrame, params: DataFrame, negatives: int, seed: int, constrained: bool = True) -> DataFrame:
    """(sent, positive_score, negative_score): of the heads given, and the mean of those drawn `negatives` times."""
    drawn = drawn_negatives(found, params, negatives, seed, constrained)
    numbered = found.drop("heads").join(drawn, "sent").withColumns({"whole": F.col("sent"), "sent": F.struct("sent", "draw")})
    far = scores(numbered, params).groupBy(F.col("sent.sent").alias("sent")).agg(F.avg("score").alias("negative_score"))
    return scores(found, params).withColumnRenamed("score", "positive_score").join(far, "sent")


def drawn_negatives(found: DataFrame, params: DataFrame, negatives: int, seed: int, constrained: bool = True) -> DataFrame:
    """(sent, draw, heads): heads drawn by the parameters' chances, `negatives` times; trees where constrained."""
    chances, out = cut(head_chances(energies(found, params)), "chances"), None
    for k in range(negatives):
        heads = tree_heads(chances, seed + 1000 * k) if constrained else as_arrays(drawn_heads(chances, seed + 1000 * k))
        one = heads.select("sent", F.lit(k).alias("draw"), "heads")
        out = one if out is None else out.unionByName(one)
    return out


def head_pairs(found: DataFrame, sign: Column) -> DataFrame:
    """(sent, i, j, sign): for every word but the root the word of its head as i, itself as j."""
    each = F.slice(F.arrays_zip(head_words().alias("i"), F.col("words").alias("j")), 2, 1_000_000)
    return found.select("sent", sign.alias("sign"), F.explode(each).alias("t")).select("sent", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "sign")


def parser_loss() -> SampledLoss:
    """The loss of `parser_batches`: their pairs' signs times the scores."""
    return SampledLoss(lambda n: F.col("sign") * F.col("score") / n, lambda n: F.col("sign") / n)


def parser_batches(found: DataFrame, many: int, negatives: int, seed: int, constrained: bool = True) -> Callable:
    """batch(k, params) for `sampled_training.train_sampled`, with needs_params and size 1: batch k mod `many` of the sentences.

    The loss is -(sum of the given heads' scores - mean of the drawn heads' sums) by the number of sentences. Heads are
    drawn anew for each batch, by the chances that its parameters give. A word's vector v learns where it is a head, w
    where it has one, whatever sentences and places they are. Biases are at the ends of the vectors.
    """

    def batch(k: int, params: DataFrame) -> DataFrame:
        mine = cut(found.where(F.pmod(F.xxhash64("sent"), F.lit(many)) == k % many), "sentences")
        whole = params.select("id", "v", "w", F.lit(0.0).alias("vb"), F.lit(0.0).alias("wb"))
        size = max(1, mine.count())
        drawn = drawn_negatives(mine, whole, negatives, seed + 7919 * k, constrained)
        far = mine.drop("heads").join(drawn, "sent")
        return head_pairs(mine, F.lit(-1.0 / size)).unionByName(head_pairs(far, F.lit(1.0 / size / negatives)))

    return batch
