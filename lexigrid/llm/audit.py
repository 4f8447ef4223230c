"""How filters interact: what each removes behind every prefix of every order, from stored tables of failing ids."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import stored

FILTERS = "ABCDE"
_SPACES = r"[\x20\x09-\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """The filters that a text alone decides: A few words, B repeated words, C capitals, D odd marks."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def rows_and_failing(docs: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(row, doc_id, part) of every document, and for each filter of FILTERS the stored table (row) of those that fail it.

    Texts are read once; hashes of 128 bits stand for them where copies are sought. E fails a row whose text a smaller
    doc_id has; a null doc_id is not smaller or greater than any.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), *(c.alias(name) for name, c in conditions(text).items()),
    )
    narrow = stored(narrow, "measured")
    failing = {name: stored(narrow.where(name).select("row"), f"failing-{name}") for name in "ABCD"}
    texts = narrow.select("row", "doc_id", "t1", "t2").where("doc_id is not null")
    least = texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("t1", "t2", "least")
    failing["E"] = stored(texts.join(stored(least, "texts"), ["t1", "t2"]).where("doc_id > least").select("row"), "failing-E")
    return narrow.select("row", "doc_id", "part"), failing


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with good and toxic as 0 or 1, 0 without a label; an id's repeated labels count if any is 1."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    one = lambda name: F.coalesce((F.col(name) == 1).cast("int"), F.lit(0)).alias(name)
    return rows.join(marks, "doc_id", "left").select("row", "part", one("good"), one("toxic"))


def interactions(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """What each filter does in every order of the filters, by part; rows (row, part, good, toxic), failing (row) by filter.

    One filter after the other, the left-semi join of what came so far with the filter's id table is what it removes, and
    the left-anti join what survives; both are stored, the former with the filter among those `failed`. A prefix's
    survivors are the rows that failed no filter of it, whatever its order, so what is left is sums over at most
    2^filters groups a part. Only rows that some table holds take part in the joins; the rest survives everything.

    Returns for each part, filter_order (the filters' names in a row) and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley. `row` must be unique and not null in rows; ids of a table that no row has count
    nowhere, and an id that a table repeats counts once.
    """
    names = list(failing)
    some = reduce(DataFrame.unionByName, (t.select("row") for t in failing.values()))
    state = stored(rows.join(some, "row", "left_semi").withColumn("failed", F.lit(0)), "suspects")
    for k, table in enumerate(failing.values()):
        removed = state.join(table, "row", "left_semi").withColumn("failed", F.col("failed").bitwiseOR(F.lit(1 << k)))
        state = stored(state.join(table, "row", "left_anti").unionByName(removed), "survivors")
    groups = stored(
        state.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")), "groups"
    )
    totals = rows.groupBy("part").agg(F.count("*").alias("total"))

    bits = [1 << k for k in range(len(names))]
    prefixes = [(before, bit) for before in range(1 << len(names)) for bit in bits if not before & bit]
    pair = lambda before, bit: F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit"))
    met = groups.select("*", F.explode(F.array(*(pair(*p) for p in prefixes))).alias("p")).select("*", "p.*")
    met = met.where((F.col("failed").bitwiseAND(F.col("bit")) != 0) & (F.col("failed").bitwiseAND(F.col("before")) == 0))
    sums = met.groupBy("part", "before", "bit").agg(F.sum("n").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"), F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("unique_fails"))

    steps = [
        F.struct(F.lit("".join(names[k] for k in order)).alias("filter_order"), F.lit(at + 1).alias("step"), F.lit(sum(bits[k] for k in order[:at])).alias("before"), F.lit(bits[order[at]]).alias("bit"))
        for order in permutations(range(len(names))) for at in range(len(names))
    ]
    table = totals.select("part", "total", F.explode(F.array(*steps)).alias("s")).select("part", "total", "s.*").join(sums, ["part", "before", "bit"], "left")
    table = table.fillna(0, ["removed", "good_lost", "toxic_lost", "unique_fails"])
    order, mine = Window.partitionBy("part", "filter_order"), Window.partitionBy("part", "bit")
    so_far = F.sum("removed").over(order.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    # A filter at the front removes all that fail it.
    return table.select(
        "part", "filter_order", "step", (F.col("total") - so_far).alias("kept"), "removed", (F.max("removed").over(mine) - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(mine).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`interactions` of the filters of FILTERS over whole texts, by source.

    Null texts are empty, a null source is the empty string. Rows of one doc_id are rows of their own; rows without one
    have no label and are no copies. An empty table gives no rows; of columns with other names none is read.
    """
    rows, failing = rows_and_failing(docs)
    return interactions(labelled(rows, labels), failing)


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
        100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p JOIN x q ON q.x <> p.x JOIN x r ON r.x NOT IN (p.x, q.x) JOIN x s ON s.x NOT IN (p.x, q.x, r.x) JOIN x t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INT AS step FROM o),
k AS (SELECT filter_order, step, filter_order[step] AS f, list_transform(range(1, step), lambda i: filter_order[i]) AS before FROM s),
j AS (SELECT part, filter_order, step, f, n, good, toxic, m[f] AS fails, len(list_filter(before, lambda b: m[b])) > 0 AS gone, len(list_filter(map_values(m), lambda v: v)) = 1 AS single FROM k CROSS JOIN g),
r AS (SELECT part, filter_order, step, f, sum(n * (NOT gone AND NOT fails)::INT)::BIGINT AS kept, sum(n * (NOT gone AND fails)::INT)::BIGINT AS removed, sum(n * (gone AND fails)::INT)::BIGINT AS redundant,
        sum(n * (fails AND single)::INT)::BIGINT AS unique_fails, sum(good * (NOT gone AND fails)::INT)::BIGINT AS good_lost, sum(toxic * (NOT gone AND fails)::INT)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""
