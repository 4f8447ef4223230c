"""Connected components of a graph held as a DataFrame, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long); all nodes of a component share one root.

    Each round a node joins the neighbour, or itself, of least hash, and only edges between different
    hosts go on: an expected constant fraction of the nodes goes each round, whatever the shape of a
    component. A node's neighbours are only ever reduced to their minimum, never gathered; a node with
    very many edges is split by Spark's skew join. Self-loops are allowed, nulls are not.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    found = None
    while found is None or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hosts = both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min(rank("b")), F.first(rank("a")))["v"].alias("host")
        )
        hosts = stored(hosts, "hosts")
        if found is None:
            found = hosts.select("node", F.col("host").alias("root"))
        else:
            step = hosts.select(F.col("node").alias("root"), "host")
            found = found.join(step, "root", "left").select("node", F.coalesce("host", "root").alias("root"))
        ends = hosts.select(F.col("node").alias("a"), F.col("host").alias("host_a"))
        other = hosts.select(F.col("node").alias("b"), F.col("host").alias("host_b"))
        left = stored(
            left.join(ends, "a").join(other, "b").where("host_a <> host_b")
            .select(F.least("host_a", "host_b").alias("a"), F.greatest("host_a", "host_b").alias("b")).distinct(),
            "edges",
        )
    return found
