"""Exact top-k by inner product: M-trees of paged metric nodes, searched best first."""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE, FANOUT, SLICE = 256, 16, 2048


class Level(NamedTuple):
    """Nodes of one level: routing points, covering radii, parents in the level above and distances to these."""

    centres: object
    radii: object
    parents: object
    to_parent: object


class MTree:
    """Rows as points on one sphere, where the largest inner product is the smallest distance.

    A row x gains one more component, sqrt(r^2 - |x|^2), r the largest norm. Leaves are pages of rows
    with each row's distance to its page's routing point; nodes are paged in turn until FANOUT or fewer
    are left, and every node keeps its covering radius and its distance to its parent.
    """

    def __init__(self, ids, rows):
        import numpy as np

        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order].astype(np.float64)
        square = (rows * rows).sum(1)
        self.square = square.max(initial=0.0)
        points = np.hstack([rows, np.sqrt(np.maximum(self.square - square, 0))[:, None]])
        self.leaves, centres = [], []
        for at in self._split(points, np.arange(len(ids)), PAGE):
            centre = points[at].mean(0)
            away = np.linalg.norm(points[at] - centre, axis=1)
            by = np.argsort(away, kind="stable")
            self.leaves.append((ids[at[by]], rows[at[by]], away[by]))
            centres.append(centre)
        centres, radii = np.array(centres), np.array([leaf[2][-1] for leaf in self.leaves])
        #: From the leaves up.
        self.levels: list[Level] = []
        while len(centres) > FANOUT:
            groups = self._split(centres, np.arange(len(centres)), FANOUT)
            parents, to_parent = np.zeros(len(centres), np.int64), np.zeros(len(centres))
            above, wide = np.zeros((len(groups), centres.shape[1])), np.zeros(len(groups))
            for g, at in enumerate(groups):
                above[g] = centres[at].mean(0)
                parents[at], to_parent[at] = g, np.linalg.norm(centres[at] - above[g], axis=1)
                wide[g] = (to_parent[at] + radii[at]).max()
            self.levels.append(Level(centres, radii, parents, to_parent))
            centres, radii = above, wide
        self.levels.append(Level(centres, radii, None, None))

    @staticmethod
    def _split(points, at, size: int):
        """Parts of at most `size` points, halved along the widest component."""
        todo, done = [at], []
        while todo:
            part = todo.pop()
            if len(part) <= size:
                done.append(part)
                continue
            axis = points[part].var(0).argmax()
            part = part[points[part, axis].argsort(kind="stable")]
            half = max(size, len(part) // size // 2 * size) if len(part) > 2 * size else len(part) // 2
            todo += [part[:half], part[half:]]
        return done

    def search(self, queries, own, k: int) -> tuple:
        """(scores, ids) of the k best rows of each query but its own, by score and then smaller id; -inf where there are fewer.

        Each query visits pages by rising bound until the bound is over the distance of its k-th best.
        Queries go in step: those that visit one page next are multiplied with it together.
        """
        import numpy as np

        m = len(queries)
        points = np.hstack([queries, np.zeros((m, 1))])
        length = (queries * queries).sum(1)
        scores, found = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
        limit = np.full(m, np.inf)

        def distance(q, centres):
            return np.sqrt(np.maximum((points[q] ** 2).sum(1)[:, None] + (centres**2).sum(1) - 2 * points[q] @ centres.T, 0))

        def visit(leaf: int, q, away) -> None:
            ids, rows, to_page = self.leaves[leaf]
            reach = limit[q]
            # A row's distance to its page's point bounds its own: |away - to_page| <= distance.
            low, high = np.searchsorted(to_page, (away - reach).min()), np.searchsorted(to_page, (away + reach).max(), "right")
            product = queries[q] @ rows[low:high].T
            product[own[q][:, None] == ids[low:high]] = -np.inf
            some = np.flatnonzero((product >= np.maximum(scores[q, -1], -1e300)[:, None]).any(1))
            if not len(some):
                return
            both = np.hstack([scores[q[some]], product[some]])
            who = np.hstack([found[q[some]], np.broadcast_to(ids[low:high], (len(some), high - low))])
            order = np.lexsort((who, -both), axis=1)[:, :k]
            scores[q[some]], found[q[some]] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
            last = scores[q[some], -1]
            # A little more than the distance of the k-th best, so that ties and rounding stay in.
            far = np.sqrt(np.maximum(self.square + length[q[some]] - 2 * np.maximum(last, -1e300), 0)) * (1 + 1e-9) + 1e-6
            limit[q[some]] = np.where(np.isfinite(last), far, np.inf)

        def by_group(groups, members):
            order = np.argsort(groups, kind="stable")
            cuts = np.flatnonzero(np.diff(groups[order])) + 1
            for part in np.split(order, cuts):
                if len(part):
                    yield int(groups[part[0]]), members[part]

        # Down to the nearest page first, which gives a limit.
        everyone = np.arange(m)
        away = distance(everyone, self.levels[-1].centres)
        top = away
        nearest = away.argmin(1)
        nearest_away = away[everyone, nearest]
        for level in reversed(self.levels[:-1]):
            following, following_away = nearest.copy(), nearest_away.copy()
            for node, q in by_group(nearest, everyone):
                children = np.flatnonzero(level.parents == node)
                d = distance(q, level.centres[children])
                best = d.argmin(1)
                following[q], following_away[q] = children[best], d[np.arange(len(q)), best]
            nearest, nearest_away = following, following_away
        for leaf, q in by_group(nearest, everyone):
            visit(leaf, q, nearest_away[q])
        # Bounds of all nodes that the limit leaves, level by level.
        away, bound = top, np.maximum(top - self.levels[-1].radii, 0)
        for level in reversed(self.levels[:-1]):
            below, below_bound = np.full((m, len(level.radii)), np.inf), np.full((m, len(level.radii)), np.inf)
            for node in range(bound.shape[1]):
                q = np.flatnonzero(bound[:, node] <= limit)
                children = np.flatnonzero(level.parents == node)
                # |distance - parent distance| bounds a child's distance without computing it.
                may = np.abs(away[q, node][:, None] - level.to_parent[children]) - level.radii[children] <= limit[q][:, None]
                q, children = q[may.any(1)], children[may.any(0)]
                if len(q) and len(children):
                    d = distance(q, level.centres[children])
                    below[np.ix_(q, children)] = d
                    below_bound[np.ix_(q, children)] = np.maximum(d - level.radii[children], 0)
            away, bound = below, below_bound
        bound[everyone, nearest] = np.inf
        order = np.argsort(bound, axis=1, kind="stable")
        for step in range(bound.shape[1]):
            leaf = order[:, step]
            b = bound[everyone, leaf]
            going = np.flatnonzero((b <= limit) & np.isfinite(b))
            if not len(going):
                break
            for node, q in by_group(leaf[going], going):
                visit(node, q, away[q, node])
        return scores, found


def _search(k: int):
    """Of one block of rows and one of queries, the k best rows of each query."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        import numpy as np

        def by_width(table: pa.Table) -> dict:
            table = table.combine_chunks()
            ids = table.column("vec_id").to_numpy()
            lists = table.column("x").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.float64()))
            sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            return {n: (ids[at], flat[starts[at][:, None] + np.arange(n)]) for n in np.unique(sizes).tolist() if len(at := np.flatnonzero(sizes == n))}

        held, parts = by_width(rows), [np.zeros((3, 0), np.int64)]
        for width, (own, vectors) in by_width(queries).items():
            if width not in held:
                continue
            tree = MTree(*held[width])
            for a in range(0, len(own), SLICE):
                scores, found = tree.search(vectors[a : a + SLICE], own[a : a + SLICE], k)
                q, c = np.nonzero(np.isfinite(scores))
                parts.append(np.stack([own[a : a + SLICE][q], found[q, c], scores[q, c].astype(np.int64)]))
        return pa.Table.from_arrays([pa.array(c) for c in np.hstack(parts)], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): floor(64 * component) of the vectors whose components are all finite numbers."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    return rows.where(F.forall("x", finite)).select("vec_id", F.transform("x", lambda v: F.floor(v * 64).cast("double")).alias("x"))


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, block: int = 131_072, least: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products of every `every`-th row with all others.

    Components are floor(64 * x); scores are exact while below 2^53. Ties go to the smaller vec_id.
    Rows and queries are dealt evenly to blocks of about `block` at most (and of `least` where the cores
    are not all needed); each block of queries meets each block of rows in a task of its own, which holds
    one tree, and answers with k rows a query; these are ranked after one shuffle. Nothing but two counts
    goes through the driver. Vectors null, or with null or non-finite components, and null ids take no
    part; vectors of different lengths never meet. Rows that share a query's id are its own row, and are
    asked once each distinct vector; repeated rows are candidates each. Other columns are not read.
    """
    rows = usable(vectors, id_col, vector_col)
    asking = F.col("vec_id") % every == 0
    n = rows.agg(F.count("*").alias("rows"), F.count_if(asking).alias("queries")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(1, math.ceil(n["rows"] / block), min(cores, n["rows"] // least))
    query_blocks = max(1, math.ceil(n["queries"] / block))
    # Dealt by place as well as content, so that copies of one row don't share a block.
    deal = lambda of, blocks: F.pmod(F.xxhash64(*of, F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = rows.withColumn("r", deal(["vec_id"], row_blocks)).withColumn("q", each(query_blocks))
    asked = rows.where(asking).distinct().withColumn("q", deal(["vec_id"], query_blocks)).withColumn("r", each(row_blocks))
    found = held.groupBy("r", "q").cogroup(asked.groupBy("r", "q")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
