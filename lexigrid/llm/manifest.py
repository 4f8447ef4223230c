"""A Merkle manifest of a dataset: trees by language over all documents, a proof for each, and what tampering shows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import stored

#: Levels of a superblock: 1,024 leaves, some 100 KB, are reduced together.
BITS = 10
_SIDE = 1 << 33


def joined_hash(*hexes: str) -> str:
    """The hash of a run of nodes: sha256 of their digests as hex text."""
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def _height(size: int, bits: int) -> int:
    """Levels that a superblock of a tree with `size` nodes goes up: all of its own, or up to the tree's root."""
    return min(bits, (size - 1).bit_length())


def _levels(hexes: list[str], height: int) -> list[list[str]]:
    """The nodes of a superblock, level by level; a node that is alone in its run is hashed alone."""
    levels = [hexes]
    for _ in range(height):
        low = levels[-1]
        levels.append([joined_hash(*low[k : k + 2]) for k in range(0, len(low), 2)])
    return levels


def _path(levels: list[list[str]], at: int) -> list[str]:
    """A node's siblings from below: R and L before those on its right and left, '-' where it is alone."""
    steps = []
    for level in levels[:-1]:
        other = at ^ 1
        steps.append("-" if other >= len(level) else ("R" if other > at else "L") + level[other])
        at >>= 1
    return steps


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in path:
        other = step[1:]
        leaf = joined_hash(leaf, other) if step[0] == "R" else joined_hash(other, leaf) if step[0] == "L" else joined_hash(leaf)
    return leaf


def placed(nodes: DataFrame, key: str, *order: str) -> DataFrame:
    """nodes with `pos`, their place from 0 within the key, and `size`, the key's number of nodes.

    Range-partitioned and sorted, then stored; what is summed up in order is one number a partition and key.
    Nodes that are equal in all of `order` are told apart by where they were read, so that they can be split.
    """
    tied = nodes.withColumn("tie_", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(key, *order, "tie_").sortWithinPartitions(key, *order, "tie_").drop("tie_")
    ordered = stored(ordered.withColumn("at_", F.monotonically_increasing_id()), "ordered").withColumn("part_", F.floor(F.col("at_") / _SIDE))
    runs = ordered.groupBy(key, "part_").agg(F.count("*").alias("n"), F.min("at_").alias("first_"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stored(runs.select(key, "part_", (before - F.col("first_")).alias("shift_"), F.sum("n").over(Window.partitionBy(key)).alias("size")), "runs")
    return ordered.join(sizes, [key, "part_"]).withColumn("pos", F.col("at_") + F.col("shift_")).drop("part_", "at_", "shift_")


def _in_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", bits))


def _roots_of_blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """(key, pos, size, hash) one superblock higher: each superblock of the nodes reduced to one."""

    def reduced(names, rows):
        import pandas as pd

        rows = rows.sort_values("pos")
        size = int(rows["size"].iloc[0])
        top = _levels(rows["hash"].tolist(), _height(size, bits))[-1]
        return pd.DataFrame({"key": [names[0]], "pos": [names[1]], "size": [-(-size >> bits)], "hash": top})

    return _in_blocks(nodes, bits).groupBy("key", "block").applyInPandas(reduced, "key string, pos long, size long, hash string")


def _rising(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes (key, pos, size, hash), then those at the top of each superblock, up to one node a key."""
    levels = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        levels.append(stored(_roots_of_blocks(levels[-1], bits), "nodes"))
        most = -(-most >> bits)
    return levels


def _falling(levels: list[DataFrame], outer: DataFrame, bits: int) -> DataFrame:
    """(key, block, path): for each superblock of the lowest level, the siblings from its top to the root.

    outer has the paths above the top level. Each level's nodes and the outer paths are cogrouped by superblock.
    """

    def joined(names, rows, above):
        import pandas as pd

        rows = rows.sort_values("pos")
        found = _levels(rows["hash"].tolist(), _height(int(rows["size"].iloc[0]), bits))
        rest = list(above["path"].iloc[0])
        paths = [_path(found, k) + rest for k in range(len(rows))]
        return pd.DataFrame({"key": names[0], "block": rows["pos"].tolist(), "path": paths})

    for level in reversed(levels[1:]):
        groups = _in_blocks(level.select("key", "pos", "size", "hash"), bits).groupBy("key", "block").cogroup(outer.groupBy("key", "block"))
        outer = stored(groups.applyInPandas(joined, "key string, block long, path array<string>"), "paths")
    return outer


def _leaf_hash(parts: list[Column]) -> Column:
    """sha256 of the parts, each '-' if null, else its byte count, ':' and itself."""
    told = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, tampered): the hash of each row, and the hash it has after tampering, null where nothing changes.

    Only rows whose id's crc32 is divisible by 7 and whose n_chars isn't null are tampered with. key orders the languages, null first.
    """
    doc_id, chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    parts = lambda n: [doc_id.cast("string"), F.col("source"), F.col("lang"), n.cast("string"), F.col("text")]
    struck = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & chars.isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("key"), doc_id.alias("doc_id"), _leaf_hash(parts(chars)).alias("leaf"),
        F.when(struck, _leaf_hash(parts(chars.cast("decimal(20,0)") + 1))).alias("tampered"),
    )


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Leaves are hashed where the texts are; after that only (language, id, hashes) moves. They are placed by a range
    partition, which a language of any size is split by, and reduced in superblocks of 2^bits, level upon level; the
    languages' subroots make one more tree in the same way. Then, from the top, nodes and the siblings outside their
    superblock are cogrouped by superblock; at the leaves that finishes reduction, proofs and folding together. The last
    superblock of a language is reduced as the others, so a group has 2^bits rows at most.

    A null doc_id comes before all others and is never tampered with; rows of one id are ordered by their leaf's hash.
    Rows that repeat are leaves of their own. A language of one row has its leaf as subroot, and a table of one language
    that subroot as root; where both hold, the proof is the hash of nothing. An empty table gives no rows. Of other
    columns none is read.
    """
    nodes = stored(leaves(docs), "leaves")
    nodes = stored(placed(nodes, "key", "doc_id", "leaf"), "placed")
    mine = _rising(nodes.withColumnRenamed("leaf", "hash").select("key", "pos", "size", "hash"), bits)
    subroots = mine[-1].select("key", "hash")
    top = placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "hash"), "key", "lang_key")
    langs = _rising(top, bits)
    # One row: above the root there is nothing.
    nothing = stored(langs[-1].select("key", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("path")), "paths")
    above = _falling(langs, nothing, bits)

    def of_lang(names, rows, higher):
        import pandas as pd

        rows = rows.sort_values("pos")
        found = _levels(rows["hash"].tolist(), _height(int(rows["size"].iloc[0]), bits))
        rest, own = list(higher["path"].iloc[0]), rows["hash"].tolist()
        paths = [_path(found, k) + rest for k in range(len(own))]
        return pd.DataFrame({"key": rows["lang_key"].tolist(), "block": 0, "subroot": own, "root": folded(own[0], paths[0]), "path": paths})

    groups = _in_blocks(top, bits).groupBy("key", "block").cogroup(above.groupBy("key", "block"))
    by_lang = stored(groups.applyInPandas(of_lang, "key string, block long, subroot string, root string, path array<string>"), "subroots")
    outer = _falling(mine, by_lang.select("key", "block", "path"), bits).join(by_lang.select("key", "subroot", "root"), "key")

    def finished(names, rows, higher):
        import pandas as pd

        rows = rows.sort_values("pos")
        own = rows["leaf"].tolist()
        found = _levels(own, _height(int(rows["size"].iloc[0]), bits))
        rest, root = list(higher["path"].iloc[0]), higher["root"].iloc[0]
        proofs, back = [], []
        for k, (leaf, other) in enumerate(zip(own, rows["tampered"], strict=True)):
            path = _path(found, k) + rest
            proofs.append(joined_hash(*(step[1:] for step in path)))
            back.append(folded(other or leaf, path))
        return pd.DataFrame({
            "doc_id": rows["doc_id"].tolist(), "named": rows["named"].tolist(), "leaf": own, "subroot": higher["subroot"].iloc[0], "root": root,
            "proof_sha256": proofs, "folded_root": back, "verified": [b == root for b in back],
        })

    # A column of numbers with a null would reach pandas as floats.
    numbered = _in_blocks(nodes, bits).withColumns({"named": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    kinds = "doc_id long, named boolean, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    done = numbered.groupBy("key", "block").cogroup(outer.groupBy("key", "block")).applyInPandas(finished, kinds)
    return done.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")


#: crc32 of a decimal number, bit by bit; trees by recursion over their levels, one language's nodes and the subroots alike.
MANIFEST_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS row, coalesce('=' || lang, '') AS key,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) AS crc
  FROM documents),
told AS (SELECT row, key, doc_id, crc % 7 = 0 AND n_chars IS NOT NULL AS struck,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS body FROM d),
leaves AS (SELECT row, key, doc_id, sha256(head || n || body) AS leaf, CASE WHEN struck THEN sha256(head || n1 || body) ELSE sha256(head || n || body) END AS shown FROM told),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS size FROM leaves),
up AS (SELECT key, 0 AS level, pos, size, leaf AS h FROM placed
  UNION ALL SELECT key, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE size > 1 GROUP BY key, level, pos // 2, size),
subroots AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key::BLOB) - 1 AS pos, count(*) OVER () AS size FROM up WHERE size = 1),
high AS (SELECT 0 AS level, pos, size, subroot AS h FROM subroots
  UNION ALL SELECT level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE size > 1 GROUP BY level, pos // 2, size),
lows AS (SELECT key, level, pos, size, h FROM up), highs AS (SELECT level, pos, size, h FROM high),
low_steps AS (SELECT p.row, u.level, p.pos >> u.level AS place, s.h AS other FROM placed p JOIN lows u ON u.key = p.key AND u.pos = p.pos >> u.level AND u.size > 1
  LEFT JOIN lows s ON s.key = p.key AND s.level = u.level AND s.pos = xor(u.pos, 1)),
high_steps AS (SELECT r.key, u.level, r.pos >> u.level AS place, s.h AS other FROM subroots r JOIN highs u ON u.pos = r.pos >> u.level AND u.size > 1
  LEFT JOIN highs s ON s.level = u.level AND s.pos = xor(u.pos, 1)),
steps AS (SELECT row, level, place, other FROM low_steps UNION ALL SELECT p.row, 1000 + level, place, other FROM placed p JOIN high_steps USING (key)),
paths AS (SELECT row, list(struct_pack(place := place, other := other) ORDER BY level) AS path FROM steps GROUP BY row),
fold AS (SELECT row, shown AS h, coalesce(path, []) AS path FROM leaves LEFT JOIN paths USING (row)
  UNION ALL SELECT row, sha256(CASE WHEN path[1].other IS NULL THEN h WHEN path[1].place % 2 = 0 THEN h || path[1].other ELSE path[1].other || h END), path[2:] FROM fold WHERE len(path) > 0),
ends AS (SELECT row, h AS folded_root FROM fold WHERE len(path) = 0)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda s: coalesce(s.other, '')), '')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM placed JOIN subroots s USING (key) JOIN (SELECT h FROM highs WHERE size = 1) r ON true LEFT JOIN paths USING (row) JOIN ends USING (row)
"""
