"""SimHash near-duplicates: fingerprints, links through anchors of a covering code, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import id_and_text, stored
from lexigrid.llm.components import components

#: The 64 bits are cut into two parts of 23 bits, each covered by the perfect Golay code of radius 3,
#: and one of 18 bits, where every value is a codeword (radius 0). (shift, width)
PARTS = ((0, 23), (23, 23), (46, 18))
GOLAY_GENERATOR = 0b101011100011
MAX_BITS = 4
SALTS = 16


@cache
def golay_errors():
    """The error pattern, of weight 3 at most, of each of the 2048 syndromes."""
    import numpy as np

    patterns = [0, *(1 << i for i in range(23))]
    patterns += [1 << i | 1 << j for i in range(23) for j in range(i)]
    patterns += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    patterns = np.array(patterns, dtype=np.uint64)
    errors = np.zeros(2048, dtype=np.uint64)
    errors[syndrome(patterns)] = patterns
    return errors


def syndrome(values):
    """Remainder of 23-bit values, as polynomials over GF(2), by the generator."""
    import numpy as np

    rest = values.astype(np.uint64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint64(bit) & np.uint64(1), rest ^ np.uint64(GOLAY_GENERATOR << bit - 11), rest)
    return rest.astype(np.int64)


@cache
def _flips(width: int, most: int):
    """All masks of up to `most` bits."""
    from itertools import combinations

    import numpy as np

    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)], dtype=np.uint64)


def anchors(values, part: int, threshold: int):
    """(row, anchor, home) for each anchor within covering radius + threshold of each value of a part.

    The codes are perfect, so these are the anchors nearest to some value within `threshold` bits.
    home marks the anchor nearest to the value itself.
    """
    import numpy as np

    shift, width = PARTS[part]
    own = values >> np.uint64(shift) & np.uint64((1 << width) - 1)
    masks = _flips(width, threshold)
    rows, found, home = [], [], []
    for at in range(0, len(own), 20_000):
        near = own[at : at + 20_000, None] ^ masks[None, :]
        if width == 23:
            near ^= golay_errors()[syndrome(near)]
        first = near[:, 0].copy()
        near.sort(axis=1)
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r + at)
        found.append(near[r, c])
        home.append(near[r, c] == first[r])
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate([*rows, none.astype(np.int64)]), np.concatenate([*found, none]), np.concatenate([*home, none.astype(bool)]))


def _key(table: int, anchor):
    import numpy as np

    return (anchor | np.uint64(table << 23)).astype(np.int64)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four differing bits leave one at most in part 0, or one in part 1, or none in part 2."""
    import numpy as np

    for batch in batches:
        values = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for part, threshold in ((0, 1), (1, 1), (2, 0)):
            row, anchor, home = anchors(values, part, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_key(part, anchor)), pa.array(np.zeros(len(row), np.int64)), pa.array(values[row].view(np.int64)), pa.array(home)],
                names=["key", "sub", "fp", "home"],
            )


def _subdivide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal a crowded anchor's fingerprints to anchors of the two parts that its own table leaves.

    Together these differ in four bits at most, so in two of the first or in one of the second.
    """
    import numpy as np

    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
        values = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        at_home = batch.column("home").to_numpy(zero_copy_only=False).astype(bool)
        for table in range(3):
            mine = np.flatnonzero(key >> 23 == table)
            if not len(mine):
                continue
            others = [p for p in (1, 2, 0) if p != table] if table == 0 else [p for p in (0, 1, 2) if p != table]
            for part, threshold in zip(others, (2, 1), strict=True):
                for at in range(0, len(mine), 20_000):
                    some = mine[at : at + 20_000]
                    row, anchor, home = anchors(values[some], part, threshold)
                    src = some[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[src]), pa.array(_key(part + 1, anchor)), pa.array(values[src].view(np.int64)), pa.array(home & at_home[src])],
                        names=["key", "sub", "fp", "home"],
                    )


def spanning_links(values, home, max_bits: int = MAX_BITS):
    """Pairs (i, j) that connect what links of a home value to any value connect: fewer than the values.

    Compares blocks of home values with all; a dense group's many links are reduced block by block.
    """
    import numpy as np

    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = []
    homes = np.flatnonzero(home)
    step = max(1, 1_000_000 // max(len(values), 1))
    for at in range(0, len(homes), step):
        rows = homes[at : at + step]
        near = np.bitwise_count(values[rows, None] ^ values[None, :]) <= max_bits
        i, j = np.nonzero(near)
        first = near.argmax(axis=0)
        linked = np.unique(np.concatenate([i * len(values) + rows[first[j]], first[j] * len(values) + j]))
        for a, b in zip(rows[linked // len(values)].tolist(), (linked % len(values)).tolist(), strict=True):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
                pairs.append((a, b))
    return pairs


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each anchor; the rows of a partition come sorted by anchor."""
    import numpy as np

    def linked(group: list) -> list[tuple[int, int]]:
        values, home = (np.concatenate(x) for x in zip(*group, strict=True))
        if len(values) < 2 or not home.any():
            return []
        values, at = np.unique(values, return_index=True)
        return [(int(values[a]), int(values[b])) for a, b in spanning_links(values.view(np.uint64), home[at])]

    group, current, out = [], None, []
    for batch in batches:
        key, sub, cell, values, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sub", "cell", "fp", "home"))
        values, home = values.astype(np.int64), home.astype(bool)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (cell[1:] != cell[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(key)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            if current != (here := (key[a], sub[a], cell[a])):
                if group:
                    out += linked(group)
                group, current = [], here
            group.append((values[a:b], home[a:b]))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
            out = []
    if group:
        out += linked(group)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def links(fingerprints: DataFrame, crowded: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `fp` within four bits of each other.

    A pair meets at the anchor nearest to either of the two. What every pair of a dense group would
    be is never emitted: an anchor gives fewer edges than it has fingerprints. An anchor with more
    than `crowded` rows (there are 2^18 + 2^13 anchors at most, so the list of crowded ones is small) is subdivided
    by the anchors of the other parts, and what is crowded still is compared in blocks.
    """
    replicas = stored(fingerprints.mapInArrow(_replicate, "key long, sub long, fp long, home boolean"), "replicas")
    hot = stored(replicas.groupBy("key").count().where(F.col("count") > crowded).select("key"), "crowded")
    rest = replicas.withColumn("cell", F.lit(0))
    if not hot.isEmpty():
        spread = replicas.join(hot, "key", "left_semi").mapInArrow(_subdivide, replicas.schema)
        rest = rest.join(hot, "key", "left_anti").unionByName(_gridded(stored(spread, "spread"), crowded))
    dealt = rest.repartition(F.col("key"), F.col("sub"), F.col("cell")).sortWithinPartitions("key", "sub", "cell")
    return dealt.mapInArrow(_compare, "a long, b long")


def _gridded(replicas: DataFrame, crowded: int) -> DataFrame:
    """Replicas whose anchors are crowded still, cut into blocks of which each two meet in a cell of their own.

    A fingerprint goes to as many cells as its anchor has blocks, and a cell holds two blocks at most; the
    home values of either are compared with all.
    """
    blocks = replicas.groupBy("key", "sub").count().where(F.col("count") > crowded)
    blocks = stored(blocks.select("key", "sub", F.ceil(2 * F.col("count") / crowded).cast("int").alias("blocks")), "blocks")
    if blocks.isEmpty():
        return replicas.withColumn("cell", F.lit(0))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cut = replicas.join(blocks, ["key", "sub"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("int")
    return replicas.join(blocks, ["key", "sub"], "left_anti").withColumn("cell", F.lit(0)).unionByName(cut.withColumn("cell", cell).drop("blocks", "mine", "other"))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest, bits = xxhash.xxh64_digest, np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)

        def fingerprint(text: str) -> int:
            words = text.encode("utf-8", "surrogatepass").lower().split()
            if not words:
                return 0
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            if len(words) <= width:
                hashes = digest(line, 42)
            else:
                starts = [0, *(ends[:-width] + 1).tolist()]
                hashes = b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
            octets = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
            if len(octets) < 256:
                counts = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
            else:
                counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ bits for k in range(8)])
            return int.from_bytes(np.packbits(2 * counts > len(octets)).tobytes(), "big", signed=True)

        from lexigrid.llm.common import rows_of

        for batch in batches:
            found = [(doc_id, fingerprint(text)) for doc_id, text in rows_of([batch], "doc_id", "text")]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text over shingles of `width` words, repeats included."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, *, width: int = 4, crowded: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id it is linked to) of every row.

    Documents link where their fingerprints differ in four bits or fewer. Texts without words have
    fingerprint zero and link like any other. Equal fingerprints are one node, so copies, however
    many, cost one comparison. Rows that repeat come out as often as they came in; a null id is never
    the smallest, and a component of null ids alone has component_id null. Empty tables give no rows.
    """
    found = stored(fingerprints(docs, width=width, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = stored(nodes, "nodes")
    roots = components(links(nodes.select("fp"), crowded))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    # A component may hold a great share of all fingerprints: its rows are dealt to SALTS tasks.
    salted = grouped.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    labelled = salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["root", "salt"]).select("fp", "component_id")
    return found.join(labelled, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
