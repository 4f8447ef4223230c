"""Benchmark decontamination: item-sized SimHash windows, multi-index Hamming search, exact similarity."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import id_and_text

MATCH_SCHEMA = "doc_id long, item_id long, start long, n_words long, similarity double, hamming long"
#: ASCII marks that don't count as part of a word.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Blocks of a fingerprint, 16 bits each.
_BLOCKS = 4


def words_of(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _MARKS).split()


def shingle_hashes(words: list[bytes], width: int):
    """A well-mixed 64-bit hash of every run of `width` words; of the whole, if there are fewer words."""
    import numpy as np
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)
    n = max(1, len(h) - width + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        total = (total ^ total >> np.uint64(shift)) * np.uint64(factor)
    return total ^ total >> np.uint64(31)


def bits_of(hashes):
    """±1 for each of the 64 bits of each hash."""
    import numpy as np

    return 2 * np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) - 1


def packed(sums):
    """Fingerprints of rows of 64 sums, as four blocks of 16 bits each."""
    import numpy as np

    return np.packbits(sums > 0, axis=1).view(np.uint16)


def masks(most: int):
    """All numbers of 16 bits of which `most` are set at most."""
    import numpy as np

    values = np.arange(1 << 16, dtype=np.uint16)
    return values[np.bitwise_count(values) <= most]


class Lists:
    """For one block: the items of each value, by value, and where in them each of the 2^16 values lies."""

    def __init__(self, values):
        import numpy as np

        self.items = np.argsort(values, kind="stable")
        self.distinct, self.first, self.many = np.unique(values[self.items], return_index=True, return_counts=True)
        self.place = np.full(1 << 16, -1, np.int32)
        self.place[self.distinct] = np.arange(len(self.distinct))

    def near(self, values, flips, most: int):
        """(row, item) for all items whose block is within `most` bits, which `flips` spell out, of a row's value."""
        import numpy as np

        asked, row_of = np.unique(values, return_inverse=True)
        if len(self.distinct) <= len(flips):
            a, d = np.nonzero(np.bitwise_count(asked[:, None] ^ self.distinct[None, :]) <= most)
        else:
            met = self.place[asked[:, None] ^ flips[None, :]]
            a, c = np.nonzero(met >= 0)
            d = met[a, c]
        # Rows that ask for one value meet the same lists.
        start = np.searchsorted(a, np.arange(len(asked) + 1))
        each = np.diff(start)[row_of]
        rows = np.repeat(np.arange(len(values)), each)
        lists = d[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[row_of], each)]
        many = self.many[lists]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[lists], many)
        return np.repeat(rows, many), self.items[at]


class ItemIndex:
    """Benchmark items by window size: fingerprints, and for each 16-bit block the lists of items by its value.

    Two fingerprints within the radius are within radius // 4 bits of each other in some block, so the
    lists of all values so near to a window's, over all blocks, hold every item within the radius.
    """

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int):
        import numpy as np

        self.width, self.radius = width, radius
        self.ids, self.shingles, sizes, prints = [], [], [], []
        for item_id, text in items:
            hashes = shingle_hashes(words_of(text), width)
            if not len(hashes):
                continue
            self.ids.append(item_id)
            self.shingles.append(np.unique(hashes, return_counts=True))
            sizes.append(len(hashes))
            prints.append(packed(bits_of(hashes).sum(axis=0, keepdims=True))[0])
        self.sizes = np.array(sizes, np.int64)
        self.prints = np.array(prints, np.uint16).reshape(-1, _BLOCKS)
        held = [x[0] for x in self.shingles] or [np.zeros(0, np.uint64)]
        self.hashes = np.concatenate(held)
        self.owners = np.repeat(np.arange(len(self.ids)), [len(x) for x in held] if self.ids else [])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners = self.hashes[order], self.owners[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.most = radius // _BLOCKS
        self.flips = masks(self.most)
        self.by_size = {}
        for size in np.unique(self.sizes).tolist():
            mine = np.flatnonzero(self.sizes == size)
            self.by_size[size] = (mine, [Lists(self.prints[mine, b]) for b in range(_BLOCKS)])

    def hits(self, hashes):
        """(position, owner) wherever a text's shingle is one of an item's."""
        import numpy as np

        at = np.flatnonzero(self.seen[(hashes >> np.uint64(42)).astype(np.int64)])
        if not len(at):
            return at, at
        low = np.searchsorted(self.hashes, hashes[at], "left")
        high = np.searchsorted(self.hashes, hashes[at], "right")
        n = high - low
        rows = np.repeat(at, n)
        owners = self.owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        return rows, owners

    def matches(self, text: str, threshold: float) -> list[tuple[int, int, int, float, int]]:
        """(item_id, first word, words, similarity, differing bits): the best window of each item."""
        import numpy as np

        words = words_of(text)
        hashes = shingle_hashes(words, self.width)
        rows, owners = self.hits(hashes)
        if not len(rows):
            return []
        best: dict[int, tuple] = {}
        for size in np.unique(self.sizes[owners]).tolist():
            at = np.unique(rows[self.sizes[owners] == size])
            length = min(size, len(hashes))
            # A window as similar as asked shares a shingle with its item, so it covers a hit.
            for part in np.split(at, np.flatnonzero(np.diff(at) > length) + 1):
                first = max(0, int(part[0]) - length + 1)
                last = min(len(hashes) - length, int(part[-1]))
                for a in range(first, last + 1, 4096):
                    b = min(last, a + 4095)
                    self._search(hashes, size, length, a, b, threshold, best)
        n_words = len(words)
        return [
            (self.ids[k], start, min(length + self.width - 1, n_words - start), s, d)
            for k, (s, start, length, d) in sorted(best.items())
        ]

    def _search(self, hashes, size, length, a, b, threshold, best) -> None:
        import numpy as np

        sums = np.cumsum(bits_of(hashes[a : b + length]), axis=0)
        sums = np.concatenate([np.zeros((1, 64), sums.dtype), sums])
        prints = packed(sums[length:] - sums[:-length])
        mine, lists = self.by_size[size]
        window, item = (np.concatenate(x) for x in zip(*(lists[b].near(prints[:, b], self.flips, self.most) for b in range(_BLOCKS)), strict=True))
        distance = np.bitwise_count(prints[window] ^ self.prints[mine[item]]).sum(axis=1)
        within = distance <= self.radius
        # A pair may be found in several blocks.
        pair, first = np.unique(window[within] * len(mine) + item[within], return_index=True)
        for w, k, d in zip((pair // len(mine)).tolist(), mine[pair % len(mine)].tolist(), distance[within][first].tolist(), strict=True):
            found, counts = np.unique(hashes[a + w : a + w + length], return_counts=True)
            theirs, weights = self.shingles[k]
            _, x, y = np.intersect1d(found, theirs, assume_unique=True, return_indices=True)
            common = int(np.minimum(counts[x], weights[y]).sum())
            similarity = common / (length + int(self.sizes[k]) - common)
            if similarity >= threshold and (k not in best or similarity > best[k][0]):
                best[k] = (similarity, a + w, length, d)


#: The index that a Python worker made last, so that its next tasks find it.
_INDEX: dict[str, ItemIndex] = {}


def _matcher(items, key: str, width: int, radius: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexigrid.llm.common import rows_of

        if key not in _INDEX:
            _INDEX.clear()
            _INDEX[key] = ItemIndex(items.value, width, radius)
        index = _INDEX[key]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        names = ["doc_id", "item_id", "start", "n_words", "similarity", "hamming"]
        for batch in batches:
            found = [(doc_id, *m) for doc_id, text in rows_of([batch], "doc_id", "text") for m in index.matches(text, threshold)]
            if found:
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = 5,
    threshold: float = 0.8,
    radius: int = 15,
    pass_chars: int = 8_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage: the best window.

    A window has as many shingles (`width` words) as the item and slides word by word. Windows that
    share a shingle with an item of their size are fingerprinted; the multi-index gives all items
    within `radius` differing bits (a pair as similar as asked differs in about ten); of these, the ones whose multiset Jaccard similarity of shingles,
    weighted by their counts, reaches `threshold` are returned, ties to the earliest window.

    The items' index is broadcast to the tasks that scan the documents, which are not shuffled. It
    is bounded: items of more than `pass_chars` characters in all are dealt by hash to several passes.
    Null or empty texts match nothing; a text shorter than an item is one window; rows that repeat
    match as often as they occur; an item_id with several texts is an item for each. Empty tables give no rows.
    """
    items = id_and_text(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").where("item_id is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, math.ceil(1.25 * total / pass_chars)) if total > pass_chars else 1
    source, out = id_and_text(docs, id_col, text_col), None
    context = docs.sparkSession.sparkContext
    for k in range(passes):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else items
        held = context.broadcast(sorted((r.item_id, r.text) for r in mine.collect()))
        found = source.mapInArrow(_matcher(held, uuid.uuid4().hex, width, radius, threshold), MATCH_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out
