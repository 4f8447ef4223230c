"""Substring dedup: windows that repeat at one length are extended to twice that length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import id_and_text, stored
from lexigrid.sources.shared import removed

#: Keys that hold more than one in so many anchors are dealt out; as an anchor counts for two at most, no more than twice as many keys can.
SHARES = 4096


def word_hashes(words: list[bytes]):
    """Two independent 64-bit hashes of each word."""
    import numpy as np
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2).T


def doubled(hashes, gap: int):
    """Hashes of windows twice as long, from those of the windows that begin `gap` words apart."""
    import numpy as np

    x = hashes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + (hashes[gap:] ^ hashes[gap:] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def windows(hashes, length: int):
    """A hash of every run of `length` words: doubled up from the odd part of the length."""
    import numpy as np

    base = length
    while base % 2 == 0:
        base //= 2
    n = len(hashes) - base + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(base):
        out = (out ^ out >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    while base < length:
        if len(out) <= base:
            return np.zeros(0, np.uint64)
        out, base = doubled(out, base), 2 * base
    return out


def anchors(half, gap: int):
    """Place of the least hash among the `gap` + 1 half-length windows of each full window.

    It depends on a window's words alone, so windows with the same words have the same anchor.
    """
    import numpy as np

    view = np.lib.stride_tricks.sliding_window_view(half, gap + 1)
    return np.arange(len(view)) + view.argmin(axis=1)


def _emit(names, kinds, columns):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _halves(length: int):
    """Anchors of a text: (key, uid), each key once a text, and once more if it recurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from lexigrid.llm.common import rows_of

        for batch in batches:
            for uid, text in rows_of([batch], "uid", "text"):
                half = windows(word_hashes(text.encode("utf-8", "surrogatepass").split())[0], length // 2)
                if len(half) <= length // 2:
                    continue
                keys, n = np.unique(half[np.unique(anchors(half, length // 2))], return_counts=True)
                yield _emit(["key", "uid", "n"], [pa.int64(), pa.int64(), pa.int32()], [keys.view(np.int64), np.full(len(keys), uid), np.minimum(n, 2)])

    return run


def _extended(length: int, frequent: list[int], parts: list[int]):
    """Windows of full length over the surviving anchors: (key, check, doc, uid, start, salt).

    Windows of frequent anchors, given in ascending order, have salts under the anchor's number of parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from lexigrid.llm.common import rows_of

        kinds = [pa.int64()] * 4 + [pa.int32()] * 2
        many, among = np.array([*frequent, np.iinfo(np.int64).max], np.int64), np.array([*parts, 1], np.int64)
        for batch in batches:
            for uid, doc, text, alive in rows_of([batch], "uid", "doc", "text", "alive"):
                words, others = word_hashes(text.encode("utf-8", "surrogatepass").split())
                half = windows(words, length // 2)
                if len(half) <= length // 2:
                    continue
                at = anchors(half, length // 2)
                half = half.view(np.int64)
                live = np.isin(half, np.array(alive, np.int64))
                start = np.flatnonzero(live[at])
                if not len(start):
                    continue
                full = windows(words, length)[start]
                # From the words' second hashes, so that keys are 128 bits.
                check = windows(others, length)[start]
                near = np.searchsorted(many, half[at[start]])
                of = np.where(many[near] == half[at[start]], among[near], 1)
                salt = (uid % of + start) % of
                for a in range(0, len(start), 50_000):
                    s = slice(a, a + 50_000)
                    n = len(start[s])
                    columns = [full[s].view(np.int64), check[s].view(np.int64), np.full(n, doc), np.full(n, uid), start[s].astype(np.int32), salt[s].astype(np.int32)]
                    yield _emit(["key", "check", "doc", "uid", "start", "salt"], kinds, columns)

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        from lexigrid.llm.common import rows_of

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for doc_id, text, starts, copy in rows_of([batch], "doc_id", "text", "starts", "copy"):
                words = text.encode("utf-8", "surrogatepass").split()
                kept = [] if copy and len(words) >= length else words
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = np.unique(np.array(starts))
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + length, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                line = b" ".join(kept)
                yield _emit(["doc_id", "n_words", "n_removed", "kept_sha256", "kept"], kinds, [[doc_id], [len(words)], [len(words) - len(kept)], [hashlib.sha256(line).hexdigest()], [line.decode("utf-8", "replace")]])

    return run


def remove_repeats(docs: DataFrame, *, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept words of every row.

    A word goes if a window of `length` (even) words over it has the same words as a window that starts
    earlier: in a smaller doc_id, or before it in the same document. Windows of half the length are
    counted first, at one anchor for each full window, picked by its words alone; full windows are
    made only where that anchor repeats, and judged by their least place. Keys are counted by
    partial aggregation. In the joins, an anchor that holds over 1/4096 of all, and the windows over it,
    are dealt to parts of about that size by salts, so that one very common passage is no hot group; at
    most 8,192 anchors can be so frequent, and only these are broadcast. Tables of anchors and windows are
    removed once what they lead to is stored.

    Null texts count as empty; texts under `length` words keep all. A null doc_id counts as smallest.
    Rows of one doc_id with different texts come in the order of their text hashes; rows that repeat
    whole are the same document and get the same result.
    """
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = id_and_text(docs, id_col, text_col).withColumns(
        {"uid": F.xxhash64("doc_id", "text"), "doc": place, "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")}
    )
    # A whole text that a smaller doc_id also has is a repeat from its first window to its last.
    least = rows.groupBy("t1", "t2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    rows = rows.join(stored(least, "texts"), ["t1", "t2"], "left").withColumn("copy", F.coalesce(F.col("doc") > F.col("least"), F.lit(False)))
    source = rows.where("not copy")
    halves = stored(source.select("uid", "text").mapInArrow(_halves(length), "key long, uid long, n int"), "halves")
    again = stored(halves.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "repeated")
    share = max(1, halves.count()) / SHARES
    parts = F.when(F.col("n") > share, F.ceil(F.col("n") / share)).otherwise(1).cast("int")
    hot = again.where(F.col("n") > share).select("key", parts.alias("parts"))
    frequent = sorted((r.key, r.parts) for r in hot.collect())
    dealt = halves.join(F.broadcast(hot), "key", "left").select("key", "uid", F.pmod("uid", F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    met = again.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    alive = dealt.join(met.hint("merge"), ["key", "salt"]).groupBy("uid").agg(F.collect_set("key").alias("alive"))
    live = source.join(alive, "uid").select("uid", "doc", "text", "alive")
    extended = _extended(length, [key for key, _ in frequent], [n for _, n in frequent])
    full = stored(live.mapInArrow(extended, "key long, check long, doc long, uid long, start int, salt int"), "windows")
    removed(halves, again)
    place = F.struct("doc", "uid", "start")
    ends = full.groupBy("key", "check").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("salt").alias("top")).where("first <> last")
    first = ends.select("key", "check", "first", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("salt"))
    later = full.join(first.hint("merge"), ["key", "check", "salt"]).where(place != F.col("first"))
    # A row's hash may be another document's: with the document's id, only one of its own rows could share it.
    starts = stored(later.groupBy("doc", "uid").agg(F.collect_set("start").alias("starts")), "starts")
    removed(full)
    joined = source.join(starts, ["doc", "uid"], "left").select("doc_id", "text", "starts", "copy")
    joined = joined.unionByName(rows.where("copy").select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"), "copy"))
    return joined.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS k FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM r, (SELECT unnest(range(20)) AS o)),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
m AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id
"""
