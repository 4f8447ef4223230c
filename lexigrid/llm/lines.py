"""Line dedup: lines that many documents hold stay in one of them; decisions are keep bitmaps, not texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import ASCII_SPACES, stored

#: Kinds of rows that a stream over sorted occurrences gives.
_DROP, _OPEN, _EDGE = 0, 1, 2
_FOUND = "h1 long, h2 long, doc long, uid long, n_lines long, lines array<int>"


def key_of(line: str) -> str:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(ASCII_SPACES).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _occurrences(least: int):
    """Each key of a document once, with its lines and how many the document has: (h1, h2, doc, uid, n_lines, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        from lexigrid.llm.common import rows_of

        for batch in batches:
            keys, docs, uids, sizes, lines = [], [], [], [], []
            for doc, uid, text in rows_of([batch], "doc", "uid", "text"):
                mine: dict[bytes, list[int]] = {}
                split = text.split("\n")
                for at, line in enumerate(split):
                    bare = line.strip(ASCII_SPACES)
                    if len(bare) >= least:
                        mine.setdefault(xxhash.xxh128_digest(bare.encode("utf-8", "surrogatepass").lower()), []).append(at)
                keys += mine
                lines += mine.values()
                docs += [doc] * len(mine)
                uids += [uid] * len(mine)
                sizes += [len(split)] * len(mine)
                if len(keys) > 100_000:
                    yield _batch(np.frombuffer(b"".join(keys), ">i8").astype(np.int64), docs, uids, sizes, lines)
                    keys, docs, uids, sizes, lines = [], [], [], [], []
            if keys:
                yield _batch(np.frombuffer(b"".join(keys), ">i8").astype(np.int64), docs, uids, sizes, lines)

    return run


def _batch(hashes, docs, uids, sizes, lines) -> pa.RecordBatch:
    columns = [pa.array(hashes[::2]), pa.array(hashes[1::2]), *(pa.array(c, pa.int64()) for c in (docs, uids, sizes)), pa.array(lines, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc", "uid", "n_lines", "lines"])


def _first_occurrences(many: int):
    """One pass over a partition sorted by key and then by falling document: (kind, h1, h2, doc, uid, n_lines, lines).

    A key's first document keeps its lines. Those of the next `many` - 2 are held until another one shows that enough
    documents have the key, and then all but the first drop theirs. The first key of a partition may have begun in the
    partition before, and its last may go on in the next: their undecided rows are left open, and up to `many` of their
    documents are told as edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "h1", "h2", "doc", "uid", "n_lines", "lines"]
        kinds = [pa.int8(), *[pa.int64()] * 5, pa.list_(pa.int32())]
        out: list[tuple] = []
        key = last = None
        first_key, docs, held = True, [], []

        def end_of_key(at_end: bool) -> None:
            if first_key or at_end:
                out.extend((_OPEN, *row) for row in held)
                out.extend((_EDGE, *key, *doc, None, None) for doc in docs)

        def taken() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return found

        for batch in batches:
            for h1, h2, doc, uid, n_lines, lines in zip(*(batch.column(n).to_pylist() for n in names[1:]), strict=True):
                if key != (h1, h2):
                    if key is not None:
                        end_of_key(False)
                        first_key = False
                    key, last, docs, held = (h1, h2), None, [], []
                if last == (doc, uid):
                    continue  # a row that repeats whole is the same document
                last = doc, uid
                if len(docs) < many:
                    docs.append(last)
                row = h1, h2, doc, uid, n_lines, lines
                if first_key:
                    # Whether this is the key's first document is not known here.
                    out.append((_OPEN, *row))
                elif len(docs) >= many:
                    out.extend((_DROP, *r) for r in [*held, row])
                    held.clear()
                elif len(docs) > 1:
                    held.append(row)
            if len(out) > 50_000:
                yield taken()
        if key is not None:
            end_of_key(True)
        if out:
            yield taken()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        n_dropped, keep = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[np.array(gone or [], np.int64)] = 0
            n_dropped.append(int(n - bits.sum()))
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
        columns = [batch.column("doc"), batch.column("uid"), batch.column("n_lines"), pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "uid", "n_lines", "n_dropped", "keep"])


def kept_lines(text: str, keep: bytes) -> str:
    """A text's lines that its keep bitmap keeps."""
    import numpy as np

    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([line for line, bit in zip(lines, bits.tolist(), strict=True) if bit])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, uid, text): documents by (doc, uid); a null id counts as smallest, a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "uid": F.xxhash64("doc_id", "text")})


def _n_lines():
    return (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")


def keep_bitmaps(docs: DataFrame, *, least: int = 20, many: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, uid, n_lines, n_dropped, keep) of every document that drops lines: a compressed bitmap, one bit a line, 1 if it stays.

    A line's key is the line without ASCII white space at both ends, A-Z in lower case. A key of `least` code points and
    more that `many` (2 at least) documents hold stays in the largest of them alone, with all its lines there. Keys are
    128-bit hashes, each once a document. They are range-partitioned by hash, falling document and place, so a very
    common line is spread over partitions, and each partition is streamed once in that order. What a key has beyond the
    partition's ends is told by a few edge rows a partition, which settle the rows left open.

    Documents are told apart by (doc, uid): doc is the id, the least long for none, uid a hash of id and text. Among
    rows of one id, the one of greatest uid is the largest. Rows that repeat whole are one document.
    """
    if many < 2:
        raise ValueError("a key is dropped in all but one of 2 documents at least")
    rows = _rows(docs, id_col, text_col)
    found = stored(rows.select("doc", "uid", "text").mapInArrow(_occurrences(least), _FOUND), "lines")
    falling = [F.col("doc").desc(), F.col("uid").desc()]
    ordered = found.repartitionByRange("h1", "h2", *falling).sortWithinPartitions("h1", "h2", *falling)
    streamed = stored(ordered.mapInArrow(_first_occurrences(many), f"kind byte, {_FOUND}"), "streamed")
    edges = streamed.where(F.col("kind") == _EDGE).select("h1", "h2", "doc", "uid").distinct()
    # As many rows as twice the partitions, at most.
    known = edges.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max(F.struct("doc", "uid")).alias("largest")).where(F.col("docs") >= many)
    opened = streamed.where(F.col("kind") == _OPEN).join(F.broadcast(known), ["h1", "h2"]).where(F.struct("doc", "uid") != F.col("largest"))
    gone = streamed.where(F.col("kind") == _DROP).select("doc", "uid", "n_lines", "lines").unionByName(opened.select("doc", "uid", "n_lines", "lines"))
    gone = gone.groupBy("doc", "uid").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("lines")).alias("gone"))
    return gone.mapInArrow(_bitmaps, "doc long, uid long, n_lines long, n_dropped long, keep binary")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    from lexigrid.llm.common import rows_of

    for batch in batches:
        rows = [(d, u, n, hashlib.sha256(kept_lines(t, k).encode("utf-8", "surrogatepass")).hexdigest()) for d, u, n, t, k in rows_of([batch], "doc", "uid", "n_dropped", "text", "keep")]
        if rows:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "uid", "n_dropped", "kept_sha256"])


def line_digests(docs: DataFrame, *, least: int = 20, many: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and the sha256 of what stays, of every row, by the bitmaps of `keep_bitmaps`.

    Texts meet their bitmaps by a shuffle, also where few documents drop lines: bitmaps grow with the table. The hash of
    documents that drop none is that of the whole text. A null or
    empty text is one empty line. A null id stays null. An empty table gives no rows; other columns aren't read.
    """
    rows = _rows(docs, id_col, text_col)
    bitmaps = stored(keep_bitmaps(docs, least=least, many=many, id_col=id_col, text_col=text_col).select("doc", "uid", "n_dropped", "keep"), "bitmaps")
    texts = rows.select("doc", "uid", "text").join(bitmaps.hint("merge"), ["doc", "uid"]).select("doc", "uid", "n_dropped", "text", "keep")
    # Rows that repeat whole have one digest.
    changed = stored(texts.mapInArrow(_applied, "doc long, uid long, n_dropped long, kept_sha256 string").distinct(), "digests")
    whole = rows.select("doc_id", "doc", "uid", _n_lines(), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    both = whole.join(changed, ["doc", "uid"], "left")
    return both.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT k.row, k.doc_id, place, line, m.key IS NULL OR k.doc_id = largest AS stays FROM k LEFT JOIN m ON m.key = k.key)
SELECT doc_id, count(*) AS n_lines, sum((NOT stays)::INT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE stays), '')) AS kept_sha256
FROM s GROUP BY row, doc_id
"""
