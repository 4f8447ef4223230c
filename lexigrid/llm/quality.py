"""Quality: votes of the nearest labelled texts by cosine in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import fold, id_and_text, stored

BUCKETS = 4096
_SHAPE = bytes(
    65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 97 if b >= 128 or 97 <= b <= 122 else b for b in range(256)
)
_RUN = re.compile(rb"([Aa9])\1+")


class _Places(dict):
    """Bucket and sign of a term, as a number whose last bit is the sign; starts afresh when it has grown large."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = zlib.crc32(term)
        self[term] = value = 2 * (h % BUCKETS) + (h >> 31)
        return value


_PLACES = {kind: _Places() for kind in "swf"}


def terms(text: str) -> Iterator[tuple[str, Counter, float]]:
    """(kind, counts, weight): shapes of words, all words, and how words and lines repeat in a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(1, len(words))
    yield "s", Counter(_RUN.sub(rb"\1", data.translate(_SHAPE)).split()), 100 / n
    counts = Counter(words)
    yield "w", counts, 20 / n
    again = sum(map(eq, words, islice(words, 1, None)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    out: Counter = Counter()
    for name, value in (
        (b"distinct", len(counts) / n), (b"again", again / n), (b"top", max(counts.values(), default=0) / n),
        (b"lines", len(set(lines)) / max(1, len(lines))), (b"long", min(1.0, len(data) / n / 40)),
    ):
        level = value * 10
        low = int(level)
        out[b"%s%d" % (name, low)] += 12 * (1 - level + low)
        out[b"%s%d" % (name, low + 1)] += 12 * (level - low)
    out[b"n%d" % len(words).bit_length()] += 4
    yield "f", out, 1.0


def vector(text: str):
    """Hashed, damped term weights."""
    import numpy as np

    out = np.zeros(BUCKETS)
    for kind, counts, weight in terms(text):
        place = np.fromiter(map(_PLACES[kind].__getitem__, counts), np.int64, len(counts))
        value = np.fromiter(counts.values(), np.float64, len(counts)) * weight
        # Kinds lie apart by a rotation of the buckets.
        out += np.roll(np.bincount(place >> 1, np.where(place & 1, value, -value), BUCKETS), {"s": 0, "w": 1361, "f": 2729}[kind])
    return (np.sign(out) * np.log1p(np.abs(out))).astype(np.float32)


def _unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """Labelled texts as unit vectors in the latent space of `basis`."""

    def __init__(self, idf, basis, vectors, labels, k: int):
        self.idf, self.basis, self.vectors, self.labels, self.k = idf, basis, vectors, labels, k

    def scores(self, texts: list[str]):
        """Cosines of a block of texts with all labelled vectors; similar neighbours weigh more."""
        import numpy as np

        x = np.stack([vector(t) for t in texts])
        cosine = _unit((x * self.idf) @ self.basis) @ self.vectors.T
        k = min(self.k, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.exp(12 * (np.take_along_axis(cosine, near, 1) - 1))
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 3000, dims: int = 48, k: int = 15, parts: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Latent-semantic vectors of a hash sample of about `fit_rows` labelled rows outside the held-out fold; None without any.

    A vector holds all words of a text, by how few of all documents have them. The space is that of the leading
    singular vectors of the sample.
    """
    import numpy as np

    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where("doc_id is not null and quality is not null").where(fold("doc_id", parts) != held_out).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = marked.count()
    if not n:
        return None
    if n > fit_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexigrid.llm.common import rows_of

        for batch in batches:
            found = [(d, q, vector(t).astype("<f4").tobytes()) for d, t, q in rows_of([batch], "doc_id", "text", "quality")]
            if found:
                d, q, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(q, pa.int32()), pa.array(v, pa.binary())], names=["doc_id", "quality", "v"])

    sample = id_and_text(docs, id_col, text_col).join(F.broadcast(marked), "doc_id")  # fit_rows rows of two numbers
    found = sorted(stored(sample.mapInArrow(rows, "doc_id long, quality int, v binary"), "quality-sample").collect())
    if not found:
        return None
    x = np.stack([np.frombuffer(r.v, "<f4") for r in found])
    seen = np.zeros(BUCKETS)
    counted = id_and_text(docs, id_col, text_col).mapInArrow(_seen, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for r in counted:  # a row a bucket, and one of bucket BUCKETS with the number of documents
        if r.bucket < BUCKETS:
            seen[r.bucket] = r.n
    many = next((r.n for r in counted if r.bucket == BUCKETS), 0)
    idf = np.log((1 + many) / (1 + seen)).astype(np.float32) + 1
    basis = np.ascontiguousarray(_top_axes(x * idf, dims)[:dims].T.astype(np.float32))
    return Model(idf, basis, _unit((x * idf) @ basis), np.array([r.quality for r in found], np.float32), k)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each bucket is filled, and of bucket BUCKETS how many texts there are."""
    import numpy as np

    from lexigrid.llm.common import rows_of

    n = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for (text,) in rows_of([batch], "text"):
            n[:BUCKETS] += vector(text) != 0
            n[BUCKETS] += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])


def _top_axes(x, dims: int):
    """Leading right singular vectors by subspace iteration from a fixed start."""
    import numpy as np

    q = np.random.default_rng(7).standard_normal((x.shape[1], dims + 10)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return v @ q.T


def score(docs: DataFrame, model: Model | None, *, threshold: float = 0.3, parts: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row's whole text.

    Null texts count as empty. Without a model every score is 0. Repeated rows and null ids come out
    as they came in (held_out is then false). The model is broadcast: `fit_rows` x `dims` numbers at most.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexigrid.llm.common import rows_of

        for batch in batches:
            source = rows_of([batch], "doc_id", "text")
            while block := list(islice(source, 256)):
                d, t = zip(*block, strict=True)
                s = held.value.scores(t) if held.value else [0.0] * len(d)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "score"])

    found = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return found.select(
        "doc_id", F.coalesce(fold("doc_id", parts) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
