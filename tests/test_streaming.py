from __future__ import annotations

import random

import pytest

from lexigrid.functions.kernels import kernel
from lexigrid.operators import cooccurrence as co
from lexigrid.sources.corpus import all_words, lines
from lexigrid.streaming.counts import GrowingCounts


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["\n".join(" ".join(f"w{int(30 * rng.random() ** 2)}" for _ in range(rng.randrange(9))) for _ in range(3)) for _ in range(60)] + [None, ""]


def whole(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    vocab = co.vocabulary(co.unigram(all_words(docs)))
    cells = co.line_cooccurrences(lines(docs), vocab, *kernel("dynamic", 3))
    return vocab, {(r.i, r.j): r.nij for r in cells.collect()}, {r.token: r.n for r in vocab.collect()}


def test_batches_that_come_again_add_nothing(spark, texts, tmp_path):
    vocab, cells, words = whole(spark, texts)
    grown = GrowingCounts(spark, str(tmp_path / "counts"), *kernel("dynamic", 3), compact_every=3)
    assert grown.counts().count() == 0
    parts = [texts[k::5] for k in range(5)]
    for b, part in enumerate(parts):
        docs = spark.createDataFrame([(t,) for t in part], "text string")
        grown.take(docs, b)
        # Delivered again, at once or after it became part of a base.
        grown.take(docs, b)
        if b == 3:
            grown.take(spark.createDataFrame([(t,) for t in parts[0]], "text string"), 0)
    assert {r.token: r.n for r in grown.unigram().collect()} == words
    assert {(r.i, r.j): r.nij for r in grown.cells(vocab).collect()} == pytest.approx(cells)
    left = {p.name for p in (tmp_path / "counts").iterdir()}
    assert left == {"base-2", "manifest-2", "delta-3", "delta-4"}
    grown.compact()
    grown.compact()
    assert {r.token: r.n for r in grown.unigram().collect()} == words
    assert {p.name for p in (tmp_path / "counts").iterdir()} == {"base-4", "manifest-4"}


def test_a_stopped_compaction_loses_nothing(spark, texts, tmp_path):
    _, _, words = whole(spark, texts)
    grown = GrowingCounts(spark, str(tmp_path / "counts"), *kernel("dynamic", 3))
    for b, part in enumerate((texts[::2], texts[1::2])):
        grown.take(spark.createDataFrame([(t,) for t in part], "text string"), b)
    # A base without its manifest, as where the driver is lost between the two.
    grown.counts().limit(3).write.parquet(str(tmp_path / "counts" / "base-1"))
    assert {r.token: r.n for r in grown.unigram().collect()} == words
    grown.compact()
    assert {r.token: r.n for r in grown.unigram().collect()} == words


def test_a_stream_of_files_equals_one_pass(spark, texts, tmp_path):
    vocab, cells, words = whole(spark, texts)
    folder = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(t,) for t in texts[k::3]], "text string").coalesce(1).write.mode("append").parquet(folder)
        grown = GrowingCounts(spark, str(tmp_path / "counts"), *kernel("dynamic", 3), compact_every=2)
        stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(folder)
        query = grown.start(stream, str(tmp_path / "checkpoint"), availableNow=True)
        assert query.awaitTermination(120)
    assert {r.token: r.n for r in grown.unigram().collect()} == words
    assert {(r.i, r.j): r.nij for r in grown.cells(vocab).collect()} == pytest.approx(cells)
