from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline

WORDS = ["river", "stone", "letter", "garden", "window", "morning", "paper", "winter", "market", "bridge", "forest", "harbour"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Clean, toxic, copied and contaminated rows, with null and repeated ids among each, and a column more."""
    path, rng = tmp_path_factory.mktemp("pipeline"), random.Random(4)
    line = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    passage = line(30)
    rows = [(i, line(60)) for i in range(120)]
    toxic = [(200 + i, f"{line(20)} blockhead {line(10)} dimwit nitwit {line(20)} blockhead") for i in range(60)]
    copies = line(80)
    rows += toxic + [(None, toxic[1][1]), (5, toxic[2][1] + " again"), (300, copies), (301, copies), (None, copies), (301, copies + " more")]
    rows += [(400, f"{line(40)} {passage} {line(30)}"), (None, f"{line(15)} {passage}"), (7, f"{passage} {line(9)}")]
    rows += [(500, None), (501, ""), (None, None), (502, "mail me at someone@place.example or 10.1.2.3"), (503, "long " * 60_000)]
    text = [t for _, t in rows]
    table = pa.table({"doc_id": [d for d, _ in rows], "text": text, "lang": ["en"] * len(rows), "source": [None] * len(rows), "n_chars": [len(t or "") for t in text], "row": ["x"] * len(rows)})
    pq.write_table(table.set_column(3, "source", pa.array([None] * len(rows), pa.string())), path / "documents.parquet")
    marks = [(i, 0) for i in range(120)] + [(d, 1) for d, _ in toxic] + [(None, 1)]
    pq.write_table(pa.table({"doc_id": [d for d, _ in marks], "quality": [1] * len(marks), "toxic": [t for _, t in marks]}), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [passage]}), path / "benchmark.parquet")
    return str(path), passage, copies


def test_each_stage(spark, folder):
    path, passage, copies = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, path)
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    assert clean.where("text like '%blockhead%'").count() == 0
    # Rows without a toxic word stay, those that share an id with a toxic one too.
    assert clean.count() == docs.where("text is null or text not like '%blockhead%'").count() and clean.where("doc_id = 5").count() == 1
    one = corpus_pipeline.near_dedup(spark, clean, path)
    assert [r.doc_id for r in one.where(one.text.startswith(copies)).collect()] == [300]
    # Texts without words are one group, and the least id of it stays.
    assert [r.doc_id for r in one.where("coalesce(text, '') = ''").collect()] == [500] and one.where("doc_id = 7").count() == 2
    free = corpus_pipeline.decontamination(spark, one, path)
    assert free.where(free.text.contains(passage)).count() == 0 and free.where("doc_id = 7").count() == 1 and free.count() == one.count() - 3
    private = corpus_pipeline.privacy(spark, free, path)
    assert private.where("doc_id = 502").first().text == "mail me at [EMAIL] or [IP]" and private.where("n_chars <> length(text)").isEmpty()
    packed = corpus_pipeline.packing(spark, private, path)
    assert packed.select("doc_id").distinct().count() == private.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_whole_run_and_empty_tables(spark, folder, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    assert corpus_pipeline.run(spark, folder[0]).count() > 100
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{folder[0]}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
