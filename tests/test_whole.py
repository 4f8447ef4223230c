from __future__ import annotations

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import duckdb
import pytest

from lexigrid.plans import catalogue, whole


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Texts of 900 distinct tokens, more than any limit, and seven vectors."""
    path = tmp_path_factory.mktemp("whole")
    rng = random.Random(5)
    lines = [" ".join(f"w{int(900 * rng.random() ** 2)}" for _ in range(12)) for _ in range(400)] + [f"w{k} é{k}" for k in range(900)]
    docs = [(k, "\n".join(lines[k : k + 4])) for k in range(0, len(lines), 4)]
    pq.write_table(pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]}), path / "documents.parquet")
    pq.write_table(pa.table({"conv_id": [1], "text": ["w899 w1 never"]}), path / "conversations.parquet")
    vectors = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(7)]
    pq.write_table(pa.table({"vec_id": list(range(7)), "embedding": vectors}), path / "embeddings.parquet")
    return str(path), [line.split() for line in lines], vectors


@pytest.mark.parametrize("name", sorted(whole.ORACLE_SQL))
def test_whole_query_equals_its_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder[0]}/{table}.parquet'")
    assert f"LIMIT {catalogue.VOCABULARY}" not in whole.ORACLE_SQL[name]
    found, want = whole.QUERIES[name](spark, folder[0]), db.sql(whole.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
    a, b = order(tuple(r[c] for c in columns) for r in found.collect()), order(want.select(*columns).fetchall())
    assert len(a) == len(b) > 0 and all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) else x == y for r, s in zip(a, b) for x, y in zip(r, s))


def test_whole_models_use_every_cell(spark, folder):
    path, lines, vectors = folder
    counts: dict = {}
    for line in lines:
        for w in line:
            counts[w] = counts.get(w, 0) + 1
    ids = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w.encode())))}
    assert len(ids) > 1500
    cells: dict = {}
    for line in lines:
        for p, w in enumerate(line):
            for q in range(max(0, p - 5), min(len(line), p + 6)):
                if q != p:
                    key = ids[w], ids[line[q]]
                    cells[key] = cells.get(key, 0) + 1
    score = {(i, j): sum(a * b for a, b in zip(vectors[(7 * i + 3) % 7], vectors[j % 7])) for i, j in cells}
    got = {(r.i, r.j): r.score for r in whole.QUERIES["dense_response_whole"](spark, path).collect()}
    assert got.keys() == cells.keys() and all(abs(got[k] - score[k]) < 1e-5 for k in got)
    loss: dict = {}
    for (i, j), n in cells.items():
        loss[i] = loss.get(i, 0) + min(1, (n / 100) ** 0.75) * (score[i, j] - math.log(n)) ** 2
    got = {r.i: r.loss for r in whole.QUERIES["loss_glove_whole"](spark, path).collect()}
    assert got == pytest.approx(loss, abs=1e-4)
    entry = catalogue.flagship(spark, path)
    assert {(r.i, r.j) for r in entry.collect()} == cells.keys()
