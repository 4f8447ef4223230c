from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexigrid.llm.lines import _first_occurrences, keep_bitmaps, kept_lines, key_of, line_digests

SPACES = " \t\n\x0b\x0c\r"


def expected(rows, least=20, many=3):
    """By document: a row that repeats whole is the same one; of one id the rows come in the order of their hashes."""
    docs = sorted({(-(1 << 63) if d is None else d, u, t or "") for d, t, u in rows})
    holds: dict = {}
    for doc, uid, text in docs:
        for line in text.split("\n"):
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))
            if len(key) >= least:
                holds.setdefault(key, set()).add((doc, uid))
    out = []
    for d, t, u in rows:
        mine, lines = (-(1 << 63) if d is None else d, u), (t or "").split("\n")
        stays = []
        for line in lines:
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))
            if len(holds.get(key, ())) < many or max(holds[key]) == mine:
                stays.append(line)
        out.append((d, len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    common = ["A Common Line of many documents", "exactly twenty chars", "nineteen characters", "é" * 20, "É" * 20 + "X", "é" * 20 + "x", "line\x0bwith odd space ends", "İstanbul is a line of its own"]
    rows = []
    for k in range(120):
        lines = [rng.choice([rng.choice(common), rng.choice(common).upper(), " \t" + rng.choice(common) + "\r", f"own line of document {k} {rng.random()}", "", "short"]) for _ in range(rng.randrange(8))]
        rows.append((k, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "the very same line, again and again\n" * 3000), (204, "the very same line, again and again"), (205, "The very same line, again and again ")]
    rows += [rows[5], rows[5], (7, "exactly twenty chars\nnew"), (None, "exactly twenty chars"), (None, "exactly twenty chars\n"), (None, "exactly twenty chars"), (-3, " exactly twenty chars")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, keep string, n_lines int").repartition(6)
    uids = {(r.doc_id, r.text): r.u for r in docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("u")).collect()}
    return docs, [(d, t, uids[d, t]) for d, t in rows]


@pytest.mark.parametrize(("partitions", "many"), [(1, 3), (4, 2), (40, 3), (9, 5)])
def test_digests_equal_brute_force(spark, data, partitions, many):
    docs, rows = data
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_digests(docs, many=many).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(found, key=repr) == expected(rows, many=many)


def test_bitmaps(spark, data):
    docs, rows = data
    found = {(r.doc, r.uid): r for r in keep_bitmaps(docs).collect()}
    assert found and all(r.n_dropped for r in found.values())
    for d, t, u in rows:
        r = found.get((-(1 << 63) if d is None else d, u))
        if r:
            assert len(kept_lines(t, r.keep).split("\n")) >= 1 and r.n_lines == len(t.split("\n"))
            assert len(zlib.decompress(r.keep)) == (r.n_lines + 7) // 8
    assert line_digests(docs.limit(0)).count() == 0
    assert key_of("  AbÉ\r") == "abÉ"
    with pytest.raises(ValueError):
        keep_bitmaps(docs, many=1)


def test_a_key_over_three_partitions():
    """Parts of a sorted stream, told apart wherever they are cut, come to the same drops."""
    import pyarrow as pa

    rows = [(k, 0, d, 0) for k, docs in ((1, [5]), (2, [9, 8, 8, 7, 6, 2]), (3, [4, 1]), (4, [3, 2, 1])) for d in docs]
    want = {(2, 8), (2, 7), (2, 6), (2, 2), (4, 2), (4, 1)}
    for a in range(len(rows) + 1):
        for b in range(a, len(rows) + 1):
            out = []
            for part in (rows[:a], rows[a:b], rows[b:]):
                if part:
                    columns = [*map(pa.array, zip(*part)), pa.array([1] * len(part)), pa.array([[0]] * len(part), pa.list_(pa.int32()))]
                    batch = pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc", "uid", "n_lines", "lines"])
                    out += [r for found in _first_occurrences(3)(iter([batch.slice(0, 2), batch.slice(2)])) for r in found.to_pylist()]
            edges: dict = {}
            for r in out:
                if r["kind"] == 2:
                    edges.setdefault(r["h1"], set()).add(r["doc"])
            got = {(r["h1"], r["doc"]) for r in out if r["kind"] == 0}
            got |= {(r["h1"], r["doc"]) for r in out if r["kind"] == 1 and len(edges[r["h1"]]) >= 3 and r["doc"] != max(edges[r["h1"]])}
            assert got == want, (a, b)
