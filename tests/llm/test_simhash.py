from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lexigrid.llm import simhash
from lexigrid.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, values):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, doc in enumerate(ids):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return [least[root(i)] for i in range(len(ids))]


def test_golay_code_is_perfect():
    errors = simhash.golay_errors()
    assert len(set(errors.tolist())) == 2048 and max(int(e).bit_count() for e in errors) == 3


def near_values(rng, n):
    out = []
    for _ in range(n):
        base = rng.getrandbits(64)
        out.append(base)
        for _ in range(rng.randrange(3)):
            other = base
            for b in rng.sample(range(64), rng.randrange(1, 8)):
                other ^= 1 << b
            out.append(other)
    return out


@pytest.mark.parametrize("crowded", [20_000, 3])
def test_links_find_all_pairs(spark, crowded):
    values = list(set(near_values(random.Random(7), 300)) | {(1 << k) - 1 for k in range(0, 64, 2)})
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowded)
    roots = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(list(range(len(values))), values)
    got = [roots.get(v, v) for v in signed]
    assert len({*zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = ["Word%d" % i for i in range(400)] + ["über", "ñandú"]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            other = base[:]
            other[rng.randrange(len(base))] = "changed"
            texts.append("\n".join(other).upper() if rng.random() < 0.2 else " ".join(other))
    texts += ["", None, " \t\n", "one", "ONE", "two words", "x " * 3000]
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "alone here", "x")], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    ids, values = [r[0] for r in rows], [brute_fingerprint(t) for t in texts]
    want = {d: (f"{v:016x}", c) for d, v, c in zip(ids, values, brute_components(ids, values), strict=True)}
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fingerprint, r.component_id) == want[r.doc_id]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5001), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[k] for k in range(1000, 1100)}) == 1
    assert len(set(found.values())) == 3


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
