from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from lexigrid.llm.manifest import folded, manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, size long, key string, hash string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def reduced(nodes):
    """The levels of a tree of runs of two."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha(*low[k : k + 2]) for k in range(0, len(low), 2)])
    return levels


def up(levels, at):
    """(siblings' run with a gap for the node itself) of each level."""
    for level in levels[:-1]:
        first = at - at % 2
        yield [None if k == at else level[k] for k in range(first, min(first + 2, len(level)))]
        at //= 2


def expected(rows):
    by_lang: dict = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = reduced([leaf(r) for r in by_lang[lang]])
    top = reduced([trees[lang][-1][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        for k, row in enumerate(by_lang[lang]):
            runs = [*up(trees[lang], k), *up(top, n)]
            struck = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            back = leaf(row, int(struck))
            for run in runs:
                back = sha(*(back if x is None else x for x in run))
            out.append((row[0], leaf(row), trees[lang][-1][0], top[-1][0], sha(*(x for run in runs for x in run if x)), back, back == top[-1][0]))
    return sorted(out, key=repr)


def table(rng, n, langs):
    rows = [(k, rng.choice([None, "", "text é\n", "word " * rng.randrange(200)]), rng.choice(langs), rng.choice([None, "src1", "q"]), rng.choice([None, 0, 10**12])) for k in range(n)]
    # Repeated ids, repeated rows, ids that are null or no double holds.
    return rows + [(3, "other", langs[0], None, 5), rows[1], rows[1], (None, None, None, None, None), (None, "x", langs[0], "a", 2), (None, "x", langs[0], "a", 2), (-5, "x", langs[0], "a", 2), (2**53 + 1, "y", langs[-1], "b", 7), (5, "most", langs[0], "a", 2**63 - 1)]


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest_equals_brute_force(spark, bits):
    rng = random.Random(bits)
    rows = table(rng, 150, ["en", "de", None, "", "été", "zz"])
    got = manifest(spark.createDataFrame([(*r, 1, 2, "k", "h") for r in rows], SCHEMA).repartition(5), bits)
    found = sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()), key=repr)
    assert found == expected(rows)
    assert {v for *_, v in found} == {True, False}


def test_small_manifests(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest(make([])).count() == 0
    one = (8, "a", "en", "s", 1)
    r = manifest(make([one])).first()
    assert r.leaf == r.subroot == r.root == leaf(one) and r.proof_sha256 == sha() and r.verified
    three = [(k, "x" * k, "en", "s", k) for k in (1, 2, 3)]
    got = [tuple(r) for r in manifest(make(three)).collect()]
    assert sorted(got, key=repr) == expected(three)


def test_a_path_leads_to_the_root():
    assert folded("a", ["Rb", "-", "Lc"]) == sha("c", sha(sha("a", "b")))
