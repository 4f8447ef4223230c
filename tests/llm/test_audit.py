from __future__ import annotations

import random
import re
from itertools import permutations

from lexigrid.llm.audit import audit, interactions, rows_and_failing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, row long, failed int, lang string"


def failures(rows):
    """Of every row (doc_id, text, source) the letters of the filters that it fails."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        out.append({k for k, v in fails.items() if v})
    return out


def expected(rows, labels, failed, filters="ABCDE"):
    out = []
    mark = lambda doc_id, at: int(doc_id is not None and any(x[0] == doc_id and x[at] == 1 for x in labels))
    for part in {r[2] or "" for r in rows}:
        mine = [(mark(r[0], 1), mark(r[0], 2), f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys(filters, 0)
        found = []
        for order in permutations(filters):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                redundant = sum(f in x[2] for x in mine) - len(gone)
                left = [x for x in left if f not in x[2]]
                shapley[f] += len(gone)
                found.append([part, "".join(order), step, len(left), len(gone), redundant, sum(x[2] == {f} for x in mine), sum(x[0] for x in gone), sum(x[1] for x in gone), f])
        out += [(*x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out)


def told(found):
    return sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found.collect())


def test_audit_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["one", "Two", "THREE", "é", "#tag", "50%", " ", "x"] + [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 40, 308])] if rng.random() < 0.5 else words[8:]) for _ in range(rng.choice([0, 49, 50, 51, 120]))) for _ in range(40)]
    texts += [None, "", "\x1c" * 3, "a\tb\x0bc\r\nd", "w " * 3000, "ABC" + "d" * 57, "ABC" + "d" * 56]
    rows = [(k, rng.choice(texts), rng.choice([None, "", "s1", "s2", "only" if k == 7 else "s1"])) for k in range(160)]
    rows += [rows[3], rows[3], (4, texts[0], "s2"), (None, texts[0], "s2"), (None, texts[0], "s2"), (-9, texts[1], None)]
    labels = [(k, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for k in range(-10, 120)] + [(5, 0, 0), (5, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 1, "en") for r in rows], SCHEMA).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert told(audit(docs, marks)) == expected(rows, labels, failures(rows))
    narrow, failing = rows_and_failing(docs)
    assert list(failing) == list("ABCDE") and narrow.count() == len(rows)
    assert audit(docs.limit(0), marks).count() == 0
    assert told(audit(docs.limit(1), marks.limit(0)))[0][3:5] in {(1, 0), (0, 1)}


def test_any_filters_by_their_id_tables(spark):
    rows = spark.createDataFrame([(k, "p" if k < 6 else "q", k % 2, 0) for k in range(10)], "row long, part string, good int, toxic int")
    ids = {"X": [0, 1, 2, 2, 99], "Y": [2, 3, 8], "Z": []}
    failing = {k: spark.createDataFrame([(x,) for x in v], "row long") for k, v in ids.items()}
    got = told(interactions(rows, failing))
    want = expected([(k, "", "p" if k < 6 else "q") for k in range(10)], [(k, k % 2, 0) for k in range(10)], [{f for f, v in ids.items() if k in v} for k in range(10)], "XYZ")
    assert got == want and len(got) == 2 * 6 * 3
