from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lexigrid.llm import quality, toxicity

DOCS = "doc_id long, text string, score int"


def corpus(bad):
    rng = random.Random(3)
    words = ["river", "stone", "letter", "garden", "window", "morning", "paper", "winter", "market", "bridge"]
    docs, marks = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(30)]
        label = i % 3 == 0
        docs.append((i, bad(text, i) if label else " ".join(text), 1))
        marks.append((i, int(not label), int(label)))
    return [*docs, (900, None, 1), (901, "", 1), (None, "river", 1), (902, "stone " * 50_000, 1), (902, "stone " * 50_000, 1)], marks


def check(spark, module, bad, column):
    docs, marks = corpus(bad)
    docs = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = module.score(docs, module.fit(docs, labels)).collect()
    assert len(rows) == 245 and all(0 <= r.score <= 1 for r in rows)
    right = {m[0]: m[1 if column == "quality" else 2] for m in marks}
    held = [r for r in rows if r.held_out and r.doc_id in right]
    assert len(held) > 20 and sum(r.predicted == right[r.doc_id] for r in held) >= 0.95 * len(held)
    none = module.score(docs, module.fit(docs, labels.limit(0)))
    assert none.count() == 245 and none.where("score <> 0").isEmpty()
    assert module.score(docs.limit(0), None).count() == 0


def test_toxicity_finds_gapped_insults(spark):
    def bad(text, i):
        text[i % 30] = ("blockhead", "bl-ockhead", "dimwit", "dim*wit,", "Blockheads")[i % 5]
        return " ".join(text)

    check(spark, toxicity, bad, "toxic")


def value(text, words):
    """Kernel of the strings of a text with each of these words, one by one: the sum of the strongest."""
    return [float(toxicity.strongest(pa.array([text]), toxicity.Landmarks([w]).table([1.0]))[0][0]) for w in words]


def test_insult_before_a_sentence_end_counts():
    for end in (".", "!", "?", "!!", "?!", '."', ".)", "\n"):
        for text in (f"you are a blockhead{end}", f"Blockhead{end} Next line", f"(blockhead{end}) river"):
            assert value(text, ["blockhead"]) == pytest.approx([1.0], abs=0.1), (text, end)


def test_spelled_out_insults_count():
    for spelled in ("i-d-i-o-t", "i*d*i*o*t", "i d i o t", "i.d.i.o.t", "i. d. i. o. t!", "i_d_i_o_t", "stu pid", "st.upid", "s-t-u-p-i-d", "st upid,", "i - d - i - o - t", "ÍDIOT", "1d1o1t idiot"):
        assert max(value(f"The river: such {spelled}\nand more", ["idiot", "stupid"])) > 0.9, spelled
    for spelled in ("b.l.o.c.k.h.e.a.d", "b l o c k h e a d", "bxlxoxcxkxhxexaxd", "xbxlxoxcxkxhxexaxdx", "Block head"[:5] + "head"):
        assert value(f"such a {spelled} here", ["blockhead"])[0] > 0.9, spelled
    assert value("such a blockxhead here", ["blockhead"])[0] > 0.5
    assert max(value("a river i do not know, it is on\nto the sea", ["idiot", "stupid", "blockhead"])) < 0.5
    assert value("oaf", ["oaf"]) == pytest.approx([1.0]) and value("", ["oaf"]) == value("1 2 .", ["oaf"]) == [0.0]


def test_kernel_equals_brute_force():
    """Subsequences of four codes, at most one other between two of them, weighted by decay^span, over both norms."""
    def vector(word):
        codes = [31, *toxicity.letters(word).tolist(), 31]
        found, square = Counter(), 0.0
        for places in combinations(range(len(codes)), 4):
            if all(b - a <= 2 for a, b in zip(places, places[1:])):
                weight = 0.5 ** (places[3] - places[0] + 1)
                found[tuple(codes[p] for p in places)] += weight
                square += weight**2
        return found, square

    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))) for _ in range(12)]
    marks = toxicity.Landmarks(words)
    codes = [toxicity.letters(w) for w in words]
    got = marks.values(toxicity.Strings([c for x in codes for c in x], [len(x) for x in codes]))
    for i, one in enumerate(words):
        a, square = vector(one)
        for k, other in enumerate(words):
            b, _ = vector(other)
            length = sum(v * v for v in b.values()) ** 0.5
            assert got[i, k] == pytest.approx(sum(v * b[u] for u, v in a.items()) / length / square**0.5), (one, other)
    gram = marks.gram()
    assert gram == pytest.approx(gram.T) and min(np.linalg.eigvalsh(gram)) > -1e-9


def test_quality_votes(spark):
    check(spark, quality, lambda text, i: "### ".join(text) if i % 2 else " ".join(text[:1] * 30), "quality")
