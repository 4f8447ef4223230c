from __future__ import annotations

import random
from collections import Counter

from lexigrid.llm.decontam import ItemIndex, contaminated, words_of


def shingles(words):
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def brute(text, item):
    """Best similarity and its first start over all windows as long as the item."""
    mine, theirs = shingles(words_of(text)), shingles(words_of(item))
    if not mine or not theirs:
        return 0.0, 0
    n = min(len(theirs), len(mine))
    scores = [(jaccard(mine[i : i + n], theirs), -i) for i in range(len(mine) - n + 1)]
    score, at = max(scores)
    return score, -at


def make(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def cases():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [make(rng, vocabulary, rng.randrange(3, 60)) for _ in range(30)]
    texts = []
    for item in items:
        words = item.split()
        before, after = make(rng, vocabulary, rng.randrange(120)), make(rng, vocabulary, rng.randrange(120))
        texts.append(f"{before} {item.upper()}! {after}")
        if len(words) > 45:
            words[3] = "changed"
            texts.append(f"{before}\n{' '.join(words)}, {after}")
        texts.append(f"{before} {' '.join(words[: len(words) // 2])} {after}")
        texts.append(before)
    return items, [*texts, "", " ", "same " * 500, items[0], items[0]]


def test_matches_equal_brute_force():
    items, texts = cases()
    index = ItemIndex(list(enumerate(items)), 5, 23)
    planted = 0
    for text in texts:
        got = {m[0]: m for m in index.matches(text, 0.8)}
        want = {k: brute(text, item) for k, item in enumerate(items)}
        want = {k: v for k, v in want.items() if v[0] >= 0.8}
        assert {k: (m[3], m[1]) for k, m in got.items()} == want
        planted += len(want)
    assert planted >= len(items)


def test_contaminated(spark):
    items, texts = cases()
    bench = spark.createDataFrame([*enumerate(items), (None, "x y z"), (500, None), (501, "")], "item_id long, text string")
    docs = spark.createDataFrame([*[(i, t, 1) for i, t in enumerate(texts)], (None, None, 2)], "doc_id long, text string, item_id int")
    one = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in one} == {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if brute(t, item)[0] >= 0.8}
    assert sorted(one) == sorted(contaminated(docs, bench, pass_chars=1500).collect())
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
