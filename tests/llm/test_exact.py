from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from lexigrid.llm.html import Page, main_text
from lexigrid.llm.substrings import remove_repeats
from lexigrid.llm.tokencounts import Counter, CountTree, apply_edits, count_trees, edited_counts, n_tokens, revision_edits, with_edits
from lexigrid.llm.topk import MTree, top_k


def repeats(docs, length):
    seen, out = set(), []
    for doc_id, text in docs:
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                gone.update(range(i, i + length))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rng = random.Random(5)
    passages = [[f"p{k}w{i}" for i in range(rng.choice([19, 20, 21, 45]))] for k in range(6)]
    docs = []
    for i in range(60):
        words = [rng.choice("abcdef") + str(rng.randrange(40)) for _ in range(rng.randrange(60))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        docs.append((i, " ".join(words)))
    docs += [(60, None), (61, ""), (62, "same " * 3000), (63, docs[3][1]), (64, docs[3][1])]
    for length in (20, 6):
        got = remove_repeats(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, starts string"), length=length)
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == repeats(docs, length)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(700)]
    rows += [(700 + i, list(rows[i][1])) for i in range(40)] + [(800, [0.3] * 3), (801, [0.5] * 3), (820, None), (840, [math.nan] * 8), (860, [None] * 8), (None, [1.0] * 8)]
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))[:20]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, least in ((20_000, 8192), (10, 5), (300, 100)):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(data, block=block, least=least).collect())
        assert got == sorted(want)
    assert top_k(data.limit(0)).count() == 0


def test_deep_tree_equals_brute_force():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 6, (40, 6))
    rows = np.floor(centres[rng.integers(0, 40, 9000)] + rng.normal(0, 1, (9000, 6)))
    ids = rng.permutation(9000)
    tree = MTree(ids, rows)
    assert len(tree.levels) == 2
    scores, found = tree.search(rows[:50], ids[:50], 20)
    for q in range(50):
        product = rows @ rows[q]
        product[q] = -np.inf
        order = np.lexsort((ids, -product))[:20]
        assert scores[q].tolist() == product[order].tolist() and found[q].tolist() == ids[order].tolist()


def test_counts_follow_edits(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counter, rng = Counter(path), random.Random(1)
    parts = ["a", "bc", " ", "  ", "\n", "'", "l", "'ll", "1", "22", ".", "é", "\n\n", "word "]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 300, 1500])))
        tree = CountTree(text, counter)
        for _ in range(6):
            at, removed, new = rng.randrange(len(text) + 1), rng.randrange(6), rng.choice(["", "x", "'", "ll", " ", "\n ", "hello there "])
            text = text[:at] + new + text[at + removed :]
            tree.edit(at, removed, new)
            assert tree.text == text and tree.total() == len(counter.encode(text))
    docs = spark.createDataFrame([(1, "some words " * 900, 1), (2, None, 1), (None, "x", 1)], "doc_id long, text string, edits int")
    rows = {r.doc_id: r for r in edited_counts(docs, revision_edits(), path).collect()}
    assert rows[1].n_tokens == len(counter.encode("some words " * 900)) and rows[1].n_reencoded < 4000 and rows[2].n_tokens == 0
    assert edited_counts(docs.limit(0), revision_edits(), path).count() == 0


def test_leaves_split_and_trees_are_kept(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counter, rng = Counter(path), random.Random(7)
    text = "some plain words here. " * 400
    tree = CountTree(text, counter)
    for _ in range(300):
        at = rng.randrange(400) + 3000
        text = text[:at] + " inserted words, and more" + text[at:]
        tree.edit(at, 0, " inserted words, and more")
    assert tree.text == text and tree.total() == len(counter.encode(text))
    assert max(tree.chars[tree.size :]) < 64 * 2 * 12 and tree.reencoded < 300 * 2000
    again = CountTree(text, counter, tree.kept())
    again.edit(10, 5, "new")
    assert again.total() == len(counter.encode(text[:10] + "new" + text[15:])) and again.reencoded < 2000
    docs = spark.createDataFrame([(1, "one two three " * 200), (2, None), (3, "left alone"), (None, "x")], "doc_id long, text string")
    table = spark.createDataFrame([(1, 2, 0, 3, "ONE"), (1, 1, 5, 0, "zzz"), (9, 1, 0, 0, "lost"), (2, 1, 4, 4, "now full")], "doc_id long, seq int, start long, removed long, inserted string")
    after = apply_edits(with_edits(count_trees(docs, path), table), F.col("edits"), path).withColumn("n", n_tokens()).collect()
    want = {1: "ONE" + ("one two three " * 200)[3:5] + "zzz" + ("one two three " * 200)[5:], 2: "now full", 3: "left alone", None: "x"}
    assert {r.doc_id: (r.text, r.n) for r in after} == {k: (t, len(counter.encode(t))) for k, t in want.items()}
    assert {r.doc_id: r.n_edits for r in after} == {1: 2, 2: 1, 3: 0, None: 0}


def test_main_text(spark):
    body = "<nav><a href='/x'>Menu</a></nav><div class=ad>Buy</div><article><h1>T</h1><p><b>A &amp; b<br><p>Body  text\nhere</p><div class='comments'>me</div></article><footer>F</footer><script>var t='</p>';</script>"
    pages = [(1, "http://a.example/1", f"<html><body>{body}</body></html>"), (2, "http://a.example/2", "<p>only this"), (3, None, None), (4, "x", ""), (4, "x", "")]
    got = [(r.page_id, r.text, r.n_chars) for r in main_text(spark.createDataFrame([(*p, "p") for p in pages], "page_id long, url string, html string, path string")).collect()]
    assert sorted(got) == [(1, "T\n\nA & b\n\nBody text here", 24), (2, "only this", 9), (3, "", 0), (4, "", 0), (4, "", 0)]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_only_whole_names_of_boilerplate_go():
    story = "<p>A long story about a river.</p><p>It goes on for a while.</p>"
    text = "A long story about a river.\n\nIt goes on for a while."
    for opened, closed in (
        ("<div class='content with-sidebar'>", "</div>"), ("<div class='site has-sidebar'>", "</div>"), ("<div class='post no-comments'>", "</div>"),
        ("<article class='share'>", "</article>"), ("<article class='article share-enabled'>", "</article>"), ("<form class='page'>", "</form>"),
        ("<div data-role='menu' data-id='ads' title=\"class='ad'\">", "</div>"), ("<div id='sidebar'>", "</div>"),
    ):
        page = f"<html><body>{opened}{story}<div class='ad'>Buy now</div>{closed}<footer>Imprint</footer></body></html>"
        assert Page(page).text("") == text, opened
    for extra in (
        "<ul class='menu'><li>Home<ul><li>Deep</li></ul></li><li>About</li></ul>", "<p class='notice'>Mind this.", "<p class='advert'>Buy now</p>",
        "<div class='site-footer'>Imprint</div>", "<div class='ad-300x250 left'>Buy now</div>", "<h2 id=newsletter>Sign up</h2>",
        "<nav><a href='/'>Home</a></nav>", "<div role=navigation>Go</div>", "<ul><li class='share'>Tell all<li class='share'>Tell more</ul>",
    ):
        assert Page(f"<html><body><div>{extra}{story}</div></body></html>").text("") == text, extra
    assert Page("<form>One part</form><form>Other part</form>").text("")
