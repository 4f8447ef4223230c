"""HTML extraction held against the same vote counted in plain Python, and measured on generated pages."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from lexigrid.llm.html import Page, main_text

SHELLS = [  # what stands around the article: before it and after it
    ("<div class='wrap with-sidebar'><{t} class='{c}'>", "</{t}><div class='{s}'>{junk}</div></div>"),
    ("<main id='{c}'><{t} class='{c}'>", "</{t}></main><aside>{junk}</aside>"),
    ("<table><tr><td class='{s}'>{junk}</td><td><{t} class='{c}'>", "</{t}></td></tr></table>"),
    ("<section><{t} class='{c}' id='n{n}'>", "</{t}></section><section class='{s}'>{junk}</section>"),
]
NAMES = ["story", "post-body social-science", "c9f2", "text ad-free", "entry hentry no-comments", "kolumne", "content share-enabled", "prose"]
SIDES = ["sidebar", "col-b", "x7", "related-posts", "rail", "widget-area", "teaser", "links"]
INSIDE = ["<ul class='menu'><li>{0}</ul>", "<p class='advert'>{0}</p>", "<div class='newsletter-signup'>{0}</div>", "<form><p>{0}</form>", "<div class='comments'><p>{0}</p></div>", "<script>var s='<p>{0}</p>';</script>", "<!-- {0} -->"]


def _words(rng, stem, low, high):
    return " ".join(f"{stem}{rng.randrange(400)}" for _ in range(rng.randint(low, high)))


def generated(hosts, pages, seed=11):
    """(page_id, url, html) and the article words of each page. Words of articles begin with a, all others with j."""
    rng, rows, truth = random.Random(seed), [], {}
    for host in range(hosts):
        shell, name, side, tag = rng.choice(SHELLS), rng.choice(NAMES), rng.choice(SIDES), rng.choice(["div", "article", "section"])
        for page in range(pages):
            blocks = [_words(rng, "a", 5, 60) for _ in range(rng.randint(1, 9))]
            body = [f"<{rng.choice(['p', 'p', 'h2', 'blockquote'])}>{b}" for b in blocks]
            body = [b + f"</{re.match('<([a-z0-9]+)', b)[1]}>" for b in body]
            body.insert(rng.randint(0, len(body)), rng.choice(INSIDE).format(_words(rng, "j", 3, 25)))
            # On one page in five what stands beside the article is longer than it.
            n = rng.choice([2, 3, 4, 5, 60])
            junk = "".join(f"<p>{_words(rng, 'j', 2, 6)} <a href='/'>{_words(rng, 'j', 2, 6)}</a></p>" for _ in range(n))
            names = {"t": tag, "c": name, "s": side, "junk": junk, "n": page}
            source = f"<html><head><title>{_words(rng, 'j', 3, 6)}</title></head><body><nav>{_words(rng, 'j', 3, 9)}</nav>{shell[0].format(**names)}{''.join(body)}{shell[1].format(**names)}<footer>{_words(rng, 'j', 3, 30)}</footer></body></html>"
            key = host * pages + page
            rows.append((key, f"https://h{host}.example/{page}", source))
            truth[key] = " ".join(blocks).split()
    return rows, truth


STORY = "<h1>A bridge</h1><p>The old bridge was closed in spring.</p><p>It opens again soon.</p>"
TOLD = "A bridge\n\nThe old bridge was closed in spring.\n\nIt opens again soon."
LONG = "<p>I have seen that bridge a hundred times and I still say so here.</p>" * 40


@pytest.mark.parametrize("extra", [
    f"<section class='comments'>{LONG}</section>", f"<div class='user-comments'>{LONG}</div>", f"<div id='comment-thread'>{LONG}</div>", f"<div class='related-articles'>{LONG}</div>",
    f"<div class='cookie-policy'>{LONG}</div>", f"<div class='userComments'>{LONG}</div>", f"<footer>{LONG}</footer>", f"<div class='related'>{LONG}</div>", f"<form>{LONG}</form>",
    f"<article class='comment'>{LONG}</article>" * 3, f"<div hidden>{LONG}</div>", "<p hidden>Not shown to anybody.</p>", f"<aside>{LONG}</aside>", f"<div role='navigation'>{LONG}</div>",
])
def test_what_is_left_out_goes_whatever_its_size(extra):
    for page in (f"<article>{STORY}{extra}</article>", f"<article>{STORY}</article>{extra}", f"<div class='story'>{extra}{STORY}</div>", f"<div id='page'><main>{STORY}</main>{extra}</div>"):
        assert Page(f"<html><body><nav>Home</nav>{page}<footer>Imprint</footer></body></html>").text("") == TOLD, page[:80]


def test_where_all_is_marked_the_largest_part_stays():
    assert Page(f"<body><form id='aspnet'><nav>Home</nav>{STORY}<div class='ads'>Buy</div></form><footer>Imprint</footer></body>").text("") == TOLD
    assert Page(f"<body><form><div class='top'>Go</div><article>{STORY}</article></form><p>Stray</p></body>").text("").startswith("A bridge")
    assert Page("<div class='comments'><p>Only this was ever said.</p></div>").text("") == "Only this was ever said."
    assert Page("<footer></footer>").text("") == ""
    deep = "<div class='ad'>" * 30_000 + "<p>deep"
    assert Page(deep).text("") == "deep"


def test_comments_longer_than_articles_on_generated_pages(spark):
    """Names that the lists don't hold as a whole, comments of up to five times the article, inside it and beside it."""
    rng, rows, truth = random.Random(21), [], {}
    names = ["readerComments", "comment_stream-list", "user-comments", "comments-42", "post-replies", "discussion-zone", "article-comments wide", "guestbook-entries"]
    for host in range(16):
        name, inside = rng.choice(names), rng.random() < 0.5
        for page in range(8):
            blocks = [_words(rng, "a", 10, 40) for _ in range(rng.randint(2, 6))]
            said = "".join(f"<div class='entry'><b>{_words(rng, 'j', 1, 2)}</b><p>{_words(rng, 'j', 5, 40)}</p></div>" for _ in range(rng.randint(0, 5 * len(blocks))))
            story, talk = "".join(f"<p>{b}</p>" for b in blocks), f"<div class='{name}'>{said}</div>"
            body = f"<div class='txt'>{story}{talk}</div>" if inside else f"<div class='txt'>{story}</div>{talk}"
            key = host * 8 + page
            rows.append((key, f"https://c{host}.example/{page}", f"<html><body><div class='page'>{body}</div></body></html>"))
            truth[key] = " ".join(blocks).split()
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    hit = sum((Counter(truth[k]) & Counter(got[k].split())).total() for k in truth)
    assert hit / sum(map(len, truth.values())) >= 0.95 and hit / sum(len(t.split()) for t in got.values()) >= 0.95


@pytest.fixture(scope="module")
def extracted(spark):
    rows, truth = generated(40, 12)
    found = main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7))
    return rows, truth, {r.page_id: r.text for r in found.collect()}


def test_vote_equals_brute_force(extracted):
    rows, _, got = extracted
    votes, weight = defaultdict(Counter), Counter()
    for _, url, source in rows:
        host = url.split("/")[2]
        path, score = Page(source).best()
        votes[host][path] += 1
        weight[host, path] += score
    for key, url, source in rows:
        host = url.split("/")[2]
        path = min(votes[host], key=lambda p: (-votes[host][p], -round(weight[host, p]), p))
        assert got[key] == Page(source).text(path), url


def test_words_of_articles_are_found_and_others_are_not(extracted):
    _, truth, got = extracted
    hit = sum((Counter(truth[k]) & Counter(got[k].split())).total() for k in truth)
    recall, precision = hit / sum(map(len, truth.values())), hit / sum(len(t.split()) for t in got.values())
    print(f"recall {recall:.4f}, precision {precision:.4f}")
    assert recall >= 0.9 and precision >= 0.9
    assert min((Counter(truth[k]) & Counter(got[k].split())).total() for k in truth) > 0
