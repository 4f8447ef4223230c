"""HTML extraction: containers scored on each page, paths voted on by host, pages extracted by the winning path."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import stored

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title|select|math)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)[^>]*+>|<[!?][^>]*+>",
    re.I | re.S,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CONTAINERS = frozenset("html body main article section div td table tbody tr blockquote center".split())
DROPPED = frozenset("head nav footer aside form button dialog menu".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre hr figure figcaption th address caption thead tfoot details summary".split())
#: Words that name boilerplate, words that name readers' comments, words that only tell a place, shape or kind of a
#: thing, and words after which a name tells what a page has or lacks, as with-sidebar or no-comments.
_BOILERPLATE = re.compile(
    r"ads?|advert\w*|banners?|breadcrumbs?|cookies?|consent|disclaimer|disqus|footer|masthead|menu|modal|nav|navbar|navigation|newsletter"
    r"|notices?|outbrain|paywall|popup|promo\w*|related|recommend\w*|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|subscription|taboola|teasers?|toolbar|trending|widgets?",
    re.I,
)
_COMMENTS = re.compile(r"comments?|commentlist|commenters?|discussions?|guestbook|replies|reply|respond|responses", re.I)
_PLACE = re.compile(
    r"areas?|articles?|bar|blog|block|blurb|body|bottom|box|boxes|buttons?|cards?|center|centre|column|container|content|count|desktop|entry|entries|feed|fixed|form|global|grid|group|header|heading|holder|icons?|inner|items?|left|links?|lists?|main|message|mobile"
    r"|outer|overlay|page|pages|panel|policy|posts?|primary|recent|region|right|row|secondary|section|site|slot|small|sticky|stories|story|tabs?|text|thread|threads|title|top|trail|units?|user|view|wrap|wrapper|zone|\d+(?:x\d+)?",
    re.I,
)
_HAVING = frozenset("with has have no not without show shows is hide hides enable enables enabled disabled allow allows open closed on off".split())
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=65_536)
def _named(value: str) -> str:
    """What a class, id or role names by a whole word of it: 'comments', other 'boilerplate', or nothing.

    A word tells by its last part that is no place, or by comments among its parts, so that user-comments, comment-thread and related-articles name the
    thing itself, and with-sidebar, ad-free, social-science or share-enabled don't.
    """
    found = ""
    for word in value.split():
        parts = [part for part in _PARTS.split(word) if part]
        telling = [part for part in parts if not _PLACE.fullmatch(part)]
        if not telling or any(part.lower() in _HAVING for part in parts):
            continue
        if _COMMENTS.fullmatch(telling[-1]) or any(part.lower() in ("comment", "comments") for part in telling):
            return "comments"
        if _BOILERPLATE.fullmatch(telling[-1]):
            found = "boilerplate"
    return found


class Page:
    """Nodes (path, parent, score) and blocks (node, text) of a page, boilerplate left out."""

    def __init__(self, source: str):
        self.paths, self.parents, self.scores = ["/"], [-1], [0.0]
        self.blocks: list[tuple[int, str]] = []
        marked, unlinked = [False], [0]
        stack: list[tuple[str, int]] = [("", 0)]
        held: list[str] = []
        linked, in_link, at = 0, False, 0

        def close_block() -> None:
            nonlocal linked
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                node = stack[-1][1]
                self.blocks.append((node, text))
                self.scores[node] += max(0, len(text) - 2 * linked)
                unlinked[node] += max(0, len(text) - linked)
            linked = 0

        def open_node(tag: str, names: dict[str, str], off: bool) -> None:
            node = stack[-1][1]
            kind = ".".join([tag, *sorted(_DIGITS.sub("#", names.get("class", "")).lower().split())])
            self.paths.append(f"{self.paths[node].rstrip('/')}/{kind}")
            self.parents.append(node)
            self.scores.append(0.0)
            marked.append(off), unlinked.append(0)
            stack.append((tag, len(self.paths) - 1))

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at : m.start()]
                held.append(piece)
                linked += len(piece) if in_link else 0
            at = m.end()
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            end = m["end"] or m["end2"]
            if tag == "a":
                in_link = not end
                continue
            if tag == "br":
                held.append(" ")
                continue
            block = tag in BLOCKS
            if not block and tag not in CONTAINERS and tag not in DROPPED and tag != "header":
                continue
            close_block()
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if block and stack[k][0] not in BLOCKS:
                        # A list that began outside its items ends them.
                        del stack[k + 1 if tag in ("ul", "ol", "dl") else len(stack) :]
                        break
                continue
            # The end of a paragraph or an item may be left out.
            if stack[-1][0] == "p" or (tag == stack[-1][0] == "li") or (tag in ("dt", "dd") and stack[-1][0] in ("dt", "dd")):
                stack.pop()
            names: dict[str, str] = {}
            for a, b, c, d in _ATTR.findall(m["attrs"] or ""):
                if (a := a.lower()) in ("class", "id", "role", "hidden"):
                    names.setdefault(a, b or c or d)
            hidden = names.pop("hidden", None) is not None
            kinds = set(map(_named, names.values()))
            named = hidden or "comments" in kinds or "boilerplate" in kinds
            if block:
                # Only a block to leave out is a node; blocks within it are kept apart from its end.
                if named and tag != "hr":
                    open_node(tag, names, True)
                elif stack[-1][0] in BLOCKS and tag != "hr":
                    stack.append((tag, stack[-1][1]))
            else:
                off = tag in DROPPED or (tag == "header" and not any(t in ("article", "main") for t, _ in stack))
                if tag in ("article", "main"):
                    # A comment may be an article, but one that tells what it shares is still the page's own.
                    named = hidden or "comments" in kinds
                    # A form around the page's article is no form to fill in.
                    for t, node in stack:
                        if t == "form":
                            marked[node] = False
                open_node(tag, names, off or (named and tag not in ("html", "body")))
        if at < len(source):
            held.append(source[at:])
        close_block()
        self._leave_out(marked, unlinked)

    def _leave_out(self, marked: list[bool], unlinked: list[int]) -> None:
        """Marked nodes go with all below them, whatever their size.

        Only where no text at all would be left, the marked node that has most text outside the marked nodes
        in it stays, with those around it.
        """
        gone = self._below(marked)
        if any(unlinked) and not any(n for n, g in zip(unlinked, gone, strict=True) if not g):
            own = list(unlinked)
            for k in range(len(own) - 1, 0, -1):
                if not marked[k]:
                    own[self.parents[k]] += own[k]
            k = max((k for k in range(1, len(own)) if marked[k]), key=lambda k: (own[k], -k))
            while k > 0:
                marked[k], k = False, self.parents[k]
            gone = self._below(marked)
        left = [k for k, g in enumerate(gone) if not g]
        place = {k: i for i, k in enumerate(left)} | {-1: -1}
        self.paths, self.scores = [self.paths[k] for k in left], [self.scores[k] for k in left]
        self.parents = [place[self.parents[k]] for k in left]
        self.blocks = [(place[node], text) for node, text in self.blocks if node in place]

    def _below(self, marked: list[bool]) -> list[bool]:
        gone = list(marked)
        for k in range(1, len(gone)):
            gone[k] = gone[k] or gone[self.parents[k]]
        return gone

    def best(self) -> tuple[str, float]:
        """The path of the container with most text of its own and half of what its children hold."""
        total = list(self.scores)
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k] / 2
        k = max(range(len(total)), key=lambda i: (total[i], -i))
        return self.paths[k], total[k]

    def text(self, path: str) -> str:
        """The blocks at or below the nodes of this path, or of the page's own best one if it has none."""
        if path not in self.paths:
            path = self.best()[0]
        inside = [False] * len(self.paths)
        for k, p in enumerate(self.paths):
            inside[k] = p == path or (k > 0 and inside[self.parents[k]])
        return "\n\n".join(t for node, t in self.blocks if inside[node])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from lexigrid.llm.common import rows_of

    for batch in batches:
        rows = [(host, *Page(source).best()) for host, source in rows_of([batch], "host", "html")]
        if rows:
            h, p, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(p, pa.string()), pa.array(s, pa.float64())], names=["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from lexigrid.llm.common import rows_of

    for batch in batches:
        rows = [(i, u, t := Page(s).text(path or ""), len(t)) for i, u, s, path in rows_of([batch], "page_id", "url", "html", "path")]
        if rows:
            i, u, t, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(u, pa.string()), pa.array(t, pa.string()), pa.array(n, pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page's main text.

    Each page votes, with one vote, for the path of its best container; a path is the tags and
    classes from the root, digits as #. The path with most votes of a host (ties: more text, then the
    path) is extracted from all its pages; a page without it uses its own best. Votes are counted by
    partial aggregation. Null html is empty, with empty text; pages without a host share one vote;
    repeated rows come out as they came in.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    votes = rows.select("host", "html").mapInArrow(_vote, "host string, path string, score double")
    votes = stored(votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score")), "votes")
    order = Window.partitionBy("host").orderBy(F.col("n").desc(), F.round("score").desc(), "path")
    won = stored(votes.withColumn("r", F.row_number().over(order)).where("r = 1").select("host", "path"), "paths")
    found = rows.join(won, "host", "left").select("page_id", "url", "html", "path")
    return found.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
