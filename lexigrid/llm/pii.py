"""Personal data: anchors found by Aho-Corasick, spans grown from them by local parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import id_and_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "secret")
SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Account boundaries: a login in an address, an account number after its cue, a value assigned to a secret's name.
_LOGIN = re.compile(r"[^\s/@<>\"']++@[A-Za-z0-9.-]+(?::[0-9]+)?")
_IBAN = re.compile(r"[\s:=#]*+([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_VALUE = re.compile(r"[A-Za-z0-9_-]*+[\"']?\x20*+[=:]\x20*+[\"']?([^\s\"',;&<>]{6,}+)")
_NAME = re.compile(r"[A-Za-z0-9_-]*+")
_SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_key")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(number: str) -> bool:
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Finder:
    """One automaton over all anchors; each anchor hands its place to the parser of its kind."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for anchor in ("@", "+"):
            self.automaton.add_word(anchor, (anchor, 1))
        for d in "0123456789":
            self.automaton.add_word(d, ("digit", 1))
        self.automaton.add_word("://", ("scheme", 3))
        for cue in (*_SECRET_CUES, "iban"):
            for form in {cue, cue.upper(), cue.capitalize()}:
                self.automaton.add_word(form, ("iban" if cue == "iban" else "secret", len(form)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) sorted by kind in the order of KINDS, then start."""
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        # A kind's matches, kept or dropped, don't overlap: the next starts where the last ended.
        over = dict.fromkeys(KINDS, 0)
        for last, (kind, width) in self.automaton.iter(text):
            at = last - width + 1
            if kind == "digit":
                if at and text[at - 1] in _DIGITS:
                    continue
                if at >= over["ip"] and (m := _IP.match(text, at)):
                    over["ip"] = m.end()
                    if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
                        found["ip"].append(m.span())
                if at >= over["card"] and (m := _CARD.match(text, at)):
                    over["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "") if m.end() - at < 60 else ""
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
            elif kind == "@":
                start = at
                while start > over["email"] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    over["email"] = m.end()
                    found["email"].append((start, m.end()))
            elif kind == "+":
                if m := _PHONE.match(text, at):
                    over["phone"] = m.end()
                    if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                        found["phone"].append(m.span())
            elif kind == "scheme":
                start = at
                while start > over["url"] and text[start - 1] in _LETTERS:
                    start -= 1
                if start < at and (m := _LOGIN.match(text, last + 1)):
                    over["url"] = m.end()
                    found["url"].append((start, m.end()))
            elif kind == "iban":
                if at >= over["iban"] and (m := _IBAN.match(text, last + 1)):
                    over["iban"] = m.end()
                    # The longest valid number counts: words in capitals may follow it.
                    number, ends = m[1], [i + 1 for i, c in enumerate(m[1]) if c != " "]
                    for end in reversed(ends):
                        bare = number[:end].replace(" ", "")
                        if 15 <= len(bare) <= 34 and iban_valid(bare):
                            found["iban"].append((m.start(1), m.start(1) + end))
                            break
            elif at >= over["secret"]:
                if m := _VALUE.match(text, last + 1):
                    over["secret"] = m.end(1)
                    found["secret"].append(m.span(1))
                else:
                    # Other cues in the same name lead to the same place.
                    over["secret"] = _NAME.match(text, last + 1).end()
        return [(k, a, b) for k in KINDS for a, b in found[k]]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of spans that overlap, becomes the mark of its first kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from lexigrid.llm.common import rows_of

    finder = Finder()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        ids, spans = [], []
        for doc_id, text in rows_of([batch], "doc_id", "text"):
            ids.append(doc_id)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in finder.spans(text)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every row's whole text.

    email, ip, card and phone are the base kinds: leftmost matches of their patterns that pass their
    checks. url (an address with a login), iban (after its cue, checksum valid) and secret (a value
    assigned to a password, token or key) come on top. A null or empty text has no spans. Rows that
    repeat and null ids come out as they came in; an empty table gives no rows.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_find, f"doc_id long, spans {SPAN_TYPE}")


def redact(text_col: str = "text") -> Column:
    """Whole texts with every span replaced by the mark of its kind; null stays null."""

    def clean(texts: pd.Series) -> pd.Series:
        finder = Finder()
        return texts.map(lambda t: None if t is None else redacted(t, finder.spans(t)))

    return F.pandas_udf(clean, "string")(text_col)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the SHA-256 of the base spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *map(of, BASE_KINDS), F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )
