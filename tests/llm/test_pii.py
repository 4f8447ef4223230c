from __future__ import annotations

import hashlib
import random
import re

from lexigrid.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(map(int, digits[::-1]))]
    return sum(doubled) % 10 == 0


def keep(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if keep(k, m[0])]


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    finder = pii.Finder()
    bits = ["a@b.c", "@", "+", "1", "25", "256", ".", "-", " ", "x", "é", "4777431686562174", "4111 1111 1111 1111", "10.0.0.1",
            "+49 (30) 123-456-78", "user.name+tag@mail6.example.com", "..", "(", ")", "\n", "日本", "00000000000000", "://", "password=", "iban "]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        got = [s for s in finder.spans(text) if s[0] in pii.BASE_KINDS]
        assert got == brute(text), text


def test_added_kinds_and_redaction():
    text = "see https://bob:pw@host.example/x, IBAN: DE89 3704 0044 0532 0130 00 and password=5aaa9ac60bfe mail a.b@c.de"
    spans = pii.Finder().spans(text)
    assert [s[0] for s in spans] == ["email", "email", "url", "iban", "secret"] or {s[0] for s in spans} >= {"email", "url", "iban", "secret"}
    out = pii.redacted(text, spans)
    assert "a.b@c.de" not in out and "3704" not in out and "5aaa9" not in out and "bob" not in out and out.startswith("see [")


def test_long_texts_stay_linear():
    finder = pii.Finder()
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1 " * 100_000, "+1" * 50_000, "1." * 100_000, "+1" + "(" * 200_000, "secret" * 30_000):
        finder.spans(text)


def test_query_digest(spark):
    texts = ["mail x@y.zz or 4111 1111 1111 1111", "", None, "ip 1.2.3.4 and 300.1.1.1", "日本 +49 30 1234567 x"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k"), (None, "a@b.cd", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.digest(pii.personal_data(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = "a@b.cd" if r.doc_id is None else texts[r.doc_id] or ""
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans == listed
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in brute(text)) for k in PATTERNS]
    assert pii.digest(pii.personal_data(docs.limit(0))).count() == 0
    clean = [r.text for r in docs.select(pii.redact("text").alias("text")).collect()]
    assert clean[0] == "mail [EMAIL] or [CARD]" and clean[2] is None


def test_long_secrets_and_logins_go_whole(spark):
    token, login = "eyJh0_-." * 250, "user:" + "p4ss" * 100
    text = f"token={token} then https://{login}@example.com/x and secret: {token}end."
    found = pii.Finder().spans(text)
    assert [text[a:b] for k, a, b in found if k == "secret"] == [token, f"{token}end."]
    assert [text[a:b] for k, a, b in found if k == "url"] == [f"https://{login}@example.com"]
    clean = spark.createDataFrame([(text,)], "text string").select(pii.redact("text").alias("t")).first().t
    assert clean == "token=[SECRET] then [URL]/x and secret: [SECRET]"


def test_secrets_and_names_of_any_length():
    secret = "x9" * 5000
    name = "token_" + "of_the_service_" * 20
    for text in (f"token={secret} after", f"{name} =  {secret}, after", f"{name}" * 40 + f"      :      {secret} after"):
        found = [(a, b) for k, a, b in pii.Finder().spans(text) if k == "secret"]
        assert [text[a:b] for a, b in found] == [secret]
        assert secret[:50] not in pii.redacted(text, pii.Finder().spans(text))
    long = "a" * 300 + "://" + "user" * 100 + "@host.example"
    assert ("url", 0, len(long)) in pii.Finder().spans(long)
    assert pii.Finder().spans("token" * 20_000 + " end") == []
