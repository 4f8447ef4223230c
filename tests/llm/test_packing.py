from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexigrid.llm.packing import _TAIL, WordIds, balance, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The quick, brown fox. It's 42!! <|endoftext|> ok", "", "   ", None, "Straße naïve ÉCOLE İstanbul ΟΔΟΣ\n\nx\ty",
    "don't we'll THEY'VE", "a" * 5000, "word " * 9000, "é café \x1c odd space", "same text", "same text",
    "日本語 テスト 123 abc-def", "x.y,z!? ... ,",
]


def expected(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def test_word_ids_equal_whole_text_encoding():
    for kept in (3, 10_000):
        words = WordIds(PATH, kept)
        for text, ids in zip(TEXTS * 2, words.encode([t or "" for t in TEXTS * 2]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == expected(text)[:-1]
            assert words.encode([text or ""]) == [ids]


def test_every_latin_letter_before_every_mark():
    """Words that end in any letter up to U+017F, before one mark and two, have the ids of the whole text."""
    whole = Tokenizer.from_file(PATH)
    letters = [c for k in range(0x180) if (c := chr(k)).isalpha()]
    texts = [f"{stem}{c}{mark}" for c in letters for stem in ("", "AL", "kayser") for mark in (*_TAIL, "?!", "...")]
    texts += [f"x {c}{c} y, {c}." for c in letters]
    for text, ids in zip(texts, WordIds(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def test_random_texts_of_all_kinds_of_letters():
    rng, whole = random.Random(9), Tokenizer.from_file(PATH)
    kinds = [range(0x20, 0x7F), range(0xA0, 0x250), range(0x300, 0x370), range(0x370, 0x500), range(0x2000, 0x2100), range(0x4E00, 0x4E40), (0x130, 0xDF, 0x1E9E, 0xFB01)]
    texts = ["".join(chr(rng.choice(rng.choice(kinds))) if rng.random() < 0.8 else rng.choice(" .,!?;:") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    words = WordIds(PATH)
    wrong = [t for t, ids in zip(texts, words.encode(texts), strict=True) if np.frombuffer(ids, "<u4").tolist() != whole.encode(t, add_special_tokens=False).ids]
    assert not wrong, ascii(wrong[:3])


def test_balance_fills_all_but_one_sequence():
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in rng.integers(1, 5000, 300)]
    pieces = balance(lengths, 2048, 2048.0, 1.0)
    fill, cover = {}, {}
    for k, start, n, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert n > 0 and offset == fill.get(sequence, 0)
        fill[sequence] = offset + n
        cover.setdefault(k, []).append((start, n))
    assert all(x <= 2048 for x in fill.values()) and sum(x < 2048 for x in fill.values()) <= 1
    for k, n in enumerate(lengths):
        at = 0
        for start, length in sorted(cover[k]):
            assert start == at
            at += length
        assert at == n


def test_pack_documents(spark):
    rows = [(i, t, "en", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "en", 7), (0, TEXTS[0], "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, sequence_id int")
    out = pack_documents(docs, PATH, block_tokens=3000).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(TEXTS):
        ids = np.asarray(expected(text), "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) * (2 if i == 0 else 1)
        for r in pieces:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert None in by_doc
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
