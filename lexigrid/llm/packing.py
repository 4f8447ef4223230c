"""Cost-balanced packing of tokenized documents into fixed-capacity training sequences."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexigrid.llm.common import id_and_text

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: Marks in a text that are glued to a word and always make tokens of their own.
_TAIL = ".,!?;:"
#: Words whose ids one Python worker keeps, some 220 bytes each; when there are more, it starts afresh.
_KEPT_WORDS = 1_000_000
#: Bytes of texts that are split and encoded together.
_SLICE = 8e6


def _letters(tokenizer) -> frozenset[str]:
    """Latin letters of one lower case that this tokenizer parts from every mark of _TAIL: it was asked about each letter before each mark.

    A letter such as U+0130, whose lower case has a mark of its own, is none of them.
    """
    ids = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    found = [c for k in range(0x180) if (c := chr(k)).isalpha() and len(c.lower()) == 1]
    marks, alone = ids(list(_TAIL)), ids([w for c in found for w in (c, f"a{c}")])
    glued = iter(ids([w + m for c in found for w in (c, f"a{c}") for m in _TAIL]))
    apart = [all([next(glued) == word + mark for word in alone[2 * k : 2 * k + 2] for mark in marks]) for k in range(len(found))]
    return frozenset(c for c, ok in zip(found, apart, strict=True) if ok)


def _by_words(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, drops white space, and marks the end of a word, so that words can be encoded apart."""
    spec = json.loads(tokenizer.to_str())
    return spec["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in json.dumps(spec["normalizer"]) and all(
        tokenizer.encode(text, add_special_tokens=False).ids == [i for w in text.split() for i in tokenizer.encode(w, add_special_tokens=False).ids]
        for text in ("River  stone, (letter)\nGarden's 12", "Êtes-vous là? \t a.b", "İ. Aİ; x\u0301! 'Tis \u2014 e.g. 3.5%, #a_b")
    )


class WordIds(dict):
    """Token ids of each space-separated word as little-endian uint32 bytes.

    Where the tokenizer drops white space and never joins tokens across it, a text's ids are its words'
    ids in a row. Ids that end a run of letters carry the vocabulary's word-end mark, which lets many
    unseen words be encoded in one call and cut apart again. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str, kept: int = _KEPT_WORDS):
        import numpy as np
        from tokenizers import Tokenizer

        super().__init__()
        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _by_words(self.tokenizer)
        self.letters = _letters(self.tokenizer) if self.by_words else frozenset()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.word_end[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Put unseen words among the known ones: plain words in one call, the others each on its own."""
        import numpy as np

        bare = [word.rstrip(_TAIL) for word in words]
        cores = [core.lower() if core and self.letters.issuperset(core) else "" for core in bare]
        tails = [word[len(core) :] for word, core in zip(words, bare, strict=True)]
        unseen = list({core for core in cores if core and core not in self})
        others = list({w for word, core, tail in zip(words, cores, tails, strict=True) if (w := tail if core else word) not in self})
        self.update(zip(others, self._each(others), strict=True))
        if unseen:
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(unseen)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(unseen):
                data, upto = ids.tobytes(), (4 * ends).tolist()
                self.update(zip(unseen, (data[i:j] for i, j in zip([0, *upto[:-1]], upto, strict=True)), strict=True))
            else:
                self.update(zip(unseen, self._each(unseen), strict=True))
        for word, core, tail in zip(words, cores, tails, strict=True):
            if core:
                self[word] = self[core] + self[tail] if tail else self[core]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encoded(pa.array(texts, pa.string()))
        upto = ends.tolist()
        return [ids[i:j].tobytes() for i, j in zip([0, *upto[:-1]], upto, strict=True)]

    def encoded(self, texts: pa.Array) -> tuple:
        """(ids, ends): the ids of all texts in a row, and how many there are up to the end of each."""
        import numpy as np
        import pyarrow.compute as pc

        if not self.by_words:
            each = self._each(texts.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(x) // 4 for x in each], dtype=np.int64)
        for space in "\n\t\r":
            texts = pc.replace_substring(texts, space, " ")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if "" not in self:
            self[""] = b""
        unseen = [w for w in distinct if w not in self]
        if unseen:
            if len(self) + len(unseen) > self.kept:
                self.clear()
                self[""] = b""
                unseen = distinct
            self.learn(unseen)
        known = [self[w] for w in distinct]
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int32, len(known)) // 4
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        ids, upto = [flat[:0]], np.concatenate([[0], np.cumsum(sizes[which], dtype=np.int64)])
        for at in range(0, len(which), 65_536):
            part = which[at : at + 65_536]
            each = sizes[part]
            ends = np.cumsum(each, dtype=np.int32)
            # A word's ids lie in `flat` from its first place on.
            ids.append(flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(first[part] - ends + each, each)])
        words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.concatenate(ids), upto[np.cumsum(words)]


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these token counts.

    A document beyond the capacity fills sequences of its own; what is left of each goes, longest
    first, to the sequence of least linear + quadratic attention cost that has room. Where none has
    room, a piece is cut to fill the roomiest sequences. As many sequences are open as the tokens
    need, so all but one are full at the end.
    """
    import numpy as np

    pieces, rest, sequence = [], [], 0
    for k, n in enumerate(lengths):
        full = n // capacity
        for i in range(full):
            pieces.append((k, i * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, k, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    room = np.full(-(-total // capacity), capacity, np.int64)
    if total % capacity:
        room[-1] = total % capacity
    filled, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    for n, k, start in rest:
        while n:
            at = int(np.where(room >= n, cost, np.inf).argmin())
            if room[at] < n:
                # None has room for the whole piece: the cheapest of the roomiest is filled.
                at = int(np.where(room == room.max(), cost, np.inf).argmin())
            take = min(n, int(room[at]))
            pieces.append((k, start, take, sequence + at, int(filled[at])))
            filled[at] += take
            room[at] -= take
            cost[at] += linear * take + quadratic * take * take
            n -= take
            start += take
    return pieces


_WORKER: dict[str, WordIds] = {}


def _packer(path: str, end_id: int, capacity: int, block_tokens: int, linear: float, quadratic: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        if path not in _WORKER:
            _WORKER[path] = WordIds(path)
        words = _WORKER[path]
        end = end_id.to_bytes(4, "little")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        #: Sequences of a task are numbered within the task; a task that runs again gives the same numbers.
        base = TaskContext.get().partitionId() << 36

        def packed(block: list[tuple[int, bytes]]) -> pa.RecordBatch:
            nonlocal base
            lengths = [len(ids) // 4 for _, ids in block]
            document, start, length, sequence, offset = zip(*balance(lengths, capacity, linear, quadratic), strict=True)
            crc = [zlib.crc32(block[k][1][4 * a : 4 * (a + n)]) for k, a, n in zip(document, start, length, strict=True)]
            numbers = np.array(sequence, np.int64) + base
            columns = [[block[k][0] for k in document], start, length, crc, [lengths[k] for k in document], numbers, offset]
            base = int(numbers.max()) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=names)

        block, held = [], 0
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * _SLICE / max(batch.nbytes, 1))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, ends = words.encoded(part.column("text"))
                begin = 0
                for doc_id, upto in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                    block.append((doc_id, ids[begin:upto].tobytes() + end))
                    held += upto - begin + 1
                    begin = upto
                    if held >= block_tokens:
                        yield packed(block)
                        block, held = [], 0
        if block:
            yield packed(block)

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    capacity: int = 2048,
    block_tokens: int = 1 << 20,
    linear: float = 2048.0,
    quadratic: float = 1.0,
) -> DataFrame:
    """Pack every document into sequences of at most `capacity` tokens, balanced by attention cost.

    A document is its text's token ids and then `end_id`. A sequence costs linear * tokens +
    quadratic * the sum of squares of its pieces' lengths (a piece attends to itself). Blocks of
    about `block_tokens` tokens are packed on their own where they are read, without a shuffle; at
    most one sequence of a block isn't full. Pieces of a sequence lie gapless from offset 0.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null or empty text is a document of the end id alone. Rows that repeat are documents of their
    own, and a null id stays null. An empty table gives no rows. Columns of other names are not read.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _packer(tokenizer_path, end_id, capacity, block_tokens, linear, quadratic), PIECE_SCHEMA
    )
