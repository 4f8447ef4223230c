"""Token counts kept up to date under edits: a tree of sums over runs of pre-tokens for each document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import id_and_text, stored

EDIT_TYPE = "array<struct<start:long,removed:long,inserted:string>>"
#: Pre-tokens of one leaf.
LEAF = 64
#: No pre-token's end depends on characters farther ahead than this.
CONTEXT = 8
_KEPT = 500_000


class Counter(dict):
    """Tokens of each pre-token; pre-tokens are encoded apart, so their counts add up."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        n = len(self.encode(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n


class CountTree:
    """Sums of characters and tokens over leaves of about LEAF pre-tokens; node k has children 2k and 2k + 1."""

    def __init__(self, text: str, counter: Counter, leaves: tuple[list[int], list[int]] | None = None):
        """From the leaves that were kept of it, or else from the text alone."""
        self.text, self.counter, self.reencoded = text, counter, 0
        self._build(*(leaves or self._cut(counter.pattern.findall(text))))

    def _cut(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Characters and tokens of leaves of LEAF pre-tokens each."""
        import numpy as np

        if not pieces:
            return [0], [0]
        starts = np.arange(0, len(pieces), LEAF)
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tokens = np.fromiter(map(self.counter.__getitem__, pieces), np.int64, len(pieces))
        return np.add.reduceat(chars, starts).tolist(), np.add.reduceat(tokens, starts).tolist()

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = len(chars)
        self.size = 1 << (self.leaves - 1).bit_length()
        fill = [0] * (self.size - self.leaves)
        self.chars, self.tokens = [0] * self.size + chars + fill, [0] * self.size + tokens + fill
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves, those emptied by edits left out."""
        held = [(c, t) for c, t in zip(self.chars[self.size :], self.tokens[self.size :], strict=True) if c]
        return [c for c, _ in held] or [0], [t for _, t in held] or [0]

    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character; the last one beyond the end."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if position >= before + self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.size + leaf
        self.chars[k], self.tokens[k] = chars, tokens
        while k > 1:
            k //= 2
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace `removed` characters at `start`; only leaves from shortly before the edit to the first
        leaf after it that begins at a pre-token again are encoded anew."""
        start = min(max(start, 0), len(self.text))
        end = min(start + max(removed, 0), len(self.text))
        first, begin = self._leaf_at(max(0, start - CONTEXT))
        shift = len(inserted) - (end - start)
        self.text = self.text[:start] + inserted + self.text[end:]
        # Ends of leaves after the edit, in the new text.
        leaf, at, pieces = first, begin, []
        stop = None
        edge = begin + self.chars[self.size + leaf]
        for m in self.counter.pattern.finditer(self.text, begin):
            pieces.append(m[0])
            at = m.end()
            while (edge < end or edge + shift < at) and leaf + 1 < self.size:
                leaf += 1
                edge += self.chars[self.size + leaf]
            if edge >= end and edge + shift == at and at >= start + len(inserted):
                stop = leaf
                break
        last = stop if stop is not None else self.size - 1
        self.reencoded += at - begin
        chars, tokens = self._cut(pieces)
        if len(chars) > last - first + 1:
            # More leaves than there were: they are split off, which so many insertions have paid for.
            held = list(zip(self.chars[self.size :], self.tokens[self.size :], strict=True))
            held[first : last + 1] = zip(chars, tokens, strict=True)
            held = [leaf for leaf in held if leaf[0]]
            self._build([c for c, _ in held], [t for _, t in held])
            return
        for k in range(first, last + 1):
            c, t = (chars[k - first], tokens[k - first]) if k - first < len(chars) else (0, 0)
            if (c, t) != (self.chars[self.size + k], self.tokens[self.size + k]):
                self._set(k, c, t)


def revision_edits(text_col: str = "text") -> Column:
    """A fixed revision of every text: a cut at a quarter, a note at a half, a break at three quarters of it."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    edit = lambda at, removed, inserted: F.struct(
        F.floor(n * F.lit(at)).cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted")
    )
    return F.array(edit(0.75, 1, "\n\n"), edit(0.5, 0, " (revised)"), edit(0.25, 5, ""))


TREE_SCHEMA = "doc_id long, text string, chars array<int>, tokens array<int>"


def _trees(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexigrid.llm.common import rows_of

        counter, kind = Counter(path), pa.list_(pa.int32())
        for batch in batches:
            rows = [(d, t, *CountTree(t, counter).kept()) for d, t in rows_of([batch], "doc_id", "text")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), kind, kind), strict=True)], names=["doc_id", "text", "chars", "tokens"])

    return run


def count_trees(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and characters and tokens of each leaf of every whole text: the table to keep between edits."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_trees(tokenizer_path), TREE_SCHEMA)


def _edit(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexigrid.llm.common import rows_of

        counter, kind = Counter(path), pa.list_(pa.int32())
        names = ["doc_id", "text", "chars", "tokens", "n_edits", "n_reencoded"]
        kinds = [pa.int64(), pa.string(), kind, kind, pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc_id, text, chars, tokens, edits in rows_of([batch], "doc_id", "text", "chars", "tokens", "edits"):
                tree, done = CountTree(text, counter, (chars, tokens)), [e for e in edits if e and e["start"] is not None]
                for e in done:
                    tree.edit(e["start"], e["removed"] or 0, e["inserted"] or "")
                rows.append((doc_id, tree.text, *tree.kept(), len(done), tree.reencoded))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def apply_edits(trees: DataFrame, edits: Column, tokenizer_path: str) -> DataFrame:
    """Kept trees after each text's edits (start, removed, inserted), made one after another, with n_edits and n_reencoded.

    Trees without edits pass unread by Python. Positions are code points of the text as the edits before
    left it, clipped to it; null parts of an edit are 0 or empty, one without a start does nothing.
    """
    rows = trees.withColumn("edits", edits.cast(EDIT_TYPE))
    some = F.coalesce(F.size("edits") > 0, F.lit(False))
    none = rows.where(~some).select("doc_id", "text", "chars", "tokens", F.lit(0).cast("long").alias("n_edits"), F.lit(0).cast("long").alias("n_reencoded"))
    return none.unionByName(rows.where(some).mapInArrow(_edit(tokenizer_path), f"{TREE_SCHEMA}, n_edits long, n_reencoded long"))


def with_edits(trees: DataFrame, table: DataFrame) -> DataFrame:
    """Kept trees with the column `edits`, the lists of a table (doc_id, seq, start, removed, inserted) in the order of seq."""
    edit = F.struct("seq", F.struct("start", "removed", "inserted").alias("e"))
    lists = table.where("doc_id is not null").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(edit)), lambda x: x["e"]).alias("edits"))
    return trees.join(lists, "doc_id", "left")


def n_tokens() -> Column:
    """Of a kept tree."""
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)


def edited_counts(docs: DataFrame, edits: Column, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, and after its edits: its tree is made once and stored, and the edits change the stored tree.

    Edits are as for `apply_edits`, of the column `text`. A null text is empty. n_reencoded is the number
    of characters encoded again. Repeated rows and null ids come out as they came in.
    """
    trees = stored(count_trees(docs, tokenizer_path, id_col=id_col, text_col=text_col), "trees")
    before = n_tokens()
    rows = trees.withColumn("edits", edits.cast(EDIT_TYPE)).withColumn("n_tokens", before)
    return rows.mapInArrow(_recount(tokenizer_path), "doc_id long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, n_reencoded long")


def _recount(path: str):
    """Counts alone of what `apply_edits` gives, so that edited texts don't go back to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexigrid.llm.common import rows_of

        counter = Counter(path)
        names = ["doc_id", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_reencoded"]
        for batch in batches:
            rows = []
            for doc_id, text, chars, tokens, edits, before in rows_of([batch], "doc_id", "text", "chars", "tokens", "edits", "n_tokens"):
                tree, done = CountTree(text, counter, (chars, tokens)), [e for e in edits or [] if e and e["start"] is not None]
                for e in done:
                    tree.edit(e["start"], e["removed"] or 0, e["inserted"] or "")
                rows.append((doc_id, before, len(done), len(tree.text), tree.total(), tree.reencoded))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run
