"""Toxicity: a support vector machine on a gapped-subsequence kernel of letters, through Nyström landmarks."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import fold, id_and_text, stored

#: Letters of a subsequence, and how far apart two neighbours among them may be: one other letter may stand between.
ORDER = 4
GAPS = (1, 2)
DECAY = 0.5
#: The code that stands before and after the letters of a string.
EDGE = 31
#: A piece of a word that spaces take apart has at most so many letters.
SHORT = 3
#: Strings of a text that add up to its value: one chance likeness is not yet an insult.
COUNTED = 5
_NUMBERS = 1 << 5 * ORDER


@lru_cache(maxsize=1)
def _letter_codes():
    """By code point: 1 to 26 for a to z in either case and with any accent, 27 to 30 for other letters, else 0."""
    import numpy as np

    out = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            base = ord(unicodedata.normalize("NFKD", c).lower()[0])
            out[point] = base - 96 if 97 <= base <= 122 else 27 + base % 4
    return out


def letters(text: str):
    """The letters of a text as codes; marks, digits and white space between them are left out."""
    import numpy as np

    codes = _letter_codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    return codes[codes > 0]


class Strings:
    """Strings of letter codes in a row, `sizes` codes each, set between edges and apart from one another."""

    def __init__(self, flat, sizes):
        import numpy as np

        self.sizes = np.asarray(sizes, np.int64)
        gap = ORDER * max(GAPS)
        self.starts = np.cumsum(self.sizes + gap) - self.sizes - gap
        self.x = np.zeros(int((self.sizes + gap).sum()), np.int32)
        begin = np.repeat(self.starts + 1 - (np.cumsum(self.sizes) - self.sizes), self.sizes)
        self.x[np.arange(len(flat)) + begin] = flat
        self.x[self.starts] = self.x[self.starts + 1 + self.sizes] = EDGE

    def subsequences(self) -> Iterator[tuple]:
        """(weight, numbers): for every pattern of gaps, what begins at each place, as a number; 0 is in no string.

        The weight is DECAY^span, of the letters from the first to the last.
        """
        import numpy as np

        x = self.x
        pairs = {g: x[:-g] << 5 | x[g:] for g in GAPS}
        for first, second, third in product(GAPS, repeat=3):
            reach = first + second + third
            n = len(x) - reach
            if n > 0:
                numbers = pairs[first][:n] << 10 | pairs[third][first + second : first + second + n]
                inside = (x[:n] > 0) & (x[first : first + n] > 0) & (x[first + second : first + second + n] > 0) & (x[reach:] > 0)
                yield DECAY ** (reach + 1), np.where(inside, numbers, 0)

    def norms(self):
        """The length of each string's vector, if none of its subsequences came twice."""
        import numpy as np

        square = np.zeros(len(self.sizes))
        for gaps in product(GAPS, repeat=3):
            square += np.maximum(self.sizes + 2 - sum(gaps), 0) * DECAY ** (2 * sum(gaps) + 2)
        return np.sqrt(np.maximum(square, 1e-12))

    def products(self, table):
        """For each string the sum of `table` over its subsequences, by its norm."""
        import numpy as np

        total = np.zeros(len(self.x))
        for weight, numbers in self.subsequences():
            total[: len(numbers)] += weight * table.take(numbers)
        if not len(total):
            return np.zeros(0)
        return np.add.reduceat(total, self.starts) / self.norms()


def _of_word(word: str) -> Strings:
    """A word, or one that begins so where it ends with a star: that has no edge at its end."""
    found = Strings(letters(word), [len(letters(word))])
    if word.endswith("*"):
        found.x[found.x.nonzero()[0][-1]] = 0
    return found


class Landmarks:
    """Words with their subsequences as vectors over the norm: row k of `vectors` by the numbers of `columns`."""

    def __init__(self, words: list[str]):
        import numpy as np

        self.words = words
        each: list[dict[int, float]] = []
        for word in words:
            found: dict[int, float] = defaultdict(float)
            for weight, numbers in _of_word(word).subsequences():
                for u in numbers[numbers > 0].tolist():
                    found[u] += weight
            each.append(found)
        self.columns = np.array(sorted(set().union(*each)), np.int64)
        at = {u: k for k, u in enumerate(self.columns.tolist())}
        self.vectors = np.zeros((len(words), len(self.columns)))
        for k, found in enumerate(each):
            for u, v in found.items():
                self.vectors[k, at[u]] = v
        self.vectors /= np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)

    def gram(self):
        return self.vectors @ self.vectors.T

    def table(self, weights):
        """The weighted sum of all landmarks' vectors by number: one lookup a subsequence gives the sum of all kernel values."""
        import numpy as np

        out = np.zeros(_NUMBERS, np.float32)
        out[self.columns] = np.asarray(weights) @ self.vectors
        return out

    def bound(self):
        """The largest entry of any landmark by number."""
        import numpy as np

        out = np.zeros(_NUMBERS, np.float32)
        out[self.columns] = self.vectors.max(axis=0, initial=0.0)
        return out

    def values(self, strings: Strings):
        """The kernel of each string with each landmark."""
        import numpy as np

        out = np.zeros((len(strings.sizes), len(self.words)))
        owner = np.repeat(np.arange(len(strings.sizes)), np.diff(np.append(strings.starts, len(strings.x))))
        place = np.full(_NUMBERS, -1, np.int64)
        place[self.columns] = np.arange(len(self.columns))
        for weight, numbers in strings.subsequences():
            column = place[numbers]
            at = np.flatnonzero(column >= 0)
            np.add.at(out, owner[at], weight * self.vectors[:, column[at]].T)
        return out / strings.norms()[:, None]


class Readings(NamedTuple):
    """What texts may spell: the strings, and where they occur."""

    strings: Strings
    owner: object  # of each string: itself, or the word of which it leaves letters out
    text: object  # of each occurrence
    string: object  # of each occurrence
    left: object  # words of each pair
    right: object
    pair: object  # occurrences that are pairs
    words: object  # of each text: how many

    def occurring(self, value):
        """(occurrences, their values) with a value above 0, by text and falling value; a pair only if more than twice its words."""
        import numpy as np

        best = np.zeros(len(self.strings.sizes))
        np.maximum.at(best, self.owner, value)
        found = best[self.string]
        found[self.pair[found[self.pair] <= 2 * np.maximum(best[self.left], best[self.right])]] = 0
        some = np.flatnonzero(found > 1e-6)
        some = some[np.lexsort((some, -found[some], self.text[some]))]
        return some, found[some]


def _ranks(groups):
    """Place of each row within its group, from 0; the groups lie together in order."""
    import numpy as np

    return np.arange(len(groups)) - np.searchsorted(groups, groups)


def readings(texts: pa.Array) -> Readings:
    """The strings that texts may spell, each distinct one once.

    A word between white space is read without its marks and digits. Words of eight letters and more are
    also read without every other letter, as 'bxlxoxcxkx'. A piece of up to three letters is also read with
    each neighbour, as 'stu pid', and three such pieces and more in a row as one, as 'i d i o t'.
    """
    import numpy as np
    import pyarrow.compute as pc

    split = pc.utf8_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    line = np.frombuffer("\0".join([*distinct, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _letter_codes()[line]
    word = np.cumsum(line == 0) - (line == 0)
    flat, size = codes[codes > 0], np.bincount(word[codes > 0], minlength=len(distinct))
    first = np.cumsum(size) - size
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    spelled = size[which] > 0
    which, text = which[spelled], text[spelled]
    n = size[which]

    def joined(words, counts):
        """Letters and sizes of strings made of `counts` words each."""
        each = size[words]
        at = np.arange(each.sum()) + np.repeat(first[words] - (np.cumsum(each) - each), each)
        return flat[at], np.add.reduceat(each, np.cumsum(counts) - counts) if len(counts) else each

    held = [(flat, size)]
    owner, texts_of, strings_of = [np.arange(len(size))], [text], [which]
    many = len(size)
    # Every other letter of long words, from the first and from the second.
    long = np.flatnonzero(size >= 8)
    for skip in (0, 1):
        each = (size[long] + 1 - skip) // 2
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        held.append((flat[np.repeat(first[long], each) + 2 * at + skip], each))
        owner.append(long)
        many += len(long)
    # A short piece and its neighbour.
    two = np.flatnonzero((text[1:] == text[:-1]) & ((n[1:] <= SHORT) | (n[:-1] <= SHORT))) if len(n) > 1 else np.zeros(0, np.int64)
    pairs, of_pair = np.unique(which[two] * len(distinct) + which[two + 1], return_inverse=True)
    both = np.stack([pairs // max(1, len(distinct)), pairs % max(1, len(distinct))], 1).ravel()
    held.append(joined(both, np.full(len(pairs), 2)))
    owner.append(np.arange(many, many + len(pairs)))
    texts_of.append(text[two]), strings_of.append(many + of_pair)
    many += len(pairs)
    # Single letters, and short pieces, in a row.
    for most in (1, SHORT):
        inside = n <= most
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.where(inside, text + 1, 0), [0]])))
        runs = [(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if b - a > 2 and inside[a]]
        if runs:
            a, b = np.array(runs).T
            at = np.arange((b - a).sum()) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
            held.append(joined(which[at], b - a))
            owner.append(np.arange(many, many + len(runs)))
            texts_of.append(text[a]), strings_of.append(np.arange(many, many + len(runs)))
            many += len(runs)
    spells = Strings(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
    return Readings(spells, *map(np.concatenate, (owner, texts_of, strings_of)), which[two], which[two + 1], np.arange(len(which), len(which) + len(two)), np.bincount(text, minlength=len(texts)))


def strongest(texts: pa.Array, table) -> tuple:
    """For each text, and with the logarithm of its number of words, the sum of its COUNTED largest values above 0: of its strings, repeats included, as Strings.products gives them."""
    import numpy as np

    found = readings(texts)
    some, value = found.occurring(found.strings.products(table))
    text = found.text[some]
    first = _ranks(text) < COUNTED
    return np.bincount(text[first], weights=value[first], minlength=len(texts)), np.log1p(found.words)


class Model:
    """score = logistic(slope * f + shift), f the SVM's value of a text: its strongest strings, its length and the bias."""

    def __init__(self, words, weights, length, bias, slope, shift):
        self.words, self.weights, self.length, self.bias, self.slope, self.shift = words, weights, length, bias, slope, shift

    def scorer(self):
        """A function from an Arrow array of texts to their scores."""
        import numpy as np

        table = Landmarks(self.words).table(self.weights)

        def scores(texts: pa.Array):
            value, length = strongest(texts, table)
            f = value + self.length * length + self.bias
            return 1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -30, 30)))

        return scores


def _svm(x, y, weight, rounds: int = 400, penalty: float = 1e-2):
    """Squared hinge with an L2 penalty, by accelerated gradient steps; weight is each row's share."""
    import numpy as np

    a = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (2 * np.linalg.norm(np.sqrt(weight)[:, None] * a, 2) ** 2 + penalty)
    w = v = np.zeros(a.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (a @ v))
        new = v - step * (-2 * a.T @ (weight * y * slack) + penalty * np.r_[v[:-1], 0])
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1], w[-1]


def _platt(f, y):
    """Slope and shift of the logistic fit with smoothed targets, where some of class 1 show nothing and are like class 0.

    Expectation-maximisation: a row of class 1 counts as far as its value, and not that share, explains its label.
    """
    import numpy as np

    a = np.stack([f, np.ones(len(f))], 1)
    n1, n0 = y.sum(), len(y) - y.sum()
    share, p = 0.05, 1 / (1 + np.exp(-np.clip(4 * f, -30, 30)))
    w = np.array([4.0, 0.0])
    for _ in range(30):
        known = p / (p + (1 - p) * share)
        target = np.where(y > 0, known * (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        share = max(1e-4, (y * (1 - known)).sum() / ((y * (1 - known)).sum() + n0))
        for _ in range(10):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + 1e-6 * np.eye(2)
            w = w - np.clip(np.linalg.solve(h, a.T @ (p - target)), -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about 4 MB."""
    for batch in batches:
        step = max(1, min(batch.num_rows, int(batch.num_rows * 4e6 / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Once for each text: its words in lower case without marks, and how they begin, which inflected words share."""
    from lexigrid.llm.common import rows_of

    for batch in batches:
        for text, label in rows_of([batch], "text", "toxic"):
            bare = {b for w in text.lower().split() if len(b := "".join(filter(str.isalpha, w))) > 2}
            found = list(bare.union(*({b[:n] + "*" for b in bare if len(b) > n} for n in (4, 5, 6))))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.string())], names=["toxic", "w"])


def _spread(words: list[str], most: int) -> list[str]:
    """The first words whose kernel with every word before them is under 0.6."""
    rows, kept = Landmarks(words).gram(), []
    for k in range(len(words)):
        if len(kept) < most and rows[k, k] > 0 and all(rows[k, j] < 0.6 for j in kept):
            kept.append(k)
    return [words[k] for k in kept]


def _instances(words: list[str], most: int):
    """Of every text the `most` strings likest to landmarks, as kernel values: (doc_id, toxic, length, v); v null where none is alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        landmarks = Landmarks(words)
        bound = landmarks.bound()
        for part in _slices(batches):
            found = readings(part.column("text"))
            strings = found.strings
            some, _ = found.occurring(strings.products(bound))
            some = some[_ranks(found.text[some]) < most]
            pairs = np.stack([found.text[some], found.string[some]], 1)
            chosen, at = np.unique(pairs[:, 1], return_inverse=True)
            size = strings.sizes[chosen]
            place = np.arange(size.sum()) + np.repeat(strings.starts[chosen] + 1 - (np.cumsum(size) - size), size)
            values = landmarks.values(Strings(strings.x[place], size))[at] if len(chosen) else []
            bare = np.setdiff1d(np.arange(part.num_rows), pairs[:, 0])
            rows = np.concatenate([pairs[:, 0], bare])
            v = pa.array([*values, *[None] * len(bare)], pa.list_(pa.float32()))
            columns = [part.column("doc_id").take(pa.array(rows)), part.column("toxic").take(pa.array(rows)), pa.array(np.log1p(found.words[rows])), v]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "length", "v"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, landmarks: int = 64, places: int = 16, least_gain: float = 10.0, parts: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model from a hash sample of about `fit_rows` labelled rows outside the held-out fold.

    Landmarks are words that more toxic than clean texts hold, by at least `least_gain` (three toxic texts and no clean
    one are enough in a small sample), and how these begin. The `places` strings of
    a labelled text that are likest to landmarks go to the driver, fit_rows * places vectors at most and
    add up to the text's vector; once fitted, those COUNTED that score most, as in scoring.
    None if either class is missing.
    """
    import numpy as np

    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("doc_id is not null and toxic is not null").where(fold("doc_id", parts) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if n > fit_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    marked = F.broadcast(marked)  # fit_rows rows of two numbers
    sample = stored(id_and_text(docs, id_col, text_col).join(marked, "doc_id"), "toxic-sample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return None
    counts = sample.mapInArrow(_candidates, "toxic int, w string").groupBy("w").agg(
        F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")
    )
    gain = F.col("n1") * F.log((F.col("n1") + 0.5) / n1 / ((F.col("n0") + 0.5) / n0))
    # exp(-gain) bounds how likely chance gives such counts to a word; there may be a million words.
    chosen = counts.where((gain > least_gain) & (F.col("n1") * n0 > 8 * F.col("n0") * n1)).orderBy(gain.desc(), F.col("w").endswith("*"), F.length("w").desc(), "w")
    words = _spread([r.w for r in chosen.limit(10 * landmarks).collect()], landmarks)
    if not words:
        return None
    rows = sample.mapInArrow(_instances(words, places), "doc_id long, toxic int, length double, v array<float>").toPandas()
    full = rows[rows.v.notna()].reset_index(drop=True)
    x = np.vstack([*full.v, np.zeros((0, len(words)))]).astype(float)
    each = rows.groupby("doc_id").toxic.max()
    place = each.index.get_indexer(full.doc_id)
    length = rows.groupby("doc_id").length.max().to_numpy()
    y = np.where(each.to_numpy() > 0, 1.0, -1.0)
    weight = np.where(y > 0, 1 / n1, 1 / n0)
    # Nyström: the kernel map of a string is its landmark values times gram^(-1/2).
    s, u = np.linalg.eigh(Landmarks(words).gram())
    root = (u / np.sqrt(np.maximum(s, 0.05))) @ u.T
    some = np.arange(len(x))
    for _ in range(2):
        text = np.zeros((len(each), len(words)))
        np.add.at(text, place[some], x[some])
        w, bias = _svm(np.hstack([text @ root, length[:, None] / 10]), y, weight)
        w, per_length = root @ w[:-1], w[-1] / 10
        f = np.maximum(x @ w, 0)
        # All strings count in the first fit, the strongest in the second, as in scoring.
        order = np.lexsort((-f, place))
        some = order[_ranks(place[order]) < COUNTED]
    top = np.bincount(place[some], weights=f[some], minlength=len(each)) + per_length * length + bias
    slope, shift = _platt(top, each.to_numpy(dtype=float))
    return Model(words, w.tolist(), float(per_length), float(bias), slope, shift)


def _scorer(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        scores = model.scorer() if model else lambda texts: np.zeros(len(texts))
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text")))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None, *, threshold: float = 0.7, parts: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row's whole text.

    Null or empty texts score as a text without insults. Without a model (no labels of one class)
    every score is 0. Repeated rows and null ids come out as they came in (held_out is then false).
    """
    found = id_and_text(docs, id_col, text_col).mapInArrow(_scorer(model), "doc_id long, score double")
    return found.select(
        "doc_id", F.coalesce(fold("doc_id", parts) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
