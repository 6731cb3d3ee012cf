"""Toxicity by noisy-channel deobfuscation (operator 4).

A word that looks disguised (digits or signs among letters, letters spaced
apart, letters repeated) is a lattice: each character may stand for itself, for
the letters it is used to replace, or for nothing. Viterbi decoding under a
character trigram model picks the most likely restored word. The trigram model
counts every text of the corpus; counts are summed in Spark, so what is
gathered follows the corpus and the driver gets at most ``SYMBOLS**3`` numbers.
Texts are read as one byte a character: Latin-1 letters are themselves, and in
a disguise may stand for the letter without the accent; letters of other
alphabets are all ``OTHER``.

Texts are then scored by a logistic model over their restored words and the
beginnings of their words. It is fitted on at most ``SAMPLE_ROWS`` labelled rows
(by a hash of the id) whose crc32 of the id modulo 4 is not 2; its vocabulary
is the at most ``FEATURES`` terms most associated with the label there.

Only text is an input of a score. Defined cases: a null text scores as empty;
an empty text gets the model's base score; without labelled rows of both kinds
every score is 0; a document with several labels trains once for each.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, byte_texts
from ruleloom.llm.decontam import FOLD
from ruleloom.llm.langid import held_out

SAMPLE_ROWS = 16_000
FEATURES = 4000
#: Least association (z of the log odds) and least toxic rows of a feature.
LEAST_Z = 3.5
LEAST_ROWS = 3
THRESHOLD = 0.3
#: Terms in one batch of counts.
TERMS_BATCH = 50_000
#: Bytes at a word's beginning that are features.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Longest disguised word whose restored form is kept for the next time.
LONGEST = 80

#: Trigram symbols: 0 the edge of a word, 1-26 letters, 27 any other letter.
SYMBOLS = 28
SYMBOL = np.array([0 if not chr(b).isalpha() else (b | 32) - 96 if b < 128 else 27 for b in range(256)], np.int32)
#: The byte of a letter beyond Latin-1.
OTHER = b"\xff"
#: Letters without their accents.
PLAIN = {c: d for c in map(chr, range(0xC0, 0x100)) if (d := unicodedata.normalize("NFD", c)[0]) != c and d.isascii()}

#: Letters that signs and digits are used to replace.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou"}
#: Costs (negative logs) of the channel's steps.
SWAP, DROP_SIGN, DROP_REPEAT, DROP_DOUBLE, DROP_GAP = 1.0, 9.0, 0.2, 7.0, 0.1
#: A gap between spaced letters that is the edge of a word.
EDGE = 0.1

_LETTER = SYMBOL > 0
_SIGN = np.array([chr(b) in STANDS_FOR for b in range(256)])
_GAP = np.array([chr(b) in " .-_*" for b in range(256)])
_WORDY = _LETTER | _SIGN
_REPEATS = re.compile(rb"([a-z\xe0-\xff])\1{3,}")


def _beyond(error: UnicodeEncodeError) -> tuple[bytes, int]:
    return b"".join(OTHER if c.isalpha() else b"\0" for c in error.object[error.start : error.end]), error.end


codecs.register_error("ruleloom-beyond", _beyond)


def one_byte(text: bytes) -> bytes:
    """A text with one byte a character, in lower case."""
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode("latin-1", "ruleloom-beyond")


# The language model


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    s = SYMBOL[np.frombuffer(b"  " + b"  ".join(map(one_byte, texts)) + b"  ", np.uint8)]
    key = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return np.bincount(key, minlength=SYMBOLS**3)


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            total += trigram_counts(byte_texts(b.column(0)))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["tri", "n"])

    counts = np.zeros(SYMBOLS**3)
    for tri, n in arrow_map(docs.select("text"), run, "tri int, n long").groupBy("tri").agg(F.sum("n")).collect():
        counts[tri] = n
    return counts


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), smoothed by the shorter contexts."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    uni = (tri.sum((0, 1)) + 1) / (tri.sum() + SYMBOLS)
    bi = (tri.sum(0) + 20 * uni) / (tri.sum((0, 2))[:, None] + 20)
    return -np.log((tri + 20 * bi) / (tri.sum(2)[:, :, None] + 20))


# The channel


def options(text: str, i: int, spaced: bool) -> list[tuple[str, float]]:
    """What the character at ``i`` may stand for, and the cost."""
    c = text[i]
    if c in STANDS_FOR and not (spaced and c == "*"):
        return [*((x, SWAP) for x in STANDS_FOR[c]), ("", DROP_SIGN)]
    if not c.isalpha():
        return [("", DROP_GAP if spaced else DROP_SIGN)]
    if i and text[i - 1] == c:
        run = 1
        while i - run >= 0 and text[i - run] == c:
            run += 1
        j = i
        while j + 1 < len(text) and text[j + 1] == c:
            j += 1
        return [(c, 0.0 if j - i + run <= 2 else 1.0), ("", DROP_DOUBLE if j - i + run <= 2 else DROP_REPEAT)]
    return [(c, 0.0), (PLAIN[c], SWAP)] if c in PLAIN else [(c, 0.0)]


def decode(text: str, costs: np.ndarray, edges: bool = False) -> str:
    """The most likely word behind a disguised one (lower case Latin-1); with
    ``edges``, the most likely words, as a gap may also be an edge. The states
    are the last two letters, so the time follows the length."""
    spaced = any(c in " .-_" for c in text)
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, c in enumerate(text):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        steps = options(text, i, spaced)
        if edges and _GAP[ord(c)]:
            steps = [*steps, (" ", EDGE)]
        for to, price in steps:
            s = int(SYMBOL[ord(to)]) if to else 0
            for (a, b), (cost, word) in states.items():
                if to == " " and not b:  # no empty words
                    continue
                key = (b, s) if to else (a, b)
                now = cost + price + (float(costs[a, b, s]) if to else 0.0)
                if key not in after or now < after[key][0]:
                    after[key] = (now, (word, to) if to else word)
        states = after
    word = min(((cost + float(costs[a, b, 0]), word) for (a, b), (cost, word) in states.items()), key=lambda x: x[0])[1]
    out = []
    while word:
        word, to = word
        out.append(to)
    return "".join(reversed(out))


def disguised(texts: list[bytes]) -> list[set[str]]:
    """For each text the words and the runs of spaced letters that look
    disguised, lower-cased; a letter's repeats beyond three are left out.
    Vectorised over the bytes of all texts; only hits are handled one by one."""
    gap = b"\n" * 8
    texts = [*map(one_byte, texts)]
    joined = gap + gap.join(texts) + gap
    a = np.frombuffer(joined, np.uint8)
    letter, sign = _LETTER[a], _SIGN[a]
    swapped = np.flatnonzero(sign[:-1] & letter[1:])
    ends = np.flatnonzero(sign[1:-1] & letter[:-2] & (a[2:] <= 32) & (a[1:-1] != 33) & (a[1:-1] != 42)) + 1
    repeated = np.flatnonzero(letter[2:] & (a[2:] != OTHER[0]) & (a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]))
    single = np.zeros(len(a), bool)
    single[1:-1] = (letter | sign)[1:-1] & _GAP[a[2:]] & _GAP[a[:-2]] | (letter | sign)[1:-1] & ~_WORDY[a[2:]] & ~_WORDY[a[:-2]]
    gaps = _GAP[a]
    spread = np.flatnonzero(single[:-2] & single[2:] & gaps[1:-1])
    starts = np.cumsum([len(gap)] + [len(t) + len(gap) for t in texts])
    found: list[set[str]] = [set() for _ in texts]
    done = -1
    for i in np.union1d(np.union1d(swapped, ends), repeated).tolist():
        if i < done:
            continue
        s = e = i
        while _WORDY[joined[s - 1]]:
            s -= 1
        while _WORDY[joined[e]]:
            e += 1
        done = e
        if e - s >= 3:
            found[int(np.searchsorted(starts, s, "right")) - 1].add(_REPEATS.sub(rb"\1\1\1", joined[s:e]).decode("latin-1"))
    done = -1
    for i in spread.tolist():
        if i < done:
            continue
        e = i
        while single[e] and gaps[e + 1]:
            e += 2
        e += bool(single[e])
        done = e
        run = joined[i:e].decode("latin-1").rstrip(" .-_*")
        if len(run) >= 7 or any(map(str.isalpha, run)):  # a few figures are no word
            found[int(np.searchsorted(starts, i, "right")) - 1].add(run)
    return found


@dataclass
class Restorer:
    costs: np.ndarray
    kept: dict[str, str] = field(default_factory=dict)

    def restore(self, word: str) -> set[str]:
        """The words behind a disguised one; spaced letters are read as one
        word and as several."""
        got = self.kept.get(word)
        if got is None:
            got = {decode(word, self.costs)}
            if any(c in " .-_" for c in word):
                got.update(decode(word, self.costs, True).split())
            if len(word) <= LONGEST:
                if len(self.kept) > 200_000:
                    self.kept.clear()
                self.kept[word] = got
        return got

    def features(self, texts: list[bytes]) -> Iterator[set[bytes]]:
        """The terms of each text: its words, the restored ones and their
        beginnings (with a mark in front)."""
        for t, hidden in zip(texts, disguised(texts), strict=True):
            words = set(t.translate(FOLD).split())
            words.update(x.encode() for w in hidden for x in self.restore(w))
            starts: set[bytes] = set()
            for k in BEGINNINGS:
                starts |= {b"^" + w[:k] for w in words if len(w) > k}
            yield words | starts


# The classifier


@dataclass
class Model:
    costs: np.ndarray
    weights: dict[bytes, float]
    bias: float | None  # None: nothing was learned

    def scores(self, restorer: Restorer, texts: list[bytes]) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(texts))
        known, get = self.weights.keys(), self.weights.__getitem__
        z = np.array([self.bias + sum(map(get, known & terms)) for terms in restorer.features(texts)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most about ``rows`` rows that are not held out. The
    sample of labels is what the join broadcasts: its bound is ``rows``."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    n = usable.count()
    if n > rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    found = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")
    # copies would make every word of theirs look telling
    return found.select("text", F.col("toxic").cast("int").alias("toxic")).dropDuplicates()


def vocabulary(rows: DataFrame, costs: np.ndarray) -> list[bytes]:
    held = rows.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, all_rows, toxic_rows, kinds = Restorer(held.value), Counter(), Counter(), [0, 0]
        for b in batches:
            for terms, toxic in zip(restorer.features(byte_texts(b.column(0))), b.column(1).to_pylist(), strict=True):
                all_rows.update(terms)
                kinds[toxic] += 1
                if toxic:
                    toxic_rows.update(terms)
        # every term goes on: its toxic rows may be in other partitions; the empty term counts rows
        toxic_rows[b""], all_rows[b""] = kinds[1], sum(kinds)
        every = list(all_rows)
        for k in range(0, len(every), TERMS_BATCH):
            terms = every[k : k + TERMS_BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([toxic_rows[t] for t in terms], pa.int64()), pa.array([all_rows[t] for t in terms], pa.int64())], ["term", "toxic", "seen"])

    sums = arrow_map(rows, run, "term binary, toxic long, seen long").groupBy("term").agg(F.sum("toxic").alias("p"), F.sum("seen").alias("n")).where(F.col("p") >= LEAST_ROWS)
    total = sums.where(F.col("term") == F.lit(bytearray())).first()
    if not total or total.p == total.n:
        return []
    base = np.log(total.p / (total.n - total.p))
    odds = F.log((F.col("p") + 0.5) / (F.col("n") - F.col("p") + 0.5)) - F.lit(float(base))
    z = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") - F.col("p") + 0.5))
    best = sums.where(F.col("term") != F.lit(bytearray())).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(FEATURES)
    return [bytes(r[0]) for r in best.select("term").collect()]


def fit(rows: DataFrame, costs: np.ndarray, rounds: int = 400, ridge: float = 2e-4) -> Model:
    terms = vocabulary(rows, costs)
    number = {t: i for i, t in enumerate(terms)}
    held = rows.sparkSession.sparkContext.broadcast((costs, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, number = held.value
        restorer = Restorer(costs)
        for b in batches:
            found = [[number[t] for t in terms & number.keys()] for terms in restorer.features(byte_texts(b.column(0)))]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["toxic", "terms"])

    # rows with equal terms are one, so copies cost nothing here
    got = arrow_map(rows, run, "toxic int, terms array<int>").withColumn("terms", F.array_sort("terms")).groupBy("terms").agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    got.sort(key=lambda r: r[0])  # the same sums in the same order, however rows were dealt
    p, n = (np.array([r[k] for r in got], float) for k in (1, 2))
    if not got or p.sum() in (0, n.sum()):
        return Model(costs, {}, None)
    got_terms = [r[0] for r in got]
    # each term of a text alone, too: one telling word must do
    alone = [(t, k) for k, terms in enumerate(got_terms) if len(terms) > 1 for t in terms]
    share = np.array([1 / len(got_terms[k]) for _, k in alone])
    p, n = (np.concatenate([x, x[[k for _, k in alone]] * share]) if alone else x for x in (p, n))
    got_terms += [[t] for t, _ in alone]
    row = np.repeat(np.arange(len(got_terms)), [len(t) for t in got_terms])
    col = np.array([t for r in got_terms for t in r], int)
    w, bias, total = np.zeros(len(terms)), float(np.log(p.sum() / (n.sum() - p.sum()))), n.sum()
    m, v = np.zeros(len(terms) + 1), np.zeros(len(terms) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(row, w[col], len(got_terms)) if len(col) else np.full(len(got_terms), bias)
        d = (n / (1 + np.exp(-z)) - p) / total
        g = np.append(np.bincount(col, d[row], len(terms)) + ridge * w / max(len(terms), 1), d.sum()) if len(col) else np.append(np.zeros(len(terms)), d.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        s = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w -= s[:-1]
        np.maximum(w, 0, out=w)
        bias -= float(s[-1])
    return Model(costs, {t: float(x) for t, x in zip(terms, w, strict=True) if x > 0}, bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled(docs, labels), trigram_costs(corpus_trigrams(docs)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        restorer = Restorer(model.costs)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(model.scores(restorer, byte_texts(b.column(1))))], ["doc_id", "score"])

    found = arrow_map(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows and score every row of ``docs``."""
    return score(docs, train(docs, labels))
