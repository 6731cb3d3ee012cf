"""Language identification by a byte convolutional network (operator 1).

Texts are cut into windows of ``WINDOW`` bytes, the last one padded. Filters of
two, three and four bytes run over each window; every filter's largest response
in a window, rectified, feeds a softmax over the learned languages. A text's
language is the one with the largest mean probability over all its windows, and
its score is that mean. Every byte of a text is read, however long it is.

Training (numpy, Adam) uses at most ``SAMPLE_ROWS`` labelled rows, picked by a
hash of id and text, and crops of ``CROP_BYTES`` bytes that are spread evenly over
each whole text, one for every ``CROP_EVERY`` bytes or a few. All crops have at
most ``SAMPLE_BYTES`` bytes, which bounds what the driver gets and the time of
training; fewer rows are taken where texts are long. Rows whose crc32 of the id
modulo 4 is 2 are held out. Only text and lang are inputs. For inference the filters become two tables over byte pairs,
so a position costs two row lookups; positions go through them in spans, so a
worker's memory is a few bytes for each of a batch.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
without labelled rows every text is ``und``; equal texts get equal answers; a
null id is kept, trained on if labelled, and not held out; of languages with
equal probability the first by name is the answer; columns beyond doc_id, text
and lang are ignored by ``identify`` and kept by ``keep_known``, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, byte_texts

SAMPLE_ROWS = 6000
#: Bytes of all crops; where texts are long, fewer rows are taken. A text whose
#: crops alone have more (one of 128 MB) isn't learned from.
SAMPLE_BYTES = 16 << 20
#: Bins of the hash by which rows are chosen.
BINS = 1 << 16
CROPS = 3
CROP_BYTES = 256
CROP_EVERY = 2048
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Windows convolved at once; windows whose positions are turned into numbers of
#: table rows at once, which take eight bytes each.
CHUNK_WINDOWS = 32
SPAN_WINDOWS = 64 * CHUNK_WINDOWS

#: Codes of bytes: white space 0, ASCII letters without case 1-26, digits 27,
#: other ASCII 28, bytes beyond ASCII one each.
CODE = np.array([0 if b in b" \t\n\r\x0b\x0c" else (b | 32) - 96 if chr(b | 32).isalpha() and b < 128 else 27 if 48 <= b < 58 else 28 if b < 128 else b - 99 for b in range(256)], np.int64)
CODES = int(CODE.max()) + 1
CODE_BYTES = CODE.astype(np.uint8).tobytes()
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letters(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # of each width: (width, CODES, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by the pair of codes at a position and two further on."""
        first, second = (np.zeros((CODES, CODES, len(WIDTHS) * FILTERS), np.float32) for _ in range(2))
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            s = slice(k * FILTERS, (k + 1) * FILTERS)
            first[:, :, s] = f[0][:, None] + f[1][None, :]
            if w > 2:
                second[:, :, s] += f[2][:, None]
            if w > 3:
                second[:, :, s] += f[3][None, :]
        return first.reshape(CODES * CODES, -1), second.reshape(CODES * CODES, -1)

    def window_probabilities(self, codes: np.ndarray, tables: tuple[np.ndarray, np.ndarray], ends: np.ndarray) -> np.ndarray:
        """``codes``: whole windows one after the other; ``ends``: where texts
        end. What follows an end counts as white space (code 0), so no filter
        reads the next text."""
        found = []
        for at in range(0, len(codes), SPAN_WINDOWS * WINDOW):
            n = min(len(codes) - at, SPAN_WINDOWS * WINDOW)
            near = np.zeros(n + 3, np.int64)
            part = codes[at : at + n + 3]
            near[: len(part)] = part
            last = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + n + 2, "right")] - at - 1
            first = near[:-1] * CODES + near[1:]
            first[last] = near[last] * CODES
            second = first[2:].copy()
            second[last[last < n]] = 0
            second[last[(last > 0) & (last <= n)] - 1] = 0
            peaks = []
            for i in range(0, n, CHUNK_WINDOWS * WINDOW):
                part = slice(i, min(i + CHUNK_WINDOWS * WINDOW, n))
                r = tables[0].take(first[part], axis=0)
                r += tables[1].take(second[part], axis=0)
                peaks.append(r.reshape(-1, WINDOW, r.shape[1]).max(axis=1))
            z = np.maximum(np.concatenate(peaks) + self.bias, 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            found.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(found)


def window_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of all texts, a byte each, and each text's number of
    windows. A text is padded with white space, four bytes at least."""
    counts = np.array([(len(t) + 4 + WINDOW - 1) // WINDOW for t in texts], np.int64)
    joined = b"".join([t.translate(CODE_BYTES).ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts, strict=True)])
    return np.frombuffer(joined, np.uint8), counts


def train(samples: list[tuple[bytes, str]], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    """Fit on (text, language) crops; crops are cut again to random lengths,
    so that short texts are known too."""
    languages = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    width, k = len(WIDTHS) * FILTERS, len(languages)
    f = [rng.normal(0, 0.3, (w, CODES, FILTERS)).astype(np.float32) for w in WIDTHS]
    params = [*f, np.zeros(width, np.float32), rng.normal(0, 0.1, (width, max(k, 1))).astype(np.float32), np.zeros(max(k, 1), np.float32)]
    if k > 1:
        y = np.array([languages.index(lang) for _, lang in samples])
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        length, cols, step = WINDOW + max(WIDTHS) - 1, np.arange(FILTERS)[None, :], 0
        for epoch in range(epochs):
            order = rng.permutation(len(samples))
            for s in range(0, len(order), batch):
                at = order[s : s + batch]
                codes = np.zeros((len(at), length), np.int64)
                for i, j in enumerate(at):
                    t = samples[j][0]
                    size = min(len(t), WINDOW if rng.random() < 0.6 else int(rng.integers(6, WINDOW)))
                    start = int(rng.integers(0, len(t) - size + 1))
                    codes[i, :size] = CODE[np.frombuffer(t[start : start + size], np.uint8)]
                peak, where = [], []
                for w, e in zip(WIDTHS, params, strict=False):
                    r = sum(e[o][codes[:, o : length - w + 1 + o]] for o in range(w))
                    where.append(r.argmax(axis=1))
                    peak.append(np.take_along_axis(r, where[-1][:, None, :], 1)[:, 0])
                h = np.maximum(np.concatenate(peak, axis=1) + params[3], 0)
                z = h @ params[4] + params[5]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(at)), y[at]] -= 1
                p /= len(at)
                dh = (p @ params[4].T) * (h > 0)
                grads = [np.zeros_like(e) for e in params[:3]] + [dh.sum(0), h.T @ p, p.sum(0)]
                rows = np.arange(len(at))[:, None]
                for n, w in enumerate(WIDTHS):
                    d = dh[:, n * FILTERS : (n + 1) * FILTERS]
                    for o in range(w):
                        np.add.at(grads[n][o], (codes[rows, where[n] + o], cols), d)
                step += 1
                now = rate * (0.5 if epoch > epochs // 2 else 1)
                for q, g, (m, v) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(languages, params[:3], params[3], params[4], params[5])


def crops(text: bytes) -> list[bytes]:
    """Crops from the beginning to the end of a text, as many as it is long."""
    n, size = max(CROPS, len(text) // CROP_EVERY), max(0, len(text) - CROP_BYTES)
    starts = sorted({size * i // (n - 1) for i in range(n)})
    return [c for c in dict.fromkeys(text[s : s + CROP_BYTES] for s in starts) if has_letters(c)]


def chosen(labelled: DataFrame, rows: int, budget: int) -> str | None:
    """A condition on ``bin`` that keeps at most ``rows`` rows whose crops have
    at most ``budget`` bytes; null where all rows do. Rows and bytes of each bin
    of a hash are counted by the executors; bins are taken in order, and one
    that doesn't fit is left out."""
    size = F.greatest(F.lit(CROPS), F.floor(F.octet_length("text") / CROP_EVERY)) * CROP_BYTES
    counts = labelled.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    bins = sorted(tuple(r) for r in counts.collect())  # at most BINS
    if sum(n for _, n, _ in bins) <= rows and sum(size for _, _, size in bins) <= budget:
        return None
    taken = []
    for at, n, size in bins:
        if n <= rows and size <= budget:
            rows, budget = rows - n, budget - size
            taken.append(str(at))
    return f"bin in ({', '.join(taken)})" if taken else "false"


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, budget: int = SAMPLE_BYTES) -> list[tuple[bytes, str]]:
    """Crops of labelled rows that are not held out: of at most ``rows`` rows,
    and at most ``budget`` bytes."""
    some = docs.where(F.col("lang").isNotNull() & ~held_out())
    some = some.select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(BINS)).alias("bin"))
    condition = chosen(some, rows, budget)
    some = some.where(condition) if condition else some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(c, lang) for lang, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True) for c in crops(t)]
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], ["crop", "lang"])

    found = arrow_map(some.select("lang", "text"), run, "crop binary, lang string").toArrow()
    return sorted(zip(found.column("crop").to_pylist(), found.column("lang").to_pylist(), strict=True))


def answers(net: Network, tables: tuple[np.ndarray, np.ndarray] | None, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if net.languages and has_letters(t)]
    if at:
        codes, counts = window_codes([texts[i] for i in at])
        p = net.window_probabilities(codes, tables, counts.cumsum() * WINDOW)
        mean = np.add.reduceat(p, np.concatenate([[0], counts.cumsum()[:-1]]), axis=0) / counts[:, None]
        best = mean.argmax(axis=1)
        lang[at] = np.array(net.languages, object)[best]
        score[at] = np.clip(mean[np.arange(len(at)), best], 0, 1)
    return lang, score


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = held.value
        tables = net.tables() if net.languages else None
        for b in batches:
            lang, score = answers(net, tables, byte_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows of ``docs`` and predict all of its rows."""
    found = predict(docs, train(sample(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without texts whose language can't be told: no letters, or a
    score under ``least`` (a text half in another language stays). One pass, all
    columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(train(sample(docs)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = held.value
        tables = net.tables() if net.languages else None
        for b in batches:
            lang, score = answers(net, tables, byte_texts(b.column(at)))
            yield b.filter(pa.array((lang != "und") & (score >= least), pa.bool_()))

    return arrow_map(docs, run, docs.schema)
