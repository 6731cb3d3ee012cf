"""Benchmark decontamination with a generalised suffix automaton (operator 3).

Test items become sequences of word numbers and one suffix automaton holds all
of them. Executors stream each document's words through it and track the
longest suffix that occurs in some item. Where that length reaches the limit,
the words of the match are hit. An item of fewer words than the limit counts
where it occurs whole.

An automaton is broadcast, so its size is bounded: items are cut on executors
into pieces that overlap by a window less a word, so that every window is whole
in one of them, and pieces are dealt into as many groups as it takes for none
to have more than ``MAX_WORDS`` words. Each group is one pass over the documents, and
what the passes find in a document is put together. Nearly all benchmarks are
one group, and then documents never shuffle: each is one row in, one row out.

An automaton takes about 500 bytes a word while it is built, on the driver, and
about 50 bytes a word as arrays on executors (``MAX_WORDS``: 130 and 12 MB).

Words: ASCII letters are lower-cased; a word is a run of letters, digits and
characters beyond ASCII. Defined cases: a null text has no words; an item
without words has no window; equal items are each reported; a null item_id is
matched but not listed; an empty benchmark hits nothing; rows with equal ids
and texts get equal answers.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, byte_texts, free_name, written

#: Most words of the items of one automaton, and of one piece of an item.
MAX_WORDS = 250_000
PIECE_WORDS = 2_000

#: Lower-cases ASCII letters and turns every other ASCII byte, digits apart, into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Suffix automaton over several sequences of numbers from 1."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item has this string
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def add(self, words: list[int]) -> None:
        last = 0
        for c in words:
            last = self._extend(last, c)


class Matcher:
    """The automaton of a group of items (name, text), as sorted arrays, ready
    to stream documents. Names may be null."""

    def __init__(self, items: list[tuple[str | None, bytes]], limit: int = 10):
        self.limit = limit
        self.number: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        auto = Automaton()
        sequences = [[self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)] for _, t in items]
        for s in sequences:
            auto.add(s)
        #: A run of known words shorter than this holds no window.
        self.least = min([limit, *(len(s) for s in sequences if s)])
        pairs = {(a << 32) | b for s in sequences for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        # (state, word) and where it leads
        size = sum(map(len, auto.next))
        keys = np.fromiter(((s << 32) | c for s, after in enumerate(auto.next) for c in after), np.int64, size)
        to = np.fromiter((t for after in auto.next for t in after.values()), np.int32, size)
        order = np.argsort(keys)
        self.keys, self.to = array("q", keys[order].tobytes()), array("i", to[order].tobytes())
        self.link, self.length = array("i", auto.link), array("i", auto.length)
        del auto
        #: Items with a state's windows, as (state, item) in order; and short
        #: items by the state that is the whole of one: (length, item).
        marks: set[int] = set()
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(sequences):
            self._mark(k, s, marks)
        self.marks = array("q", sorted(marks))

    def _mark(self, item: int, words: list[int], marks: set[int]) -> None:
        state = length = 0
        for i, c in enumerate(words, 1):
            state, length = self.step(state, length, c)
            if i >= self.limit:
                marks.add((self.shortest(state, self.limit) << 32) | item)
        if 0 < len(words) < self.limit:
            self.whole.setdefault(self.shortest(state, len(words)), []).append((len(words), item))

    def shortest(self, state: int, least: int) -> int:
        """The state of the state's suffix of ``least`` words."""
        while self.length[self.link[state]] >= least:
            state = self.link[state]
        return state

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        keys = self.keys
        while True:
            key = (state << 32) | c
            i = bisect_left(keys, key)
            if i < len(keys) and keys[i] == key:
                return self.to[i], length + 1
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.length[state]

    def items_at(self, state: int) -> Iterator[int]:
        i = bisect_left(self.marks, state << 32)
        while i < len(self.marks) and self.marks[i] >> 32 == state:
            yield self.marks[i] & 0xFFFFFFFF
            i += 1

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of known words, neighbours in some item each with the
        next, that are long enough for a window."""
        if self.least < 2:
            linked = (ids[1:] > 0) & (ids[:-1] > 0)
        else:
            linked = np.zeros(len(ids) - 1, bool)
            at = np.nonzero((ids[1:] > 0) & (ids[:-1] > 0))[0]
            key = (ids[at] << 32) | ids[at + 1]
            i = np.searchsorted(self.pairs, key)
            linked[at] = (i < len(self.pairs)) & (self.pairs[np.minimum(i, len(self.pairs) - 1)] == key)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], linked.astype(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2] + 1
        if self.least < 2:
            alone = np.flatnonzero((ids > 0) & ~np.concatenate([[False], linked]) & ~np.concatenate([linked, [False]]))
            starts, ends = np.concatenate([starts, alone]), np.concatenate([ends, alone + 1])
        long = ends - starts >= self.least
        return sorted(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def match(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """Words of the text, hit spans of words [start, end), names of items
        found."""
        words = words_of(text)
        if len(words) < self.least or not self.number:
            return len(words), [], set()
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        limit = self.limit
        spans: list[list[int]] = []
        found: set[int] = set()
        seen: set[int] = set()

        def hit(start: int, end: int) -> None:
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        for start, end in self._runs(ids) if len(ids) > 1 else [(0, 1)] * int(ids[0] > 0):
            state = length = 0
            for i, c in enumerate(ids[start:end].tolist(), start + 1):
                state, length = self.step(state, length, c)
                if length >= limit:
                    hit(i - length, i)
                    s = self.shortest(state, limit)
                    if s not in seen:
                        seen.add(s)
                        found.update(self.items_at(s))
                if self.least < limit:
                    s = state
                    while s > 0:
                        for size, item in self.whole.get(s, ()):
                            if size <= length:
                                hit(i - size, i)
                                found.add(item)
                        s = self.link[s]
        return len(words), [(a, b) for a, b in spans], {self.names[k] for k in found}


def pieces(benchmark: DataFrame, limit: int) -> DataFrame:
    """(item, words, n): items cut into pieces that overlap so that each window
    is whole in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                w = words_of(t)
                size = max(PIECE_WORDS, 2 * limit)
                for s in range(0, max(len(w) - limit + 1, min(len(w), 1)), size - limit + 1):
                    rows.append((item, b" ".join(w[s : s + size]), len(w[s : s + size])))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["item", "words", "n"])

    return arrow_map(benchmark.select(F.col("item_id").cast("string"), "text"), run, "item string, words binary, n long")


def matchers(benchmark: DataFrame, limit: int, most: int) -> Iterator[Matcher]:
    """One matcher for each group of pieces; no group has more than ``most``
    words, but for a single piece that has."""
    cut = written(pieces(benchmark, limit), "benchmark-pieces")
    total, largest = cut.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total <= most:
        yield Matcher([(r.item, bytes(r.words)) for r in cut.select("item", "words").collect()], limit)
        return
    groups = -(-2 * total // most)
    group = F.pmod(F.xxhash64("item", "words"), F.lit(groups))
    while cut.groupBy(group.alias("g")).agg(F.sum("n").alias("n")).where(F.col("n") > max(most, largest)).take(1) and groups < total:
        groups *= 2
        group = F.pmod(F.xxhash64("item", "words"), F.lit(groups))
    for g in range(groups):
        rows = cut.where(group == g).select("item", "words").distinct().collect()
        if rows:
            yield Matcher([(r.item, bytes(r.words)) for r in rows], limit)


def one_or_more(benchmark: DataFrame, limit: int, most: int) -> tuple[Matcher | None, Iterator[Matcher]]:
    """The matcher, if there is one alone, or all, of which the driver should
    hold one at a time."""
    found = matchers(benchmark, limit, most)
    first, second = next(found), next(found, None)
    return (first, iter(())) if second is None else (None, chain((first, second), found))


def spans_text(spans: list[tuple[int, int]]) -> str:
    return ",".join(f"{s}:{e}" for s, e in spans)


def spans_of(texts: list[str]) -> list[tuple[int, int]]:
    """Spans of several passes, put together."""
    out: list[list[int]] = []
    for s, e in sorted(tuple(map(int, x.split(":"))) for t in texts for x in t.split(",") if x):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def hits(docs: DataFrame, found: Iterator[Matcher]) -> DataFrame:
    """(doc_id, h, passes): of each document (and hash of its text) that is
    hit, the spans and items of every pass."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    schema, every = "doc_id long, h long, spans string, items array<string>", None
    for m in found:
        held = docs.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            match = held.value.match
            for b in batches:
                out = []
                for doc, t, h in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                    _, spans, names = match(t)
                    if spans:
                        out.append((doc, h, spans_text(spans), sorted(i for i in names if i is not None)))
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)], ["doc_id", "h", "spans", "items"])

        one = written(arrow_map(rows, run, schema), "benchmark-hits")
        every = one if every is None else every.unionByName(one)
        held.unpersist()
    return every.groupBy("doc_id", "h").agg(F.collect_set(F.struct("spans", "items")).alias("passes"))


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
_RESULT = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())


def answer(doc: int | None, n: int, spans: list[tuple[int, int]], names: set[str | None]) -> tuple:
    known = sorted(i for i in names if i is not None)
    n_hit = sum(e - s for s, e in spans)
    return doc, n, n_hit, len(known), hashlib.sha256(",".join(known).encode()).hexdigest(), n_hit > 0, spans_text(spans)


def answers(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _RESULT, strict=True)], [c.split()[0] for c in RESULT.split(", ")])


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = 10, most: int = MAX_WORDS) -> DataFrame:
    """For each document its words, hit words and the items whose windows
    occur in it; ``spans`` has the hit spans as word positions."""
    only, found = one_or_more(benchmark, limit, most)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    if only:
        held = docs.sparkSession.sparkContext.broadcast(only)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = held.value.match
            for b in batches:
                yield answers([answer(doc, *match(t)) for doc, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True)])

        return arrow_map(rows.select("doc_id", "text"), run, RESULT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words_of(t)) for t in byte_texts(b.column(1))], pa.int64()), b.column(2)], ["doc_id", "n", "h"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, n, passes in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                out.append(answer(doc, n, spans_of([p["spans"] for p in passes or ()]), {i for p in passes or () for i in p["items"]}))
            yield answers(out)

    hit = hits(docs, found).select(F.struct("doc_id", "h").alias("at"), "passes")
    sizes = arrow_map(rows, count, "doc_id long, n long, h long")
    joined = sizes.join(hit, sizes["doc_id"].eqNullSafe(hit["at.doc_id"]) & (sizes["h"] == hit["at.h"]), "left")
    return arrow_map(joined.select("doc_id", "n", "passes"), together, RESULT)


def removed(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of a span."""
    folded, out, at, word, i = text.translate(FOLD), [], 0, 0, 0
    edges: list[tuple[int, int]] = []
    for w in folded.split():
        i = folded.index(w, i)
        edges.append((i, i + len(w)))
        i += len(w)
    for s, e in spans:
        out.append(text[at : edges[s][0]])
        at = edges[e - 1][1]
    return b"".join([*out, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, limit: int = 10, coverage: float = 0.5, most: int = MAX_WORDS) -> DataFrame:
    """``docs`` without hit spans; a document of which more than ``coverage``
    of the words are hit goes. Other columns stay; n_chars follows the text
    where the table has it."""
    (only, found), names = one_or_more(benchmark, limit, most), docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    held = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: Matcher | None = held.value
        for b in batches:
            keep, texts, sizes = [], b.column(at).to_pylist(), b.column(count).to_pylist() if count is not None else []
            passes = [] if one else b.column(len(names)).to_pylist()
            for i, t in enumerate(byte_texts(b.column(at))):
                if one:
                    n, spans, _ = one.match(t)
                else:
                    spans = spans_of([p["spans"] for p in passes[i] or ()])
                    n = len(words_of(t)) if spans else 0
                if spans:
                    texts[i] = removed(t, spans).decode("utf-8", "replace")
                    if count is not None:
                        sizes[i] = len(texts[i])
                keep.append(sum(e - s for s, e in spans) <= coverage * n)
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(texts, b.column(at).type)
            if count is not None:
                columns[count] = pa.array(sizes, b.column(count).type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    if only:
        return arrow_map(docs, run, docs.schema)
    own = free_name(names, "hits")
    hit = hits(docs, found).select(F.struct("doc_id", "h", "passes").alias(own))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)["doc_id"]) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own)["h"])
    return arrow_map(docs.join(hit, same, "left").select(*(F.col(f"`{c}`") for c in names), F.col(own)["passes"].alias(own)), run, docs.schema)
