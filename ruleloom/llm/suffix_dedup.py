"""Removal of repeated byte strings with suffix arrays (operator 5).

A byte goes if a string of ``length`` bytes covers it that also starts earlier
(in a document of smaller id, or earlier in the same one).

1. Anchors. Every window of ``length`` bytes has a least hash over its ``SEED``-
   byte strings. Those positions are the anchors, about one in 31 bytes; equal
   windows have equal anchors at equal offsets, so nothing is missed.
2. Anchors are dealt and sorted by (hash, hash of context, document, position)
   and streamed. A context is all that windows around the anchor can reach.
   Where a context repeats, all but its first occurrence are repeated whole.
   This pre-aggregates copies: a group of any size goes on as one row.
3. Where one anchor has different contexts, their texts meet, split into
   blocks of windows by where these start before the anchor and grouped by the
   bytes that all windows of the block cover. Windows whose hash occurs once
   can't repeat, and are cut off first. What is left is sorted by
   ``suffix_array``: neighbours in that order with the same first ``length``
   bytes are one string, and all of its starts but the earliest repeat. Groups
   too large for a task are cut into narrower blocks and sorted again; the
   narrowest hold a single window, so that all of a group are equal.
4. Intervals are put together for each document.

``suffix_array`` is the linear construction by groups: suffixes are grouped by
their first byte, groups are taken in descending order, and each one splits
the groups of its members' previous smaller suffixes, which ends with suffixes
grouped by Lyndon prefix. A second pass follows previous-smaller pointers from
the smallest suffix on and emits every group in order. Nothing is renamed and
nothing recurses.

Anchors that very many places have (a line or a period that fills the corpus)
are looked for in a sample of documents. They are dealt by their contexts, not
by their hash alone, and cut into narrow blocks at once; and what repeats within
a batch is settled there. Which anchors the sample finds changes where rows go,
not what is found.

Defined cases: a null text counts as empty; a null id comes before all others;
rows with equal ids are ordered by a hash of their texts; rows with equal ids
and texts are one document, and each row gets its result; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, byte_texts, dealt_join, shuffle_partitions, written

LENGTH = 100
SEED = 32
#: Blocks that the windows around an anchor are split into, those of common
#: anchors and of groups that are too large for a task, and the most contexts
#: of one core that a task holds.
BLOCKS = 2
NARROW = 12
GROUP = 8_000
#: Documents of the sample that common anchors are looked for in.
SAMPLE = 4_000
#: Bytes of text whose anchors are found at once.
PIECE = 1 << 20
#: Blocks that a task holds at once to put equal ones together (about 550 bytes
#: each).
HELD = 200_000

_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


# Suffix arrays


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Each suffix's group, its previous smaller suffix (-1: none) and the
    groups in ascending order. ``text`` ends in its only smallest symbol."""
    n = len(text)
    symbols = sorted(set(text))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))  # the next lower group
    above = [*range(1, len(symbols)), -1]
    done = [False] * len(symbols)
    previous = [-1] * n
    g = len(symbols) - 1
    while g >= 0:
        done[g] = True
        runs: list[list[int]] = []  # [previous smaller suffix, members that have it]
        for s in members[g]:
            if group[s] != g:
                continue
            p = s - 1
            while p >= 0 and done[group[p]]:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                if runs and runs[-1][0] == p:
                    runs[-1][1] += 1
                else:
                    runs.append([p, 1])
        if runs:
            counts = sorted({k for _, k in runs}, reverse=True)
            for k in counts:
                split: dict[int, int] = {}
                for p, many in runs:
                    if many != k:
                        continue
                    old = group[p]
                    new = split.get(old)
                    if new is None:
                        new = split[old] = len(members)
                        members.append([])
                        done.append(False)
                        below.append(old)
                        above.append(above[old])
                        if above[old] >= 0:
                            below[above[old]] = new
                        above[old] = new
                    group[p] = new
                    members[new].append(p)
        g = below[g]
    order, g = [], 0
    while g >= 0:
        order.append(g)
        g = above[g]
    return group, previous, order


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in order. ``text`` ends in its only smallest symbol."""
    n = len(text)
    group, previous, order = lyndon_groups(text)
    sizes = [0] * (max(order) + 1)
    for g in group:
        sizes[g] += 1
    start, at = [0] * len(sizes), 0
    for g in order:
        start[g] = at
        at += sizes[g]
    out, placed = [-1] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[start[g]] = s
            start[g] += 1
            placed[s] = True
            s = previous[s]
    return out


def common_start(strings: list[bytes]) -> int:
    """Bytes that all strings begin with."""
    low, high = min(strings), max(strings)
    n = min(len(low), len(high))
    if low[:n] == high[:n]:
        return n
    good, bad = 0, n
    while bad - good > 1:
        half = (good + bad) // 2
        if low[:half] == high[:half]:
            good = half
        else:
            bad = half
    return good


def equal_windows(parts: list[tuple[bytes, int]], length: int = LENGTH, seed: int = SEED) -> list[list[tuple[int, int]]]:
    """Sets of (part, offset) that begin the same ``length`` bytes, from one
    suffix array. A part is bytes and the place of the anchor, which all of
    its windows cover.

    What follows the anchor in all parts alike is one symbol, as it tells no
    suffix from another; where parts are more alike before the anchor they are
    read backwards. Equal windows stay neighbours in either reading."""
    back = common_start([t[:a][::-1] for t, a in parts]) > common_start([t[a + seed :] for t, a in parts])
    if back:
        parts = [(t[::-1], len(t) - a - seed) for t, a in parts]
    alike = seed + common_start([t[a + seed :] for t, a in parts])
    symbols: list[int] = []
    place: list[tuple[int, int] | None] = []
    for k, (t, a) in enumerate(parts):
        symbols += [b + 3 for b in t[:a]]
        symbols.append(2)
        symbols += [b + 3 for b in t[a + alike :]]
        symbols.append(1)
        starts = min(a, len(t) - length) + 1
        place += [(k, o) for o in range(starts)]
        place += [None] * (len(symbols) - len(place))
    symbols.append(0)
    place.append(None)
    out: list[list[tuple[int, int]]] = []
    last: bytes | None = None
    for i in suffix_array(symbols):
        at = place[i]
        if at is None:
            continue
        window = parts[at[0]][0][at[1] : at[1] + length]
        if back:
            at = at[0], len(parts[at[0]][0]) - at[1] - length
        if window == last:
            out[-1].append(at)
        else:
            out.append([at])
            last = window
    return [x for x in out if len(x) > 1]


# Anchors


def _slide(x: np.ndarray, size: int, op: np.ufunc, back: bool) -> np.ndarray:
    """op over [i, i + size) of x, or over (i - size, i] if ``back``."""
    have, step = 1, 1
    x = x.copy()
    while have < size:
        step = min(have, size - have)
        y = x.copy()
        if back:
            op(x[step:], x[:-step], out=y[step:])
        else:
            op(x[:-step], x[step:], out=y[:-step])
        x, have = y, have + step
    return x


def _find(pieces: list[bytes], length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the joined pieces, and hashes, of the anchors of the
    windows that lie within one piece."""
    joined = b"".join(pieces)
    n = len(joined)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _BYTE[np.frombuffer(joined, np.uint8)]
    have, power = 1, _BASE
    while have < seed:  # seed is a power of two
        h[: n - have] = h[: n - have] * np.uint64(power) + h[have:]
        power, have = power * power % (1 << 64), have * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    least = _slide(h, length - seed + 1, np.minimum, False)
    inside = np.zeros(n, bool)
    at = 0
    for p in pieces:
        if len(p) >= length:
            inside[at : at + len(p) - length + 1] = True
        at += len(p)
    least[~inside] = 0
    found = np.flatnonzero(_slide(least, length - seed + 1, np.maximum, True) == h)
    return found, h[found]


def anchors(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of every anchor. Long texts are taken in pieces
    that overlap so that every window lies within one."""
    out: list[np.ndarray] = []
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        at, h = _find([p for _, _, p in pieces], length, seed)
        begin = np.cumsum([0] + [len(p) for _, _, p in pieces])
        k = np.searchsorted(begin, at, side="right") - 1
        text, first = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
        if len(at):
            out.append(np.stack([text[k], at - begin[k] + first[k], h.view(np.int64)]))
        pieces.clear()
        size = 0

    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), PIECE):
            pieces.append((i, s, t[s : s + PIECE + length - 1]))
            size += len(pieces[-1][2])
            if size >= PIECE:
                flush()
    flush()
    if not out:
        return tuple(np.zeros((3, 0), np.int64))  # type: ignore[return-value]
    both = np.unique(np.concatenate(out, axis=1), axis=1)
    return both[0], both[1], both[2]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, th, text): the order of documents is that of (doc, th)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("th"), text.alias("text"))


def unions(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document, put together where they meet."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    # intervals of a document lie beyond those of the one before it
    shift = doc * (int(stop.max()) + 1 if len(stop) else 1)
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1 if len(at) else at
    return doc[at], start[at], (reach - shift)[last]


def common_anchors(docs: DataFrame, length: int, seed: int) -> np.ndarray:
    """Hashes of anchors that have more than a quarter of a task's share of the
    rows, in a sample of documents: fewer than four times the partitions."""
    every = max(1, math.ceil(docs.count() / SAMPLE))
    some = anchor_rows(docs.where(F.pmod(F.xxhash64("doc", "th"), F.lit(every)) == 0), length, seed, np.zeros(0, np.int64)).where("not again")
    counts = written(some.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "suffix-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(16, total / (4 * shuffle_partitions(docs.sparkSession)))
    return np.array(sorted(r[0] for r in counts.where(F.col("n") > least).select("h").collect()), np.int64)


def anchor_rows(docs: DataFrame, length: int, seed: int, common: np.ndarray) -> DataFrame:
    """Anchors with their contexts' hashes, and a number to deal them by: the
    anchor's hash, with the context's for ``common`` ones. Where a context repeats within a
    batch, all but its first occurrence are settled here: they go on as merged
    intervals (``again``, with a hash of their own to deal them by), so a line
    or a period that fills the corpus isn't one hot key. Repeated rows are one
    document: an anchor at the same place of one is itself, no repeat."""
    reach = length - seed
    names = [c.split()[0] for c in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            texts = byte_texts(b.column(2))
            t, pos, h = anchors(texts, length, seed)
            sides = list(zip(t.tolist(), pos.tolist(), strict=True))
            c = np.fromiter((digest(texts[i][max(0, p - reach) : p + length], min(p, reach)) for i, p in sides), np.uint64, len(sides)).view(np.int64)
            stop = np.minimum(pos + length, np.array([len(x) for x in texts], np.int64)[t] if len(t) else pos)
            doc, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((t, pos, th[t], doc[t], c, h))
            one, two = order[:-1], order[1:]
            again, same = np.zeros(len(t), bool), np.zeros(len(t), bool)
            again[two] = (h[two] == h[one]) & (c[two] == c[one])
            same[two] = again[two] & (doc[t[two]] == doc[t[one]]) & (th[t[two]] == th[t[one]]) & (pos[two] == pos[one])
            again, first = again & ~same, ~again
            at, start, end = unions(t[again], np.maximum(pos - reach, 0)[again], stop[again])
            deal = (at.astype(np.uint64) * np.uint64(_BASE) + start.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
            own = np.where(np.isin(h, common), (h.view(np.uint64) ^ c.view(np.uint64) * np.uint64(_BASE)).view(np.int64), h)
            columns = [np.concatenate(x) for x in ((own[first], deal), (h[first], deal), (c[first], np.zeros_like(deal)), (doc[t[first]], doc[at]), (th[t[first]], th[at]), (pos[first], start), (stop[first], end), (np.zeros(int(first.sum()), bool), np.ones(len(at), bool)))]
            columns[5:7] = [x.astype(np.int32) for x in columns[5:7]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return arrow_map(docs, run, ANCHORS)


ANCHORS = "deal long, h long, c long, doc long, th int, pos int, stop int, again boolean"
FOUND = "kind int, h long, doc long, th int, start int, stop int"


def sift(rows: DataFrame, reach: int, common: np.ndarray) -> DataFrame:
    """Of sorted anchors: intervals that repeat whole (kind 0), and the first
    of each context where an anchor has several or is ``common`` (kind 1), as
    contexts of common anchors are in many places. An anchor that
    repeated rows give again is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, ...] | None = None
        waits: list[np.ndarray] | None = None  # the first context of the anchor at hand

        def out(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
            h, doc, th, start, stop = columns
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(doc), pa.array(th), pa.array(start.astype(np.int32)), pa.array(stop)], ["kind", "h", "doc", "th", "start", "stop"])

        for b in batches:
            if not b.num_rows:
                continue
            settled = b.column(7).to_numpy(zero_copy_only=False)
            h, c, doc, th, pos, stop = (b.column(i).to_numpy() for i in range(1, 7))
            if settled.any():
                yield out(0, [x[settled] for x in (h, doc, th, pos, stop)])
                h, c, doc, th, pos, stop = (x[~settled] for x in (h, c, doc, th, pos, stop))
                if not len(h):
                    continue
            place = (h, c, doc, th, pos)
            other = np.zeros(len(h), bool)
            other[0] = last != tuple(int(x[0]) for x in place)
            for x in place:
                other[1:] |= x[1:] != x[:-1]
            if not other.any():
                continue
            h, c, doc, th, pos, stop = (x[other] for x in (*place, stop))
            new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
            if last is not None and last[0] == h[0]:
                new_h[0], new_c[0] = False, last[1] != c[0]
            last = tuple(int(x[-1]) for x in (h, c, doc, th, pos))
            again = ~new_c
            if again.any():
                yield out(0, [x[again] for x in (h, doc, th, np.maximum(pos - reach, 0), stop)])
            at = np.flatnonzero(new_c)
            if not len(at):
                continue
            first = new_h[at]
            if not first[0] and waits is not None:
                yield out(1, waits)
                waits = None
            follows = np.append(first[1:], True)  # is the next context another anchor's
            many = np.isin(h[at], common)
            keep = at[~(first & follows) | many]
            if len(keep):
                yield out(1, [x[keep] for x in (h, doc, th, pos, stop)])
            if first[-1] and not many[-1]:
                waits = [x[at[-1:]] for x in (h, doc, th, pos, stop)]
            else:
                waits = None

    return arrow_map(rows, run, FOUND)


def cores(a: int, t: bytes, length: int, seed: int, blocks: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The windows of a context, split by where they start before the anchor:
    (block, first start, last start, the bytes that all windows of the block
    cover). Equal windows are in equal blocks and have equal cores."""
    reach = length - seed
    wide = (reach + 1 + blocks - 1) // blocks
    for j in range(-(-(reach + 1) // wide)):
        begin = a - reach + j * wide
        end = min(begin + wide - 1, a)
        low, high = max(begin, 0), min(end, len(t) - length)
        if low <= high:
            yield j, low, high, t[end : begin + length]


def same_core(group: list[tuple[int, int, int, int, bytes]], length: int, seed: int) -> list[tuple[int, int, int, int]]:
    """Intervals (doc, th, start, stop) that repeat among contexts (doc, th,
    start, anchor's place, bytes) of one anchor and core."""
    out: list[tuple[int, int, int, int]] = []
    whole: dict[tuple[bytes, int], tuple[int, int, int]] = {}
    for doc, th, start, a, t in group:
        where = (doc, th, start)
        other = whole.setdefault((t, a), where)
        if other != where:  # all of it repeats: one of the two is later
            late, whole[t, a] = max(other, where), min(other, where)
            out.append((*late, late[2] + len(t)))
    if len(whole) < 2:
        return out
    digest = xxhash.xxh64_intdigest
    hashes = [[digest(t[o : o + length]) for o in range(len(t) - length + 1)] for t, _ in whole]
    seen: dict[int, int] = {}
    for k, row in enumerate(hashes):
        for x in row:
            seen[x] = -1 if seen.get(x, k) != k else k

    def shared() -> Iterator[tuple[tuple[int, int, int], int, bytes]]:
        for ((t, a), (doc, th, start)), row in zip(whole.items(), hashes, strict=True):
            o = 0
            while o < len(row):
                e = o
                while e < len(row) and seen[row[e]] == -1:
                    e += 1
                if e > o:
                    yield (doc, th, start + o), a - o, t[o : e - 1 + length]
                o = e + 1

    parts = list(shared())
    if len(parts) > 1:
        for same in equal_windows([(t, a) for _, a, t in parts], length, seed):
            # contexts in one document may overlap, so a start can be there twice
            starts = sorted({(parts[k][0][0], parts[k][0][1], parts[k][0][2] + o) for k, o in same})
            out += [(d, t, s, s + length) for d, t, s in starts[1:]]
    return out


def merged(intervals: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for d, t, s, e in sorted(set(intervals)):
        if out and out[-1][:2] == (d, t) and s <= out[-1][3]:
            out[-1] = (d, t, out[-1][2], max(e, out[-1][3]))
        else:
            out.append((d, t, s, e))
    return out


CONTEXT = "k long, doc long, th int, start int, at int, context binary"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [c.split()[0] for c in CONTEXT.split(", ")])


def solved(contexts: DataFrame, length: int, seed: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Intervals that repeat within the groups of ``k``, with those that are
    settled already (of no context), and the contexts of groups of more than
    ``GROUP`` rows, which aren't held in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        at, large = None, False

        def close() -> None:
            if len(held) > 1 and not large:
                out.extend((None, d, t, s, e, None) for d, t, s, e in merged(same_core([r[1:] for r in held], length, seed)))
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[5] is None:
                    out.append((None, *row[1:]))
                else:
                    if row[0] != at:
                        close()
                        at, large = row[0], False
                    held.append(row)
                    if large or len(held) > GROUP:
                        large = True
                        out.extend(held)
                        held.clear()
                if len(out) > 5000:
                    yield _context_batch(out)
                    out.clear()
        close()
        yield _context_batch(out)

    dealt = contexts.repartition(shuffle_partitions(contexts.sparkSession), "k").sortWithinPartitions("k", "doc", "th", "start")
    found = written(arrow_map(dealt, run, CONTEXT), name)
    return found.where("context is null").select("doc", "th", "start", F.col("at").alias("stop")), found.where("context is not null")


def blocks_of(rows: Iterable[tuple[int, int, int, int, bytes, int]], length: int, seed: int, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """``CONTEXT`` for the blocks of contexts (doc, th, start, place of the
    anchor, bytes, number of blocks), in batches of about ``most`` rows. Where a
    block repeats within a batch, the later one is settled: a row without a
    context, its end in place of the anchor's, and a number of its own to deal
    it by. What repeats in different batches meets later, with its group."""
    out: list[tuple] = []
    first: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
    digest = xxhash.xxh64_intdigest
    for doc, th, start, a, t, blocks in rows:
        for j, low, high, core in cores(a, t, length, seed, blocks):
            key = (digest(core, 1000 * blocks + j) - (1 << 63), a - low, t[low : high + length])
            where = (doc, th, start + low)
            other = first.setdefault(key, where)
            if other != where:
                first[key], late = min(other, where), max(other, where)
                out.append((digest(b"%d %d" % (late[0], late[2])) - (1 << 63), *late, late[2] + len(key[2]), None))
        if len(out) + len(first) >= most:
            yield _context_batch(out + [(k, *where, at, t) for (k, at, t), where in first.items()])
            out, first = [], {}
    yield _context_batch(out + [(k, *where, at, t) for (k, at, t), where in first.items()])


def windows_apart(contexts: DataFrame, length: int, name: str) -> DataFrame:
    """Intervals that repeat among contexts whose groups are too large even in
    narrow blocks: each window is a group of equal strings, of which partial
    aggregates keep the earliest."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for _, doc, th, start, _, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(xxhash.xxh3_128_digest(t[o : o + length]), doc, th, start + o) for o in range(len(t) - length + 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["w", "doc", "th", "start"])

    each = arrow_map(contexts, windows, "w binary, doc long, th int, start int")
    earliest = each.groupBy("w").agg(F.min(F.struct("doc", "th", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    earliest = written(earliest, f"{name}-windows")
    late = dealt_join(each, earliest, "w", ["doc", "th", "start"]).where(F.struct("doc", "th", "start") > F.col("first"))
    return late.select("doc", "th", "start", (F.col("start") + length).alias("stop"))


def meet(docs: DataFrame, firsts: DataFrame, length: int, seed: int, common: np.ndarray) -> DataFrame:
    """Intervals that repeat between different contexts of one anchor.

    Contexts are split into blocks of windows and grouped by core: two blocks,
    or narrow ones for ``common`` anchors and for what is in too large groups
    then."""
    reach = length - seed
    many = frozenset(common.tolist())
    wanted = firsts.groupBy(F.col("doc").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("h", "start")).alias("at"))
    with_text = docs.join(wanted, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("t"))).select("doc", "th", "text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def contexts(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes, int]]:
            at = b.column(3)
            ends = at.value_lengths().to_numpy().cumsum()
            h, start = (at.flatten().field(i).to_numpy() for i in (0, 1))
            for doc, th, t, n, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), at.value_lengths().to_pylist(), ends.tolist(), strict=True):
                for i in range(end - n, end):
                    x = int(start[i])
                    s = max(0, x - reach)
                    yield doc, th, s, x - s, t[s : x + length], NARROW if int(h[i]) in many else BLOCKS

        for b in batches:
            yield from blocks_of(contexts(b), length, seed)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield from blocks_of(((doc, th, start, a, t, NARROW) for _, doc, th, start, a, t in rows), length, seed)

    out, large = solved(arrow_map(with_text, cut, CONTEXT), length, seed, "suffix-cores")
    if large.isEmpty():
        return out
    more, large = solved(arrow_map(large, again, CONTEXT), length, seed, "suffix-narrow")
    out = out.unionByName(more)
    return out if large.isEmpty() else out.unionByName(windows_apart(large, length, "suffix"))


def repeated(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc, th, spans): the merged intervals that go, of each document that
    has any."""
    keys = keyed(docs)
    common = common_anchors(keys, length, seed)
    rows = anchor_rows(keys, length, seed, common).repartition(shuffle_partitions(docs.sparkSession), "deal").sortWithinPartitions("h", "c", "doc", "th", "pos")
    found = written(sift(rows, length - seed, common), "suffix-sifted")
    between = written(meet(keys, found.where("kind = 1"), length, seed, common), "suffix-between")
    every = found.where("kind = 0").select("doc", "th", "start", "stop").unionByName(between)
    return every.groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row."""
    spans = repeated(docs, length, seed).select(F.col("doc").alias("d"), F.col("th").alias("t"), "spans")
    joined = keyed(docs).join(spans, (F.col("doc") == F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, t, spans in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                kept, at, n = [], 0, 0
                for x in spans or ():
                    if x["start"] > at or not n:
                        kept.append(t[at : x["start"]])
                        n += 1
                    at = max(at, x["stop"])
                kept.append(t[at:])
                left = b"".join(kept)
                rows.append((None if doc == -(1 << 63) else doc, len(t), len(t) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return arrow_map(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
