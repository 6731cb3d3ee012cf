"""Document fingerprints by a randomised edit embedding (operator 6).

All texts share one random walk. It reads a character, and at each step stays
on it or moves to the next, as a random bit for that step and character says;
the characters read, step by step, are the embedding. Texts at a small edit
distance fall into step again after an edit, so they agree at most steps: edit
distance becomes Hamming distance.

Bit sampling picks ``SAMPLES`` steps. Each sample has its own random increasing
sequence of steps (its record times) and uses the last one before the text's
embedding ends, so texts of like length mostly sample the same steps; four
bits of a hash of the character read there are one hexadecimal digit of the
fingerprint. Equal texts have equal fingerprints. Likeness is the share of equal
digits, corrected for the one in sixteen that agree by chance.

The walk runs for many texts side by side in numpy, two characters at a time:
the random bits repeat with ``PERIOD`` steps and characters have ``CLASSES``
classes, so a table gives how far pairs of characters move the step. Whole
texts are walked; memory is one batch. A turn has a fixed cost, which a long
text that is alone in its batch bears by itself: about 6 microseconds a
character.

``near_earlier`` finds for each fingerprint an earlier one that is near. Each of
``BANDS`` bands samples ``BAND`` digits; fingerprints that agree on a band share a
bucket, and each is verified against the earliest of the bucket by its whole
fingerprint, so a bucket of any size gives one candidate a member and no pairs.
Members for which no bucket's earliest is near go on among themselves: their
buckets are dealt again by ``BAND`` more digits, ``AGAIN`` ways, up to ``LEVELS``
times. Two fingerprints at the threshold (0.8) share no band with a chance of
1.5 %, and one that is near only to members that have found another is missed;
the tests measure recall.

Defined cases: null counts as empty; the fingerprint of an empty text is all
zeros, as no step is read; the document after the last is the first, so a lone
document is followed by itself; equal ids are ordered by text; a null id sorts
first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, dealt_join, shuffle_partitions, written

SAMPLES = 128
#: Bands, digits of a band, ways to deal a bucket again, and how often.
BANDS = 20
BAND = 8
AGAIN = 24
LEVELS = 3
LEAST = 0.8
CLASSES = 32
PERIOD = 1024
SEED = 20_001
#: Longest embedding that record times are made for.
LONGEST = 1 << 40

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Walk:
    """The shared randomness."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mix = rng.integers(1, 1 << 62, 2, dtype=np.uint64) | np.uint64(1)
        moves = rng.random((CLASSES, PERIOD)) < 0.5
        # steps until the walk leaves a character it reads first at a step
        stay = np.zeros((CLASSES, 2 * PERIOD), np.int32)
        moves2 = np.concatenate([moves, moves], axis=1)
        for s in range(2 * PERIOD - 2, -1, -1):
            stay[:, s] = np.where(moves2[:, s], 1, stay[:, s + 1] + 1)
        self.stay = np.ascontiguousarray(stay[:, :PERIOD])
        one = self.stay  # [class, phase]
        after = (np.arange(PERIOD)[None, :] + one) % PERIOD
        # both steps of a pair: [first class, second class, phase]
        self.pair = np.ascontiguousarray(one[:, None, :] + np.stack([one[c][after] for c in range(CLASSES)], axis=1)).astype(np.int32)
        # record times of each sample, ever further apart
        records = []
        for _ in range(samples):
            at, mine = 0, [0]
            while at < LONGEST:
                at = max(at + 1, int(np.ceil((at + 1) / max(rng.random(), 1e-9))) - 1)
                mine.append(at)
            records.append(mine)
        width = max(map(len, records))
        self.records = np.array([r + [1 << 62] * (width - len(r)) for r in records])
        self.salt = rng.integers(1, 1 << 62, samples, dtype=np.uint64) | np.uint64(1)

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Class of each code point; letters of one alphabet keep apart."""
        return ((points.astype(np.uint64) * self.mix[0]) >> np.uint64(40)).astype(np.int64) % CLASSES

    def fingerprints(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, samples) digits from arrays of code points."""
        n = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.salt)), np.uint8)
        order = np.argsort(-n, kind="stable")
        alive = int((n > 0).sum())
        if not alive:
            return out
        order, n = order[:alive], n[order[:alive]]
        flat = np.concatenate([texts[i] for i in order])
        base = np.concatenate([[0], n.cumsum()[:-1]])
        cls = np.append(self.classes(flat), 0)
        pairs = n // 2
        # place[base2 + k] is the step before the k-th pair of a text
        base2 = np.concatenate([[0], (pairs + 1).cumsum()[:-1]])
        place = np.zeros(int((pairs + 1).sum()), np.int64)
        step = np.zeros(alive, np.int64)
        table = self.pair.reshape(-1)
        live = np.searchsorted(-pairs, -np.arange(1, int(pairs[0]) + 1), side="right") if pairs[0] else []
        for k, m in enumerate(live):
            at = base[:m] + 2 * k
            step[:m] += table[(cls[at] * CLASSES + cls[at + 1]) * PERIOD + (step[:m] & (PERIOD - 1))]
            place[base2[:m] + k + 1] = step[:m]
        odd = n % 2 == 1
        total = step + np.where(odd, self.stay[cls[base + n - 1], step & (PERIOD - 1)], 0)
        for i in range(alive):
            # the last record time of each sample before the embedding ends
            r = self.records
            want = np.take_along_axis(r, (r < total[i]).sum(axis=1)[:, None] - 1, 1)[:, 0]
            mine = place[base2[i] : base2[i] + pairs[i] + 1]
            k = np.searchsorted(mine, want, side="right") - 1
            at = base[i] + 2 * k
            first = self.stay[cls[at], mine[k] & (PERIOD - 1)]
            char = flat[at + ((want - mine[k]) >= first)].astype(np.uint64)
            out[order[i]] = ((char * self.mix[1] + np.uint64(1)) * self.salt) >> np.uint64(60)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal digits, corrected for chance."""
    return max(0.0, (float((a == b).mean()) - 1 / 16) / (15 / 16))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the next document's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def hex_of(digits: np.ndarray) -> str:
    return "".join(map("0123456789abcdef".__getitem__, digits.tolist()))


_WALKS: dict[int, Walk] = {}


def walk(samples: int = SAMPLES) -> Walk:
    if samples not in _WALKS:
        _WALKS[samples] = Walk(samples)
    return _WALKS[samples]


def digest_rows(ids: list, texts: list[str], followers: list[str], prints: np.ndarray, next_prints: np.ndarray) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, followers, strict=True)]
    other = walk().fingerprints([code_points(t) for t in changed])
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
        pa.array([hex_of(p) for p in prints]),
        pa.array([hex_of(p) for p in other]),
        pa.array([likeness(a, b) for a, b in zip(prints, other, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(prints, next_prints, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])


def with_next(docs: DataFrame) -> DataFrame:
    """Digest of every document against the one after it in order of id.
    Rows of the ranges are written.

    Documents are dealt by ranges of id and sorted there. All but the last of a
    range meet their next document in the same task. The last one waits: it and
    the first of each range are written out with their texts (two rows a range)
    and paired up afterwards."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId(), None, len(RESULT.split(", "))
        names = [c.split()[0] for c in RESULT.split(", ")] + ["part", "edge", "text"]

        def edge(kind: str, doc: int | None, text: str) -> pa.RecordBatch:
            row = [pa.array([doc], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
            return pa.RecordBatch.from_arrays([*row, pa.array([part], pa.int32()), pa.array([kind]), pa.array([text])], names)

        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            prints = walk().fingerprints([code_points(t) for t in texts])
            if held is None:
                yield edge("first", ids[0], texts[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], prints])
            if len(ids) > 1:
                rows = digest_rows(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                none = [pa.nulls(len(ids) - 1, t) for t in (pa.int32(), pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:n], *none], names)
            held = ids[-1], texts[-1], prints[-1]
        if held is not None:
            yield edge("last", held[0], held[1])

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    found = written(arrow_map(dealt, run, RESULT + ", part int, edge string, text string"), "edit-fingerprints")
    parts = sorted(r[0] for r in found.where("edge = 'first'").select("part").collect())  # one number a range
    rows = found.where("edge is null").drop("part", "edge", "text")
    if not parts:
        return rows
    before = spark.createDataFrame([(p, parts[i - 1]) for i, p in enumerate(parts)], "part int, waits int")
    edges = found.where("edge is not null").select("part", "edge", "doc_id", "text")
    waiting = edges.where("edge = 'last'").select(F.col("part").alias("waits"), "edge", "doc_id", "text")
    coming = edges.where("edge = 'first'").join(before, "part").select("waits", "edge", "doc_id", "text")

    def meet(group: pa.Table) -> pa.Table:
        r = {e: (d, t or "") for e, d, t in zip(*(group.column(c).to_pylist() for c in ("edge", "doc_id", "text")), strict=True)}
        (doc, text), (_, following) = r["last"], r["first"]
        prints = walk().fingerprints([code_points(text), code_points(following)])
        return pa.Table.from_batches([digest_rows([doc], [text], [following], prints[:1], prints[1:])])

    return rows.unionByName(waiting.unionByName(coming).groupBy("waits").applyInArrow(meet, RESULT))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = walk().fingerprints([code_points(t or "") for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([hex_of(p) for p in prints], pa.string())], ["doc_id", "fingerprint"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


def digits_of(prints: pa.Array) -> np.ndarray:
    """(rows, samples) characters of hexadecimal fingerprints."""
    return np.frombuffer("".join(prints.to_pylist()).encode(), np.uint8).reshape(len(prints), -1)


def bands(level: int, ways: int, band: int) -> np.ndarray:
    """The digits that each band of a level samples."""
    rng = np.random.default_rng(1000 + level)
    return np.stack([rng.permutation(SAMPLES)[:band] for _ in range(ways)])


def banded(rows: DataFrame, level: int, ways: int, band: int) -> DataFrame:
    """(key, doc, f) for each band of each row (key, doc, f, fingerprint)."""
    places = bands(level, ways, band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, old = digits_of(b.column(3)), b.column(0).to_numpy().view(np.uint64)
            for k, place in enumerate(places):
                key = old * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
                for i in place:
                    key = (key ^ d[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1), b.column(2)], ["key", "doc", "f"])

    return arrow_map(rows, run, "key long, doc long, f long")


def verified(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """(f, near): of pairs (f, doc, other), the smallest ``doc`` whose
    fingerprint ``other`` is near that of ``f``."""
    a = prints.select("f", F.col("fingerprint").alias("mine"))
    b = prints.select(F.col("f").alias("other"), F.col("fingerprint").alias("theirs"))
    rows = pairs.join(a, "f").join(b, "other").select("f", "doc", "mine", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                share = (digits_of(b.column(2)) == digits_of(b.column(3))).mean(axis=1)
                near = pa.array((share - 1 / 16) / (15 / 16) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["f", "doc"]).filter(near)

    return arrow_map(rows, run, "f long, doc long").groupBy("f").agg(F.min("doc").alias("near"))


def near_earlier(prints: DataFrame, least: float = LEAST, ways: int = BANDS, band: int = BAND) -> DataFrame:
    """(f, near): for distinct fingerprints (f, doc, fingerprint) the id of one
    of a smaller id whose likeness is at least ``least``, where one is found."""
    found: DataFrame | None = None
    todo = banded(prints.select(F.lit(0).cast("long").alias("key"), "doc", "f", "fingerprint"), 0, ways, band)
    for level in range(1, LEVELS + 1):
        sizes = written(todo.groupBy("key").agg(F.min(F.struct("doc", "f")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "edit-buckets")
        large = sizes.select("key", "first", "n", (F.col("n") > 2).alias("more"))
        rows = written(dealt_join(todo, large, "key", ["f"]).select("key", "doc", "f", "more", F.col("first.doc").alias("first"), F.col("first.f").alias("other")), "edit-candidates")
        near = written(verified(rows.where("first < doc").select("f", "other", F.col("first").alias("doc")).distinct(), prints, least), "edit-near")
        found = near if found is None else found.unionByName(near)
        if level == LEVELS:
            return found
        rest = rows.where("more and f <> other").join(found, "f", "left_anti").select("key", "doc", "f")
        rest = written(rest.join(prints.select("f", "fingerprint"), "f").select("key", "doc", "f", "fingerprint"), "edit-rest")
        if rest.isEmpty():
            return found
        todo = banded(rest, level, AGAIN, band)
    return found


def with_near(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """``rows`` (doc_id, fingerprint and more) with ``near_id``: a smaller id
    whose document is near by fingerprint, found by bands and verified; null
    where none is found. Of equal fingerprints the smallest id is near to the
    others, and to rows without an id."""
    prints = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n")).withColumn("f", F.xxhash64("fingerprint")), "edit-prints")
    near = near_earlier(prints.where(F.col("doc").isNotNull()).select("f", "doc", "fingerprint"), least)
    near = near.groupBy("f").agg(F.min("near").alias("near"))
    known = written(prints.join(near, "f", "left").select("fingerprint", "n", "doc", "near"), "edit-known")
    joined = dealt_join(rows, known, "fingerprint", ["doc_id"])
    copy = F.col("doc_id").isNull() | (F.col("doc_id") > F.col("doc"))
    return joined.select(*rows.columns, F.when(copy, F.col("doc")).otherwise(F.col("near")).alias("near_id"))


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, fingerprint, near_id) of every row of ``docs``."""
    return with_near(written(fingerprints(docs), "edit-fingerprints"), least)
