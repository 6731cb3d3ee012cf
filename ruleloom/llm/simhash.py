"""SimHash near-duplicates by a vantage-point tree (operator 9).

A document's fingerprint has a bit set where over half of the XXH64 values
(seed 42) of its word shingles have it set. Documents link when fingerprints
differ in at most ``radius`` bits; the result is connected components.

How it runs:

* ``fingerprints`` maps Arrow batches; one text at a time is in memory.
* Equal fingerprints become one row (fingerprint, smallest id, count) before
  anything else, so a group of copies of any size costs one row. Near copies
  share a bounded ball of fingerprints, so they cost at most that many.
* ``build_tree`` fits a vantage-point tree on a bounded sample (``PER_SHARD``
  fingerprints for a shard, at most ``SAMPLE``). Every fingerprint is then
  routed through it: a node sends a point within its radius to the inner side
  and one outside to the outer side. By the triangle inequality two points
  within ``radius`` have distances to the vantage point that differ by at most
  ``radius``, so a point whose distance exceeds the node's by at most
  ``radius`` also queries the inner side. Each close pair therefore meets in
  some shard: the join is exact. Shards grow in number with the fingerprints;
  the tree is cut where the sample is largest and ends at the number asked for,
  so that a fingerprint is copied no more often than that number needs.
* Each shard goes on splitting by vantage points until leaves are small, then
  compares in blocks, and gives each local component as a binary tree: a
  fingerprint has at most three links in a shard, so there are no hubs.
* Components over these links come from minimum labels with pointer jumping;
  each round is written to the shared folder. Where many rows have one label,
  fingerprint or component, the joins deal them over several tasks.

Fingerprints are what links; ids are looked up at the end. Defined cases: null
or empty texts (and texts of white space only) have the fingerprint zero and
link like any other; an empty table gives an empty table; rows with equal ids
share one component; a row with a null id links like any other, and its id
counts as smallest only where all ids of a component are null.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, byte_texts, dealt_join, shuffle_partitions, written

#: Fingerprints of the sample that the driver's tree is fitted on: for each
#: shard, and at most.
PER_SHARD = 64
SAMPLE = 1 << 20
#: Fingerprints of a shard: more shards than this small aren't made for the
#: sake of parallel tasks, and fewer than this large aren't made at all.
SMALL_SHARD = 4096
LARGE_SHARD = 1 << 16
#: Fingerprints that a leaf compares directly, and rows of one block.
LEAF = 384
BLOCK = 1024
#: Fingerprints that go down the tree at once: a visit of a node costs about
#: the same for one as for many.
ROUTED = 1 << 16

_SPREAD = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint of an array of 64-bit hashes.

    Byte lanes of shifted hashes are added 255 at a time, so eight sums count
    all 64 bits.
    """
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros((8, 8), np.int64)
    for i in range(0, n, 255 * 256):
        part = hashes[i : i + 255 * 256]
        lanes = (part[None, :] >> _SHIFTS) & _SPREAD
        for j in range(0, len(part), 255):
            counts += lanes[:, j : j + 255].sum(axis=1).view(np.uint8).reshape(8, 8)
    bits = counts.T.reshape(64) * 2 > n  # bit 8 * lane + shift
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text (UTF-8 bytes), ASCII letters lower-cased."""
    w = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return digest(b" ".join(w), seed)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return majority_bits(np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(w) - words + 1))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in byte_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(id_col, text_col), run, "doc_id long, fp long")


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def cut(d: np.ndarray, radius: int) -> int:
    """The distance for a node to cut at: the larger side, counting the
    inner side's overlap, is as small as can be."""
    at_most = np.bincount(d, minlength=65 + radius).cumsum()
    inner, outer = at_most[radius : 65 + radius], at_most[-1] - at_most[:65]
    return int(np.argmin(np.maximum(inner[:65], outer)))


def build_tree(sample: np.ndarray, shards: int, radius: int, seed: int = 7) -> list:
    """Nested [vantage point, cut, inner, outer]; a leaf is []. The leaf with
    most of the sample is cut next, until there are ``shards`` leaves or none
    left that a cut makes smaller."""
    rng = np.random.default_rng(seed)
    root: list = []
    largest = [(-len(sample), 0, root, np.asarray(sample, np.uint64))]
    leaves, made = 1, 0
    while largest and leaves < shards:
        size, _, leaf, points = heapq.heappop(largest)
        if -size < 16:
            break
        at = points[rng.integers(len(points))]
        d = distances(points, at)
        c = cut(d, radius)
        sides = points[d <= c + radius], points[d > c]
        if max(map(len, sides)) > 0.95 * len(points):
            continue
        leaf += [int(at), c, [], []]
        leaves += 1
        for child, side in zip(leaf[2:], sides, strict=True):
            made += 1
            heapq.heappush(largest, (-len(side), made, child, side))
    return root


def route(tree: list, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions of points) for every shard that gets points."""
    shard = 0
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if not node:
            if len(at):
                yield shard, at
            shard += 1
            continue
        d = distances(points[at], np.uint64(node[0]))
        stack += [(node[3], at[d > node[1]]), (node[2], at[d <= node[1] + radius])]


def components(points: np.ndarray, radius: int, seed: int = 11) -> np.ndarray:
    """For each of the distinct points, the lowest position of its component
    over links of at most ``radius`` bits. Exact; memory is one block."""
    rng = np.random.default_rng(seed)
    label = np.arange(len(points))

    def find(a: np.ndarray) -> np.ndarray:
        while True:
            up = label[a]
            if (up == a).all():
                return a
            label[a] = label[up]
            a = label[a]

    def merge(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = find(i), find(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))

    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        p = points[at]
        if len(at) > LEAF:
            best = None
            for _ in range(3):
                v = p[rng.integers(len(p))]
                d = distances(p, v)
                c = cut(d, radius)
                worst = max(int((d <= c + radius).sum()), int((d > c).sum()))
                if best is None or worst < best[0]:
                    best = (worst, d, c)
            worst, d, c = best
            if worst <= 0.85 * len(p):
                stack += [at[d > c], at[d <= c + radius]]
                continue
        for s in range(0, len(p), BLOCK):
            for t in range(s, len(p), BLOCK):
                i, j = np.nonzero(np.bitwise_count(p[s : s + BLOCK, None] ^ p[None, t : t + BLOCK]) <= radius)
                merge(at[i + s], at[j + t])
    return find(np.arange(len(points)))


def shard_count(n: int, partitions: int) -> int:
    """Shards that ``n`` fingerprints should make; their sizes are before
    overlap."""
    return max(1, math.ceil(n / LARGE_SHARD), min(math.ceil(n / SMALL_SHARD), 4 * partitions))


def near_links(reps: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between fingerprints that have the same components as all
    links between the distinct fingerprints ``fp`` of ``reps``. At most one row
    for each fingerprint and shard it visits."""
    n = reps.count()
    shards = shard_count(n, shuffle_partitions(reps.sparkSession))
    tree: list = []
    if shards > 1:
        every = max(1, math.ceil(n / min(SAMPLE, PER_SHARD * shards)))
        sample = reps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").toArrow().column("fp").to_numpy()
        tree = build_tree(np.sort(sample).view(np.uint64), shards, radius)

    def dealt(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = list(route(tree, fp.view(np.uint64), radius))
        if found:
            shard = np.repeat(np.array([k for k, _ in found], np.int32), [len(at) for _, at in found])
            fp = fp[np.concatenate([at for _, at in found])]
            for i in range(0, len(fp), ROUTED):
                yield pa.RecordBatch.from_arrays([pa.array(shard[i : i + ROUTED]), pa.array(fp[i : i + ROUTED])], ["shard", "fp"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy())
            n += len(held[-1])
            if n >= ROUTED:
                yield from dealt(np.concatenate(held))
                held, n = [], 0
        if held:
            yield from dealt(np.concatenate(held))

    def linked(group: pa.Table) -> pa.Table:
        fp = np.sort(group.column("fp").to_numpy())
        root = components(fp.view(np.uint64), radius)
        order = np.argsort(root, kind="stable")
        new = np.append(True, root[order][1:] != root[order][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
        child = np.flatnonzero(~new)
        parent = first[child] + (child - first[child] - 1) // 2
        return pa.table({"a": pa.array(fp[order[child]]), "b": pa.array(fp[order[parent]])})

    return arrow_map(reps.select("fp"), deal, "shard int, fp long").groupBy("shard").applyInArrow(linked, "a long, b long")


def component_labels(links: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label): the smallest node reachable, for each node of ``links``
    (a, b), where no node should have very many links. Minimum labels spread
    over links, then labels jump to the labels of their labels; ends when a
    round changes nothing."""
    links = links.where("a <> b").distinct()
    both = written(links.union(links.select("b", "a")).toDF("u", "v"), f"{name}-links")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).toDF("node", "label"), f"{name}-0")
    total, turn = labels.count(), 0
    while True:
        turn += 1
        heard = both.join(labels.toDF("v", "heard"), "v").groupBy("u").agg(F.min("heard").alias("heard"))
        met = labels.join(heard, labels["node"] == heard["u"]).select("node", F.least("label", "heard").alias("now"), F.col("label").alias("was"))
        met = written(met, f"{name}-met-{turn}")
        sizes = met.groupBy("now").agg(F.count(F.lit(1)).alias("n"))
        moved = met.where("now < node").select(F.col("node").alias("now"), F.col("now").alias("next"))  # labels that have another label
        jumped = dealt_join(met, sizes.join(moved, "now"), "now", ["node"], total, "left")
        new = written(jumped.select("node", F.least("now", F.coalesce("next", "now")).alias("label"), "was"), f"{name}-{turn}")
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def linked(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``fps`` (doc_id, fp)."""
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-reps")
    labels = component_labels(near_links(reps, radius), "simhash")
    members = written(reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "rep", F.col("n").alias("rows"), F.coalesce("label", "fp").alias("label")), "simhash-members")
    ids = members.groupBy("label").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = written(dealt_join(members, ids, "label", ["fp"], members.count()).select("fp", F.col("rows").alias("n"), "component_id"), "simhash-named")
    return dealt_join(fps, named, "fp", ["doc_id"])


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of ``docs``."""
    fps = written(fingerprints(docs, words, seed, id_col, text_col), "simhash-fps")
    return linked(fps, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; of
    rows with that same id all stay. Rows with a null id stay."""
    found = near_duplicates(docs.select("doc_id", "text"), radius, words, seed).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
