"""Hard negatives by a two-dimensional block matrix product (operator 13).

Scores of all anchors against all rows are a matrix product, done the SUMMA way:
both factors are cut into blocks of rows; a grid of cells gets the anchor blocks
of its line and the row blocks of its column; a cell adds up the products of
panels of dimensions where they are, so that a tile of whole-number scores is
neither stored nor sent. A cell reduces its tiles at once, in two passes:

1. the leading rows of the anchor's own label, in each cell and then overall,
   are its positives; only rows of that label are multiplied;
2. each (anchor, positive) has a window of scores, and the leading rows of other
   labels in it, in each cell and then overall, are its negatives.

Components are quantised: floor(scale * x). A product is exact, as it is made in
the narrowest kind of number that holds its largest sum; beyond doubles, panels
of 32 dimensions with components of at most 24 bits are added up in int64.

How it runs: blocks are a few thousand rows of bytes, so Spark moves blocks, and
what leaves a cell are leading rows. What is dealt grows with the root of the
number of cells, not with the scores. No key is hot: cells and blocks have
bounded sizes whatever the labels. The blocks that a grid repeats are never
broadcast, as their size before they are repeated says nothing of it after. The
work is anchors times rows, as every row is looked at for every anchor.

Defined cases: rows with a null label or vector, or a null or non-finite
component, take no part, nor do rows without an id, as no pair could name them;
vectors that are shorter than others count as ending in zeros; a component beyond
``LIMIT`` after quantising counts as ``LIMIT``; rows with equal ids are different
rows (an anchor is no positive of its own row alone); equal scores go by the
smaller id; without anchors, positives or a row in the window there are no rows;
other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, shuffle_partitions, written

SCALE = 256
#: Largest size of a quantised component: products of 32 sum up exactly in a double.
LIMIT = 1 << 24
EXACT = 32
#: Rows of a block, and anchors of one.
ROWS = 2048
ANCHORS = 256
#: Anchor blocks whose leading rows a task holds before it passes them on.
HELD = 256

BLOCKS = "block long, n int, dim int, ids binary, labels binary, at_block binary, at_row binary, vectors binary"


def longs(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.int64).tobytes()


def stored(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as all of them need."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in (np.int16, np.int32, np.int64) if low >= np.iinfo(k).min and high <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def restored(data: bytes, n: int, m: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // max(1, n * m) or 2}").reshape(n, m)


def block_row(block: int, ids: np.ndarray, labels: np.ndarray, at_block: np.ndarray, at_row: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    """One block as a row, its rows in order of id."""
    order = np.argsort(ids, kind="stable")
    n, dim = vectors.shape
    cells = [block, n, dim, longs(ids[order]), longs(labels[order]), longs(at_block[order]), longs(at_row[order]), stored(vectors[order])]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])


def quantised(vectors: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are finite throughout, and these as one matrix, shorter
    ones with zeros at the end."""
    at = vectors.offsets.to_numpy()
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[at[0] : at[-1]]  # null becomes NaN
    at = at - at[0]
    bad = np.concatenate([[0], (~np.isfinite(flat)).cumsum()])
    ok = (bad[at[1:]] == bad[at[:-1]]) & ~np.asarray(vectors.is_null())
    whole = np.clip(np.floor(np.where(np.isfinite(flat), flat, 0) * scale), -LIMIT, LIMIT).astype(np.int32)
    starts, sizes = at[:-1][ok], np.diff(at)[ok]
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int32)
    for size in np.unique(sizes):
        same = np.nonzero(sizes == size)[0]
        out[same, :size] = whole[starts[same][:, None] + np.arange(size)]
    return ok, out


def stacked(matrices: list[np.ndarray]) -> np.ndarray:
    dim = max(m.shape[1] for m in matrices)
    return np.concatenate([np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in matrices])


def packed(parts: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of any lengths as arrays of ``most`` rows, but the last; the last
    array of each tuple is a matrix of any width."""
    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        held.append(part)
        while sum(len(h[0]) for h in held) >= most:
            whole = [*(np.concatenate(c) for c in list(zip(*held, strict=True))[:-1]), stacked([h[-1] for h in held])]
            yield tuple(c[:most] for c in whole)
            held = [tuple(c[most:] for c in whole)]
    if sum(len(h[0]) for h in held):
        yield (*(np.concatenate(c) for c in list(zip(*held, strict=True))[:-1]), stacked([h[-1] for h in held]))


def row_blocks(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """Blocks of the rows (vec_id, label, embedding) that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                ok, vectors = quantised(b.column(2), scale)
                if ok.any():
                    yield b.column(0).to_numpy()[ok], b.column(1).to_numpy()[ok], vectors

        first = TaskContext.get().partitionId() << 32
        for k, (ids, labels, vectors) in enumerate(packed(parts(), ROWS)):
            yield block_row(first + k, ids, labels, np.full(len(ids), first + k), np.zeros(len(ids), np.int64), vectors)

    return arrow_map(rows, run, BLOCKS)


def anchor_blocks(blocks: DataFrame, every: int) -> DataFrame:
    """Blocks of the rows whose id ``every`` divides; ``at_block`` and
    ``at_row`` say where these stand among ``blocks``."""

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                labels, vectors = np.frombuffer(r["labels"], np.int64), restored(r["vectors"], r["n"], r["dim"])
                for i in np.nonzero(ids % every == 0)[0]:
                    yield block_row(r["block"], ids[i : i + 1], labels[i : i + 1], np.array([r["block"]]), np.array([i]), vectors[i : i + 1])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for b in batches:
                for r in b.to_pylist():
                    yield (*(np.frombuffer(r[c], np.int64) for c in ("ids", "labels", "at_block", "at_row")), restored(r["vectors"], 1, r["dim"]))

        first = TaskContext.get().partitionId() << 32
        for k, (ids, labels, at_block, at_row, vectors) in enumerate(packed(parts(), ANCHORS)):
            yield block_row(first + k, ids, labels, at_block, at_row, vectors)

    found = written(arrow_map(blocks, singles, BLOCKS), "negatives-anchors")
    return arrow_map(found.repartition(max(1, math.ceil(found.count() / ANCHORS))), together, BLOCKS)


def size(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b', exactly: panels of dimensions, added up in place."""
    dim = min(a.shape[1], b.shape[1])  # a shorter one has zeros at its end
    most = size(a) * size(b) * dim
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    panel = np.float32 if kind == np.float32 else np.float64
    out = np.zeros((len(a), len(b)), kind)
    for i in range(0, dim, EXACT):
        out += (a[:, i : min(i + EXACT, dim)].astype(panel) @ b[:, i : min(i + EXACT, dim)].astype(panel).T).astype(kind, copy=False)
    return out


def grid(anchors: int, rows: int, cells: int) -> tuple[int, int]:
    """Lines and columns of about ``cells`` cells, so that little is copied,
    and a cell has fewer anchor blocks than a task holds."""
    cells = max(1, min(cells, anchors * rows))
    lines = min(anchors, max(1, round(math.sqrt(cells * anchors * ANCHORS / (rows * ROWS))), math.ceil(2 * anchors / HELD)))
    return lines, min(rows, math.ceil(cells / lines))


def span(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def dealt(anchors: DataFrame, rows: DataFrame, lines: int, columns: int) -> DataFrame:
    """Each anchor block with each row block, in the cells of the grid. Neither
    side is broadcast: Spark knows its size before the grid repeats it."""
    line, column = F.pmod(F.xxhash64("block"), F.lit(lines)), F.pmod(F.xxhash64("block"), F.lit(columns))
    facts = F.concat("ids", "labels", "at_block", "at_row")
    more = [F.col(c) for c in anchors.columns if c not in {x.split()[0] for x in BLOCKS.split(", ")}]
    spread = anchors.repartition(shuffle_partitions(anchors.sparkSession), "block")  # these are few, but repeated often
    left = spread.select(line.alias("line"), F.explode(span(columns)).alias("col"), F.col("block").alias("a"), F.col("n").alias("a_n"), F.col("dim").alias("a_dim"), facts.alias("a_facts"), F.col("vectors").alias("a_vectors"), *more)
    right = rows.select(F.explode(span(lines)).alias("line"), column.alias("col"), F.col("block").alias("b"), F.col("n").alias("b_n"), F.col("dim").alias("b_dim"), F.concat("ids", "labels").alias("b_facts"), F.col("vectors").alias("b_vectors"))
    return right.repartition(lines * columns, "line", "col").join(left.hint("merge"), ["line", "col"]).drop("line", "col")


class Block:
    """Ids, labels and vectors of a block, and the places of each label."""

    def __init__(self, r: dict, side: str):
        n = r[f"{side}_n"]
        self.ids, self.labels, *self.at = np.frombuffer(r[f"{side}_facts"], np.int64).reshape(-1, n)
        self.vectors = restored(r[f"{side}_vectors"], n, r[f"{side}_dim"])
        order = np.argsort(self.labels, kind="stable")
        names, starts = np.unique(self.labels[order], return_index=True)
        self.of = dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))


def leading(scores: np.ndarray, may: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and columns of the ``most`` best scores of each line among
    ``may``; equal scores go by column. Where ``may`` has few, all of them."""
    if may.shape[1] > most and np.count_nonzero(may) > 8 * most * len(may):
        least = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
        some = np.where(may, scores, least)
        last = np.partition(some, -most, axis=1)[:, -most][:, None]
        better, equal = some > last, may & (some == last)
        may = better | equal & (equal.cumsum(axis=1) <= most - better.sum(axis=1, keepdims=True))
    return np.nonzero(may)


class Best:
    """The leading (score, id) of each group, best first and then by id."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.group, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        #: A group's last score, once it has ``most`` rows: lower ones are none of its best.
        self.least = np.full(groups, np.iinfo(np.int64).min)

    def add(self, group: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        group, scores, ids = np.concatenate([self.group, group]), np.concatenate([self.scores, scores.astype(np.int64)]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores, group))
        group, scores, ids = group[order], scores[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        self.least[group[rank == self.most - 1]] = scores[rank == self.most - 1]
        self.group, self.scores, self.ids = (x[rank < self.most] for x in (group, scores, ids))


class Anchors(Block):
    """An anchor block, and what a task has found for it so far."""

    def __init__(self, r: dict, most: int):
        super().__init__(r, "a")
        self.block, self.at_block, self.at_row = r["a"], *self.at
        self.best = Best(len(self.ids), most)

    def see(self, b: Block, block: int) -> None:
        """Leading rows of each anchor's label."""
        for label in self.of.keys() & b.of.keys():
            rows, columns = self.of[label], b.of[label]
            scores = product(self.vectors[rows], b.vectors[columns])
            may = scores >= held(self.best.least[rows], scores.dtype)[:, None]
            own = np.nonzero(self.at_block[rows] == block)[0]
            may[own, np.searchsorted(columns, self.at_row[rows[own]])] = False
            i, j = leading(scores, may, self.best.most)
            self.best.add(rows[i], scores[i, j], b.ids[columns[j]])

    def found(self) -> list[np.ndarray]:
        return [np.full(len(self.best.ids), self.block), self.best.group, self.best.ids, self.best.scores]


class Windows(Anchors):
    """An anchor block with the windows of its positives: one group for each
    (place, anchor), in order of place."""

    def __init__(self, r: dict, most: int, low: int, high: int):
        super().__init__(r, most)
        wanted, n = r["wanted"], len(self.ids)
        places = max(w["place"] for w in wanted)
        lows, highs = np.full(places * n, 1), np.zeros(places * n, np.int64)  # nothing is in such a window
        self.positive, self.score = np.zeros(places * n, np.int64), np.zeros(places * n, np.int64)
        for w in wanted:
            k = (w["place"] - 1) * n + w["row"]
            lows[k], highs[k], self.positive[k], self.score[k] = ceil_of(low, w["score"]), high * w["score"] // 100, w["id"], w["score"]
        self.lows, self.highs = lows, highs
        self.best = Best(places * n, most)

    def see(self, b: Block, block: int) -> None:
        """Leading rows of other labels in each window."""
        n, scores = len(self.ids), product(self.vectors, b.vectors)
        lows, highs = (held(x, scores.dtype).reshape(-1, n) for x in (np.maximum(self.lows, self.best.least), self.highs))
        some = lows <= highs
        most = np.iinfo(np.int64).max if scores.dtype.kind == "i" else np.inf
        least, greatest = np.where(some, lows, most).min(axis=0), np.where(some, highs, -most).max(axis=0)
        may = (scores >= least[:, None]) & (scores <= greatest[:, None])
        if np.count_nonzero(may) > 8 * self.best.most * n:
            may &= self.labels[:, None] != b.labels
            found = [leading(scores, may & (scores >= lows[p][:, None]) & (scores <= highs[p][:, None]), self.best.most) for p in range(len(lows))]
        else:
            i, j = np.nonzero(may)
            other = self.labels[i] != b.labels[j]
            i, j = i[other], j[other]
            each = ((scores[i, j] >= lows[p][i]) & (scores[i, j] <= highs[p][i]) for p in range(len(lows)))
            found = [(i[k], j[k]) for k in each]
        if any(len(i) for i, _ in found):
            group, i, j = np.concatenate([p * n + i for p, (i, _) in enumerate(found)]), *(np.concatenate([f[k] for f in found]) for k in (0, 1))
            self.best.add(group, scores[i, j], b.ids[j])

    def found(self) -> list[np.ndarray]:
        place, row = np.divmod(self.best.group, len(self.ids))
        return [np.full(len(row), self.block), row, place + 1, self.ids[row], self.positive[self.best.group], self.score[self.best.group], self.best.ids, self.best.scores]


def held(values: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Bounds of scores, in their kind of number; scores are below the least
    number that ``product`` has no place for in that kind."""
    if kind.kind == "i":
        return values
    most = 1 << (24 if kind == np.float32 else 53)
    return np.clip(values, -most, most).astype(kind)


def ceil_of(percent: int, score: int) -> int:
    """The least whole number of at least ``percent`` of ``score``."""
    return -((-percent * score) // 100)


def in_cells(met: DataFrame, make: Callable[[dict], Anchors], schema: str) -> DataFrame:
    """What each anchor block finds in the cells of a task."""

    def rows(anchors: dict[int, Anchors]) -> Iterator[pa.RecordBatch]:
        for a in anchors.values():
            if len(a.best.ids):
                columns = zip(a.found(), schema.split(", "), strict=True)
                yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array(x, pa.int64()).cast(pa.int32() if c.endswith(" int") else pa.int64()) for x, c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: dict[int, Anchors] = {}
        last, b = None, None
        for batch in batches:
            a_blocks, b_blocks = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i, (a_block, b_block) in enumerate(zip(a_blocks, b_blocks, strict=True)):
                r = lambda side, i=i: {c: batch.column(c)[i].as_py() for c in batch.schema.names if c[:2] in (side, f"{side}_") or side == "a" and c == "wanted"}
                if b is None or b_block != last:
                    last, b = b_block, Block(r("b"), "b")
                if a_block not in anchors:
                    if len(anchors) == HELD:
                        yield from rows(anchors)
                        anchors = {}
                    anchors[a_block] = make(r("a"))
                anchors[a_block].see(b, b_block)
        yield from rows(anchors)

    return arrow_map(met, run, schema)


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Anchors are the rows whose id ``every`` divides; the negatives of a pair
    score ``low`` to ``high`` percent of its positive."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    blocks = written(row_blocks(rows.dropna("any"), scale), "negatives-rows")
    anchors = written(anchor_blocks(blocks, every), "negatives-anchor-blocks")
    lines, columns = grid(max(1, anchors.count()), max(1, blocks.count()), 2 * shuffle_partitions(rows.sparkSession))
    best = in_cells(dealt(anchors, blocks, lines, columns), lambda r: Anchors(r, positives), "a long, row int, id long, score long")
    place = F.row_number().over(Window.partitionBy("a", "row").orderBy(F.desc("score"), "id"))
    best = best.withColumn("place", place).where(F.col("place") <= positives)
    wanted = best.groupBy(F.col("a").alias("block")).agg(F.collect_list(F.struct("row", "place", "id", "score")).alias("wanted"))  # at most ANCHORS * positives
    anchors = written(anchors.join(wanted, "block"), "negatives-positives")
    found = in_cells(dealt(anchors, blocks, lines, columns), lambda r: Windows(r, negatives, low, high), "a long, row int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("a", "row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
