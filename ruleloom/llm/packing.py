"""Vector best-fit packing (operator 8).

Every piece of a document demands a vector: its tokens, one document place and
its attention cost (tokens squared). A sequence has a capacity for each. Pieces
of one length have one demand, so packing needs no more than the number of
pieces of each length: at most ``max_tokens`` numbers, whatever the input.

``plan`` packs these classes on the driver, longest first. Sequences with equal
residuals are one group; a class takes the group that best fits it under every
capacity (smallest weighted norm of what would remain, or largest weighted dot
product of demand and residual) and fills as many of the group's sequences as
it has pieces. Each step uses up a class or a group, so the plan's size depends
on ``max_tokens``, not on the input. Executors then give each piece its place
from its rank among the pieces of its length. Ranks come from counts by length
and salt, so a length that a third of all pieces have is dealt over many tasks.

With the default capacities tokens alone bind, as a sequence has no more
documents than tokens and its attention cost is at most their square; that
gives the fewest sequences. Tighter ones bind by themselves: the pipeline
limits documents to fewer than tokens alone would put together, and tests limit
both.

Defined cases: a null text counts as empty and has the end id alone; equal
rows are packed one by one; an empty table gives no rows; a longer document is
cut into pieces of as many tokens as one sequence can hold (all its tokens, or
the root of its attention cost where that is less), the last one may be shorter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, byte_texts, shuffle_partitions, written
from ruleloom.llm.tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold. The attention cost of a full sequence of
    one document is its square, so the default never binds before tokens do."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that fits."""
        return min(self.tokens, math.isqrt(self.attention))


def pieces(docs: DataFrame, end_id: int = 1, max_tokens: int = 4096, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, in order; ``with_ids`` adds the ids."""
    vocabulary = vocabulary or default_path()
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            cut = []
            for doc, ids in zip(b.column(0).to_pylist(), encode(byte_texts(b.column(1))), strict=True):
                ids += tail
                for k, i in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[i : i + 4 * max_tokens]
                    cut.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*cut, strict=True)) or [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, np.int32) for x in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return arrow_map(docs.select("doc_id", "text"), run, PIECES + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], capacity: Capacity = Capacity(), rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, offset) and the number
    of sequences. A run puts pieces of one length, by rank, into sequences that
    follow each other, at one offset."""
    caps = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    w = np.array(weights)
    room = np.empty((64, 3))  # residuals of the groups
    held: list[list[list[int]]] = []  # their runs of [first sequence, sequences]
    at: dict[tuple, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(residual: np.ndarray, run: list[int]) -> None:
        nonlocal room
        key = tuple(residual)
        if key not in at:
            at[key] = len(held)
            held.append([])
            if len(held) > len(room):
                room = np.concatenate([room, np.empty_like(room)])
        room[at[key]] = residual
        held[at[key]].append(run)

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        n, rank = counts[length], 0
        while rank < n:
            r = room[: len(held)]
            fits = np.nonzero((r >= need).all(axis=1))[0]
            if len(fits):
                left = r[fits] / caps
                score = ((left - need / caps) ** 2 @ w) if rule == "norm" else -(left * (need / caps) @ w)
                g = fits[int(np.argmin(score))]
                residual = room[g].copy()
                first, many = held[g].pop()
                if not held[g]:
                    room[g] = -1  # empty: nothing fits
                    del at[tuple(residual)]
                    at[(-1.0, g)] = g
                k = min(many, n - rank)
                if k < many:
                    put(residual, [first + k, many - k])
                runs.append((length, rank, k, first, int(caps[0] - residual[0])))
                put(residual - need, [first, k])
                rank += k
            else:
                each = max(1, int((caps // need).min()))
                k = max(1, (n - rank) // each)  # sequences to open, filled at once
                each = min(each, n - rank)
                for j in range(each):
                    runs.append((length, rank, k, made, j * length))
                    rank += k
                put(caps - each * need, [made, k])
                made += k
    return np.array(runs, np.int64).reshape(-1, 5), made


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, ... within each length."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own"))


def pack(docs: DataFrame, end_id: int = 1, capacity: Capacity = Capacity(), rule: str = "norm", vocabulary: str | None = None) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    rows = written(pieces(docs, end_id, capacity.longest, vocabulary), "packing-pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    runs, _ = plan(counts, capacity, rule)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    key = (runs[:, 0] << 44) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(runs[i, 3] + rank - runs[i, 1]), pa.array(runs[i, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    full = ranked(rows, max(16, shuffle_partitions(docs.sparkSession))).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long"))
    return arrow_map(full, place, PIECES + ", sequence_id long, offset long")
