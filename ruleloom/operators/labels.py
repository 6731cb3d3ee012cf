"""Reachability of many roots at once, as bits.

Roots become labels: bit ``label & 63`` of word ``label >> 6``. What a node is
reached from is a row (view, word, node, mask), so 64 roots that reach the same
node are one row, and joining a round's news with the edges is one join for all
roots and all edge filters: ``view`` numbers the filter, and an edge has a flag
for each view that keeps it.

``spread`` is the fixpoint. A round joins the new bits with the edges twice, and
one aggregate by node ORs them and drops the bits that are known. Rounds are tables in the shared
folder, so lineage stays short, a lost executor costs one round, and Spark knows
their sizes when it picks joins. OR is summed before the shuffle, so a node that
a third of all edges lead to is one row a task.

``reached`` answers which roots reach which targets. It looks from the side with
fewer nodes: labels are the roots, spread along the edges, or the targets, spread
against them. Both give the same pairs (tested), and it counts both sides first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.shared import written

#: Tables of rounds that are read one by one before they become one table.
ROUNDS = 16
WORD = 6

KEY = ["view", "word", "node"]


def kept(view: Column) -> Column:
    """Does the edge belong to the view?"""
    return F.element_at("views", view + 1)


def after(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Bits one edge further, not summed."""
    met = rows.join(edges, (F.col("node") == F.col("src")) & kept(F.col("view")))
    return met.select("view", "word", F.col("dst").alias("node"), "mask")


def ored(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.bit_or("mask").alias("mask"))


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(view, word, node, mask): the ``seeds`` and all they reach, along the
    edges (src, dst, views) that their view keeps."""
    new = written(ored(seeds.select(*KEY, "mask")), "labels-0")
    rounds, turn = [new], 0
    while not new.isEmpty():
        turn += 1
        one = ored(after(new, edges))
        known = reduce(DataFrame.unionByName, rounds).select(*KEY, "mask", F.lit(True).alias("old"))
        both = one.unionByName(after(one, edges)).withColumn("old", F.lit(False)).unionByName(known)
        had, got = (F.coalesce(F.bit_or(F.when(F.col("old") == old, F.col("mask"))), F.lit(0).cast("long")) for old in (True, False))
        new = written(both.groupBy(*KEY).agg(got.bitwiseAND(F.bitwise_not(had)).alias("mask")).where("mask <> 0"), f"labels-{turn}")
        rounds.append(new)
        if len(rounds) > ROUNDS:
            rounds = [written(ored(reduce(DataFrame.unionByName, rounds)), "labels-known")]
    return ored(reduce(DataFrame.unionByName, rounds))


def bit(label: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), label.bitwiseAND(63).cast("int"))


def labelled(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a label each: a number within its task's, so that words
    are filled wherever a task has many nodes."""
    label = F.monotonically_increasing_id()
    return written(nodes.withColumn("label", label).withColumns({"word": F.shiftright("label", WORD), "mask": bit(F.col("label"))}), "labels-of")


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "views")


def expanded(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """A row for each bit of ``rows``, with its label's node as ``name``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("mask"), i) == 1)
    each = rows.withColumn("bit", F.explode(bits)).withColumn("label", F.shiftleft("word", WORD) + F.col("bit"))
    return each.drop("word", "bit", "mask").join(labels.select("label", F.col("node").alias(name)), "label").drop("label")


def reached(edges: DataFrame, roots: DataFrame, targets: DataFrame, forwards: bool | None = None) -> DataFrame:
    """(view, root, node): which roots (view, node) reach which targets (view,
    node) in their view; a root that is a target reaches itself. ``forwards``
    chooses a side, None the one with fewer nodes."""
    if forwards is None:
        forwards = roots.count() <= targets.count()
    few, many = (roots, targets) if forwards else (targets, roots)
    labels = labelled(few.select("view", "node"))
    found = spread(edges if forwards else turned(edges), labels)
    met = found.join(many.select("view", "node"), ["view", "node"], "left_semi")
    named = expanded(met, labels, "label_node")
    return named.select("view", *((F.col("label_node").alias("root"), "node") if forwards else (F.col("node").alias("root"), F.col("label_node").alias("node"))))
