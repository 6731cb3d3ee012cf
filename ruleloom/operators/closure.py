"""Reachability over edges (src, dst), seeds included.

A semi-naive fixpoint: each round joins what is new with the edges, twice, and
one aggregate drops what is known. Rounds are written to the shared folder, so lineage stays short
and a lost executor costs one round; edges that are small enough are broadcast
by Spark, which knows the size of the written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.shared import written

#: Tables of rounds that are read one by one before they become one table.
ROUNDS = 16


class Edges:
    """Edges whose closures are asked for; they are written once."""

    def __init__(self, edges: DataFrame):
        self.edges = written(edges.select("src", "dst").distinct(), "closure-edges")

    def after(self, pairs: DataFrame) -> DataFrame:
        """(root, node) one edge further."""
        return pairs.join(self.edges.withColumnRenamed("src", "node"), "node").select("root", F.col("dst").alias("node"))

    def closure(self, seeds: DataFrame) -> DataFrame:
        """(root, node) for all nodes that each root's seeds (root, node) reach."""
        new = written(seeds.select("root", "node").distinct(), "closure-0")
        rounds, turn = [new], 0
        while True:
            turn += 1
            one = self.after(new).distinct()
            known = reduce(DataFrame.union, rounds)
            both = one.union(self.after(one)).withColumn("old", F.lit(False)).union(known.withColumn("old", F.lit(True)))
            new = written(both.groupBy("root", "node").agg(F.max("old").alias("old")).where("not old").drop("old"), f"closure-{turn}")
            if new.isEmpty():
                return known
            rounds.append(new)
            if len(rounds) > ROUNDS:
                rounds = [written(known.union(new), "closure-known")]


def reachable(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Closure of ``seeds`` (root, node); seeds that are not among ``nodes``
    (package_path) are ignored, if given."""
    if nodes is not None:
        seeds = seeds.join(nodes.select(F.col("package_path").alias("node")), "node", "left_semi")
    return Edges(edges).closure(seeds)


def forward_closure(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return reachable(edges, seeds, nodes)


def reverse_closure(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, nodes)
