"""The package graph as relations.

``provenance`` (src, dst, path) has the files behind each edge; ``edges`` are
its distinct packages. Self-imports make no edge but count as imports.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.resolve import cleaned
from ruleloom.shared import written


@dataclass
class Graph:
    files: DataFrame
    imports: DataFrame

    @cached_property
    def local(self) -> DataFrame:
        """(path, src, dst): every import of an own package."""
        own = self.imports.where((F.col("dependency_type") == "local") & (F.col("resolved_path") != "")).select("path", cleaned(F.col("resolved_path")).alias("dst"))
        return self.files.select("path", cleaned(F.col("package_path")).alias("src")).where("src <> ''").join(own, "path")

    @cached_property
    def pairs(self) -> DataFrame:
        """(src, dst): the distinct packages of ``local``, self-imports too."""
        return self.local.select("src", "dst").distinct()

    def kept(self) -> Graph:
        """This graph with its pairs of packages written once, for plans that
        read them several times."""
        self.pairs = written(self.pairs, "package-pairs")
        return self

    @cached_property
    def provenance(self) -> DataFrame:
        return self.local.where("src <> dst").select("src", "dst", "path").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        return self.pairs.where("src <> dst")

    def edges_without(self, skipped: Column | None) -> DataFrame:
        """Edges that some file supports for which ``skipped`` (on its path)
        doesn't hold."""
        if skipped is None:
            return self.edges
        return self.local.where("src <> dst").where(~skipped).select("src", "dst").distinct()

    @cached_property
    def packages(self) -> DataFrame:
        """Scanned packages."""
        return self.files.select(cleaned(F.col("package_path")).alias("package_path")).where("package_path <> ''").distinct()

    @cached_property
    def nodes(self) -> DataFrame:
        return self.packages.union(self.pairs.select("dst")).distinct()

    @cached_property
    def imported(self) -> DataFrame:
        return self.pairs.select(F.col("dst").alias("package_path")).distinct()

    @cached_property
    def fan_in(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("package_path")).agg(F.count(F.lit(1)).alias("fan_in"))

    @cached_property
    def fan_out(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("package_path")).agg(F.count(F.lit(1)).alias("fan_out"))

    @cached_property
    def stability(self) -> DataFrame:
        """(package_path, fan_in, fan_out) of every node, in one aggregate over
        the ends of imports and the scanned packages."""
        edge = (F.col("src") != F.col("dst")).cast("int")
        end = lambda name, i, o: F.struct(F.col(name).alias("package_path"), i.alias("i"), o.alias("o"))
        ends = self.pairs.select(F.explode(F.array(end("src", F.lit(0), edge), end("dst", edge, F.lit(0)))).alias("x")).select("x.*")
        alone = self.files.select(cleaned(F.col("package_path")).alias("package_path"), F.lit(0).alias("i"), F.lit(0).alias("o")).where("package_path <> ''")
        return ends.unionByName(alone).groupBy("package_path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))

    @cached_property
    def instability(self) -> DataFrame:
        degree = F.col("fan_in") + F.col("fan_out")
        return self.stability.withColumn("instability", F.when(degree == 0, 0.0).otherwise(F.col("fan_out") / F.greatest(degree, F.lit(1))))

    def dependents(self, package: str) -> DataFrame:
        return self.edges.where(F.col("dst") == package).select(F.col("src").alias("package_path")).orderBy("package_path")

    def dependencies(self, package: str) -> DataFrame:
        return self.edges.where(F.col("src") == package).select(F.col("dst").alias("package_path")).orderBy("package_path")

    @cached_property
    def facts(self) -> DataFrame:
        """``files`` with ``dependents`` and ``orphan``: a file without imports
        whose package nothing imports."""
        importing = self.imports.select("path").distinct().withColumn("imports_any", F.lit(True))
        other = F.when(F.col("src") != F.col("dst"), F.col("src"))
        packages = self.local.groupBy(F.col("dst").alias("pkg")).agg(F.count_distinct(other).alias("fan_in"), F.lit(True).alias("is_imported"))
        files = self.files.withColumn("pkg", cleaned(F.col("package_path")))
        joined = files.join(importing, "path", "left").join(packages, "pkg", "left")
        return joined.select(
            *self.files.columns,
            F.coalesce("fan_in", F.lit(0)).alias("dependents"),
            (F.col("imports_any").isNull() & F.col("is_imported").isNull()).alias("orphan"),
        )


def more_unstable(from_in: Column, from_out: Column, to_in: Column, to_out: Column) -> Column:
    """Is the target's instability strictly higher? In whole numbers:
    out/(in+out) compared by cross products; degree 0 counts as 0."""
    return F.when(from_in + from_out == 0, to_out > 0).otherwise(to_out * (from_in + from_out) > from_out * (to_in + to_out))
