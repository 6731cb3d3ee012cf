"""Report rows as DataFrames: text lines and the graph of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.reports.text import dot_label, fields, one_line, quoted
from ruleloom.shared import written

# Reasons by kind, for violations with and without a target.
EDGE_REASONS = {"forbidden": "forbidden dependency", "not-in-allowed": "dependency matches no allowed rule", "reachable": "target package is transitively reachable"}
SOURCE_REASONS = {"forbidden": "forbidden source", "required": "required dependency is missing", "unreachable": "package is unreachable from matching sources"}


def reason(kind: Column, edge: Column) -> Column:
    unknown = F.concat(F.lit("unknown violation kind "), quoted(kind))

    def chosen(reasons: dict[str, str]) -> Column:
        out = F.when(F.lit(False), "")
        for k, text in reasons.items():
            out = out.when(kind == k, text)
        return out.otherwise(unknown)

    return F.when(edge, chosen(EDGE_REASONS)).otherwise(chosen(SOURCE_REASONS))


def err_lines(violations: DataFrame) -> DataFrame:
    """A line for each violation, and what to do about it on a second one."""
    edge = F.col("to").isNotNull()
    line = F.concat(
        F.lit("["), one_line(F.col("severity")), F.lit("] rule "), quoted(F.col("rule")), F.lit(": "), one_line(F.col("from.path")),
        F.when(F.col("from.line") != 0, F.concat(F.lit(":"), F.col("from.line").cast("string"))).otherwise(""),
        F.when(edge, F.concat(F.lit(" -> "), one_line(F.col("to.path")), F.lit(" ("), one_line(F.col("to.type")), F.lit(")"))).otherwise(""),
        F.lit(": "), reason(F.col("kind"), edge),
    )
    fix = fields(F.col("comment"))
    return violations.select(F.concat(line, F.when(fix != "", F.concat(F.lit("\n  fix: "), fix)).otherwise("")).alias("line"))


def json_lines(violations: DataFrame) -> DataFrame:
    """A JSON object for each violation, with the report's field names."""
    source = F.struct(F.col("from.path").alias("path"), F.col("from.line").alias("line"), F.col("from.package_name").alias("packageName"))
    target = F.when(F.col("to").isNotNull(), F.struct(F.col("to.path").alias("path"), F.col("to.import_path").alias("importPath"), F.col("to.type").alias("dependencyType")))
    document = F.struct("rule", "comment", "severity", "kind", source.alias("from"), target.alias("to"))
    return violations.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("line"))


def dot_edges(violations: DataFrame) -> DataFrame:
    """(place, line): the edges of the graph of violations, in DOT. Nodes are
    numbered by first appearance."""
    nodes = written(graph_nodes(violations), "report-nodes")
    order = nodes.select("kind", "path", "type", "first").orderBy("first")
    parts = written(order.withColumn("part", F.spark_partition_id()), "report-numbers")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    number = parts.withColumn("own", own).join(F.broadcast(bases), "part").select("kind", "path", "type", F.concat(F.lit("n"), (F.col("base") + F.col("own")).cast("string")).alias("id"))
    a = number.where("kind = 0").select(F.col("path").alias("from_path"), F.col("id").alias("a"))
    b = number.where("kind = 1").select(F.col("path").alias("to_path"), F.col("type").alias("to_type"), F.col("id").alias("b"))
    rows = graph_edges(violations).join(a, "from_path").join(b, ["to_path", "to_type"])
    label = dot_label(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.col("labels")))
    line = F.concat(F.lit("  "), "a", F.lit(" -> "), "b", F.lit(' [label="'), label, F.lit('", color="#cf222e", penwidth=3];'))
    return rows.select(F.col("first").alias("place"), line.alias("line"))


def placed(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """``rows`` with ``pos``, their place in an order: they are dealt by ranges
    of that order, and a place is one within a range after the rows of the
    ranges before it. Ranges are written, so that they stay as they are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "report-order")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("own", own).join(F.broadcast(bases), "range").withColumn("pos", (F.col("base") + F.col("own")).cast("long")).drop("range", "own", "base")


def positioned(violations: DataFrame) -> DataFrame:
    """Violations with their place in report order."""
    target = [F.coalesce(F.col(c), F.lit("")) for c in ("to.path", "to.type")]
    return placed(violations, ["rule", "severity", "from.path", "from.line", *target, "kind", F.coalesce("to.import_path", F.lit(""))])


def graph_nodes(violations: DataFrame) -> DataFrame:
    """(kind, path, type, first, labels): sources (kind 0) and targets (1) by
    first appearance; ``labels`` are of violations without a target."""
    v = positioned(violations)
    label = F.concat(F.col("rule"), F.lit(" ["), F.col("severity"), F.lit("]"))
    at_line = F.concat(label, F.lit(" @ line "), F.col("from.line").cast("string"))
    source = F.struct(F.lit(0).alias("kind"), F.col("from.path").alias("path"), F.lit("").alias("type"), (F.col("pos") * 2).alias("at"), F.when(F.col("to").isNull(), F.struct("pos", at_line.alias("label"))).alias("said"))
    target = F.when(F.col("to").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("to.path").alias("path"), F.coalesce("to.type", F.lit("")).alias("type"), (F.col("pos") * 2 + 1).alias("at"), F.lit(None).cast("struct<pos:bigint,label:string>").alias("said")))
    ends = v.select(F.explode(F.filter(F.array(source, target), lambda x: x.isNotNull())).alias("x")).select("x.*")
    return ends.groupBy("kind", "path", "type").agg(F.min("at").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list("said")), lambda s: s["label"]), "; ").alias("labels"))


def graph_edges(violations: DataFrame) -> DataFrame:
    """(from_path, to_path, to_type, line, first, labels)."""
    v = positioned(violations).where(F.col("to").isNotNull())
    label = F.concat(F.col("rule"), F.lit(" ["), F.col("severity"), F.lit("]"))
    rows = v.select(F.col("from.path").alias("from_path"), F.col("to.path").alias("to_path"), F.coalesce("to.type", F.lit("")).alias("to_type"), F.col("from.line").alias("line"), "pos", label.alias("label"))
    return rows.groupBy("from_path", "to_path", "to_type", "line").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]), "; ").alias("labels"))
