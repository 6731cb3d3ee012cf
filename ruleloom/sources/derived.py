"""Files and imports derived from star-schema tables.

Orders, parts, suppliers, nations and regions are source files of one module;
line items and keys are their imports. ``FILES_SQL`` and ``IMPORTS_SQL`` say the
same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.resolve import classified

MODULE = "example.test/commerce"
FILE_COLUMNS = ["path", "package_path", "package", "package_line"]
IMPORT_COLUMNS = ["path", "import_path", "resolved_path", "dependency_type", "line"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    segment = F.lower("c_mktsegment")
    package = F.concat(F.lit("cmd/"), segment, F.lit("/c"), F.col("c_custkey").cast("string"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"])
    return rows.select(
        "o_orderkey",
        F.concat(package, F.lit("/o"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "_test.go").otherwise(".go")).alias("path"),
        package.alias("package_path"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "main").otherwise(segment).alias("package"),
    )


def _keyed(prefix: str, key: str, name: str) -> list:
    package = F.concat(F.lit(prefix), F.col(key).cast("string"))
    return [F.concat(package, F.lit(f"/{name}.go")).alias("path"), package.alias("package_path"), F.lit(name).alias("package"), F.lit(1).alias("package_line")]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _order_paths(spark, sf_dir).select("path", "package_path", "package", F.lit(1).alias("package_line"))
    for name in ("part", "supplier", "nation", "region"):
        key = {"part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}[name]
        out = out.unionByName(_table(spark, sf_dir, name).select(*_keyed(f"internal/{name}/{name[0]}", key, name)))
    return out


def raw_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, import_path, line)"""
    items = _table(spark, sf_dir, "lineitem")
    own = lambda kind, key: F.concat(F.lit(f"{MODULE}/internal/{kind}/{kind[0]}"), F.col(key).cast("string")).alias("import_path")
    at = lambda kind, key: F.concat(F.lit(f"internal/{kind}/{kind[0]}"), F.col(key).cast("string"), F.lit(f"/{kind}.go")).alias("path")
    orders = _order_paths(spark, sf_dir).select("o_orderkey", "path")
    part, supplier, nation = (_table(spark, sf_dir, n) for n in ("part", "supplier", "nation"))
    found = [
        items.where("l_quantity >= 48").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("path", own("part", "l_partkey"), (F.col("l_linenumber") + 2).alias("line")),
        items.where("l_discount >= 0.09 and l_linenumber = 1").select("l_partkey", "l_suppkey").distinct().join(part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select(at("part", "p_partkey"), own("supplier", "l_suppkey"), F.lit(4).alias("line")),
        part.select(at("part", "p_partkey"), F.explode(F.array(F.struct(F.lower("p_type").alias("import_path"), F.lit(2).alias("line")), F.struct(F.concat(F.lit("brand.example.net/"), F.col("p_brand")).alias("import_path"), F.lit(3).alias("line")))).alias("x")).select("path", "x.*"),
        supplier.select(at("supplier", "s_suppkey"), own("nation", "s_nationkey"), F.lit(3).alias("line")),
        supplier.where("s_acctbal < 0").select(at("supplier", "s_suppkey"), F.lit("C").alias("import_path"), F.lit(2).alias("line")),
        nation.select(at("nation", "n_nationkey"), own("region", "n_regionkey"), F.lit(3).alias("line")),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.withColumn("line", F.col("line").cast("int"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(raw_imports(spark, sf_dir), MODULE).select(*IMPORT_COLUMNS)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): the files as source text, each import on its line. Letters
    that no import path has are replaced."""
    path = F.regexp_replace("import_path", "[ #]", "-")
    found = raw_imports(spark, sf_dir).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", path.alias("import_path")))).alias("found"))
    at = lambda n: F.transform(F.filter("found", lambda x: x["line"] == n), lambda x: F.concat(F.lit('import _ "'), x["import_path"], F.lit('"')))
    lines = F.transform(F.sequence(F.lit(2), F.array_max(F.transform("found", lambda x: x["line"]))), lambda n: F.array_join(at(n), "; "))
    body = F.when(F.col("found").isNull(), F.lit("")).otherwise(F.array_join(lines, "\n"))
    rows = files(spark, sf_dir).select("path", "package").join(found, "path", "left")
    return rows.select("path", F.concat(F.lit("package "), "package", F.lit("\n"), body, F.lit("\nvar x = 1\n")).alias("text"))


def page_imports(spark: SparkSession, sf_dir: str, module: str = "example.com") -> DataFrame:
    """Page addresses as imports."""
    rows = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("import_path"))
    return classified(rows, module).select("page_id", "import_path", "resolved_path", "dependency_type")


def sequel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): keys of parts whose large items are followed by another part
    in an order; a graph full of cycles."""
    items = _table(spark, sf_dir, "lineitem")
    a = items.where("l_quantity >= 45").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    b = items.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return b.join(a.hint("shuffle_hash"), ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def part_package(key: str) -> Column:
    return F.concat(F.lit("internal/part/p"), F.col(key).cast("string"))


def sequels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with packages instead of keys."""
    return sequel_keys(spark, sf_dir).select(part_package("src").alias("src"), part_package("dst").alias("dst"))


SEQUELS_SQL = """SELECT DISTINCT 'internal/part/p' || a.l_partkey AS src, 'internal/part/p' || b.l_partkey AS dst
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= 45"""

_ORDERS_SQL = """SELECT o_orderkey,
  'cmd/' || lower(c_mktsegment) || '/c' || c_custkey || '/o' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '_test.go' ELSE '.go' END AS path,
  'cmd/' || lower(c_mktsegment) || '/c' || c_custkey AS package_path,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'main' ELSE lower(c_mktsegment) END AS package
FROM orders JOIN customer ON o_custkey = c_custkey"""

FILES_SQL = "\n".join(
    ["SELECT path, package_path, package, 1 AS package_line FROM order_paths"]
    + [f"UNION ALL SELECT 'internal/{n}/{n[0]}' || {k} || '/{n}.go', 'internal/{n}/{n[0]}' || {k}, '{n}', 1 FROM {n}" for n, k in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"))]
)

RAW_IMPORTS_SQL = f"""SELECT path, '{MODULE}/internal/part/p' || l_partkey AS import_path, (2 + l_linenumber)::INT AS line
FROM lineitem JOIN order_paths ON l_orderkey = o_orderkey WHERE l_quantity >= 48
UNION ALL SELECT DISTINCT 'internal/part/p' || l_partkey || '/part.go', '{MODULE}/internal/supplier/s' || l_suppkey, 4
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount >= 0.09 AND l_linenumber = 1
UNION ALL SELECT 'internal/part/p' || p_partkey || '/part.go', lower(p_type), 2 FROM part
UNION ALL SELECT 'internal/part/p' || p_partkey || '/part.go', 'brand.example.net/' || p_brand, 3 FROM part
UNION ALL SELECT 'internal/supplier/s' || s_suppkey || '/supplier.go', '{MODULE}/internal/nation/n' || s_nationkey, 3 FROM supplier
UNION ALL SELECT 'internal/supplier/s' || s_suppkey || '/supplier.go', 'C', 2 FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'internal/nation/n' || n_nationkey || '/nation.go', '{MODULE}/internal/region/r' || n_regionkey, 3 FROM nation"""


def classify_sql(source: str, module: str) -> str:
    return f"""SELECT *, CASE WHEN import_path IN ('', 'C') THEN '' WHEN import_path = '{module}' THEN '.'
    WHEN starts_with(import_path, '{module}/') THEN substr(import_path, {len(module) + 2}) ELSE import_path END AS resolved_path,
  CASE WHEN import_path IN ('', 'C') THEN 'unresolved' WHEN import_path = '{module}' OR starts_with(import_path, '{module}/') THEN 'local'
    WHEN contains(split_part(import_path, '/', 1), '.') THEN 'module' ELSE 'stdlib' END AS dependency_type
FROM ({source})"""


#: Common table expressions that queries build on.
WITH_SQL = f"""WITH RECURSIVE order_paths AS ({_ORDERS_SQL}),
files AS ({FILES_SQL}),
imports AS ({classify_sql(RAW_IMPORTS_SQL, MODULE)}),
local AS (SELECT i.path, f.package_path AS src, i.resolved_path AS dst, i.line, i.import_path FROM imports i JOIN files f USING (path) WHERE dependency_type = 'local' AND resolved_path <> ''),
provenance AS (SELECT DISTINCT src, dst, path FROM local WHERE src <> dst),
edges AS (SELECT DISTINCT src, dst FROM provenance),
nodes AS (SELECT package_path FROM files UNION SELECT dst FROM local),
fan_in AS (SELECT dst AS package_path, count(*)::BIGINT AS fan_in FROM edges GROUP BY dst),
fan_out AS (SELECT src AS package_path, count(*)::BIGINT AS fan_out FROM edges GROUP BY src),
stability AS (SELECT package_path, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM nodes LEFT JOIN fan_in USING (package_path) LEFT JOIN fan_out USING (package_path)),
facts AS (SELECT f.*, coalesce(fan_in, 0) AS dependents,
  NOT EXISTS (SELECT 1 FROM imports i WHERE i.path = f.path) AND f.package_path NOT IN (SELECT dst FROM local) AS orphan
  FROM files f LEFT JOIN fan_in USING (package_path)),
wide AS (SELECT i.*, f.package_path, f.package, f.dependents, f.orphan, coalesce(nullif(i.resolved_path, ''), i.import_path) AS target FROM imports i JOIN facts f USING (path))"""
