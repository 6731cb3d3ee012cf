"""One query for each operator, over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom import config as rules
from ruleloom.operators import baseline as base
from ruleloom.operators import closure
from ruleloom.operators.components import Condensed, components
from ruleloom.operators.graph import more_unstable
from ruleloom.operators.resolve import cleaned
from ruleloom.plans.rules import Evaluation, ordered, shape
from ruleloom.reports import frames
from ruleloom.shared import written
from ruleloom.sources import derived
from ruleloom.sources.derived import MODULE, RAW_IMPORTS_SQL, SEQUELS_SQL, WITH_SQL, classify_sql
from ruleloom.sources.scan import Module, parse_sources, relations, scan_written

Query = Callable[[SparkSession, str], DataFrame]


class Source:
    """Relations of one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def files(self) -> DataFrame:
        return derived.files(self.spark, self.sf_dir)

    @cached_property
    def imports(self) -> DataFrame:
        return derived.imports(self.spark, self.sf_dir)

    @cached_property
    def evaluation(self) -> Evaluation:
        return Evaluation(self.files, self.imports)

    @property
    def graph(self):
        return self.evaluation.graph

    def violations(self, document: dict[str, Any]) -> DataFrame:
        """Documents of many shapes read the relations many times, so these
        are written once; for one or two shapes the joins below are cheaper."""
        config = rules.from_dict(document)
        shapes = {shape(r) for r in config.forbidden} | ({"allowed"} if config.allowed is not None else set()) | ({"required"} if config.required else set())
        if len(shapes) < 3:
            return self.evaluation.violations(config)
        files, imports = written(self.files, "files"), written(self.imports, "imports")
        return Evaluation(files, imports).violations(config)


def flat(violations: DataFrame, *more: str) -> DataFrame:
    """Violations without structs."""
    return violations.select(
        "rule", "severity", "kind", F.col("from.path").alias("from_path"), F.col("from.line").alias("from_line"), F.col("from.package_name").alias("from_package"),
        F.col("to.path").alias("to_path"), F.col("to.import_path").alias("to_import"), F.col("to.type").alias("to_type"), *more,
    )


def forbid(name: str, source: dict, target: dict, **more: Any) -> dict:
    return {"name": name, "from": source, "to": target} | more


def edge_sql(rule: str, where: str, severity: str = "warn", kind: str = "forbidden") -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, '{kind}' AS kind, path AS from_path, line AS from_line, package AS from_package, target AS to_path, import_path AS to_import, dependency_type AS to_type FROM wide WHERE {where}"


def source_sql(rule: str, where: str, severity: str = "warn", kind: str = "forbidden", table: str = "facts") -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, '{kind}' AS kind, path AS from_path, package_line AS from_line, package AS from_package, NULL::VARCHAR AS to_path, NULL::VARCHAR AS to_import, NULL::VARCHAR AS to_type FROM {table} WHERE {where}"


def folder_sql(rule: str, where: str, severity: str = "warn") -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, 'forbidden' AS kind, src AS from_path, 0 AS from_line, '' AS from_package, dst AS to_path, '' AS to_import, 'local' AS to_type FROM folder WHERE {where}"


STABLE = "CASE WHEN a.fan_in + a.fan_out = 0 THEN b.fan_out > 0 ELSE b.fan_out * (a.fan_in + a.fan_out) > a.fan_out * (b.fan_in + b.fan_out) END"
FOLDER = f"folder AS (SELECT src, dst, coalesce(f.fan_in, 0) AS dependents, {STABLE} AS unstable FROM edges LEFT JOIN fan_in f ON f.package_path = src JOIN stability a ON a.package_path = src JOIN stability b ON b.package_path = dst)"
PLAIN = "plain AS (SELECT DISTINCT src, dst FROM provenance WHERE NOT regexp_matches(path, '_test\\.go$'))"


def closure_sql(name: str, edges: str, seeds: str, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"{name} AS ({seeds} UNION SELECT c.root, e.{b} FROM {name} c JOIN {edges} e ON e.{a} = c.node)"


CMD_SEEDS = "SELECT DISTINCT package_path AS root, package_path AS node FROM files WHERE starts_with(package_path, 'cmd/')"
IMPORT_SEEDS = "SELECT DISTINCT dst AS root, dst AS node FROM local WHERE starts_with(path, 'cmd/')"


def reach_sql(rule: str, where: str, name: str = "reach", severity: str = "warn") -> str:
    return f"""SELECT '{rule}' AS rule, '{severity}' AS severity, 'reachable' AS kind, l.path AS from_path, min(l.line)::INT AS from_line, f.package AS from_package, c.node AS to_path, '' AS to_import, 'local' AS to_type
FROM local l JOIN facts f USING (path) JOIN {name} c ON c.root = l.dst WHERE {where} GROUP BY l.path, f.package, c.node"""


# Documents of the queries

LAYERS = forbid("entry-no-part", {"path": ["^cmd/"]}, {"path": ["^internal/part/"]}, severity="error", comment="go through  a service")
OWN_KEY = forbid("same-digit", {"path": [r"^cmd/[a-z]+/c([0-9])"]}, {"path": [r"^internal/part/p$1"]})
#: One rule for each of many parts, two thirds by target and the rest by source, and some that nothing matches.
MANY = [forbid(f"part-{i:03d}", *(({"path": ["^cmd/"]}, {"path": [f"^internal/part/p{i}$"]}) if i % 3 else ({"path": [f"^internal/part/p{i}/"]}, {"path": ["^internal/supplier/"]})), severity=("info", "warn", "error")[i % 3]) for i in range(256)]
VENDOR = forbid("no-brands", {"path": ["^internal/"]}, {"dependencyTypes": ["module"]}, severity="info")
NOT_TYPES = forbid("own-or-std", {"path": ["^internal/"]}, {"dependencyTypesNot": ["local", "stdlib"]})
MAINS = forbid("urgent-main", {"packageName": ["^main$"], "pathNot": ["/c[0-4][^/]*/"]}, {}, severity="error")
LESS = forbid("few-dependents", {"path": ["^internal/supplier/"], "numberOfDependentsLessThan": 12}, {})
MORE = forbid("hub", {"numberOfDependentsMoreThan": 15}, {})
RANGE = forbid("middling", {"path": ["^internal/"], "numberOfDependentsMoreThan": 3, "numberOfDependentsLessThan": 6}, {})
ORPHAN = forbid("orphans", {"path": ["^cmd/"], "orphan": True}, {})
UNSTABLE_MODULE = forbid("stable-dependencies", {}, {"moreUnstable": True}, severity="error")
UNSTABLE_FOLDER = forbid("stable-folders", {}, {"moreUnstable": True}, scope="folder")
FOLDER_RULE = forbid("folder-parts", {"path": ["^internal/part/"]}, {"path": ["^internal/supplier/"], "pathNot": ["s[0-4]$"]}, scope="folder")
FOLDER_DEPENDENTS = forbid("busy-folders", {"numberOfDependentsMoreThan": 3}, {}, scope="folder")
REACH = forbid("reaches-region", {"path": ["^cmd/"]}, {"path": ["^internal/region/"], "reachable": True}, severity="error")
REACH_PLAIN = forbid("reaches-region-plain", {"path": ["^cmd/[a-m]"], "pathNot": [r"_test\.go$"]}, {"path": ["^internal/region/", "^internal/nation/n1$"], "reachable": True, "reachableFilePathNot": [r"_test\.go$"]})
UNREACH = forbid("dead-parts", {"path": ["^cmd/"]}, {"path": ["^internal/part/"], "reachable": False})
UNREACH_PLAIN = forbid("dead-but-tests", {"path": ["^cmd/"]}, {"path": ["^internal/(part|supplier)/"], "reachable": False, "reachableFilePathNot": [r"_test\.go$"]}, severity="info")
ALLOWED = [{"name": "down", "from": {"path": ["^cmd/"]}, "to": {"path": ["^internal/part/"]}}, {"name": "own", "from": {"path": ["^internal/"], "numberOfDependentsMoreThan": 0}, "to": {"dependencyTypes": ["local", "unresolved"]}}]
REQUIRED = {"name": "parts-have-suppliers", "from": {"path": ["^internal/part/"]}, "to": {"path": ["^internal/supplier/"]}}
REQUIRED_CAPTURE = {"name": "same-end", "severity": "error", "from": {"path": [r"^internal/part/p[0-9]*([0-9])/"]}, "to": {"path": [r"^internal/supplier/s[0-9]*$1$"]}}
WHOLE = {"forbidden": [LAYERS, VENDOR, MAINS, RANGE, FOLDER_RULE, REACH, UNREACH, forbid("off", {}, {}, severity="ignore")], "required": [REQUIRED], "allowed": ALLOWED, "allowedSeverity": "info"}

SQL_LAYERS = edge_sql("entry-no-part", "starts_with(path, 'cmd/') AND regexp_matches(target, '^internal/part/')", "error")
SQL_VENDOR = edge_sql("no-brands", "starts_with(path, 'internal/') AND dependency_type = 'module'", "info")
SQL_MAINS = source_sql("urgent-main", "package = 'main' AND NOT regexp_matches(path, '/c[0-4][^/]*/')", "error")
SQL_RANGE = source_sql("middling", "starts_with(path, 'internal/') AND dependents > 3 AND dependents < 6")
SQL_FOLDER = folder_sql("folder-parts", "starts_with(src, 'internal/part/') AND starts_with(dst, 'internal/supplier/') AND NOT regexp_matches(dst, 's[0-4]$')")
SQL_REACH = reach_sql("reaches-region", "starts_with(l.path, 'cmd/') AND starts_with(c.node, 'internal/region/')", severity="error")
SQL_UNREACH = source_sql("dead-parts", "starts_with(package_path, 'internal/part/') AND package_path NOT IN (SELECT node FROM allcmd)", kind="unreachable")
SQL_ALLOWED_WHERE = "NOT (starts_with(path, 'cmd/') AND starts_with(target, 'internal/part/')) AND NOT (starts_with(path, 'internal/') AND dependents > 0 AND dependency_type IN ('local', 'unresolved'))"
SQL_REQUIRED = source_sql("parts-have-suppliers", "starts_with(path, 'internal/part/') AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.path = facts.path AND starts_with(w.target, 'internal/supplier/'))", kind="required")
ALL_CMD = closure_sql("allcmd", "edges", "SELECT DISTINCT '' AS root, package_path AS node FROM files WHERE starts_with(path, 'cmd/')")
SQL_WHOLE = f"""{WITH_SQL}, {FOLDER}, {closure_sql("reach", "edges", IMPORT_SEEDS)}, {ALL_CMD},
violations AS ({SQL_LAYERS} UNION ALL {SQL_VENDOR} UNION ALL {SQL_MAINS} UNION ALL {SQL_RANGE} UNION ALL {SQL_FOLDER} UNION ALL {SQL_REACH} UNION ALL {SQL_UNREACH}
UNION ALL {edge_sql("not-in-allowed", SQL_ALLOWED_WHERE, "info", "not-in-allowed")} UNION ALL {SQL_REQUIRED})"""

#: A baseline that knows every second layer violation of the tables, and two entries that nobody violates.
BASELINE_SQL = f"""{WITH_SQL}, violations AS ({SQL_LAYERS} UNION ALL {SQL_MAINS}),
ids AS (SELECT DISTINCT rule, from_path, CASE WHEN to_path IS NOT NULL THEN coalesce(nullif(to_import, ''), to_path) END AS target FROM violations),
baseline AS (SELECT * FROM ids WHERE regexp_matches(from_path, '[02468](_test)?\\.go$') UNION ALL SELECT 'entry-no-part', 'cmd/gone.go', '{MODULE}/internal/part/p1' UNION ALL SELECT 'urgent-main', 'cmd/gone.go', NULL)"""
BASELINE_DOCUMENT = {"forbidden": [LAYERS, MAINS]}


def _baseline(s: Source) -> tuple[DataFrame, DataFrame]:
    found = written(s.violations(BASELINE_DOCUMENT), "violations")
    known = base.generate(found).where(F.col("from").rlike(r"[02468](_test)?\.go\z"))
    gone = base.frame(s.spark, [base.Entry("entry-no-part", "cmd/gone.go", f"{MODULE}/internal/part/p1"), base.Entry("urgent-main", "cmd/gone.go")])
    return found, written(known.unionByName(gone), "baseline")


def _unstable_rows(s: Source) -> DataFrame:
    return s.evaluation.folder_rows(True).where(more_unstable(F.col("from_in"), F.col("from_out"), F.col("to_in"), F.col("to_out")))


def _forward(s: Source, back: bool = False, plain: bool = False) -> DataFrame:
    graph = s.graph.kept()
    edges = graph.edges_without(F.col("path").rlike(r"_test\.go\z")) if plain else graph.edges
    start = graph.nodes.where(F.col("package_path").startswith("internal/region/" if back else "cmd/"))
    seeds = start.select(F.col("package_path").alias("root"), F.col("package_path").alias("node"))
    return (closure.reverse_closure if back else closure.forward_closure)(edges, seeds)  # seeds are nodes


SMALL_PARTS = "p_type = 'PROMO' AND p_size = 1"


def _clean_paths(s: Source) -> DataFrame:
    """A path of each part, written in one of five odd ways."""
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    ways = [("internal//part/./", "/"), ("./cmd/../internal/part/", ""), ("/../part/", "/.."), ("../../part//", ""), ("part/", "/../..")]
    raw = F.concat(F.lit(ways[0][0]), name, F.lit(ways[0][1]))
    for k, (head, tail) in enumerate(ways[1:], 1):
        raw = F.when(F.col("p_size") % 5 == k, F.concat(F.lit(head), name, F.lit(tail))).otherwise(raw)
    return s.spark.read.parquet(f"{s.sf_dir}/part.parquet").select("p_partkey", cleaned(raw).alias("path"))


def _cyclic_closure(s: Source) -> DataFrame:
    """From all small parts of one type; keys of parts stand for their packages
    until the end."""
    parts = s.spark.read.parquet(f"{s.sf_dir}/part.parquet").where(SMALL_PARTS)
    pairs = Condensed(derived.sequel_keys(s.spark, s.sf_dir)).closure(parts.select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("node")))
    return pairs.select(derived.part_package("root").alias("root"), derived.part_package("node").alias("node"))


def _rule_query(document: dict) -> Callable[[Source], DataFrame]:
    return lambda s: flat(s.violations(document))


def forbidden(*found: dict) -> Callable[[Source], DataFrame]:
    return _rule_query({"forbidden": list(found)})


def _scanned(s: Source) -> DataFrame:
    """Source texts, parsed and classified again."""
    parsed = parse_sources(derived.sources(s.spark, s.sf_dir))
    files, imports = relations(parsed, MODULE)
    return files.join(imports, "path", "left").select("path", "package_path", "package", "package_line", "import_path", "resolved_path", "dependency_type", "line")


def _scanned_tree(s: Source) -> DataFrame:
    """The same texts as files of a tree, listed, parsed and classified. Beside
    them lie files that don't parse, in folders that are skipped."""
    nations = s.spark.read.parquet(f"{s.sf_dir}/nation.parquet")
    folder = F.element_at(F.array(*map(F.lit, ("vendor/", "cmd/testdata/", "_old/", "internal/.cache/"))), F.col("n_nationkey") % 4 + 1)
    skipped = nations.select(F.concat(folder, F.col("n_name"), F.lit("/x.go")).alias("path"), F.lit("no source").alias("text"))
    files, imports = scan_written(derived.sources(s.spark, s.sf_dir).select("path", "text").unionByName(skipped), Module(MODULE))
    return files.join(imports, "path", "left").select("path", "package_path", "package", "package_line", "import_path", "resolved_path", "dependency_type", "line")


#: A rule document for each customer; two in three have something wrong.
def _config_errors(s: Source) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    severity = F.when(key % 3 == 1, F.concat(F.lit("grave"), key.cast("string"))).otherwise("warn")
    more = F.when(key % 3 == 2, F.concat(F.lit(', "x'), key.cast("string"), F.lit('": 1'))).otherwise("")
    text = F.concat(F.lit('{"forbidden": [{"name": "'), name, F.lit('",\n "severity": "'), severity, F.lit('", "from": {}, "to": {}'), more, F.lit("}]}"))
    documents = s.spark.read.parquet(f"{s.sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"), text.alias("document"))
    return rules.check_documents(documents)


CONFIG_ERRORS_SQL = """SELECT c_custkey::BIGINT AS id, CASE c_custkey % 3 WHEN 1 THEN '$.forbidden[0].severity' WHEN 2 THEN '$.forbidden[0].x' || c_custkey END AS at,
  CASE WHEN c_custkey % 3 > 0 THEN 2 END AS line, CASE c_custkey % 3 WHEN 1 THEN length(' "severity": ') + 1 WHEN 2 THEN length(' "severity": "warn", "from": {}, "to": {}, ') + 1 END AS col,
  CASE c_custkey % 3 WHEN 1 THEN 'unknown severity "grave' || c_custkey || '"' WHEN 2 THEN 'unknown field "x' || c_custkey || '"' END AS message FROM customer"""

SCAN_SQL = f"""{WITH_SQL}, again AS ({classify_sql(f"SELECT path, regexp_replace(import_path, '[ #]', '-', 'g') AS import_path, line FROM ({RAW_IMPORTS_SQL})", MODULE)})
SELECT path, package_path, package, package_line, import_path, resolved_path, dependency_type, line FROM files LEFT JOIN again USING (path)"""

_GRAPH_ROWS = """label AS (SELECT *, row_number() OVER (ORDER BY rule, severity, from_path, from_line, coalesce(to_path, ''), coalesce(to_type, ''), kind, coalesce(to_import, '')) AS pos FROM violations)"""

#: name: (query over a Source, SQL)
CATALOGUE: dict[str, tuple[Callable[[Source], DataFrame], str]] = {
    "q_files": (lambda s: s.files, f"{WITH_SQL} SELECT path, package_path, package, package_line FROM files"),
    "q_imports": (lambda s: s.imports.select("path", "import_path", "line"), f"{WITH_SQL} SELECT path, import_path, line FROM imports"),
    "q_classify": (lambda s: s.imports.groupBy("import_path", "resolved_path", "dependency_type").agg(F.count(F.lit(1)).alias("n")), f"{WITH_SQL} SELECT import_path, resolved_path, dependency_type, count(*) AS n FROM imports GROUP BY ALL"),
    "q_classify_pages": (lambda s: derived.page_imports(s.spark, s.sf_dir), classify_sql("SELECT page_id, regexp_replace(url, '^https?://', '') AS import_path FROM pages", "example.com")),
    "q_clean_paths": (
        _clean_paths,
        """SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'internal/part/p' || p_partkey WHEN 2 THEN '/part' WHEN 3 THEN '../../part/p' || p_partkey WHEN 4 THEN '.' ELSE 'internal/part/p' || p_partkey END AS path FROM part""",
    ),
    "q_type_counts": (lambda s: s.imports.groupBy("dependency_type").agg(F.count(F.lit(1)).alias("n")), f"{WITH_SQL} SELECT dependency_type, count(*) AS n FROM imports GROUP BY 1"),
    "q_edges": (lambda s: s.graph.edges, f"{WITH_SQL} SELECT src, dst FROM edges"),
    "q_edge_provenance": (lambda s: s.graph.provenance, f"{WITH_SQL} SELECT src, dst, path FROM provenance"),
    "q_nodes": (lambda s: s.graph.nodes, f"{WITH_SQL} SELECT package_path FROM nodes"),
    "q_scanned_packages": (lambda s: s.graph.packages.orderBy("package_path"), f"{WITH_SQL} SELECT DISTINCT package_path FROM files"),
    "q_imported": (lambda s: s.graph.imported, f"{WITH_SQL} SELECT DISTINCT dst AS package_path FROM local"),
    "q_dependents": (lambda s: s.graph.dependents("internal/nation/n3"), f"{WITH_SQL} SELECT src AS package_path FROM edges WHERE dst = 'internal/nation/n3'"),
    "q_dependencies": (lambda s: s.graph.dependencies("internal/part/p1"), f"{WITH_SQL} SELECT dst AS package_path FROM edges WHERE src = 'internal/part/p1'"),
    "q_fan_in": (lambda s: s.graph.fan_in, f"{WITH_SQL} SELECT * FROM fan_in"),
    "q_fan_out": (lambda s: s.graph.fan_out, f"{WITH_SQL} SELECT * FROM fan_out"),
    "q_file_facts": (lambda s: s.graph.facts, f"{WITH_SQL} SELECT path, package_path, package, package_line, dependents, orphan FROM facts"),
    "q_orphans": (lambda s: s.graph.facts.where("orphan").select("path"), f"{WITH_SQL} SELECT path FROM facts WHERE orphan"),
    "q_instability": (lambda s: s.graph.instability, f"{WITH_SQL} SELECT package_path, fan_in, fan_out, CASE WHEN fan_in + fan_out = 0 THEN 0.0::DOUBLE ELSE fan_out::DOUBLE / (fan_in + fan_out)::DOUBLE END AS instability FROM stability"),
    "q_more_unstable_edges": (lambda s: _unstable_rows(s).select("src", "dst"), f"{WITH_SQL}, {FOLDER} SELECT src, dst FROM folder WHERE unstable"),
    "q_more_unstable_module": (forbidden(UNSTABLE_MODULE), f"{WITH_SQL}, {FOLDER} " + edge_sql("stable-dependencies", "dependency_type = 'local' AND EXISTS (SELECT 1 FROM folder WHERE src = wide.package_path AND dst = wide.resolved_path AND unstable)", "error")),
    "q_more_unstable_folder": (forbidden(UNSTABLE_FOLDER), f"{WITH_SQL}, {FOLDER} " + folder_sql("stable-folders", "unstable")),
    "q_forward_closure": (_forward, f"{WITH_SQL}, {closure_sql('c', 'edges', CMD_SEEDS)} SELECT root, node FROM c"),
    "q_forward_closure_filtered": (lambda s: _forward(s, plain=True), f"{WITH_SQL}, {PLAIN}, {closure_sql('c', 'plain', CMD_SEEDS)} SELECT root, node FROM c"),
    "q_reverse_closure": (lambda s: _forward(s, back=True), f"{WITH_SQL}, {closure_sql('c', 'edges', CMD_SEEDS.replace('cmd/', 'internal/region/'), back=True)} SELECT root, node FROM c"),
    "q_scc": (
        lambda s: components(derived.sequels(s.spark, s.sf_dir)),
        f"""WITH RECURSIVE e AS ({SEQUELS_SQL}), {closure_sql("c", "e", "SELECT src AS root, src AS node FROM e UNION SELECT dst, dst FROM e")}
SELECT a.root AS node, min(b.root) AS component FROM c a JOIN c b ON a.root = b.node AND a.node = b.root GROUP BY a.root""",
    ),
    "q_cyclic_closure": (
        _cyclic_closure,
        f"""WITH RECURSIVE e AS ({SEQUELS_SQL}), {closure_sql("c", "e", f"SELECT 'internal/part/p' || p_partkey AS root, 'internal/part/p' || p_partkey AS node FROM part WHERE {SMALL_PARTS}")} SELECT root, node FROM c""",
    ),
    "q_forbidden_edge": (forbidden(LAYERS), f"{WITH_SQL} {SQL_LAYERS}"),
    "q_forbidden_capture": (forbidden(OWN_KEY), f"{WITH_SQL} " + edge_sql("same-digit", "regexp_matches(path, '^cmd/[a-z]+/c([0-9])') AND regexp_matches(target, '^internal/part/p(?:' || regexp_escape(regexp_extract(path, '^cmd/[a-z]+/c([0-9])', 1)) || ')')")),
    "q_forbidden_types": (forbidden(VENDOR), f"{WITH_SQL} {SQL_VENDOR}"),
    "q_forbidden_types_not": (forbidden(NOT_TYPES), f"{WITH_SQL} " + edge_sql("own-or-std", "starts_with(path, 'internal/') AND dependency_type NOT IN ('local', 'stdlib')")),
    "q_forbidden_many": (forbidden(LAYERS, OWN_KEY, VENDOR, NOT_TYPES), f"{WITH_SQL} {SQL_LAYERS} UNION ALL {SQL_VENDOR} UNION ALL " + edge_sql("own-or-std", "starts_with(path, 'internal/') AND dependency_type NOT IN ('local', 'stdlib')") + " UNION ALL " + edge_sql("same-digit", "regexp_matches(path, '^cmd/[a-z]+/c([0-9])') AND regexp_matches(target, '^internal/part/p(?:' || regexp_escape(regexp_extract(path, '^cmd/[a-z]+/c([0-9])', 1)) || ')')")),
    "q_forbidden_256": (
        forbidden(*MANY),
        f"{WITH_SQL}, many AS (SELECT *, regexp_extract(CASE WHEN starts_with(path, 'cmd/') THEN target ELSE path END, '^internal/part/p([0-9]+)' || CASE WHEN starts_with(path, 'cmd/') THEN '$' ELSE '/' END, 1) AS part FROM wide WHERE starts_with(path, 'cmd/') OR starts_with(target, 'internal/supplier/'))\n"
        + edge_sql("part-000", "part <> '' AND part::BIGINT < 256 AND (part::BIGINT % 3 > 0) = starts_with(path, 'cmd/')").replace("'part-000' AS rule, 'warn'", "'part-' || lpad(part, 3, '0') AS rule, ['info', 'warn', 'error'][part::BIGINT % 3 + 1]").replace("FROM wide", "FROM many"),
    ),
    "q_required_many": (
        _rule_query({"required": [{"name": f"part-{i:03d}", "from": {"path": [f"^internal/part/p{i}/"]}, "to": {"path": [f"^internal/supplier/s[0-9]*{i % 10}$"]}} for i in range(100)]}),
        f"{WITH_SQL}, asked AS (SELECT *, regexp_extract(path, '^internal/part/p([0-9]+)/', 1) AS part FROM facts) "
        + source_sql("part-", "part <> '' AND part::BIGINT < 100 AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.path = asked.path AND regexp_matches(w.target, '^internal/supplier/s[0-9]*' || (asked.part::BIGINT % 10) || '$'))", kind="required", table="asked").replace("'part-' AS rule", "'part-' || lpad(part, 3, '0') AS rule"),
    ),
    "q_source_package_name": (forbidden(MAINS), f"{WITH_SQL} {SQL_MAINS}"),
    "q_source_dependents_lt": (forbidden(LESS), f"{WITH_SQL} " + source_sql("few-dependents", "starts_with(path, 'internal/supplier/') AND dependents < 12")),
    "q_source_dependents_gt": (forbidden(MORE), f"{WITH_SQL} " + source_sql("hub", "dependents > 15")),
    "q_source_dependents_range": (forbidden(RANGE), f"{WITH_SQL} {SQL_RANGE}"),
    "q_source_orphan": (forbidden(ORPHAN), f"{WITH_SQL} " + source_sql("orphans", "starts_with(path, 'cmd/') AND orphan")),
    "q_folder_scope": (forbidden(FOLDER_RULE), f"{WITH_SQL}, {FOLDER} {SQL_FOLDER}"),
    "q_folder_dependents": (forbidden(FOLDER_DEPENDENTS), f"{WITH_SQL}, {FOLDER} " + folder_sql("busy-folders", "dependents > 3")),
    "q_reachable": (forbidden(REACH), f"{WITH_SQL}, {closure_sql('reach', 'edges', IMPORT_SEEDS)} {SQL_REACH}"),
    "q_reachable_filtered": (forbidden(REACH_PLAIN), f"{WITH_SQL}, {PLAIN}, {closure_sql('reach', 'plain', IMPORT_SEEDS)} " + reach_sql("reaches-region-plain", "regexp_matches(l.path, '^cmd/[a-m]') AND NOT regexp_matches(l.path, '_test\\.go$') AND (starts_with(c.node, 'internal/region/') OR regexp_matches(c.node, '^internal/nation/n1$'))")),
    "q_unreachable": (forbidden(UNREACH), f"{WITH_SQL}, {ALL_CMD} {SQL_UNREACH}"),
    "q_unreachable_filtered": (forbidden(UNREACH_PLAIN), f"{WITH_SQL}, {PLAIN}, {ALL_CMD.replace('JOIN edges', 'JOIN plain')} " + source_sql("dead-but-tests", "regexp_matches(package_path, '^internal/(part|supplier)/') AND package_path NOT IN (SELECT node FROM allcmd)", "info", "unreachable")),
    "q_allowed": (_rule_query({"allowed": ALLOWED, "allowedSeverity": "error"}), f"{WITH_SQL} " + edge_sql("not-in-allowed", SQL_ALLOWED_WHERE, "error", "not-in-allowed")),
    "q_allowed_empty": (_rule_query({"allowed": []}), f"{WITH_SQL} " + edge_sql("not-in-allowed", "true", "warn", "not-in-allowed")),
    "q_required": (_rule_query({"required": [REQUIRED]}), f"{WITH_SQL} {SQL_REQUIRED}"),
    "q_required_capture": (_rule_query({"required": [REQUIRED_CAPTURE]}), f"{WITH_SQL} " + source_sql("same-end", "starts_with(path, 'internal/part/p') AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.path = facts.path AND regexp_matches(w.target, '^internal/supplier/s[0-9]*(?:' || regexp_extract(facts.path, '^internal/part/p[0-9]*([0-9])/', 1) || ')$'))", "error", "required")),
    "q_baseline_generate": (lambda s: base.generate(s.violations(BASELINE_DOCUMENT)).withColumnsRenamed({"from": "from_path", "to": "target"}), f"{BASELINE_SQL} SELECT rule, from_path, target FROM ids"),
    "q_baseline_order": (
        lambda s: frames.placed(base.generate(s.violations(BASELINE_DOCUMENT)), ["rule", "from", F.col("to").asc_nulls_first()]).withColumnsRenamed({"from": "from_path", "to": "target"}),
        f"{BASELINE_SQL} SELECT rule, from_path, target, row_number() OVER (ORDER BY rule, from_path, target NULLS FIRST) AS pos FROM ids",
    ),
    "q_baseline_known": (lambda s: flat(base.known(*_baseline(s))), f"{BASELINE_SQL} SELECT v.* FROM violations v WHERE EXISTS (SELECT 1 FROM baseline b WHERE b.rule = v.rule AND b.from_path = v.from_path AND b.target IS NOT DISTINCT FROM coalesce(nullif(v.to_import, ''), v.to_path))"),
    "q_baseline_new": (lambda s: flat(base.new(*_baseline(s))), f"{BASELINE_SQL} SELECT v.* FROM violations v WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE b.rule = v.rule AND b.from_path = v.from_path AND b.target IS NOT DISTINCT FROM coalesce(nullif(v.to_import, ''), v.to_path))"),
    "q_baseline_stored": (lambda s: flat(base.new(*map(base.stored, _baseline(s)))), f"{BASELINE_SQL} SELECT v.* FROM violations v WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE b.rule = v.rule AND b.from_path = v.from_path AND b.target IS NOT DISTINCT FROM coalesce(nullif(v.to_import, ''), v.to_path))"),
    "q_baseline_stale": (lambda s: base.stale(*_baseline(s)).withColumnsRenamed({"from": "from_path", "to": "target"}), f"{BASELINE_SQL} SELECT rule, from_path, target FROM baseline EXCEPT SELECT rule, from_path, target FROM ids"),
    "q_violations_all": (_rule_query(WHOLE), f"{SQL_WHOLE} SELECT * FROM violations"),
    "q_summary": (lambda s: base.summary(s.violations(WHOLE)), f"{SQL_WHOLE} SELECT count(*) AS total, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'ignore') AS ignore FROM violations"),
    "q_exit_code": (lambda s: base.exit_code(s.violations(WHOLE)), f"{SQL_WHOLE} SELECT least(count(*) FILTER (severity = 'error'), 255) AS exit_code FROM violations"),
    "q_summary_stale": (
        lambda s: base.summary(*(f(*pair) for pair in [_baseline(s)] for f in (base.new, base.stale))),
        f"""{BASELINE_SQL}, fresh AS (SELECT v.severity FROM violations v WHERE NOT EXISTS (SELECT 1 FROM baseline b WHERE b.rule = v.rule AND b.from_path = v.from_path AND b.target IS NOT DISTINCT FROM coalesce(nullif(v.to_import, ''), v.to_path))
  UNION ALL SELECT 'error' FROM (SELECT rule, from_path, target FROM baseline EXCEPT SELECT rule, from_path, target FROM ids))
SELECT count(*) AS total, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'ignore') AS ignore FROM fresh""",
    ),
    "q_report_order": (
        lambda s: flat(frames.positioned(s.violations(WHOLE)), "pos"),
        f"{SQL_WHOLE} SELECT *, row_number() OVER (ORDER BY rule, severity, from_path, from_line, coalesce(to_path, ''), coalesce(to_type, ''), kind, coalesce(to_import, '')) AS pos FROM violations",
    ),
    "q_scan": (_scanned, SCAN_SQL),
    "q_scan_tree": (_scanned_tree, SCAN_SQL),
    "q_config_errors": (_config_errors, CONFIG_ERRORS_SQL),
    "q_json_lines": (
        lambda s: frames.json_lines(s.violations(BASELINE_DOCUMENT)),
        f"""{BASELINE_SQL} SELECT to_json({{'rule': rule, 'comment': CASE rule WHEN 'entry-no-part' THEN 'go through  a service' ELSE '' END, 'severity': severity, 'kind': kind, 'from': {{'path': from_path, 'line': from_line, 'packageName': from_package}},
  'to': CASE WHEN to_path IS NOT NULL THEN {{'path': to_path, 'importPath': to_import, 'dependencyType': to_type}} END}})::VARCHAR AS line FROM violations""",
    ),
    "q_dot_edges": (
        lambda s: frames.dot_edges(s.violations(BASELINE_DOCUMENT)),
        f"""{BASELINE_SQL}, {_GRAPH_ROWS}, ends AS (SELECT 0 AS kind, from_path AS path, '' AS type, pos * 2 AS place FROM label UNION ALL SELECT 1, to_path, coalesce(to_type, ''), pos * 2 + 1 FROM label WHERE to_path IS NOT NULL),
drawn_nodes AS (SELECT kind, path, type, 'n' || (row_number() OVER (ORDER BY min(place)) - 1) AS id FROM ends GROUP BY kind, path, type),
drawn AS (SELECT from_path, to_path, coalesce(to_type, '') AS to_type, from_line, min(pos) AS place, string_agg(rule || ' [' || severity || ']', '; ' ORDER BY pos) AS said FROM label WHERE to_path IS NOT NULL GROUP BY from_path, to_path, coalesce(to_type, ''), from_line)
SELECT place, '  ' || a.id || ' -> ' || b.id || ' [label="line ' || from_line || ': ' || said || '", color="#cf222e", penwidth=3];' AS line
FROM drawn JOIN drawn_nodes a ON a.kind = 0 AND a.path = from_path JOIN drawn_nodes b ON b.kind = 1 AND b.path = to_path AND b.type = to_type""",
    ),
    "q_err_lines": (
        lambda s: frames.err_lines(s.violations(BASELINE_DOCUMENT)),
        f"""{BASELINE_SQL} SELECT '[' || severity || '] rule "' || rule || '": ' || from_path || CASE WHEN from_line <> 0 THEN ':' || from_line ELSE '' END
  || CASE WHEN to_path IS NULL THEN ': forbidden source' ELSE ' -> ' || to_path || ' (' || to_type || '): forbidden dependency' END
  || CASE rule WHEN 'entry-no-part' THEN chr(10) || '  fix: go through a service' ELSE '' END AS line FROM violations""",
    ),
    "q_graph_nodes": (
        lambda s: frames.graph_nodes(s.violations(BASELINE_DOCUMENT)),
        f"""{BASELINE_SQL}, {_GRAPH_ROWS} SELECT kind, path, type, min(place) AS first, coalesce(string_agg(said, '; ' ORDER BY pos), '') AS labels FROM (
  SELECT 0 AS kind, from_path AS path, '' AS type, pos * 2 AS place, pos, CASE WHEN to_path IS NULL THEN rule || ' [' || severity || '] @ line ' || from_line END AS said FROM label
  UNION ALL SELECT 1, to_path, coalesce(to_type, ''), pos * 2 + 1, pos, NULL FROM label WHERE to_path IS NOT NULL) GROUP BY kind, path, type""",
    ),
    "q_graph_edges": (lambda s: frames.graph_edges(s.violations(BASELINE_DOCUMENT)), f"{BASELINE_SQL}, {_GRAPH_ROWS} SELECT from_path, to_path, coalesce(to_type, '') AS to_type, from_line AS line, min(pos) AS first, string_agg(rule || ' [' || severity || ']', '; ' ORDER BY pos) AS labels FROM label WHERE to_path IS NOT NULL GROUP BY from_path, to_path, to_type, from_line"),
}


def queries() -> dict[str, Query]:
    return {name: lambda spark, sf_dir, run=run: run(Source(spark, sf_dir)) for name, (run, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rule document, in report order."""
    return flat(ordered(Source(spark, sf_dir).violations(WHOLE)))
