"""Rules as column predicates and plans.

A rule has a shape (edge, source, folder, reach or unreach; allowed, required).
All rules of a shape are evaluated in one pass over their rows (``index.hits``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.config import NOT_IN_ALLOWED, Config, From, Rule
from ruleloom.functions.literals import SEPARATOR, antichain, backreferring, plain
from ruleloom.functions.re2 import Pattern, Template
from ruleloom.operators.graph import Graph, more_unstable
from ruleloom.operators.labels import bit, reached, spread
from ruleloom.operators.resolve import cleaned, target_path
from ruleloom.plans.index import TOGETHER, hits, source_prefixes
from ruleloom.schema import SOURCE, TARGET, VIOLATIONS
from ruleloom.shared import written

def any_matches(column: Column, patterns: tuple[Pattern, ...]) -> Column:
    return reduce(lambda a, b: a | b, (column.rlike(p.java) for p in patterns), F.lit(False))


def captures(column: Column, patterns: tuple[Pattern, ...], highest: int) -> Column:
    """Captures 1 to ``highest`` of the first declared pattern that matches;
    a group that takes no part is empty."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for p in patterns:
        out = out.when(column.rlike(p.java), F.array(*(F.regexp_extract(column, p.java, i) for i in range(1, highest + 1))))
    return out


def template_matches(column: Column, templates: tuple[Template, ...], found: Column | None) -> Column:
    """``found`` has the captures. No row brings a pattern of its own: text
    and captures are compared, and what else there is refers back to captures
    that stand before the text."""

    def one(t: Template) -> Column:
        if not t.highest or found is None:
            return column.rlike("".join(map(str, t.java)))
        if simple := plain(t):
            text = F.concat(*(F.lit(p) if isinstance(p, str) else found[p - 1] for p in simple.parts))
            if simple.first and simple.last:
                return column == text
            return column.startswith(text) if simple.first else column.endswith(text) if simple.last else F.contains(column, text)
        held = [found[i] for i in range(t.highest)]
        usual = F.concat(*(x for c in held for x in (c, F.lit(SEPARATOR))), column).rlike(backreferring(t))
        odd = reduce(lambda a, b: a | b, (F.contains(c, F.lit(SEPARATOR)) for c in (column, *held)))
        return F.when(odd, expanded_match(column, t, found)).otherwise(usual)

    return reduce(lambda a, b: a | b, map(one, templates), F.lit(False))


def expanded_match(column: Column, t: Template, found: Column) -> Column:
    """With a pattern for each row; only for text that holds the separator."""
    parts = [F.lit(p) if isinstance(p, str) else F.concat(F.lit("(?:"), F.regexp_replace(found[p - 1], r"([\\.+*?()|\[\]{}^$#&~\-\s])", r"\\$1"), F.lit(")")) for p in t.java]
    return F.regexp_like(column, F.concat(*parts))


def from_matches(rule: From, path: Column, facts: bool = True) -> Column:
    """``facts``: the row has package, orphan and dependents; a folder row has
    dependents alone."""
    tests: list[Column] = []  # cheap ones first
    if rule.orphan is not None and facts:
        tests.append(F.col("orphan") == F.lit(rule.orphan))
    if rule.less_than is not None:
        tests.append(F.col("dependents") < rule.less_than)
    if rule.more_than is not None:
        tests.append(F.col("dependents") > rule.more_than)
    if rule.package_name and facts:
        tests.append(any_matches(F.col("package"), rule.package_name))
    if rule.path:
        tests.append(any_matches(path, rule.path))
    if rule.path_not:
        tests.append(~any_matches(path, rule.path_not))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def to_matches(rule: Rule, path: Column, target: Column, kind: Column | None) -> Column:
    to, tests = rule.target, []
    if kind is not None and to.types:
        tests.append(kind.isin(*to.types))
    if kind is not None and to.types_not:
        tests.append(~kind.isin(*to.types_not))
    if to.more_unstable:
        unstable = more_unstable(F.col("from_in"), F.col("from_out"), F.col("to_in"), F.col("to_out"))
        tests.append((kind == "local" if kind is not None else F.lit(True)) & F.coalesce(unstable, F.lit(False)))
    found = captures(path, rule.source.path, to.highest) if to.highest else None
    if to.path:
        tests.append(template_matches(target, to.path, found))
    if to.path_not:
        tests.append(~template_matches(target, to.path_not, found))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def possible_target(rule: Rule, target: Column) -> Column:
    """Can the rule match the target, whatever the source? Patterns with
    captures aren't looked at."""
    to, tests = rule.target, []
    if to.path and not any(t.highest for t in to.path):
        tests.append(template_matches(target, to.path, None))
    if plain := tuple(t for t in to.path_not if not t.highest):
        tests.append(~template_matches(target, plain, None))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def shape(rule: Rule) -> str:
    """How a forbidden rule is evaluated."""
    s = rule.source
    if rule.scope == "folder":
        return "folder"
    if rule.target.reachable is not None:
        return "reach" if rule.target.reachable else "unreach"
    alone = s.orphan is not None or s.package_name or s.less_than is not None or s.more_than is not None
    return "source" if alone and rule.target.empty else "edge"


@dataclass
class Evaluation:
    """One run over a set of files and imports."""

    files: DataFrame
    imports: DataFrame

    def __post_init__(self) -> None:
        self.graph = Graph(self.files, self.imports)
        self.shown: tuple[list[tuple[Pattern, ...]], DataFrame] | None = None

    # Rows that rules look at

    def edge_rows(self, unstable: bool, only: list[Rule] | None = None) -> DataFrame:
        """Imports with their files' facts. If all of the rules ``only`` name
        source paths, other files are dropped before the join."""
        imports = self.imports.withColumn("target", target_path())
        if only and len(only) > TOGETHER:
            begins = antichain([p for r in only for p in source_prefixes(r)])
            if begins[0] and len(begins) <= TOGETHER:
                imports = imports.where(reduce(lambda a, b: a | b, (F.col("path").startswith(p) for p in begins)))
        elif only and all(r.source.path for r in only):
            imports = imports.where(any_matches(F.col("path"), tuple(dict.fromkeys(p for r in only for p in r.source.path))))
        rows = imports.join(self.graph.facts, "path")
        return self.with_stability(rows, cleaned(F.col("package_path")), cleaned(F.col("resolved_path"))) if unstable else rows

    def with_stability(self, rows: DataFrame, src: Column, dst: Column) -> DataFrame:
        s = self.graph.stability
        a = s.select(F.col("package_path").alias("from_pkg"), F.col("fan_in").alias("from_in"), F.col("fan_out").alias("from_out"))
        b = s.select(F.col("package_path").alias("to_pkg"), F.col("fan_in").alias("to_in"), F.col("fan_out").alias("to_out"))
        rows = rows.withColumns({"src_pkg": src, "dst_pkg": dst})
        return rows.join(a, F.col("src_pkg") == F.col("from_pkg"), "left").join(b, F.col("dst_pkg") == F.col("to_pkg"), "left")

    def folder_rows(self, unstable: bool) -> DataFrame:
        counts = self.graph.fan_in.select(F.col("package_path").alias("pkg"), "fan_in")
        rows = self.graph.edges.join(counts, F.col("src") == F.col("pkg"), "left").select("src", "dst", F.coalesce("fan_in", F.lit(0)).alias("dependents"))
        return self.with_stability(rows, F.col("src"), F.col("dst")) if unstable else rows

    # Violations

    def matched(self, rows: DataFrame, rules: list[Rule], test: Callable[[Rule], Column], source: Column, target: Column, kind: str, begins: tuple[Column, Column | None]) -> DataFrame:
        """A row for each (row, rule) that matches. ``begins`` has the columns
        that the rules' source and target patterns are matched with."""
        found = hits(rows, rules, test, *begins).select(source.alias("from"), target.alias("to"), "r")
        return found.select("r.rule", "r.comment", "r.severity", F.lit(kind).alias("kind"), "from", "to")

    def none(self) -> DataFrame:
        return self.files.sparkSession.createDataFrame([], VIOLATIONS)

    def edges(self, rules: list[Rule]) -> DataFrame:
        if not rules:
            return self.none()
        rows = self.edge_rows(any(r.target.more_unstable for r in rules), rules)
        test = lambda r: from_matches(r.source, F.col("path")) & to_matches(r, F.col("path"), F.col("target"), F.col("dependency_type"))
        return self.matched(rows, rules, test, import_source(), import_target(), "forbidden", (F.col("path"), F.col("target")))

    def sources(self, rules: list[Rule]) -> DataFrame:
        if not rules:
            return self.none()
        return self.matched(self.graph.facts, rules, lambda r: from_matches(r.source, F.col("path")), file_source(), no_target(), "forbidden", (F.col("path"), None))

    def folders(self, rules: list[Rule]) -> DataFrame:
        if not rules:
            return self.none()
        rows = self.folder_rows(any(r.target.more_unstable for r in rules))
        test = lambda r: from_matches(r.source, F.col("src"), facts=False) & to_matches(r, F.col("src"), F.col("dst"), None)
        return self.matched(rows, rules, test, source_struct(F.col("src"), F.lit(0), F.lit("")), local_target(F.col("dst")), "forbidden", (F.col("src"), F.col("dst")))

    @cached_property
    def located(self) -> DataFrame:
        """Files with the own packages they import, written once: edges and
        the rows of reach rules both come from it."""
        own = self.imports.where((F.col("dependency_type") == "local") & (F.col("resolved_path") != "")).select("path", "line", cleaned(F.col("resolved_path")).alias("root"))
        return written(self.files.select("path", "package", cleaned(F.col("package_path")).alias("src")).join(own, "path"), "located-imports")

    def view_edges(self, rules: list[Rule]) -> tuple[list[tuple[Pattern, ...]], DataFrame]:
        """The filters of all reach and unreach rules, and (src, dst, views):
        for each filter on the files behind an edge, is some file left? One
        pass for all, kept for rules that ask for no other."""
        views = list(dict.fromkeys(r.target.reachable_file_path_not for r in rules))
        if self.shown and set(views) <= set(self.shown[0]):
            return self.shown
        flags = [F.max(~any_matches(F.col("path"), skip)) if skip else F.max(F.lit(True)) for skip in views]
        rows = self.located.where("src <> '' and src <> root").groupBy("src", F.col("root").alias("dst"))
        self.shown = views, written(rows.agg(F.array(*flags).alias("views")), "view-edges")
        return self.shown

    def reaches(self, rules: list[Rule]) -> DataFrame:
        """One search for all rules and filters: from the distinct packages
        that matching files import to the packages that a rule can name, or
        against the edges where these are fewer."""
        if not rules:
            return self.none()
        views, edges = self.view_edges(rules)
        view = {r: views.index(r.target.reachable_file_path_not) for r in rules}
        own = F.col("path"), F.col("root"), F.col("node")
        in_view = lambda test: F.filter(F.array(*(F.when(reduce(lambda a, b: a | b, (test(r) for r in rules if view[r] == v)), F.lit(v)) for v in sorted(set(view.values())))), lambda x: x.isNotNull())
        facts = [c for c, asked in (("orphan", any(r.source.orphan is not None for r in rules)), ("dependents", any(r.source.less_than is not None or r.source.more_than is not None for r in rules))) if asked]
        rows = self.located.drop("src")
        if facts:
            rows = rows.join(self.graph.facts.select("path", *facts), "path")
        rows = rows.withColumn("in_views", in_view(lambda r: from_matches(r.source, own[0]))).where(F.size("in_views") > 0)
        rows = written(rows, "reach-rows")
        roots = written(rows.select(F.explode("in_views").alias("view"), F.col("root").alias("node")).distinct(), "reach-roots")
        nodes = edges.select(F.col("dst").alias("node")).union(roots.select("node")).distinct()
        targets = written(nodes.select("node", F.explode(in_view(lambda r: possible_target(r, own[2]))).alias("view")), "reach-targets")
        pairs = reached(edges, roots, targets)
        met = rows.join(pairs, "root").groupBy("path", "view", "node").agg(F.min("line").alias("line"), F.first("package").alias("package"), *(F.first(c).alias(c) for c in facts))
        test = lambda r: (F.col("view") == view[r]) & from_matches(r.source, own[0]) & to_matches(r, own[0], own[2], None)
        return self.matched(met, rules, test, source_struct(own[0], F.col("line"), F.col("package")), local_target(own[2]), "reachable", (own[0], own[2]))

    def unreaches(self, rules: list[Rule]) -> DataFrame:
        """One search for all rules and filters: a rule is a bit, packages that
        its files have are where it starts, and files that it asks for and that
        miss its bit are left."""
        if not rules:
            return self.none()
        views, edges = self.view_edges(rules)
        words = [(v, w, [r for r in rules if r.target.reachable_file_path_not == skip][64 * w : 64 * w + 64]) for v, skip in enumerate(views) for w in range(math.ceil(len(rules) / 64))]
        words = [x for x in words if x[2]]

        def masks(test: Callable[[Rule], Column]) -> Column:
            """A struct (view, word, mask) for each word that has a bit."""
            found = []
            for v, w, held in words:
                mask = reduce(Column.bitwiseOR, (F.when(test(r), bit(F.lit(k))).otherwise(F.lit(0)) for k, r in enumerate(held)))
                found.append(F.struct(F.lit(v).alias("view"), F.lit(w).cast("long").alias("word"), mask.cast("long").alias("mask")))
            return F.filter(F.array(*found), lambda x: x["mask"] != 0)

        files = self.graph.facts.withColumn("pkg", cleaned(F.col("package_path")))
        starts, asked = masks(lambda r: from_matches(r.source, F.col("path"))), masks(lambda r: to_matches(r, F.col("path"), F.col("pkg"), None))
        marked = files.select("pkg", file_source().alias("from"), starts.alias("starts"), F.when(F.col("pkg") != "", asked).alias("asked"))
        marked = written(marked.where((F.size("starts") > 0) | (F.size("asked") > 0)), "unreach-files")
        seeds = marked.select(F.col("pkg").alias("node"), F.explode("starts").alias("x")).select("node", "x.*")
        met = spread(edges, seeds).withColumnsRenamed({"node": "pkg", "mask": "met"})
        due = marked.select("pkg", "from", F.explode("asked").alias("x")).select("pkg", "from", "x.*")
        left = due.join(met, ["view", "word", "pkg"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("met", F.lit(0).cast("long"))))).where("mask <> 0")
        names = F.array(*(F.struct(F.lit(v).alias("view"), F.lit(w).cast("long").alias("word"), F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.comment).alias("comment"), F.lit(r.severity).alias("severity")) for r in held)).alias("rules")) for v, w, held in words))
        held = F.filter(names, lambda x: (x["view"] == F.col("view")) & (x["word"] == F.col("word")))[0]["rules"]
        missed = left.withColumn("r", F.explode(F.filter(held, lambda _, k: F.getbit(F.col("mask"), k) == 1)))
        return missed.select("r.rule", "r.comment", "r.severity", F.lit("unreachable").alias("kind"), "from", no_target().alias("to"))

    def not_allowed(self, rules: tuple[Rule, ...], severity: str) -> DataFrame:
        rows = self.edge_rows(False)
        tests = [from_matches(r.source, F.col("path")) & to_matches(r, F.col("path"), F.col("target"), F.col("dependency_type")) for r in rules]
        matches = reduce(lambda a, b: a | b, tests, F.lit(False))
        return rows.where(~matches).select(F.lit(NOT_IN_ALLOWED).alias("rule"), F.lit("").alias("comment"), F.lit(severity).alias("severity"), F.lit(NOT_IN_ALLOWED).alias("kind"), import_source().alias("from"), import_target().alias("to"))

    def requirements(self, rules: list[Rule]) -> DataFrame:
        """Files of each rule without an import that satisfies it: found in
        one pass over imports, and anti-joined in one pass over files."""
        rows = self.edge_rows(False, rules)
        ok = lambda r: from_matches(r.source, F.col("path")) & to_matches(r, F.col("path"), F.col("target"), F.col("dependency_type"))
        satisfied = hits(rows, rules, ok, F.col("path"), F.col("target")).select("path", "r.k").distinct()
        due = hits(self.graph.facts, rules, lambda r: from_matches(r.source, F.col("path")), F.col("path")).select("path", file_source().alias("from"), "r.*")
        missing = due.join(satisfied, ["path", "k"], "left_anti")
        return missing.select("rule", "comment", "severity", F.lit("required").alias("kind"), "from", no_target().alias("to"))

    def violations(self, config: Config) -> DataFrame:
        """Every violation, in no order; one plan."""
        by: dict[str, list[Rule]] = {"edge": [], "source": [], "folder": [], "reach": [], "unreach": []}
        for r in config.forbidden:
            if r.severity != "ignore":
                by[shape(r)].append(r)
        required = [r for r in config.required if r.severity != "ignore"]
        if by["reach"] and by["unreach"]:
            self.view_edges(by["reach"] + by["unreach"])
        parts = []
        for name, run in (("edge", self.edges), ("source", self.sources), ("folder", self.folders), ("reach", self.reaches), ("unreach", self.unreaches)):
            if by[name]:
                parts.append(run(by[name]))
        if config.allowed is not None and config.allowed_severity != "ignore":
            parts.append(self.not_allowed(config.allowed, config.allowed_severity))
        if required:
            parts.append(self.requirements(required))
        return reduce(DataFrame.unionByName, parts) if parts else self.none()


def source_struct(path: Column, line: Column, package: Column) -> Column:
    return F.struct(path.alias("path"), line.cast("int").alias("line"), package.alias("package_name")).cast(SOURCE)


def import_source() -> Column:
    return source_struct(F.col("path"), F.col("line"), F.col("package"))


def file_source() -> Column:
    return source_struct(F.col("path"), F.col("package_line"), F.col("package"))


def import_target() -> Column:
    return F.struct(F.col("target").alias("path"), F.col("import_path"), F.col("dependency_type").alias("type")).cast(TARGET)


def local_target(path: Column) -> Column:
    return F.struct(path.alias("path"), F.lit("").alias("import_path"), F.lit("local").alias("type")).cast(TARGET)


def no_target() -> Column:
    return F.lit(None).cast(TARGET)


ORDER = ("rule", "severity", "from.path", "from.line", "to.path", "to.type", "kind", "to.import_path")


def ordered(violations: DataFrame) -> DataFrame:
    """Violations in report order; what has no target sorts as empty."""
    return violations.orderBy(*(F.coalesce(F.col(c), F.lit("")) if c.startswith("to.") else F.col(c) for c in ORDER))


def evaluate(config: Config, files: DataFrame, imports: DataFrame) -> DataFrame:
    return Evaluation(files, imports).violations(config)
