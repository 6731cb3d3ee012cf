"""Rules over a stream of import rows.

Edge rules that ask for nothing but the row itself (paths, types, package name)
need no state, so a stream of wide rows (imports with their file's package) runs
through the same predicates as a table. Rules that need the graph are refused.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom import config as rules
from ruleloom.operators.resolve import target_path
from ruleloom.plans.rules import from_matches, import_source, import_target, shape, to_matches


def stateless(rule: rules.Rule) -> bool:
    s = rule.source
    return shape(rule) == "edge" and s.orphan is None and s.less_than is None and s.more_than is None and not rule.target.more_unstable


def violations(config: rules.Config | dict[str, Any], rows: DataFrame) -> DataFrame:
    """``rows``: path, package, import_path, resolved_path, dependency_type,
    line; a stream or a table."""
    config = config if isinstance(config, rules.Config) else rules.from_dict(config)
    found = [r for r in config.forbidden if r.severity != "ignore"]
    if bad := [r.name for r in found if not stateless(r)] + [r.name for r in config.required]:
        raise ValueError(f"rules need the whole graph: {', '.join(bad)}")
    rows = rows.withColumn("target", target_path())
    test = lambda r: from_matches(r.source, F.col("path")) & to_matches(r, F.col("path"), F.col("target"), F.col("dependency_type"))
    hits = [F.when(test(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.comment).alias("comment"), F.lit(r.severity).alias("severity"), F.lit("forbidden").alias("kind"))) for r in found]
    if config.allowed is not None and config.allowed_severity != "ignore":
        allowed = F.lit(False)
        for r in config.allowed:
            allowed = allowed | test(r)
        hits.append(F.when(~allowed, F.struct(F.lit(rules.NOT_IN_ALLOWED).alias("rule"), F.lit("").alias("comment"), F.lit(config.allowed_severity).alias("severity"), F.lit(rules.NOT_IN_ALLOWED).alias("kind"))))
    each = F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())) if hits else F.explode(F.array().cast("array<struct<rule:string,comment:string,severity:string,kind:string>>"))
    return rows.select(import_source().alias("from"), import_target().alias("to"), each.alias("r")).select("r.*", "from", "to")
