"""Known violations by exact identity: rule, source path, and raw import path
or target path where there is a target. What a baseline lists and nobody
violates any more is stale, which counts as an error."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.config import quoted
from ruleloom.schema import BASELINE
from ruleloom.shared import shared_path


class BaselineError(ValueError):
    pass


@dataclass(frozen=True)
class Entry:
    rule: str
    source: str
    target: str | None = None


def check_entries(entries: list[Entry]) -> list[Entry]:
    seen: dict[Entry, int] = {}
    for i, e in enumerate(entries):
        for name, value in (("rule", e.rule), ("from", e.source), ("to", e.target)):
            if value == "":
                raise BaselineError(f"baseline entry {i}: {name} must not be empty")
        if e in seen:
            raise BaselineError(f"baseline entry {i} duplicates entry {seen[e]}")
        seen[e] = i
    return entries


def _members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, value in pairs:
        if name in out:
            raise BaselineError(f"decode baseline: duplicate field {quoted(name)}")
        out[name] = value
    return out


def parse(data: bytes | str) -> list[Entry]:
    """Entries of a baseline document. Field names are matched exactly."""
    try:
        root = json.loads(data, object_pairs_hook=_members)
    except json.JSONDecodeError as error:
        raise BaselineError(f"decode baseline: {error}") from None
    if not isinstance(root, dict):
        raise BaselineError("decode baseline: document must be an object")
    if "entries" not in root:
        raise BaselineError("decode baseline: entries is required")
    if unknown := root.keys() - {"entries"}:
        raise BaselineError(f"decode baseline: unknown field {quoted(min(unknown))}")
    if not isinstance(root["entries"], list):
        raise BaselineError("decode baseline: entries must be an array")
    out = []
    for i, e in enumerate(root["entries"]):
        if not isinstance(e, dict):
            raise BaselineError(f"decode baseline: entry {i} must be an object")
        if unknown := e.keys() - {"rule", "from", "to"}:
            raise BaselineError(f"decode baseline: unknown field {quoted(min(unknown))}")
        if "to" in e and e["to"] is None:
            raise BaselineError(f"decode baseline: entry {i}: to must not be null")
        if not all(isinstance(v, str) for v in e.values()):
            raise BaselineError(f"decode baseline: entry {i}: values must be strings")
        out.append(Entry(e.get("rule", ""), e.get("from", ""), e.get("to")))
    return check_entries(out)


def load(reader: Any) -> list[Entry]:
    return parse(reader.read())


def load_file(name: str) -> list[Entry]:
    with open(name, "rb") as f:
        return parse(f.read())


def order_key(e: Entry) -> tuple:
    return e.rule.encode(), e.source.encode(), e.target is not None, (e.target or "").encode()


def dumps(entries: list[Entry]) -> str:
    """The canonical document."""
    rows = [{"rule": e.rule, "from": e.source} | ({"to": e.target} if e.target is not None else {}) for e in sorted(check_entries(entries), key=order_key)]
    return json.dumps({"entries": rows}, indent=2, ensure_ascii=False).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029") + "\n"


def frame(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    return spark.createDataFrame([(e.rule, e.source, e.target) for e in entries], BASELINE)


def key_target() -> Column:
    """What identifies a violation's target: its import path or, without one,
    its path; null without a target."""
    return F.when(F.col("to").isNotNull(), F.coalesce(F.nullif(F.col("to.import_path"), F.lit("")), F.col("to.path")))


#: What identifies a violation; tables are bucketed by it.
KEY = ["k_rule", "k_from", "k_to", "k_has"]


def identified(violations: DataFrame) -> DataFrame:
    """Violations with their ``KEY``; a stored table has it."""
    if set(KEY) <= set(violations.columns):
        return violations
    to = key_target()
    return violations.withColumns({"k_rule": F.col("rule"), "k_from": F.col("from.path"), "k_to": F.coalesce(to, F.lit("")), "k_has": to.isNotNull()})


def keys(baseline: DataFrame) -> DataFrame:
    if set(KEY) <= set(baseline.columns):
        return baseline.select(*KEY)
    return baseline.select(F.col("rule").alias("k_rule"), F.col("from").alias("k_from"), F.coalesce("to", F.lit("")).alias("k_to"), F.col("to").isNotNull().alias("k_has"))


def stored(rows: DataFrame, name: str | None = None, buckets: int | None = None) -> DataFrame:
    """A baseline (rule, from, to) or violations as a table in the shared
    folder, bucketed and sorted by ``KEY``: joins by identity don't shuffle it
    again. Two tables with as many buckets join without a shuffle. Fewer
    buckets than Spark has shuffle partitions would be shuffled for them."""
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"stored_{uuid.uuid4().hex}"
    keyed = identified(rows) if "severity" in rows.columns else keys(rows).distinct()
    writer = keyed.write.bucketBy(max(least, buckets or 0), *KEY).sortBy(*KEY).option("path", shared_path(spark, name))
    writer.saveAsTable(name)
    return spark.table(name)


def generate(violations: DataFrame) -> DataFrame:
    """Distinct identities (rule, from, to)."""
    return identified(violations).select("k_rule", "k_from", "k_to", "k_has").distinct().select(F.col("k_rule").alias("rule"), F.col("k_from").alias("from"), F.when(F.col("k_has"), F.col("k_to")).alias("to"))


def ordered(baseline: DataFrame) -> DataFrame:
    return baseline.orderBy("rule", "from", F.col("to").asc_nulls_first())


def known(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    return identified(violations).join(keys(baseline), KEY, "left_semi").select(*(c for c in violations.columns if c not in KEY))


def new(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    return identified(violations).join(keys(baseline), KEY, "left_anti").select(*(c for c in violations.columns if c not in KEY))


def stale(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    left = keys(baseline).join(identified(violations).select(*KEY).distinct(), KEY, "left_anti")
    return left.select(F.col("k_rule").alias("rule"), F.col("k_from").alias("from"), F.when(F.col("k_has"), F.col("k_to")).alias("to"))


def stale_message(e: Entry) -> str:
    to = f", to {quoted(e.target)}" if e.target is not None else ""
    return f"baseline entry is stale: rule {quoted(e.rule)}, from {quoted(e.source)}{to}; remove this entry from the baseline."


def summary(violations: DataFrame, stale_entries: DataFrame | None = None) -> DataFrame:
    """One row: total, error, warn, info, ignore; stale entries are errors."""
    rows = violations.select("severity")
    if stale_entries is not None:
        rows = rows.unionByName(stale_entries.select(F.lit("error").alias("severity")))
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info", "ignore")))


def exit_code(violations: DataFrame, stale_entries: DataFrame | None = None) -> DataFrame:
    return summary(violations, stale_entries).select(F.least("error", F.lit(255)).alias("exit_code"))
