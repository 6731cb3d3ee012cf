"""The library's front door: rules and a tree in, three kinds of findings out."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ruleloom import config as rules
from ruleloom.operators import baseline as base
from ruleloom.plans.rules import evaluate, ordered
from ruleloom.reports.render import Report, Violation, render
from ruleloom.shared import written
from ruleloom.sources.scan import module_of, scan


@dataclass
class Result:
    """``violations``, ``known`` and ``stale`` as DataFrames, in order.

    ``report`` alone brings them to the driver, for a text that a person reads;
    counts and exit codes are aggregates."""

    violations: DataFrame
    known: DataFrame
    stale: DataFrame

    @cached_property
    def report(self) -> Report:
        stale = [base.Entry(r["rule"], r["from"], r["to"]) for r in self.stale.collect()]
        return Report([Violation.of(r) for r in self.violations.collect()], stale)

    @property
    def error_count(self) -> int:
        return int(base.summary(self.violations, self.stale).first()["error"])

    @property
    def exit_code(self) -> int:
        return min(self.error_count, 255)

    def write(self, kind: str = "err") -> str:
        return render(kind, self.report)


def normalized(config: rules.Config | dict[str, Any]) -> rules.Config:
    """A config, checked: one given as Python values goes through the loader."""
    return config if isinstance(config, rules.Config) else rules.from_dict(config)


def validate_frames(config: rules.Config | dict[str, Any], files: DataFrame, imports: DataFrame, baseline: list[base.Entry] | None = None) -> Result:
    """Evaluate rules over relations that are at hand. Violations are written
    once to the shared folder, as counts, reports and a baseline all read them."""
    spark = files.sparkSession
    found = written(evaluate(normalized(config), files, imports), "violations")
    if baseline is None:
        return Result(ordered(found), found.limit(0), base.frame(spark, []))
    known = base.frame(spark, base.check_entries(baseline))
    return Result(ordered(base.new(found, known)), ordered(base.known(found, known)), base.ordered(base.stale(found, known)))


def validate(spark: SparkSession, config: rules.Config | dict[str, Any], scan_root: str, go_mod: str | None = None, baseline: list[base.Entry] | None = None) -> Result:
    config = normalized(config)
    files, imports = scan(spark, scan_root, module_of(go_mod or os.path.join(scan_root, "go.mod")))
    return validate_frames(config, files, imports, baseline)


def generate_baseline(violations: DataFrame) -> list[base.Entry]:
    return [base.Entry(r["rule"], r["from"], r["to"]) for r in base.ordered(base.generate(violations)).collect()]
