"""Architecture checks inside a test suite."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import SparkSession

from ruleloom import config as rules
from ruleloom.operators.baseline import Entry
from ruleloom.validate import Result, validate

log = logging.getLogger("ruleloom")


class ArchitectureError(AssertionError):
    """The report of a run that found errors."""


def assert_architecture(spark: SparkSession, config: rules.Config | dict[str, Any], scan_root: str, go_mod: str | None = None, baseline: list[Entry] | None = None) -> Result:
    """Raises one report if any error or stale entry is found; logs the report
    if there are only warnings. What keeps a run from being made is raised as
    it is."""
    result = validate(spark, config, scan_root, go_mod, baseline)
    text = result.write("err")
    if result.error_count:
        raise ArchitectureError("\n" + text)
    if text:
        log.warning("%s", text)
    return result
