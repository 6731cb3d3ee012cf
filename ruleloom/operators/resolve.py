"""Classification of imports and identity of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.schema import LOCAL, MODULE, STDLIB, UNRESOLVED


def check_module_path(module: str) -> str:
    """A module path that can be matched; raises for any other."""
    if not module:
        raise ValueError("module path is empty")
    if module != module.strip():
        raise ValueError(f"module path {module!r} has surrounding white space")
    if module.endswith("/"):
        raise ValueError(f"module path {module!r} has a trailing slash")
    return module


def dependency_type(path: Column, module: str) -> Column:
    """Own module first, then dotless first segments (standard library)."""
    return (
        F.when(path.isin("", "C"), UNRESOLVED)
        .when((path == module) | path.startswith(f"{module}/"), LOCAL)
        .when(~F.contains(F.split_part(path, F.lit("/"), F.lit(1)), F.lit(".")), STDLIB)
        .otherwise(MODULE)
    )


def resolved_path(path: Column, module: str) -> Column:
    """Module-relative for own packages, empty for what can't be resolved."""
    return (
        F.when(path.isin("", "C"), "")
        .when(path == module, ".")
        .when(path.startswith(f"{module}/"), F.substring(path, len(module) + 2, F.length(path)))
        .otherwise(path)
    )


def classified(imports: DataFrame, module: str, column: str = "import_path") -> DataFrame:
    module = check_module_path(module)
    path = F.col(column)
    return imports.withColumns({"resolved_path": resolved_path(path, module), "dependency_type": dependency_type(path, module)})


def target_path(resolved: str = "resolved_path", raw: str = "import_path") -> Column:
    """What rules match: the resolved path, or the raw one where it is empty."""
    return F.coalesce(F.nullif(F.col(resolved), F.lit("")), F.col(raw))


def cleaned(path: Column) -> Column:
    """Lexically clean path; empty stays. Paths in normal form, nearly all,
    don't take the slow branch."""

    def step(out: Column, part: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        up = F.when(last.isNull() | (last == ".."), F.when(rooted, out).otherwise(F.concat(out, F.array(F.lit(".."))))).otherwise(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))
        return F.when(part.isin("", "."), out).when(part == "..", up).otherwise(F.concat(out, F.array(part)))

    rooted = path.startswith("/")
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    odd = path.rlike(r"(?:^|/)(?:\.{1,2})?(?:/|$)") & (path != "") & (path != ".")
    return F.when(odd, F.coalesce(F.nullif(joined, F.lit("")), F.lit("."))).otherwise(path)
