"""Small source trees as rows: (path, package, [(line, import path)])."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ruleloom.operators.resolve import classified
from ruleloom.schema import FILES, IMPORTS

M = "example.test/m"


def own(*paths: str, first: int = 3) -> list[tuple[int, str]]:
    return [(first + i, f"{M}/{p}") for i, p in enumerate(paths)]


def relations(spark: SparkSession, tree: list[tuple[str, str, list[tuple[int, str]]]], module: str = M) -> tuple[DataFrame, DataFrame]:
    files = [(p, os.path.dirname(p) or ".", name, 1) for p, name, _ in tree]
    imports = [(p, i, path, line) for p, _, found in tree for i, (line, path) in enumerate(found)]
    frame = spark.createDataFrame(imports, "path string, ordinal int, import_path string, line int")
    return spark.createDataFrame(files, FILES), classified(frame, module).select(*(c.split()[0] for c in IMPORTS.split(", ")))


def write(root, tree: list[tuple[str, str, list[tuple[int, str]]]], module: str = M) -> str:
    """The tree as files with import lines where they belong."""
    (root / "go.mod").write_text(f"module {module}\n\ngo 1.25\n")
    for path, name, found in tree:
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        lines = [f"package {name}"]
        for line, target in found:
            lines += [""] * (line - 1 - len(lines)) + [f'import _ "{target}"']
        f.write_text("\n".join(lines) + "\n")
    return str(root)


#: A shop that bakes: tests reach further than the rest, two files of a package
#: import the same, and two files are on their own.
BAKERY = [
    ("attic/box.go", "attic", []),
    ("cellar/cellar.go", "cellar", []),
    ("fixtures/fixtures.go", "fixtures", own("cellar")),
    ("flour/flour.go", "flour", []),
    ("flour/mill_test.go", "flour_test", own("flour", "fixtures")),
    ("oven/heat/heat.go", "heat", []),
    ("oven/oven.go", "oven", own("oven/heat")),
    ("recipes/bread/bread.go", "bread", own("flour", "oven/heat")),
    ("recipes/bread/rye.go", "bread", own("oven/heat")),
    ("recipes/cake/cake.go", "cake", [(3, "fmt"), *own("flour", first=4)]),
    ("run/bake.go", "main", own("shop/till")),
    ("shop/stand.go", "main", []),
    ("shop/till/till.go", "till", own("recipes/bread", "oven")),
    ("shop/till/till_test.go", "till", own("fixtures")),
]
#: Three doors hang on a hinge (instability 2/5) with pins (3/4) and a spring
#: (1/3).
HINGE = [
    ("door/back.go", "door", own("hinge", "spring")),
    ("door/front.go", "door", own("hinge")),
    ("gate/gate.go", "gate", own("hinge")),
    ("hatch/hatch.go", "hatch", own("hinge")),
    ("hinge/hinge.go", "hinge", [(3, "fmt"), *own("pins", "spring", first=4)]),
    ("pins/pins.go", "pins", own("steel", "oil", "wood")),
    ("spring/spring.go", "spring", own("steel")),
]
#: A pattern of the first gate captures nothing.
GATES = [("gate/north/a.go", "north", own("house/north", "house/south", "house")), ("gate/x/x.go", "x", own("house", "house/x"))]
