"""Report lines as columns equal the driver's renderer for any name."""

from ruleloom.reports import frames, render, text
from ruleloom.schema import VIOLATIONS

ODD = ["plain", 'a"b', "back\\slash", "tab\there", "bell\a\b\f\v\r", "two\nlines", "\u202eright", "nul\x00\x1f\x7f", "caf\u00e9 \U0001f600", "no\u00a0break", "\u0085", "\u2028sep", "e\u0301", "\ue000private", "\U000e0001tag", "$1 \\d", "", " "]


def rows():
    out = []
    for i, name in enumerate(ODD):
        source = (f"{name}/x{i}.go", i % 3, f"p{name}")
        target = (f"t/{name}", f"i/{name}", "local") if i % 4 else None
        out.append((f"r {name}", f" fix  {name}\t it ", "error" if i % 2 else "warn", ["forbidden", "reachable", f"odd {name}"][i % 3], source, target))
    return out


def test_every_escape(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "x string")
    got = df.select("x", text.quoted(df.x).alias("q"), text.one_line(df.x).alias("o")).collect()
    assert [(r.q, r.o) for r in got] == [(render.quoted(r.x), render.one_line(r.x)) for r in got]


def test_lines_equal_the_renderer(spark):
    df = spark.createDataFrame(rows(), VIOLATIONS)
    report = render.Report([render.Violation.of(r) for r in frames.positioned(df).orderBy("pos").collect()], [])
    whole = "\n".join(r.line for r in frames.err_lines(df.orderBy("rule")).collect()) + "\n"
    assert sorted(whole.split("\n")) == sorted(render.render("err", report).split("\n"))
    drawn = [line for line in render.render("dot", report).split("\n") if " -> " in line]
    assert sorted(r.line for r in frames.dot_edges(df).collect()) == sorted(drawn)
