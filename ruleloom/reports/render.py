"""Reports as text: err, json, mermaid, dot, html. A report is what one run
found for people to read, so it is rendered on the driver.

Fixed values, as other tools read them: the words and signs of err, mermaid and
dot lines, the field names of json, the names of classes and nodes
(``sourceViolation``, ``staleBaselineError``, ``no_violations``, ``stale0``) and
the colours ``#ffebe9`` and ``#cf222e``."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from ruleloom.config import quoted
from ruleloom.operators.baseline import Entry, stale_message
from ruleloom.reports.frames import EDGE_REASONS, SOURCE_REASONS


@dataclass(frozen=True)
class Target:
    path: str
    import_path: str = ""
    type: str = ""


@dataclass(frozen=True)
class Violation:
    rule: str
    severity: str
    kind: str
    path: str
    line: int = 0
    package_name: str = ""
    target: Target | None = None
    comment: str = ""

    @classmethod
    def of(cls, row) -> Violation:
        to = row["to"]
        target = Target(to["path"], to["import_path"], to["type"]) if to is not None else None
        return cls(row["rule"], row["severity"], row["kind"], row["from"]["path"], row["from"]["line"], row["from"]["package_name"], target, row["comment"])


@dataclass
class Report:
    violations: list[Violation] = field(default_factory=list)
    stale: list[Entry] = field(default_factory=list)

    def summary(self) -> dict[str, int]:
        counts = {k: sum(v.severity == k for v in self.violations) for k in ("error", "warn", "info", "ignore")}
        counts["error"] += len(self.stale)
        return {"total": len(self.violations) + len(self.stale)} | counts


#: Unicode's white space, which is less than what ``str.split`` takes for it.
_SPACE = re.compile("[\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def fields(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def one_line(text: str) -> str:
    return quoted(text)[1:-1]


def err(report: Report) -> str:
    out = []
    for v in report.violations:
        place = f"[{one_line(v.severity)}] rule {quoted(v.rule)}: {one_line(v.path)}" + (f":{v.line}" if v.line else "")
        reasons = SOURCE_REASONS if v.target is None else EDGE_REASONS
        to = "" if v.target is None else f" -> {one_line(v.target.path)} ({one_line(v.target.type)})"
        out.append(f"{place}{to}: {reasons.get(v.kind, f'unknown violation kind {quoted(v.kind)}')}\n")
        if fix := fields(v.comment):
            out.append(f"  fix: {fix}\n")
    return "".join(out) + "".join(f"[error] {stale_message(e)}\n" for e in report.stale)


def as_json(report: Report) -> str:
    document: dict = {"schemaVersion": 1, "violations": []}
    for v in report.violations:
        to = None if v.target is None else {"path": v.target.path, "importPath": v.target.import_path, "dependencyType": v.target.type}
        document["violations"].append({"rule": v.rule, "comment": v.comment, "severity": v.severity, "kind": v.kind, "from": {"path": v.path, "line": v.line, "packageName": v.package_name}, "to": to})
    if report.stale:
        document["staleBaselineEntries"] = [{"rule": e.rule, "from": e.source} | ({"to": e.target} if e.target is not None else {}) | {"message": stale_message(e)} for e in report.stale]
    document["summary"] = report.summary()
    return json.dumps(document, indent=2, ensure_ascii=False).replace("\u2028", "\\u2028").replace("\u2029", "\\u2029") + "\n"


@dataclass
class _Graph:
    """Nodes and edges by first appearance."""

    nodes: dict[tuple, list[str]] = field(default_factory=dict)  # key: labels
    edges: dict[tuple, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, violations: list[Violation]) -> _Graph:
        g = cls()
        for v in violations:
            source, label = ("source", v.path, ""), f"{v.rule} [{v.severity}]"
            labels = g.nodes.setdefault(source, [])
            if v.target is None:
                labels.append(f"{label} @ line {v.line}")
                continue
            target = ("target", v.target.path, v.target.type)
            g.nodes.setdefault(target, [])
            g.edges.setdefault((source, target, v.line), []).append(label)
        return g

    def node_rows(self) -> list[tuple[str, str, bool]]:
        """(id, label, is at fault itself)"""
        return [(f"n{i}", path + (f" ({kind})" if kind else "") + (f" ({'; '.join(labels)})" if labels else ""), bool(labels)) for i, ((_, path, kind), labels) in enumerate(self.nodes.items())]

    def edge_rows(self) -> list[tuple[str, str, str]]:
        number = {key: f"n{i}" for i, key in enumerate(self.nodes)}
        return [(number[a], number[b], f"line {line}: {'; '.join(labels)}") for (a, b, line), labels in self.edges.items()]


def mermaid(report: Report) -> str:
    def safe(text: str) -> str:
        return "".join(f"#{ord(c)};" if c in '"#&<>\\|[]' or c < " " or c == "\x7f" else c for c in text)

    g = _Graph.of(report.violations)
    nodes, edges = g.node_rows(), g.edge_rows()
    if not nodes and not report.stale:
        return 'flowchart LR\n  no_violations["No violations"]\n'
    look = "fill:#ffebe9,stroke:#cf222e,stroke-width:2px"
    out = ["flowchart LR"]
    out += [f'  {i}["{safe(label)}"]' for i, label, _ in nodes]
    out += [f'  stale{i}["{safe("[error] " + stale_message(e))}"]' for i, e in enumerate(report.stale)]
    out += [f'  {a} -->|"{safe(label)}"| {b}' for a, b, label in edges]
    if at_fault := [i for i, _, own in nodes if own]:
        out += [f"  classDef sourceViolation {look}", *(f"  class {i} sourceViolation" for i in at_fault)]
    if report.stale:
        out += [f"  classDef staleBaselineError {look}", *(f"  class stale{i} staleBaselineError" for i in range(len(report.stale)))]
    if edges:
        out.append("  linkStyle default stroke:#cf222e,stroke-width:3px")
    return "\n".join(out) + "\n"


def dot(report: Report) -> str:
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}

    def safe(text: str) -> str:
        return "".join(short[c] if c in short else f"[U+{ord(c):04X}]" if unicodedata.category(c) == "Cc" else c for c in text)

    g = _Graph.of(report.violations)
    nodes = g.node_rows()
    out = ["digraph violations {", "  rankdir=LR;", "  node [shape=box];"]
    if not nodes and not report.stale:
        return "\n".join([*out, '  no_violations [label="No violations"];', "}", ""])
    look = ', color="#cf222e", fillcolor="#ffebe9", penwidth=2, style="filled"'
    out += [f'  {i} [label="{safe(label)}"{look if own else ""}];' for i, label, own in nodes]
    out += [f'  stale{i} [label="{safe("[error] " + stale_message(e))}"{look}];' for i, e in enumerate(report.stale)]
    out += [f'  {a} -> {b} [label="{safe(label)}", color="#cf222e", penwidth=3];' for a, b, label in g.edge_rows()]
    return "\n".join([*out, "}", ""])


_STYLE = """
body { margin: 2rem auto; max-width: 75rem; padding: 0 1rem; font-family: system-ui, sans-serif; color: #222; }
table { border-collapse: collapse; width: 100%; }
th, td { border-bottom: 1px solid #ccc; padding: .5rem; text-align: left; vertical-align: top; }
dl { display: flex; gap: 2rem; } dd { margin: 0; font-size: 1.5rem; font-weight: bold; }
code { overflow-wrap: anywhere; } .error, .stale { color: #c22; } .warn { color: #960; } .info { color: #06c; }
"""


def as_html(report: Report) -> str:
    """A page of its own: no scripts, nothing loaded from elsewhere."""
    e = html.escape

    def table(heads: tuple[str, ...], rows: list[tuple[str, ...]], empty: str) -> str:
        if not rows:
            return f"<p>{empty}</p>"
        body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>\n" for r in rows)
        return f"<table>\n<thead><tr>{''.join(f'<th scope=col>{h}</th>' for h in heads)}</tr></thead>\n<tbody>\n{body}</tbody>\n</table>"

    found = []
    for v in report.violations:
        place = e(v.path) + (f":{v.line}" if v.line else "")
        to = "source-only" if v.target is None else f"<code>{e(v.target.path)}</code>" + (f" ({e(v.target.type)})" if v.target.type else "")
        found.append((e(v.rule), f'<span class="{e(v.severity)}">{e(v.severity)}</span>', e(v.kind), f"<code>{place}</code>", to, e(v.comment) or "&mdash;"))
    old = [(e(x.rule), f"<code>{e(x.source)}</code>", "source-only" if x.target is None else f"<code>{e(x.target)}</code>", f'<span class="stale">error:</span> {e(stale_message(x))}') for x in report.stale]
    counts = "".join(f"<div><dt>{k.title()}</dt><dd>{n}</dd></div>" for k, n in report.summary().items())
    return (
        f'<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>Dependency report</title>\n<style>{_STYLE}</style>\n</head>\n<body>\n'
        f"<h1>Dependency report</h1>\n<h2>Summary</h2>\n<dl>{counts}</dl>\n<p>Stale baseline entries count as errors.</p>\n"
        f"<h2>Violations</h2>\n{table(('Rule', 'Severity', 'Kind', 'From', 'To', 'Comment'), found, 'No violations.')}\n"
        f"<h2>Stale baseline entries</h2>\n{table(('Rule', 'From', 'To', 'Message'), old, 'No stale baseline entries.')}\n</body>\n</html>\n"
    )


FORMATS: dict[str, Callable[[Report], str]] = {"err": err, "json": as_json, "mermaid": mermaid, "dot": dot, "html": as_html}


def render(kind: str, report: Report) -> str:
    if kind not in FORMATS:
        raise ValueError(f"unsupported output type {quoted(kind)}")
    return FORMATS[kind](report)
