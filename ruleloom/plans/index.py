"""Candidate rules of a row, by the prefixes that their patterns ask for.

A document of many rules isn't evaluated rule by rule: each rule is found by
what its source or its target has to begin with, whichever says more, through
one join of a row's prefixes with the index. Only the candidates' own tests run,
each row's rule chosen by number. Rules without a prefix are candidates of every
row. The index has a row for each rule and prefix; it comes from the document,
and is broadcast while it is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.config import Rule
from ruleloom.functions.literals import antichain, prefix, template_prefix

#: Rules that one array tests together; more go through the index.
TOGETHER = 16
#: Bytes of an index that may be broadcast.
BROADCAST = 8 << 20

RULE = "struct<k:int,rule:string,comment:string,severity:string>"


def source_prefixes(rule: Rule) -> list[str]:
    return antichain([prefix(p.java) for p in rule.source.path] or [""])


def target_prefixes(rule: Rule) -> list[str]:
    return antichain([template_prefix(t) for t in rule.target.path] or [""])


def keys(rule: Rule, targets: bool) -> list[str]:
    """Prefixes marked by their side. Of a rule's prefixes a row has at most
    one, as none continues another."""
    a, b = source_prefixes(rule), target_prefixes(rule) if targets else [""]
    mark, best = ("f", a) if min(map(len, a)) >= min(map(len, b)) else ("t", b)
    return [mark + p for p in best]


def facts(k: int, rule: Rule) -> tuple[int, str, str, str]:
    return k, rule.name, rule.comment, rule.severity


def chosen(k: Column, tests: list[Column], first: int = 0) -> Column:
    """``tests[k]``, found by halves."""
    if len(tests) == 1:
        return tests[0]
    half = len(tests) // 2
    return F.when(k < first + half, chosen(k, tests[:half], first)).otherwise(chosen(k, tests[half:], first + half))


def hits(rows: DataFrame, rules: list[Rule], test: Callable[[Rule], Column], source: Column, target: Column | None = None) -> DataFrame:
    """A row for each (row, rule) that passes ``test``, with the rule as
    ``r`` (k, rule, comment, severity); nothing is made distinct."""
    tests = [test(r) for r in rules]
    if len(rules) <= TOGETHER:
        found = [F.struct(*(F.lit(x).alias(n) for x, n in zip(facts(k, r), ("k", "rule", "comment", "severity"), strict=True))) for k, r in enumerate(rules)]
        if len(rules) == 1:
            return rows.where(tests[0]).withColumn("r", found[0])
        any_of = tests[0]
        for t in tests[1:]:
            any_of = any_of | t
        each = F.array(*(F.when(t, r) for t, r in zip(tests, found, strict=True)))
        return rows.where(any_of).withColumn("r", F.explode(F.filter(each, lambda x: x.isNotNull())))
    entries = [(key, facts(k, r)) for k, r in enumerate(rules) for key in keys(r, target is not None)]
    index = rows.sparkSession.createDataFrame(entries, f"rule_key string, r {RULE}")
    if sum(len(key) + sum(map(len, f[1:])) + 16 for key, f in entries) <= BROADCAST:
        index = F.broadcast(index)
    sides = {"f": source} | ({"t": target} if target is not None else {})
    lengths = sorted({(key[0], len(key) - 1) for key, _ in entries})
    begins = [F.when(F.length(sides[s]) >= n, F.concat(F.lit(s), F.substring(sides[s], 1, n))) for s, n in lengths]
    near = rows.withColumn("rule_key", F.explode(F.array(*begins))).join(index, "rule_key").drop("rule_key")
    return near.where(chosen(F.col("r.k"), tests))
