"""RE2 patterns: what is rejected, and the same answers as DuckDB's RE2."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ruleloom.functions.re2 import PatternError, compile_re2, compile_template, expand, quote, template_parts

CASES = [
    ("a$", "a\n"), ("a$", "a"), ("(?P<x>a)", "a"), ("^[[:alpha:]]+$", "abc"), ("^[a[b]$", "["), ("^[a&&b]+$", "&"), ("^x{(?:2)}$", "x{2}"),
    ("a{,2}", "a{,2}"), (r"^\p{Greek}$", "α"), ("^a.b$", "a b"), (r"^\s$", "\x0b"), (r"^\v$", "\n"), (r"^\v$", "\x0b"), (r"é\b", "éa"),
    ("(?i)É", "é"), ("(?i)straße", "STRAßE"), (r"^\w$", "é"), (r"^\d$", "٣"), (r"^\pN$", "1"), (r"^[^\d]$", "a"), (r"[\D]", "5"), (r"^[]a]+$", "]a"),
    ("^[^]a]$", "b"), (r"\Qa.b\E+", "a.bb"), (r"^\Qx", "x"), ("(?m)^b", "a\nb"), ("(?m)a$", "a\nb"), ("(?s)a.b", "a\nb"), ("a.b", "a\nb"), ("a|b|", ""),
    (r"\x41\x{42}", "AB"), (r"\101", "A"), ("a{2,3}?b", "aab"), ("(a|b)*c", "ababc"), (r"\.go$", "x.go"), (r"[\-a]", "-"), ("[a-]", "-"), ("[--a]", "."),
    (r"^[\w.-]+$", "a-b.c"), ("#", "#"), (" ", " "), (r"(?i:a)b", "Ab"), (r"(?i:a)b", "AB"), (r"\z", ""), (r"\A\z", "a"), ("x*", ""), ("[[:^digit:]]", "1"),
    (r"[^\S]", " "), (r"[^\n]", "\n"), ("~&-", "~&-"), (r"^(?:a(?:b|c)){2}$", "abac"), ("\U0001f600+", "\U0001f600"), (r"(?-s).", "\n"), (r"\B", "ab"),
]

REJECTED = ["(?=a)a", r"(a)\1", "a++", "a**", "a{1001}", "(a{100}){100}", "*a", "a|*", "(", ")", "[a", "[b-a]", r"\8", r"\c", "a\\", "(?<=a)", "(?P<1-2>a)", r"\p{nope}", r"\pX", "(?z)a", "a{3,2}", "[[:foo:]]", "(?P<a>x)(?P<a>y)", r"\Z", r"x{2}{3}", "(?)"]


@pytest.mark.parametrize("pattern", REJECTED)
def test_rejected(pattern):
    with pytest.raises(PatternError):
        compile_re2(pattern)


def spark_answers(spark, cases):
    rows = spark.createDataFrame([(i, compile_re2(p).java, t) for i, (p, t) in enumerate(cases)], "i int, p string, t string")
    return [r[0] for r in rows.orderBy("i").selectExpr("regexp_like(t, p)").collect()]


def duck_answers(cases):
    return [duckdb.execute("SELECT regexp_matches(?, ?)", [t, p]).fetchone()[0] for p, t in cases]


def test_same_as_re2(spark):
    got, want = spark_answers(spark, CASES), duck_answers(CASES)
    assert [(c, g) for c, g in zip(CASES, got, strict=True)] == [(c, w) for c, w in zip(CASES, want, strict=True)]


def test_random_patterns(spark):
    atom = st.sampled_from(["a", "b", ".", "[ab]", "[^a]", r"\w", r"\s", r"\b", "^", "$", "(a)", "(?:b|)", "-", "{", "[a-c&&b]", r"\.", "é", "(?i)B", "[[:alpha:]]", "#", "(?s).", r"\pL"])
    piece = st.builds(lambda a, r: a + r if a not in ("^", "$", r"\b", "{", "(?i)B") else a, atom, st.sampled_from(["", "", "*", "+", "?", "{2}", "{1,3}", "*?"]))
    pattern = st.lists(piece, min_size=1, max_size=6).map("".join)
    text = st.text(alphabet="abB.{-é\n #", max_size=8)
    cases = []

    @settings(max_examples=400, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(pattern, text)
    def collect(p, t):
        cases.append((p, t))

    collect()
    got, want = spark_answers(spark, cases), duck_answers(cases)
    assert not [(c, g, w) for c, g, w in zip(cases, got, want, strict=True) if g != w]


def test_groups():
    assert compile_re2(r"(a)(?:b)((?P<n>c)|\()[(]\(").groups == 3


@pytest.mark.parametrize(
    "source,parts",
    [("a$1b", ["a", 1, "b"]), (r"\$1", [r"\$1"]), ("x$", ["x$"]), ("$12/$1", ["", 12, "/", 1, ""]), ("[$]a", ["[$]a"]), ("[]$]x$1", ["[]$]x", 1, ""]), (r"\Qa\E$1", [r"\Qa\E", 1, ""]), ("[[:alpha:]]$2", ["[[:alpha:]]", 2, ""])],
)
def test_template_parts(source, parts):
    assert template_parts(source) == parts


@pytest.mark.parametrize("source", ["$0", "$01", "${1}", "$name", "[$1]", r"\Q$1\E", "[^]$1]", r"\Q$a"])
def test_template_rejected(source):
    with pytest.raises(PatternError):
        compile_template(source)


def test_expansion(spark):
    assert expand("^internal/$1/x", ["all", "a.b"]) == r"^internal/(?:a\.b)/x"
    assert expand("a$1*", ["", ""]) == "a(?:)*"
    with pytest.raises(PatternError):
        expand("$2", ["", "a"])
    assert quote("a+b(c)") == r"a\+b\(c\)"
    assert compile_template("^$1$").java == (r"\A", 1, r"\z")


def test_any_letter_may_stand_beside_a_reference():
    odd = "\U000f0000\U000f0001"
    t = compile_template(f"^{odd}$2-$1$")
    assert [p for p in t.java if isinstance(p, int)] == [2, 1] and t.highest == 2
    assert "".join(p for p in t.java if isinstance(p, str)).count("\U000f0000") == 1
