import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ruleloom.llm import chat
from ruleloom.llm.common import table


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def spans(turns):
    out, at = [], 0
    for r, t in turns:
        whole = render([(r, t)])
        if r == "assistant":
            out.append(f"{at + len(r) + 5}:{at + len(whole)}")
        at += len(whole)
    return ",".join(out)


def brute(rows):
    """Pairs and their digests from plain rows, without the operator."""
    convs = defaultdict(list)
    for c, n, r, t in rows:
        convs[c].append((n, r or "", t or ""))
    convs = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    firsts = defaultdict(list)
    for c in sorted(convs):
        firsts[convs[c][0]].append(c)
    out = []
    for two in (ids[k : k + 2] for ids in firsts.values() for k in range(0, len(ids), 2)):
        two = sorted(two, key=lambda c: (-sum(len(t) for r, t in convs[c] if r == "assistant"), c))
        a = convs[two[0]]
        if len(two) == 2:
            b = convs[two[1]]
        else:
            at = [i for i, (r, _) in enumerate(a) if r == "assistant"]
            b = [(r, (a[at[-2]][1] if len(at) > 1 else "") if at and i == at[-1] else t) for i, (r, t) in enumerate(a)]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        sha = lambda x: hashlib.sha256(render(x).encode()).hexdigest()
        out.append((two[0], two[-1], n, sha(a[:n]), sha(a[n:]), sha(b[n:]), spans(a[n:]), spans(b[n:])))
    return sorted(out)


def test_whole_table(spark):
    turns = table(spark, "/root/testdata/sf0.01", "conversations")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in chat.digests(turns).collect())
    assert got == brute(rows) and any(n > 0 for _, _, n, *_ in got)


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_hot_first_turn(spark, partitions):
    """Pairs go by id, however many tasks a first turn is dealt over."""
    rows = [(c, 0, "user", "hello" if c % 5 else f"other {c % 3}") for c in range(301)] + [(c, 1, "assistant", "a" * (c % 5)) for c in range(301)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        got = sorted(map(tuple, chat.digests(turns).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows) and len(got) < 160


def test_formatted_keeps_other_columns(spark):
    schema = "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string, _prompt string, n_prompt_turns int, chosen_spans string, held_0 string, prompt_turns string"
    (row,) = chat.formatted(spark.createDataFrame([([("user", "a"), ("assistant", "b")], [("user", "a")], "p", "q", 9, "r", "s", "t")], schema)).collect()
    assert (row["__prompt"], row["_prompt"], row["_n_prompt_turns"], row["_chosen_spans"], row["held_0"], row["prompt_turns"]) == ("p", "q", 9, "r", "s", "t")
    assert (row.prompt, row.n_prompt_turns, row.chosen_completion, row.rejected_completion) == (render([("user", "a")]), 1, render([("assistant", "b")]), "")


def test_turns_without_a_conversation(spark):
    rows = [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "user", "x"), (None, 0, "assistant", "y"), (4, 0, "user", "x")]
    got = chat.preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 3 and sorted(str(r.chosen_id) for r in got) == ["4", "None", "None"]


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string"
    rows = [(1, 0, None, None, "x"), (None, 1, "user", "q", "x"), (2, 0, "user", "é😀", "x"), (2, 0, "user", "é😀", "x"), (2, 1, "assistant", "long " * 20000, "x"), (3, None, "assistant", "", "x")]
    got = {r.chosen_id: r for r in chat.preferences(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 4 and got[2].n_prompt_turns == 2 and got[2].prompt == render([("user", "é😀")] * 2)
    assert got[2].chosen_spans == "14:100022" and got[None].chosen_completion == ""
    assert chat.preferences(spark.createDataFrame([], schema)).count() == 0
    given = spark.createDataFrame([([("user", "a"), ("assistant", "b")], [("user", "a")], 5)], "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, id int")
    (row,) = chat.formatted(given).collect()
    assert (row.id, row.n_prompt_turns, row.chosen_completion, row.rejected_completion) == (5, 1, render([("assistant", "b")]), "")
    assert "Python" not in chat.preferences(given.select(F.lit(1).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text")))._jdf.queryExecution().toString()
