"""Preference formatting of conversations (operator 7).

DataFrame functions only. A pair has a chosen and a rejected conversation. The
longest common prefix of their turns is rendered once, as the prompt; what is
left of each is rendered as its completion, with the spans (code points) that a
loss may train on: the content and end mark of assistant turns.

``preference_pairs`` makes pairs from plain conversations. Those that begin
with the same turn are paired in order of id, first with second, third with
fourth; the one with more assistant text is chosen (then the smaller id). One
that is left over is paired with itself with its last assistant turn replaced
by the assistant turn before it (by nothing where there is none). Ranks come
from counts by ranges of (first turn, id), so a first turn that a third of all
conversations share is dealt over many tasks, and no pair is missed.

Defined cases: turns are ordered by turn, role, text, nulls first; equal rows
are kept; a null role or text renders as empty; a turn whose conv_id is null is
a conversation of its own, and equal ones are one; a conversation without
assistant turns that is left over is paired with itself and has empty
completions; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import free_name, shuffle_partitions, written

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
RESULT = ("n_prompt_turns", "prompt", "chosen_completion", "rejected_completion", "chosen_spans", "rejected_spans")


def said_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, lone, said): every turn; ``lone`` tells turns without a
    conv_id apart, and is null for others."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select("conv_id", said.alias("said"))
    lone = rows.where(F.col("conv_id").isNull()).distinct().select("conv_id", F.xxhash64("said").alias("lone"), "said")
    return rows.where(F.col("conv_id").isNotNull()).select("conv_id", F.lit(None).cast("long").alias("lone"), "said").unionByName(lone)


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, lone, turns): each conversation's turns in order."""
    rows = said_turns(turns).groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    return rows.select("conv_id", "lone", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, least).otherwise(first - 1)


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def trained_spans(turns: Column) -> Column:
    """``start:end`` of what assistant turns say, in the rendered turns."""

    def step(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["role"]) + len(OPEN) + len(CLOSE)
        end = start + F.length(t["text"]) + len(END)
        span = F.array(F.concat_ws(":", start.cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(turns, first, step, lambda s: s["out"]), ",")


def formatted(pairs: DataFrame) -> DataFrame:
    """Prompt and masked completions of pairs with columns ``chosen`` and
    ``rejected`` (arrays of (role, text)). Other columns stay; one that has the
    name of a result is given underscores in front."""
    others = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    names: list[str] = []
    for c in others:
        names.append(free_name([*RESULT, *others, *names], c) if c.lower() in RESULT else c)
    n = F.col("n_prompt_turns")
    rest = lambda c: F.slice(F.col(c), n + 1, F.greatest(F.size(c) - n, F.lit(0))).alias(c)
    held = [f"held_{i}" for i in range(len(others))]
    cut = pairs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(others, held, strict=True)), "chosen", "rejected", common_turns(F.col("chosen"), F.col("rejected")).alias("n_prompt_turns"))
    cut = cut.select(*held, "n_prompt_turns", F.slice("chosen", 1, n).alias("prompt_turns"), rest("chosen"), rest("rejected"))
    return cut.select(
        *(F.col(h).alias(c) for h, c in zip(held, names, strict=True)),
        "n_prompt_turns",
        rendered(F.col("prompt_turns")).alias("prompt"),
        rendered(F.col("chosen")).alias("chosen_completion"),
        rendered(F.col("rejected")).alias("rejected_completion"),
        trained_spans(F.col("chosen")).alias("chosen_spans"),
        trained_spans(F.col("rejected")).alias("rejected_spans"),
    )


def own_contrast(turns: Column) -> Column:
    """The turns with the last assistant turn replaced by the one before."""
    places = F.filter(F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    last = F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(-1))
    earlier = F.when(F.size(places) > 1, F.element_at(turns, F.coalesce(F.try_element_at(places, F.lit(-2)), F.lit(0)) + 1)["text"]).otherwise("")
    return F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == last, earlier).otherwise(t["text"]).alias("text")))


def pair_numbers(turns: DataFrame) -> DataFrame:
    """(conv_id, lone, key, pair): conversations of one key begin with the same
    turn, and two of them, in order of id, have one pair number. Only keys are
    dealt here, by ranges of (key, id)."""
    first = said_turns(turns).groupBy("conv_id", "lone").agg(F.min("said").alias("first"))
    keys = first.select("conv_id", "lone", F.xxhash64("first.role", "first.text").alias("key"))
    dealt = keys.repartitionByRange(shuffle_partitions(turns.sparkSession), "key", "conv_id", "lone")
    blocks = written(dealt.select("*", F.spark_partition_id().alias("block")), "chat-keys")
    counts = blocks.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("key", "block").orderBy("conv_id", "lone")
    ranked = blocks.withColumn("own", F.row_number().over(own) - 1).join(bases, ["key", "block"])
    return ranked.select("conv_id", "lone", "key", F.floor((F.col("base") + F.col("own")) / 2).alias("pair"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected) from plain conversations."""
    said = F.aggregate("turns", F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))
    numbers = pair_numbers(turns).withColumnsRenamed({"conv_id": "of", "lone": "of_lone"})
    convs = conversations(turns).withColumn("said", said)
    ranked = convs.join(numbers, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("lone").eqNullSafe(F.col("of_lone")))
    best = F.struct((-F.col("said")).alias("order"), "conv_id", "lone", "turns")
    two = ranked.groupBy("key", "pair").agg(F.array_sort(F.collect_list(best)).alias("two"))
    a, b = F.col("two")[0], F.try_element_at("two", F.lit(2))
    return two.select(
        a["conv_id"].alias("chosen_id"),
        F.when(F.size("two") == 2, b["conv_id"]).otherwise(a["conv_id"]).alias("rejected_id"),
        a["turns"].alias("chosen"),
        F.when(F.size("two") == 2, b["turns"]).otherwise(own_contrast(a["turns"])).alias("rejected"),
    )


def preferences(turns: DataFrame) -> DataFrame:
    """Formatted pairs of all conversations."""
    return formatted(preference_pairs(turns))


def digests(turns: DataFrame) -> DataFrame:
    texts = ("prompt", "chosen_completion", "rejected_completion")
    return preferences(turns).select("chosen_id", "rejected_id", "n_prompt_turns", *(F.sha2(c, 256).alias(f"{c}_sha256") for c in texts), "chosen_spans", "rejected_spans")
