"""Divergence of sources, by a baseline-correction inverted index (operator 12).

Within a language every source is a smoothed distribution over the terms that
enough of the language's documents have. Two sources differ by the sum over all
terms of f(p, q) = floor((p - q)^2 / (p + q)), with p and q in parts of 10^9:
all arithmetic is in whole numbers, so results are exact.

Most sources lack most terms, so the sum isn't taken term by term. A pair of
sources starts at its baseline, V times f of both zero counts, as if neither
had any term. Postings (term, source, count) then emit corrections, only where
these aren't zero:

* a term of a alone changes f(p0a, p0b) into f(pa, p0b). That depends on the
  count alone, so a source's postings are first counted by their counts, and
  each different count gives one correction for each other source;
* a term of both needs f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b) on top,
  from the postings of one term joined with each other.

Sums are exact in any order, so corrections meet in partial aggregates.

How it runs: Arrow batches turn texts into counts by (lang, source, term), one
task's texts together, so what is shuffled grows with vocabularies rather than
texts; Spark merges them, whatever source holds a third of all texts. A term's
postings have at most one row a source. Where a language has more than ``BLOCK``
sources, postings are dealt into pairs of blocks, so no task gets all pairs of
a term. Leading terms are ranked by a window whose limit is applied before the
shuffle. Facts of groups are joined by a join that deals hot groups.

Defined cases: null text, lang and source are read as ''; a group without terms
takes part, with counts of zero; where a language keeps no term, pairs have the
value 0 and there are no terms; a repeated row is another document, also where
it has the same id; a language with one source has no pairs; an empty table
gives no rows; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import arrow_map, byte_texts, dealt_join, written

#: Documents of a language that a kept term stands in, at least.
MIN_DOCUMENTS = 10
TOP = 10
UNIT = 1_000_000_000
#: Sources of a block.
BLOCK = 64
#: Counts that a task holds before it hands them on.
HELD = 500_000
SLICE = 20_000

#: ASCII letters in lower case, other ASCII characters as spaces; the bytes of
#: all other characters stay.
_TERMS = bytes(b if b > 127 else (b | 32 if chr(b).isalpha() else 32) for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, t, n, docs): occurrences and documents of each term, in
    parts to be summed. Each group also has a row without a term."""

    def rows(occurs: dict, stands: dict) -> Iterator[pa.RecordBatch]:
        flat = [(*g, t.decode(), n, stands[g][t]) for g, found in occurs.items() for t, n in found.items()] + [(*g, None, 0, 0) for g in occurs]
        for i in range(0, len(flat), SLICE):
            lang, source, t, n, d = zip(*flat[i : i + SLICE], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "t", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurs: dict[tuple[str, str], Counter] = defaultdict(Counter)
        stands: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for b in batches:
            for text, lang, source in zip(byte_texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = terms(text)
                occurs[lang, source].update(found)
                stands[lang, source].update(set(found))
            if sum(map(len, occurs.values())) > HELD:
                yield from rows(occurs, stands)
                occurs.clear(), stands.clear()
        yield from rows(occurs, stands)

    empty = F.lit("")
    slim = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"))
    return arrow_map(slim, run, "lang string, source string, t string, n long, docs long")


def kept_postings(postings: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``postings`` of terms that enough documents of their language have, with
    ``total``, the occurrences in the language; ``first`` marks one of a term."""
    term = Window.partitionBy("lang", "t")
    summed = postings.where("t is not null").withColumns({"total": F.sum("n").over(term), "in_docs": F.sum("docs").over(term), "place": F.row_number().over(term.orderBy("source"))})
    return summed.where(F.col("in_docs") >= min_documents).select("lang", "source", "t", "n", "total", (F.col("place") == 1).alias("first"))


def share(count: Column, size: Column, v: Column) -> Column:
    """1 + floor(UNIT (count + 2) / (size + 2 v)), whatever the count; null
    where no term is kept."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * big(count + 2), F.nullif(big(size + 2 * v), F.lit(0).cast("decimal(20,0)")))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(postings: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each (lang, source): its number ``g``, occurrences ``size`` of
    kept terms there, ``n`` their postings, ``p0`` the share of a count of
    zero, ``v`` and ``whole`` of the language, and its block of ``blocks``."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("n"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("whole"))
    found = postings.select("lang", "source").distinct()
    blocks = found.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = found.join(sums, ["lang", "source"], "left").join(blocks, "lang").join(langs, "lang", "left").fillna(0, ["size", "n", "v", "whole"])
    block = F.pmod(F.xxhash64("source"), "blocks").cast("int")
    return rows.withColumns({"g": F.monotonically_increasing_id(), "block": block, "p0": share(F.lit(0), F.col("size"), F.col("v"))})


def every(blocks: str = "blocks") -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def sides(rows: DataFrame, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (block, blocks, ``own``) twice, with names ending in _a and
    _b, dealt to all pairs of blocks (at, to) that theirs is part of."""
    a = rows.select(F.col("block").alias("at"), every().alias("to"), *(F.col(c).alias(f"{c}_a") for c in own))
    b = rows.select(every().alias("at"), F.col("block").alias("to"), *(F.col(c).alias(f"{c}_b") for c in own))
    return a, b


def baselines(groups: DataFrame) -> DataFrame:
    """Every ordered pair of a language's sources as if neither had a term."""
    a, b = sides(groups, ["lang", "source", "g", "p0", "v"])
    met = a.join(b, (F.col("lang_a") == F.col("lang_b")) & (a["at"] == b["at"]) & (a["to"] == b["to"])).where("g_a <> g_b")
    value = F.coalesce(F.col("v_a") * gap(F.col("p0_a"), F.col("p0_b")), F.lit(0))
    return met.select(F.col("lang_a").alias("lang"), "g_a", "g_b", F.col("source_a").alias("source"), F.col("source_b").alias("item"), value.alias("base"))


def single_corrections(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(g_a, g_b, x): what terms of a change, if b had none of them."""
    counts = rows.groupBy("lang", "g", "p", "p0", "block", "blocks").agg(F.count(F.lit(1)).alias("terms"))
    a, _ = sides(counts, ["lang", "g", "p", "p0", "terms"])
    _, b = sides(groups, ["lang", "g", "p0"])
    met = a.join(b, (F.col("lang_a") == F.col("lang_b")) & (a["at"] == b["at"]) & (a["to"] == b["to"])).where("g_a <> g_b")
    x = F.col("terms_a") * (gap(F.col("p_a"), F.col("p0_b")) - gap(F.col("p0_a"), F.col("p0_b")))
    return met.select("g_a", "g_b", x.alias("x")).where("x <> 0").groupBy("g_a", "g_b").agg(F.sum("x").alias("x"))


def joint_corrections(rows: DataFrame) -> DataFrame:
    """(g_a, g_b, x) with g_a < g_b: what terms of both change on top."""
    a, b = sides(rows, ["lang", "t", "g", "p", "p0"])
    met = a.join(b, (F.col("lang_a") == F.col("lang_b")) & (F.col("t_a") == F.col("t_b")) & (a["at"] == b["at"]) & (a["to"] == b["to"]) & (F.col("g_a") < F.col("g_b")))
    pa_, pb, p0a, p0b = (F.col(c) for c in ("p_a", "p_b", "p0_a", "p0_b"))
    x = gap(pa_, pb) - gap(pa_, p0b) - gap(p0a, pb) + gap(p0a, p0b)
    return met.select("g_a", "g_b", x.alias("x")).where("x <> 0").groupBy("g_a", "g_b").agg(F.sum("x").alias("x"))


def pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs."""
    one, both = single_corrections(rows, groups), joint_corrections(rows)
    either = written(one.unionByName(both), "divergence-corrections")
    mirrored = either.unionByName(either.select(F.col("g_b").alias("g_a"), F.col("g_a").alias("g_b"), "x"))
    sums = mirrored.groupBy("g_a", "g_b").agg(F.sum("x").alias("x"))
    return baselines(groups).join(sums, ["g_a", "g_b"], "left").select("lang", "source", "item", (F.col("base") + F.coalesce("x", F.lit(0))).alias("value"))


def leading(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The terms that a source has more of than its language, by value."""
    q = share(F.col("total"), F.col("whole"), F.col("v"))
    found = rows.withColumn("q", q).where("p > q").select("lang", "source", F.col("t").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has all other
    sources of the language by divergence, ``term`` the leading terms."""
    summed = counted(docs, text_col, lang_col, source_col).groupBy("lang", "source", "t").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    postings = written(summed, "divergence-postings")
    kept = written(kept_postings(postings, min_documents), "divergence-kept")
    groups = written(groups_of(postings, kept), "divergence-groups")
    of = F.struct("lang", "source").alias("of")
    facts = groups.select(of, "n", "g", "p0", "size", "v", "whole", "block", "blocks")
    dealt = dealt_join(kept.select(of, "lang", "source", "t", F.col("n").alias("count"), "total"), facts, "of", ["t"])
    rows = written(dealt.withColumn("p", share(F.col("count"), F.col("size"), F.col("v"))).drop("of", "size"), "divergence-rows")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs(rows, groups).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    out = ranked.unionByName(leading(rows, top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
