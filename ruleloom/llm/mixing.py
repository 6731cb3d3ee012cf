"""Mixing sources to target weights by capped water-filling (operator 11).

Each source has a weight and a size in words; the mix has as many words as all
sources together, or ``total``. A source's target is its weighted share, but at
most ``epochs`` times its size: sources above that are clamped there, and what
they leave is shared again among the others by weight, until none is above
(``water_level``). Each round is one aggregate over the table of sources, and
every comparison is in whole numbers.

A target of r times a source's size takes each of its documents floor(r) times,
and some of them once more. Which ones: documents are ordered by a seeded hash
of their id (``draw``), and go along until the words of the fraction are
reached; the last one goes if that comes nearer, and one document is swapped in
or out where its size is nearer to what is still missed (``swaps``). So a source
misses its target by less than half of one document (rows with equal ids count
as one), runs agree, and no document goes more than ceil(r) <= ``epochs`` times.

How it runs: documents become slim rows (id, source, size, draw), written once.
The place where a source's order is cut is found by histograms over the draw's
bits: words are summed by (source, first bits), the bin where the goal falls is
opened by the next bits, and only rows of the last bin are summed in order
(about one row in a million of a source). Nothing sorts or collects a source,
and a source with a third of all rows is one row a task in each sum. Facts of
sources are joined to rows by a join that deals hot sources over several tasks.
Sources are ranked by ranges, so their number isn't bounded either.

Defined cases: a null text has size 0, and a document of size 0 is taken like
any other (its words are 0); null sources are one source, ranked last; sources
without words have target 0; rows with equal ids share a draw, as rows without
id do; an empty table gives no rows; other columns of the table are kept by
``mixed`` whatever their names, and are not looked at by ``mixture``.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import dealt_join, shuffle_partitions, written

EPOCHS = 3
SEED = 42
#: Bits of a draw that are open after the first and the second histogram.
DRAW_BITS = 60
OPEN = (50, 40)

#: Whole numbers beyond long: words times weights.
BIG = "decimal(38,0)"


def cycle(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating."""
    return rank % 3 + 1


def size(text: Column) -> Column:
    """Words of a text: runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number of ``DRAW_BITS`` bits, even over ids."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"))), 1, DRAW_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, key, size, draw); ``key`` is the source, never null: null
    sorts after all others."""
    return docs.select(F.col(id_col).alias("doc_id"), *_measures(seed, id_col, text_col, source_col))


def _measures(seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.col(source_col)))
    return [key.alias("key"), size(F.col(text_col)).alias("size"), draw(F.col(id_col), seed).alias("draw")]


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` 0, 1, ... by ``key``: sorted by ranges, and
    numbered by part. One number for each part is summed."""
    parts = shuffle_partitions(sources.sparkSession)
    dealt = written(sources.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``parts`` rows
    bases = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n_part")).select("part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return dealt.withColumn("own", own).join(bases, "part").withColumn("rank", F.col("base") + F.col("own")).drop("part", "own", "base")


def water_level(sources: DataFrame, total: int | None = None, epochs: int = EPOCHS) -> Fraction:
    """Words for a unit of weight of the sources (source_size, weight) that
    aren't clamped. More words than all epochs have are not to be had."""
    cap = F.col("source_size").cast(BIG) * epochs
    have, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = min(int(have or 0) if total is None else total, epochs * int(have or 0))
    if not total or not weights:
        return Fraction(0)
    level = Fraction(total, int(weights))
    while True:
        above = cap * F.lit(level.denominator).cast(BIG) < F.col("weight").cast(BIG) * F.lit(level.numerator).cast(BIG)
        clamped, rest = sources.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not rest:  # all are clamped: the last level clamped the rest by what it is above
            return level
        higher = Fraction(total - epochs * int(clamped or 0), int(rest))
        if higher <= level:
            return level
        level = higher


def planned(sources: DataFrame, level: Fraction, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` with target, ``whole`` repetitions of all their documents
    and ``goal``, the words of the fraction that goes once more."""
    up, down, n = F.lit(level.numerator).cast(BIG), F.lit(level.denominator).cast(BIG), F.col("source_size").cast(BIG)
    share = F.col("weight").cast(BIG) * up
    clamped = n * epochs * down <= share
    whole = F.when(n == 0, 0).when(clamped, epochs).otherwise(F.expr("shares div nullif(source_size * downs, 0)")).cast("int")
    rows = sources.withColumns({"shares": share.cast(BIG), "downs": down, "clamped": clamped})
    rows = rows.withColumn("target", F.when(F.col("clamped"), (F.col("source_size") * epochs).cast("double")).otherwise(F.col("shares").cast("double") / down.cast("double")))
    rows = rows.withColumn("whole", whole)
    left = F.expr("(shares - cast(whole * source_size as decimal(38,0)) * downs) div downs").cast("long")
    return rows.withColumn("goal", F.when(F.col("clamped") | (n == 0), F.lit(0).cast("long")).otherwise(left)).drop("shares", "downs", "clamped")


def opened(rows: DataFrame, goals: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, draw, size) of the bin where each goal (key, goal) falls, and
    what of the goal is left there. Words are summed by (key, bin) first, so
    the window has at most 1,024 rows a source, and the join is dealt by bin."""
    bins = F.shiftright("draw", bits)
    sums = rows.groupBy("key", bins.alias("bin")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin"))
    sums = sums.withColumn("before", upto - F.col("words")).join(goals, "key")
    found = written(sums.where("before <= goal and goal < before + words").select("key", "bin", (F.col("goal") - F.col("before")).alias("goal")), "mix-bins")
    inside = rows.withColumn("bin", bins).join(found.select("key", "bin"), ["key", "bin"]).select("key", "draw", "size")
    return inside, found.select("key", "goal")


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(key, cut, miss): documents of a source whose draw is below ``cut`` go
    once more than the others, which leaves ``miss`` words of the goal."""
    for bits in OPEN:
        rows, goals = opened(rows, goals, bits)
    ends = rows.groupBy("key", "draw").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("draw"))
    first = F.shiftleft(F.shiftright(F.min("draw"), OPEN[-1]), OPEN[-1])
    nearer = 2 * F.col("upto") - F.col("words") <= 2 * F.col("goal")
    ends = ends.withColumn("upto", upto).join(goals, "key").groupBy("key", "goal")
    found = ends.agg(F.coalesce(F.max(F.when(nearer, F.col("draw") + 1)), first).alias("cut"), F.coalesce(F.max(F.when(nearer, F.col("upto"))), F.lit(0)).alias("upto"))
    return found.select("key", "cut", (F.col("goal") - F.col("upto")).alias("miss"))


def swaps(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """(key, swap): the draw of the document on the wrong side of the cut that
    comes nearest to what is missed, or is too much; where it helps at all."""
    ends = rows.groupBy("key", "draw").agg(F.sum("size").alias("words"))
    off = F.abs(F.col("words") - F.abs("miss"))
    wrong = ((F.col("miss") > 0) == (F.col("draw") >= F.col("cut"))) & (off < F.abs("miss"))
    found = dealt_join(ends, cut, "key", ["draw"]).where(wrong)
    return found.groupBy("key").agg(F.min(F.struct(off.alias("off"), F.col("draw"))).alias("best")).select("key", F.col("best.draw").alias("swap"))


def facts(rows: DataFrame, weight: Callable[[Column], Column] = cycle, total: int | None = None, epochs: int = EPOCHS) -> DataFrame:
    """(key, n, source_size, target, whole, cut) of every source of ``rows``."""
    sources = numbered(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")))
    sources = written(sources.withColumn("weight", weight(F.col("rank"))), "mix-ranked")
    plan = written(planned(sources, water_level(sources, total, epochs), epochs), "mix-plan")
    cut = written(cuts(rows, plan.where("goal > 0").select("key", "goal")).join(plan.select("key", "n"), "key"), "mix-cuts")
    joined = plan.join(cut.drop("n", "miss"), "key", "left").join(swaps(rows, cut), "key", "left")
    return joined.select("key", "n", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("swap", F.lit(-1)).alias("swap"))


def times() -> Column:
    """How often a document goes."""
    more = (F.col("draw") < F.col("cut")) != (F.col("draw") == F.col("swap"))
    return F.col("whole") + more.cast("int")


def mixture(docs: DataFrame, weight: Callable[[Column], Column] = cycle, total: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """A row for each document: its size, its source's size and target, and
    the words that the mix takes of it. ``weight`` is a whole number for a
    source's rank."""
    rows = written(sized(docs, seed), "mix-rows")
    of = written(facts(rows, weight, total, epochs), "mix-facts")
    return dealt_join(rows, of, "key", ["doc_id", "size"]).select("doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"), times().alias("times"))


def mixed(docs: DataFrame, weight: Callable[[Column], Column] = cycle, total: int | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix: every document as often as it is taken, with all columns."""
    of = written(facts(written(sized(docs, seed), "mix-rows"), weight, total, epochs), "mix-facts")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_measures(seed))
    taken = dealt_join(whole, of, "key", ["draw", "size"]).where(times() > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), times()))).select("row.*")
