"""Personal data by patterns and by information-theoretic disclosure (operator 2).

DataFrame functions only; nothing runs in Python.

Base spans are four patterns: email, ip, card, phone. Each pattern is written
so that Java's matcher reads a text once (possessive runs, a start that can't
lie inside a run), which gives the same leftmost matches as the plain form and
doesn't slow down on long runs. Offsets come from the lengths of the pieces
between the matches, in code points.

The method: the protected entities are the values found and what several
values share: an email's domain, an ip's network (two numbers), a card's issuer
(six digits), a phone's area (four digits). A term discloses an entity by

    PMI(term; entity) / IC(entity) = log(n_te N / (n_t n_e)) / log(N / n_e),

with n counted over all documents, whole: 1 means that who sees the term knows
the entity. Terms that stand in documents with a value in ``SUPPORT`` different
texts or more (copies are one text; ``SHARED_SUPPORT`` for what values share,
which meets more terms by chance) and reach ``THRESHOLD`` are spans of kind
``term`` wherever they stand in documents with that entity, and are generalised
like the rest.

Entities that recur are counted first, and only their texts are joined to
terms. Counting runs as partial aggregates; one entity or term in a third of
all texts is one row a task, and its joins are dealt over several. Texts are
never shuffled to find spans.

Defined cases: a null text counts as empty and has no spans; rows with equal
id and text get equal answers; a null id is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import dealt_join, free_name, written

CONTEXT = 64
SUPPORT = 3
SHARED_SUPPORT = 6
THRESHOLD = 0.7
#: Values that are folded at a time, and code points of a chunk of text.
BLOCK = 256
CHUNK = 1024
#: Bytes of the asked terms up to which they are broadcast.
BROADCAST = 8 << 20
KINDS = ("email", "ip", "card", "phone", "term")

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{4,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"

SPAN = "array<struct<start:int,end:int,value:string>>"
PLACES = "array<struct<start:int,end:int>>"


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, also where ``use`` asks
    for it inside of a function of elements."""
    return F.transform(F.array(value), use)[0]


def scanned(values: Column, join: Callable[[Column, Column], Column], first: Column) -> Column:
    """What ``join`` makes of ``first`` and all values before each one, as
    longs. Blocks of ``BLOCK`` values are folded one by one, so no step copies
    more than a block's results or the list of blocks."""

    def fold(xs: Column, start: Column) -> Column:
        step = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda s: s["out"])

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / BLOCK).cast("int") - 1), lambda i: F.slice(xs, i * BLOCK + 1, BLOCK))
        starts = fold(F.transform(blocks, lambda part: F.aggregate(part, first, join)), first)
        return F.when(F.size(xs) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.zip_with(blocks, starts, fold)))

    return held(values, whole)


def before(lengths: Column) -> Column:
    """The sum of all lengths before each one."""
    return scanned(F.transform(lengths, lambda n: n.cast("bigint")), lambda a, b: a + b, F.lit(0).cast("bigint"))


def located(text: Column, pattern: str, maybe: Column) -> Column:
    """Matches of ``pattern`` as structs (start, end, value); ``maybe`` is a
    cheap test that is true wherever there can be one."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(gaps, found, lambda g, f: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(f), F.lit(0)).alias("n"), f.alias("value")))
    row = lambda x, s: F.struct((s + x["gap"]).cast("int").alias("start"), (s + x["gap"] + x["n"]).cast("int").alias("end"), x["value"].alias("value"))
    placed = held(pairs, lambda xs: F.zip_with(xs, before(F.transform(xs, lambda x: x["gap"] + x["n"])), row))
    spans = F.filter(placed, lambda x: x["value"].isNotNull())
    return F.when(maybe & text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def in_byte(part: Column) -> Column:
    digits = F.regexp_replace(part, "^0+", "")
    return (F.length(digits) <= 3) & (F.concat(F.lit("0"), F.substring(digits, 1, 3)).cast("int") <= 255)


def valid_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), in_byte)


def valid_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def valid_phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)


def base_spans(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")

    def kept(pattern: str, maybe: Column, test: Callable[[Column], Column]) -> Column:
        return F.filter(located(text, pattern, maybe), lambda x: test(x["value"]))

    return {
        "email": located(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": kept(IP, digit, valid_ip),
        "card": kept(CARD, digit, valid_card),
        "phone": kept(PHONE, F.contains(text, F.lit("+")), valid_phone),
    }


def lowered(text: Column) -> Column:
    """ASCII letters lower-cased; lengths stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def term_words(text: Column) -> Column:
    """Terms of a whole text, as structs (start, end, t)."""
    return F.transform(located(lowered(text), TERM, F.lit(True)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("t")))


def shared_part(kind: str, value: Column) -> Column:
    """What several values of a kind have in common."""
    figures = F.regexp_replace(value, "[^0-9]", "")
    return {"email": lowered(F.substring_index(value, "@", -1)), "ip": F.substring_index(value, ".", 2), "card": F.substring(figures, 1, 6), "phone": F.substring(figures, 1, 4)}[kind]


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row for each document: id, hash of its text, base spans by
    kind, its entities and, where it has any, its terms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    spans = base_spans(F.col("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), *(c.alias(k) for k, c in spans.items()))

    def entities(of: Callable[[str, Column], Column], least: int) -> Column:
        """Distinct as numbers, which Spark hashes; structs it compares in pairs."""
        numbers = lambda k: F.transform(F.col(k), lambda x: of(k, x["value"]))
        each = F.array_distinct(F.concat(*map(numbers, spans)))
        return F.transform(each, lambda e: F.struct(e.alias("e"), F.lit(least).alias("least")))

    value = entities(lambda k, v: F.xxhash64(F.lit(k), v), SUPPORT)
    shared = entities(lambda k, v: F.xxhash64(F.lit(f"{k} shared"), shared_part(k, v)), SHARED_SUPPORT)
    found = F.concat(value, shared)
    words = F.when(F.greatest(*(F.size(k) for k in spans)) > 0, term_words(F.col("text")))
    slim = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k)
    return rows.select("doc_id", "h", *(slim(k) for k in spans), found.alias("entities"), words.alias("words"))


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(e, t, n): the terms that disclose an entity, from counts over the
    corpus, and the number of rows that have the entity."""
    with_entities = found.where(F.size("entities") > 0)
    having = with_entities.select("h", F.explode("entities").alias("x")).groupBy("h", "x.e", "x.least").agg(F.count(F.lit(1)).alias("times"))
    n_e = having.groupBy("e", "least").agg(F.sum("times").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= F.col("least"))
    n_e = written(n_e.select("e", "n_e", F.col("texts").alias("n")), "pii-entities")
    having = dealt_join(having, n_e.select("e", "n"), "e", ["h"])
    terms = with_entities.select("h", F.explode(F.array_distinct(F.transform("words", lambda x: x["t"]))).alias("t")).distinct()
    together = having.join(terms, "h").groupBy("e", "least", "t").agg(F.sum("times").alias("n_te"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= F.col("least"))
    together = written(together.select("e", "t", "n_te"), "pii-together")
    sizes = together.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    together = dealt_join(together, n_e.drop("n").join(sizes, "e"), "e", ["t"])
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(lowered(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM), F.lit(0)))).alias("t"))
    asked = written(together.select("t").distinct(), "pii-asked")
    if (asked.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0) <= BROADCAST:
        words = words.join(F.broadcast(asked), "t", "left_semi")  # else all terms are counted, in partial sums
    n_t = words.groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    n = F.lit(found.count()).cast("double")
    pmi = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e")))
    content = F.log(n / F.col("n_e"))
    scored = together.join(n_t.where(F.col("n_t") >= SUPPORT), "t").where((content > 0) & (pmi >= THRESHOLD * content))
    return scored.select("e", "t", F.col("n_e").alias("n"))


def term_places(found: DataFrame, disclosed: DataFrame) -> DataFrame:
    """(of, of_h, term): where disclosing terms stand in documents with their
    entity. Terms are rows, so an entity may have any number of them."""
    rows = found.where(F.size("entities") > 0)
    of = [F.col("doc_id").alias("of"), F.col("h").alias("of_h")]
    having = rows.select(*of, F.explode("entities.e").alias("e"))
    total = disclosed.select("e", "n").distinct().agg(F.sum("n")).first()[0] or 0
    wanted = dealt_join(having, disclosed, "e", ["of", "of_h"], total).select("of", "of_h", "t").distinct()
    words = rows.select(*of, F.explode("words").alias("w")).select(F.col("of").alias("in"), F.col("of_h").alias("in_h"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.t").alias("word"))
    same = (F.col("of_h") == F.col("in_h")) & F.col("of").eqNullSafe(F.col("in")) & (F.col("t") == F.col("word"))
    places = words.join(wanted, same).select("of", "of_h", "start", "end").distinct()
    return places.groupBy("of", "of_h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("term"))


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, email, ip, card, phone, term): every span by kind."""
    found = written(base(docs, id_col, text_col), "pii-base")
    disclosed = written(disclosing(docs, found, text_col), "pii-disclosed")
    places = written(term_places(found, disclosed), "pii-terms")
    joined = found.join(places, (found["h"] == places["of_h"]) & found["doc_id"].eqNullSafe(places["of"]), "left")
    return joined.select("doc_id", "h", *KINDS[:4], F.coalesce("term", F.array().cast(PLACES)).alias("term"))


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans, by kind and start, comma-joined."""

    def part(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(part, kinds)), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every row."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return spans_of(docs, id_col, text_col).select("doc_id", *counts, F.sha2(listed(KINDS[:4]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each of ``spans`` (start, end, tag), in order of start,
    as its tag; one that begins inside of others goes with them. Texts are cut
    into chunks, so that a piece costs what it has and not what stands before."""

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, F.ceil(b / CHUNK).cast("int") - first), "")
        return F.when(b <= a, F.lit("")).otherwise(F.substring(near, (a - first * CHUNK + 1).cast("int"), (b - a).cast("int")))

    def whole(chunks: Column) -> Column:
        ends = F.transform(spans, lambda m: m["end"].cast("bigint"))
        upto = scanned(ends, lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint"))
        pieces = F.zip_with(spans, upto, lambda m, at: F.when(m["start"] < at, F.lit("")).otherwise(F.concat(piece(chunks, at, m["start"]), m["tag"])))
        return F.concat(F.array_join(pieces, ""), piece(chunks, F.array_max(ends), F.length(text).cast("bigint")))

    return held(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), whole)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets;
    overlapping spans become the first one's. n_chars follows the text where
    the table has it. All rows and columns stay."""
    spans = spans_of(docs)

    def tagged(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("tag")))

    name = free_name(docs.columns, "marks")
    mark = F.struct("doc_id", "h", F.array_sort(F.concat(*map(tagged, KINDS))).alias("spans"))
    marks = spans.select(mark.alias(name)).where(F.size(F.col(name)["spans"]) > 0).distinct()
    found, h = F.col(name), F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.join(marks, (h == found["h"]) & F.col("doc_id").eqNullSafe(found["doc_id"]), "left")

    text = F.when(found.isNull(), F.col("text")).otherwise(replaced(F.col("text"), found["spans"]))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(found.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
