"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import chat, decontam, divergence, edit_fingerprint, langid, mixing, negatives, packing, pii, simhash, suffix_dedup, token_orc, toxicity
from ruleloom.llm.common import table, written


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op6_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(edit_fingerprint.with_next(table(spark, sf_dir, "documents")), "edit-rows")
    return edit_fingerprint.with_near(rows)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(table(spark, sf_dir, "documents"))


def op11_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("times")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, label = table(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    return negatives.mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_id,
        op2_pii,
        op3_benchmark_decontamination,
        op4_toxicity,
        op5_suffix_dedup,
        op6_edit_fingerprints,
        op7_chat_formatting,
        op8_best_fit_packing,
        op9_simhash_near_dedup,
        op10_token_orc,
        op11_source_mixture,
        op12_source_divergence,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in found}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3 = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
    unnest(list_transform(range(0, len(w) - least(len(w), 10) + 1), lambda i: array_to_string(w[i + 1 : i + least(len(w), 10)], ' '))) AS win
  FROM items WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS word,
    unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS win
  FROM docs, sizes WHERE len(w) >= k),
found AS (SELECT doc_id, item_id, p.k, word FROM places p JOIN windows USING (k, win)),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(word, word + k)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""



def _each(first: str, after: str, body: str) -> str:
    """A list of ``body`` for i from ``first`` up to, not with, ``after``."""
    return f"list_transform(range({first}, {after}), lambda i: {body})"


def _rendered(side: str) -> str:
    body = f"'<|' || {side}_role[i] || '|>' || chr(10) || {side}_text[i] || '<|end|>' || chr(10)"
    return f"sha256(coalesce(array_to_string({_each('n + 1', f'len({side}_role) + 1', body)}, ''), ''))"


def _spans(side: str) -> str:
    """Lengths of role and text, with the 5 and 8 characters of the marks."""
    before = f"coalesce(list_sum(list_transform(range(n + 1, i), lambda j: length({side}_role[j]) + length({side}_text[j]) + 13)), 0)::BIGINT + length({side}_role[i]) + 5"
    one = f"CASE WHEN {side}_role[i] = 'assistant' THEN ({before}) || ':' || ({before} + length({side}_text[i]) + 8) END"
    return f"coalesce(array_to_string(list_filter({_each('n + 1', f'len({side}_role) + 1', one)}, lambda s: s IS NOT NULL), ','), '')"


#: conv_id is never null in the tables.
_OP7 = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
convs AS (SELECT conv_id, list(role ORDER BY turn NULLS FIRST, role, text) AS role, list(text ORDER BY turn NULLS FIRST, role, text) AS text FROM turns GROUP BY conv_id),
said AS (SELECT *, role[1] AS first_role, text[1] AS first_text, list_sum({_each("1", "len(role) + 1", "CASE WHEN role[i] = 'assistant' THEN length(text[i]) ELSE 0 END")}) AS said,
  list_filter(range(1, len(role) + 1), lambda i: role[i] = 'assistant') AS own FROM convs),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY first_role, first_text ORDER BY conv_id) - 1) // 2 AS pair FROM said),
ranked AS (SELECT *, row_number() OVER (PARTITION BY first_role, first_text, pair ORDER BY said DESC, conv_id) AS place FROM numbered),
pairs AS (SELECT a.conv_id AS chosen_id, coalesce(b.conv_id, a.conv_id) AS rejected_id, a.role AS a_role, a.text AS a_text, coalesce(b.role, a.role) AS b_role,
  CASE WHEN b.conv_id IS NOT NULL THEN b.text ELSE list_transform(range(1, len(a.role) + 1), lambda i: CASE WHEN i = a.own[-1] THEN CASE WHEN len(a.own) > 1 THEN a.text[a.own[-2]] ELSE '' END ELSE a.text[i] END) END AS b_text
  FROM (SELECT * FROM ranked WHERE place = 1) a LEFT JOIN (SELECT * FROM ranked WHERE place = 2) b USING (first_role, first_text, pair)),
cut AS (SELECT *, coalesce(list_filter(range(1, least(len(a_role), len(b_role)) + 1), lambda i: a_role[i] <> b_role[i] OR a_text[i] <> b_text[i])[1] - 1, least(len(a_role), len(b_role)))::INT AS n FROM pairs)
SELECT chosen_id, rejected_id, n AS n_prompt_turns, sha256(coalesce(array_to_string({_each("1", "n + 1", "'<|' || a_role[i] || '|>' || chr(10) || a_text[i] || '<|end|>' || chr(10)")}, ''), '')) AS prompt_sha256,
  {_rendered("a")} AS chosen_completion_sha256, {_rendered("b")} AS rejected_completion_sha256, {_spans("a")} AS chosen_spans, {_spans("b")} AS rejected_spans
FROM cut
"""


#: doc_id is never null nor repeated in the tables.
_OP5 = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, i, b[i + 1 : i + 100] AS w FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM docs)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM late),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS z FROM spans UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id),
left_over AS (SELECT doc_id, string_agg(CASE WHEN coalesce(z, octet_length(b)) > a THEN hex(b[a + 1 : coalesce(z, octet_length(b))]) ELSE '' END, '' ORDER BY a) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


#: doc_id is never repeated in the tables. Sources are clamped in order of
#: size by weight; the level is the first that the next source isn't above.
_OP11 = r"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('42:' || doc_id), 1, 15))::BIGINT AS draw FROM documents),
sums AS (SELECT source, sum(size)::HUGEINT AS n, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS w FROM docs GROUP BY source),
steps AS (SELECT *, row_number() OVER o AS k, (SELECT sum(n) FROM sums)::HUGEINT - coalesce(sum(3 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS num,
  sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS den FROM sums WINDOW o AS (ORDER BY n / w, source)),
level AS (SELECT num, den FROM steps WHERE 3 * n * den >= w * num ORDER BY k LIMIT 1),
plan AS (SELECT source, n, 3 * n * den <= w * num AS clamped, CASE WHEN 3 * n * den <= w * num THEN (3 * n)::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target,
  CASE WHEN n = 0 THEN 0 WHEN 3 * n * den <= w * num THEN 3 ELSE (w * num) // (n * den) END AS whole, w * num AS up, den FROM sums, level),
goals AS (SELECT *, CASE WHEN clamped OR n = 0 THEN 0 ELSE (up - whole * n * den) // den END AS goal FROM plan),
went AS (SELECT doc_id, d.source, size, draw, n, target, whole, goal, goal > 0 AND 2 * coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size <= 2 * goal AS more
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
missed AS (SELECT *, goal - sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY source) AS miss FROM went),
swapped AS (SELECT source, arg_min(doc_id, (abs(size - abs(miss)), draw)) AS swap FROM missed WHERE goal > 0 AND (miss > 0) = (NOT more) AND abs(size - abs(miss)) < abs(miss) GROUP BY source)
SELECT doc_id, size, n::BIGINT AS source_size, target, (size * (whole + CASE WHEN more <> coalesce(doc_id = swap, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM missed m LEFT JOIN swapped s ON m.source IS NOT DISTINCT FROM s.source
"""


#: doc_id is never repeated in the tables. Every term of every group, counts
#: of zero included.
_OP12 = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLD}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT doc_id, lang, source, unnest(w) AS t FROM docs),
kept AS (SELECT lang, t, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
postings AS (SELECT lang, source, t, count(*) AS n FROM words JOIN kept USING (lang, t) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS whole FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS size FROM postings GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT lang, source, t, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 2)::HUGEINT // (coalesce(size, 0) + 2 * v) AS p, 1 + 1000000000 * (total + 2)::HUGEINT // (whole + 2 * v) AS q
  FROM groups JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN sizes USING (lang, source) LEFT JOIN postings USING (lang, source, t)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
"""


#: vec_id is never null nor repeated in the tables.
_OP13 = """
WITH vectors AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": _OP3, "op5_suffix_dedup": _OP5, "op7_chat_formatting": _OP7, "op11_source_mixture": _OP11, "op12_source_divergence": _OP12, "op13_hard_negatives": _OP13}
