"""The text operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import decontaminate, language, licenses, lines, ngram_join, packing, quality, ranked_search, sharding, substrings, token_store, toxicity, trie

END = 2
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).select(F.col("doc.doc_id").alias("doc_id"), "held_out", "lang_pred", "score")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_table(spark, sf_dir, "documents"), WORD_TOKENIZER, END)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER, END)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.deduplicate(_table(spark, sf_dir, "documents"), min_words=1, characters=5)
    return made.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return made.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_at",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    made = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return made.select(F.col("doc.doc_id").alias("doc_id"), "held_out", "score", "predicted", "n_clauses")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_language_id, op3_token_store, op4_sharding, op5_best_fit_packing, op6_substring_dedup,
        op7_license_scan, op8_line_dedup, op9_ngram_join, op10_decontamination, op11_prefix_trie, op12_toxicity, op13_ranked_search,
    )
}

# --- SQL ---------------------------------------------------------------------------------------

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

_SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
firsts AS (SELECT k, min(doc_id) AS f FROM wins GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM wins JOIN firsts USING (k) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN x END, ' ' ORDER BY word.p) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_LEAKS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark)),
bw AS (SELECT DISTINCT item_id, p AS o, k, len(w) AS n, array_to_string(w[p:p + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM b WHERE k > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes)),
hits AS (SELECT DISTINCT doc_id, p, dw.k, o, n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
-- windows of one item that follow each other in both texts are one longer match
runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - o ORDER BY p) AS run FROM hits),
longest AS (SELECT doc_id, min(p) AS p, count(*) + min(k) - 1 AS n FROM runs GROUP BY doc_id, item_id, p - o, run),
far AS (SELECT doc_id, max(n) AS longest FROM longest GROUP BY doc_id),
far_at AS (SELECT doc_id, longest, min(p) - 1 AS longest_at FROM longest JOIN far USING (doc_id) WHERE n = longest GROUP BY ALL),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest, longest_at::BIGINT AS longest_at
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN far_at USING (doc_id)
"""


def _licenses() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(licenses.TEMPLATES.items()))
    return f"""
WITH t AS (SELECT license, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM (VALUES {values}) AS x(license, text)),
ts AS (SELECT license, s, array_to_string(w[p:p + s - 1], ' ') AS g FROM (SELECT license, w, s, unnest(range(1, len(w) - s + 2)) AS p FROM (SELECT *, least(5, len(w)) AS s FROM t))),
td AS (SELECT DISTINCT license, s, g FROM ts),
size AS (SELECT license, count(*) AS n, ceil(1.25 * count(*)) AS reach FROM td GROUP BY license),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
ds AS (SELECT doc_id, p, s, array_to_string(w[p:p + s - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS p FROM d, (SELECT DISTINCT s FROM td))),
m AS (SELECT doc_id, license, p, ds.g FROM ds JOIN td ON ds.g = td.g AND ds.s = td.s),
c AS (SELECT a.doc_id, a.license, a.p, count(DISTINCT z.g) / any_value(n)::DOUBLE AS held
  FROM m a JOIN size USING (license) JOIN m z ON a.doc_id = z.doc_id AND a.license = z.license AND z.p >= a.p AND z.p < a.p + reach
  GROUP BY a.doc_id, a.license, a.p)
SELECT doc_id, license, max(held) AS containment, min(p)::BIGINT - 1 AS first_word, count(*) AS n_starts FROM c WHERE held >= 0.8 GROUP BY doc_id, license
"""


_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b, shared.n = x.n AND shared.n = y.n AS same FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 10 * shared.n >= 8 * (x.n + y.n - shared.n)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
class AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a),
links AS (SELECT a AS doc_id, count(*) AS n, min(b) FILTER (same) AS copy, count(*) FILTER (same) AS copies FROM link GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(c, doc_id)) AS class_id, coalesce(n, 0)::BIGINT AS n_links,
  least(doc_id, coalesce(copy, doc_id)) AS copy_id, (coalesce(copies, 0) + 1)::BIGINT AS n_copies
FROM d LEFT JOIN class USING (doc_id) LEFT JOIN links USING (doc_id)
"""

_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_ALNUM})) AS t FROM benchmark),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c WHERE t IN (SELECT t FROM q) GROUP BY t, c.n),
s AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * c.n) // c.l))))::BIGINT AS score
  FROM q JOIN df USING (t) JOIN p USING (t) JOIN d USING (r), c GROUP BY item_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""

_TRIE = r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 bit by bit: each character of the decimal id, then eight shifts
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
    lambda s, x: list_reduce(list_prepend(xor(s, x), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))), 4294967295::UBIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, p AS o, role, text FROM h JOIN t ON t.c = h.c - h.c % 100 AND p <= h UNION ALL SELECT h.c, p, role, text FROM h JOIN t USING (c) WHERE p > h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS d, role, text FROM r),
x AS (SELECT c, d, length(text) AS len, md5(string_agg(concat(length(role), ',', length(text), ':', role, text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM n),
a AS (SELECT * FROM x UNION ALL SELECT c, 0, 0, '' FROM h),
m AS (SELECT c, max(d) AS last FROM a GROUP BY c),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, any_value(len) AS len, string_agg(CASE WHEN d = last THEN c END::VARCHAR, ',' ORDER BY c) AS ends FROM a JOIN m USING (c) GROUP BY d, k),
-- the path of a node's smallest member leads through all nodes above it
link AS (SELECT node.d, node.k, up.k AS pk FROM node JOIN a up ON up.c = node.conv_id AND up.d = node.d - 1),
child AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM link GROUP BY ALL),
own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (d, k)),
under AS (SELECT a.d, a.k, sum((own.n_children = 0)::INT) AS n_leaves, sum((own.n - 1) * own.len) AS saved FROM own JOIN a ON a.c = own.conv_id AND a.d <= own.d GROUP BY ALL)
SELECT own.conv_id, own.d::BIGINT AS depth, up.conv_id AS parent_conv_id, own.n AS n_convs, own.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN under USING (d, k) LEFT JOIN link USING (d, k) LEFT JOIN node up ON up.d = own.d - 1 AND up.k = link.pk
"""

ORACLES: dict[str, str] = {
    "op6_substring_dedup": _SUBSTRINGS, "op7_license_scan": _licenses(), "op9_ngram_join": _JOIN, "op10_decontamination": _LEAKS,
    "op11_prefix_trie": _TRIE, "op13_ranked_search": _SEARCH,
}
