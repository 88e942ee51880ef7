"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoded
from tidemark.llm.collocations import collocations
from tidemark.llm.factors import quality_scores
from tidemark.llm.jaccard import linked
from tidemark.llm.language import language_of
from tidemark.llm.licenses import licenses
from tidemark.llm.mixture import taken_words
from tidemark.llm.nearest import neighbours
from tidemark.llm.packing import packed_documents
from tidemark.llm.pages import extracted
from tidemark.llm.periods import run_digest
from tidemark.llm.repetition import quality_rules
from tidemark.llm.substrings import without_repeats
from tidemark.session import prepare
from tidemark.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, base: fn(prepare(spark), base)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The level of the shares: sources in the order of size over weight, the first ones at their bound, the rest by weight.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(text) AS t FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM s),
c AS (SELECT a.k, sum(b.source_size * 3) FILTER (WHERE b.k < a.k) AS fixed, sum(b.weight) FILTER (WHERE b.k >= a.k) AS open, any_value(a.source_size * 3 / a.weight) AS ratio
      FROM r a, r b GROUP BY a.k),
l AS (SELECT arg_min(level, k) AS level FROM (SELECT k, ratio, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(fixed, 0)::DOUBLE) / open::DOUBLE AS level FROM c) WHERE level <= ratio),
g AS (SELECT source, source_size, CASE WHEN level * weight > source_size * 3 THEN (source_size * 3)::DOUBLE ELSE level * weight END AS target FROM s, l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(sum(d.size) OVER (PARTITION BY d.source
        ORDER BY md5(concat_ws('|', coalesce(d.doc_id::VARCHAR, ''), 'mix')), d.doc_id, d.size, d.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, round(target)) - start) + greatest(0, least(start + source_size + size, round(target)) - start - source_size)
   + greatest(0, least(start + 2 * source_size + size, round(target)) - start - 2 * source_size))::BIGINT AS taken
FROM p
"""


@query("op10_mix_sources", OP10_SQL)
def op10_mix_sources(spark: SparkSession, base: str) -> DataFrame:
    """How often the mix takes the words of each document."""
    return taken_words(read_table(spark, base, "documents"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, base: str) -> DataFrame:
    """Token ids of each document and the text they decode to, as hashes."""
    return encoded(read_table(spark, base, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


# Words by place; a word is covered by an n-gram that starts at it or up to n - 1 words before it.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, w AS ws FROM d),
n AS (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS n),
g AS (SELECT r, i, n, word, CASE WHEN i + n - 1 <= len(ws) THEN array_to_string(ws[i : i + n - 1], ' ') END AS gram FROM w, n),
f AS (SELECT r, i, n, word, gram IS NOT NULL AND CASE WHEN n = 3 THEN count(*) OVER (PARTITION BY r, n, gram) > 1
        ELSE row_number() OVER (PARTITION BY r, n, gram ORDER BY i) > 1 END AS hit FROM g),
c AS (SELECT r, n, word, max(i) FILTER (WHERE hit) OVER (PARTITION BY r, n ORDER BY i) > i - n AS inside FROM f),
a AS (SELECT r, count(*) FILTER (WHERE n = 3 AND inside) AS n_repeat_words, sum(length(word)) FILTER (WHERE n = 3) AS word_chars,
        coalesce(sum(length(word)) FILTER (WHERE n = 5 AND inside), 0) AS c5, coalesce(sum(length(word)) FILTER (WHERE n = 6 AND inside), 0) AS c6,
        coalesce(sum(length(word)) FILTER (WHERE n = 7 AND inside), 0) AS c7, coalesce(sum(length(word)) FILTER (WHERE n = 8 AND inside), 0) AS c8,
        coalesce(sum(length(word)) FILTER (WHERE n = 9 AND inside), 0) AS c9, coalesce(sum(length(word)) FILTER (WHERE n = 10 AND inside), 0) AS c10
      FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d),
m AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS again FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
x AS (SELECT r, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (WHERE again), 0) AS cl FROM m GROUP BY r),
v AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(cl, 0)::BIGINT AS dup_line_chars, coalesce(c5, 0)::BIGINT AS dup_5gram_chars, coalesce(c6, 0)::BIGINT AS dup_6gram_chars, coalesce(c7, 0)::BIGINT AS dup_7gram_chars,
        coalesce(c8, 0)::BIGINT AS dup_8gram_chars, coalesce(c9, 0)::BIGINT AS dup_9gram_chars, coalesce(c10, 0)::BIGINT AS dup_10gram_chars
      FROM d LEFT JOIN a USING (r) LEFT JOIN x USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * dup_line_chars <= 20 * word_chars AND 100 * dup_5gram_chars <= 15 * word_chars
  AND 100 * dup_6gram_chars <= 14 * word_chars AND 100 * dup_7gram_chars <= 13 * word_chars AND 100 * dup_8gram_chars <= 12 * word_chars
  AND 100 * dup_9gram_chars <= 11 * word_chars AND 100 * dup_10gram_chars <= 10 * word_chars AS kept
FROM v
"""


@query("op4_quality_rules", OP4_SQL)
def op4_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    """Repetition measures of each document and whether it is kept."""
    return quality_rules(read_table(spark, base, "documents"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, base: str) -> DataFrame:
    """The language of each document."""
    return language_of(read_table(spark, base, "documents"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, base: str) -> DataFrame:
    """A quality score of each document, learned from the labels."""
    return quality_scores(read_table(spark, base, "documents"), read_table(spark, base, "labels"))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, base: str) -> DataFrame:
    """The main text of each page."""
    return extracted(read_table(spark, base, "pages"))


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark: SparkSession, base: str) -> DataFrame:
    """The group of near copies of each document, and how many documents it is linked to."""
    return linked(read_table(spark, base, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, w AS ws FROM d),
g AS (SELECT r, doc_id, i, word, CASE WHEN i + 12 <= len(ws) THEN array_to_string(ws[i : i + 12], ' ') END AS gram FROM w),
f AS (SELECT r, i, word, gram IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY gram) AS hit FROM g),
c AS (SELECT r, i, word, coalesce(max(i) FILTER (WHERE hit) OVER (PARTITION BY r ORDER BY i) > i - 13, false) AS gone FROM f),
k AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""


@query("op1_substring_dedup", OP1_SQL)
def op1_substring_dedup(spark: SparkSession, base: str) -> DataFrame:
    """Each document without the passages that an earlier one has."""
    return without_repeats(read_table(spark, base, "documents"), digest=True)


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, base: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return neighbours(read_table(spark, base, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, base: str) -> DataFrame:
    """License statements in the documents."""
    return licenses(read_table(spark, base, "documents"))


# crc32 by its table, built from its rule; a run of period q is an island of places where three words are those q words on.
OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, tab),
e AS (SELECT r, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS looped, h // 10 AS g FROM d),
f AS (SELECT r, w, n, looped, CASE WHEN looped THEN g % n END AS a, CASE WHEN looped THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
x AS (SELECT r, n, i, CASE WHEN looped AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)),
y AS (SELECT r, n, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
j AS (SELECT a.r, a.i, b.i - a.i AS q FROM y a JOIN y b ON a.r = b.r AND a.gram = b.gram AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM j),
s AS (SELECT r, q, min(i) AS b, max(i) + q + 3 AS e FROM k GROUP BY r, q, island HAVING max(i) + q + 3 - min(i) >= greatest(6, 4 * q)),
u AS (SELECT r, b, e, min(q) AS q FROM s GROUP BY r, b, e),
m AS (SELECT r, count(*) AS n_runs, first(struct_pack(b := b, l := e - b, q := q) ORDER BY (e - b)::DOUBLE / q DESC, b, q) AS best,
        string_agg(b || ',' || (e - b) || ',' || q || chr(10), '' ORDER BY b, q) AS lines FROM u GROUP BY r),
z AS (SELECT DISTINCT r, unnest(range(b + q, e)) AS i FROM u),
c AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN z ON x.r = z.r AND x.i = z.i GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.b::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (r) LEFT JOIN c USING (r)
"""


@query("op13_periodic_runs", OP13_SQL)
def op13_periodic_runs(spark: SparkSession, base: str) -> DataFrame:
    """Periodic runs of the words of each document."""
    return run_digest(read_table(spark, base, "documents"))


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, base: str) -> DataFrame:
    """The documents in as few sequences of 2048 tokens as the search finds."""
    return packed_documents(read_table(spark, base, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING m = 1 OR count(*) >= 100),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
s AS (SELECT lang, a, array_to_string(w[j : j + k - 1], ' ') AS inside FROM (SELECT *, unnest(range(1, m - k + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS k FROM c))),
t AS (SELECT lang, inside, max(a) AS most FROM s GROUP BY lang, inside),
x AS (SELECT c.*, unnest(range(1, m)) AS k FROM c LEFT JOIN t ON c.lang = t.lang AND c.phrase = t.inside WHERE most IS NULL OR 100 * most < 100 * a),
y AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, n.n, (1000 * x.a::HUGEINT * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : x.k], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1 : x.m], ' ') JOIN n ON n.lang = x.lang),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM z QUALIFY rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, base: str) -> DataFrame:
    """Phrases of each language that occur more often than their parts suggest."""
    return collocations(read_table(spark, base, "documents"))
