"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, language_id, line_crf, line_dedup, mixing, ngram_join, quality_rules, secret_scan, substring_dedup, token_counts
from quillgraph.llm.common import crc_mod, docs_of

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(docs_of(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs_of(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.class_report(docs_of(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(docs_of(spark, sf_dir), quality_rules.target_ids(docs_of(spark, sf_dir, "labels")))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4 that SQL can express."""
    return quality_rules.scores(docs_of(spark, sf_dir), quality_rules.no_ratios()).drop("llr")


def secret_base_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base patterns of op7."""
    return secret_scan.base_spans(docs_of(spark, sf_dir)).select("doc_id", *secret_scan.BASE_COLUMNS)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op5: sizes, targets, and that every document is taken a whole number of times, at most thrice."""
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size == 0, taken == 0).otherwise((taken % size == 0) & taken.between(0, mixing.MAX_REPEATS * size))
    return mixing.mix(docs_of(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), whole.alias("whole"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(docs_of(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    model = language_id.fit(docs, crc_mod(F.col("i"), 4) != 2)
    marked = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return language_id.predict(marked, model, keep=["doc_id", "held_out"], score_out="score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_samples(docs)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(docs_of(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    field = line_crf.fit(docs, docs_of(spark, sf_dir, "labels"), crc_mod(F.col("id"), 5) != 0)
    marked = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return line_crf.score(marked, field, keep=["doc_id", "held_out"])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(docs_of(spark, sf_dir), docs_of(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_decontaminate": op10_decontaminate,
    "mixing_targets": mixing_targets,
    "quality_base_rules": quality_base_rules,
    "secret_base_patterns": secret_base_patterns,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

# Words of a text as op10 takes them: lower-case A-Z, then split at everything else below U+0080.
_OP10_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT g, min(doc_id) AS low FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN first USING (g) WHERE low < doc_id),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN w[places.p] END, ' ' ORDER BY places.p) AS t
  FROM places LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op3_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
keyed AS (SELECT doc_id, sha256(string_agg(x, chr(10) ORDER BY x)) AS k, count(*) AS n FROM s GROUP BY doc_id),
members AS (SELECT k, min(doc_id) AS member, min(n) AS n FROM keyed GROUP BY k),
grams AS MATERIALIZED (SELECT member, n, x FROM members JOIN s ON member = doc_id),
pairs AS MATERIALIZED (
  SELECT a.member AS a, b.member AS b FROM grams a JOIN grams b ON a.x = b.x AND a.member <> b.member AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.member, b.member HAVING 5 * count(*) >= 4 * (min(a.n) + min(b.n) - count(*))),
reach(a, b) AS (SELECT member, member FROM members UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
classes AS (SELECT a AS member, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT a AS member, count(*) AS n_links FROM pairs GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CASE WHEN d.doc_id IS NOT NULL THEN CAST(coalesce(keyed.n, 0) AS BIGINT) END AS n_shingles
FROM documents d LEFT JOIN keyed USING (doc_id) LEFT JOIN members USING (k) LEFT JOIN classes USING (member) LEFT JOIN links USING (member)
""",
    "op8_line_dedup": r"""
WITH lines AS (SELECT doc_id, unnest(range(0, len(l))) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
words AS (SELECT line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT line FROM lines WHERE doc_id IS NOT NULL)),
fields AS (SELECT line, w, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS f, list_transform(w, lambda x: CAST(regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]') AND NOT regexp_matches(x, '[0-9]') AS INT)) AS s FROM words WHERE len(w) > 0),
shown AS (SELECT line, len(w) AS n, CASE WHEN len(w) >= 3 AND len(list_filter(f, lambda x: x <> '<*>')) >= 2 THEN f ELSE w END AS t, s, list_sum(s) AS held FROM fields),
few AS (SELECT line, array_to_string(list_concat([CAST(n AS VARCHAR)], t), ' ') AS g FROM shown WHERE n < 3),
opened AS (SELECT *, unnest(range(i, n + 1)) AS j FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM shown WHERE n BETWEEN 3 AND 11)),
short AS (
  SELECT DISTINCT line, n || ' ' || array_to_string(list_transform(t, lambda x, p: CASE WHEN p = i OR p = j THEN '<*>' ELSE x END), ' ') AS g FROM opened
  WHERE j = 0 OR (i = 0 AND held - s[j] >= 2) OR (0 < i AND i < j AND held - s[i] - s[j] >= 3)),
cut AS (
  SELECT line, n, held, list_transform(c, lambda x: array_to_string(t[x[1] + 1:x[2]], ' ')) AS p, list_transform(c, lambda x: list_sum(s[x[1] + 1:x[2]])) AS h
  FROM (SELECT *, [[0, 3], [3, 3 + (n - 3) // 4], [3 + (n - 3) // 4, 3 + (n - 3) * 2 // 4], [3 + (n - 3) * 2 // 4, 3 + (n - 3) * 3 // 4], [3 + (n - 3) * 3 // 4, n]] AS c FROM shown WHERE n >= 12)),
choices AS (SELECT i, j FROM range(1, 6) a(i), range(1, 6) b(j) WHERE i < j),
pairs AS (SELECT line, n, p, i, j, held - h[i] - h[j] > 2 AS ok FROM cut, choices),
single AS (SELECT line, n, p, unnest([0, 2, 3, 4, 5]) AS i FROM (SELECT line, any_value(n) AS n, any_value(p) AS p FROM pairs GROUP BY line HAVING NOT bool_and(ok))),
long AS (
  SELECT line, n, p, i, j FROM pairs WHERE ok UNION ALL SELECT line, n, p, i, 0 FROM single),
keys AS (
  SELECT line, g FROM few UNION ALL SELECT line, g FROM short
  UNION ALL SELECT line, n || chr(10) || i || chr(10) || j || chr(10) || array_to_string(list_transform(p, lambda x, q: CASE WHEN q = i OR q = j THEN '<*>' ELSE x END), chr(10)) FROM long),
hashed AS MATERIALIZED (SELECT line, md5(g) AS g FROM keys),
again AS (SELECT g, min(doc_id) AS first FROM (SELECT DISTINCT doc_id, g FROM lines JOIN hashed USING (line) WHERE doc_id IS NOT NULL) GROUP BY g HAVING count(*) >= 5),
gone AS (SELECT DISTINCT doc_id, k FROM lines JOIN hashed USING (line) JOIN again USING (g) WHERE doc_id <> first),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(gone.k) AS n_dropped, string_agg(line, chr(10) ORDER BY lines.k) FILTER (gone.k IS NULL) AS t
  FROM lines LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
""",
    "mixing_targets": rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weights AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM s),
filled AS (
  SELECT *, 3 * source_size / weight AS level, row_number() OVER by_level AS place, sum(source_size) OVER () - sum(3 * source_size) OVER by_level + 3 * source_size AS rest,
    sum(weight) OVER () - sum(weight) OVER by_level + weight AS share
  FROM weights WINDOW by_level AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
settled AS (SELECT arg_min(rest / share, place) AS l FROM filled WHERE rest / share <= level)
SELECT doc_id, size, source_size, round(least(CAST(3 * source_size AS DOUBLE), weight * l), 3) AS target, true AS whole
FROM d JOIN weights ON d.source IS NOT DISTINCT FROM weights.source, settled
""",
    "quality_base_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
lines AS (
  SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
""",
    "secret_base_patterns": r"""
WITH p(k, kind, re) AS (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', '(AKIA)([A-Z0-9]{16,})'), (2, 'hex', '()([0-9a-f]{24,})')),
t AS (SELECT doc_id, k, kind, re, coalesce(text, '') AS s FROM documents, p),
cut AS (
  SELECT doc_id, k, kind, unnest(regexp_extract_all(s, re, 0)) AS v, unnest(regexp_extract_all(s, re, 2)) AS g, unnest(string_split_regex(s, re)) AS piece, unnest(range(1, len(s) + 2)) AS i
  FROM t WHERE regexp_matches(s, re)),
placed AS (SELECT doc_id, k, kind, v, g, sum(length(piece) + length(v)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM cut WHERE v IS NOT NULL),
kept AS (SELECT doc_id, k, kind, e - length(v) AS a, e FROM placed WHERE k > 0 OR length(g) >= 6)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k), '')) AS base_sha256
FROM documents LEFT JOIN kept USING (doc_id) GROUP BY doc_id
""",
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, {_OP10_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP10_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, n, i, item_id FROM grams JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
