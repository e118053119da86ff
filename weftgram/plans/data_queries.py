"""Queries on raw records, hot keys and table copies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.operators import hotkeys, rawrecords, tablediff
from weftgram.runtime import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return rawrecords.failing_lines(table(spark, sf, "phrasetable_raw"), table(spark, sf, "lm_raw")).select("raw_table", "line_id")


def p2_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return rawrecords.failing_lines(table(spark, sf, "phrasetable_raw"), table(spark, sf, "lm_raw"))


def p2_phrase_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = rawrecords.parse_phrase_lines(table(spark, sf, "phrasetable_raw")).filter("reason IS NULL")
    return rows.select("line_id", "source", "target", F.size("scores").alias("n_scores"), F.array_max("scores").alias("best_score"))


def p2_lm_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = rawrecords.parse_lm_lines(table(spark, sf, "lm_raw")).filter("kind = 'entry'")
    return rows.select("line_id", "file_no", "k", "ngram", "logprob", "backoff")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    profile = hotkeys.key_profile(table(spark, sf, "phrasepairs"), "pair_id", "source", "target")
    return profile.filter("n_records * 100 >= n_all").select(F.col("key").alias("source"))


def p6_sources(spark: SparkSession, sf: str) -> DataFrame:
    profile = hotkeys.key_profile(table(spark, sf, "phrasepairs"), "pair_id", "source", "target")
    return profile.select(F.col("key").alias("source"), "n_records", F.col("n_items").alias("n_targets"), F.round("flat_score", 9).alias("flat_score"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return tablediff.differences(table(spark, sf, "phrasetable_a"), table(spark, sf, "phrasetable_b"))


QUERIES = {f.__name__: f for f in (p2_found, p2_reasons, p2_phrase_pairs, p2_lm_entries, p6_found, p6_sources, p7_found)}

_PAIRS = r"""pairs AS (SELECT pair_id, trim(regexp_replace(source, '[ \t]+', ' ', 'g'), ' ') AS source,
    trim(regexp_replace(target, '[ \t]+', ' ', 'g'), ' ') AS target FROM phrasepairs)"""

_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_LM = rf"""lines AS (SELECT line_id, file_no, line,
    TRY_CAST(nullif(regexp_extract(line, '^\\([0-9]+)-grams:[ \t\r]*$', 1), '') AS INT) AS own FROM lm_raw),
  placed AS (SELECT line_id, file_no, line, last_value(own IGNORE NULLS) OVER (PARTITION BY file_no ORDER BY line_id) AS k FROM lines),
  content AS (SELECT *, string_split(line, chr(9)) AS f FROM placed
    WHERE line IS NULL OR NOT regexp_full_match(line, '(\\data\\|ngram [0-9]+=[0-9]+|\\[0-9]+-grams:|\\end\\)?[ \t\r]*')),
  parts AS (SELECT *, trim(f[1], ' ' || chr(13)) AS p, trim(f[2], ' ' || chr(13)) AS g, trim(coalesce(f[3], ''), ' ' || chr(13)) AS b FROM content),
  judged AS (SELECT *, coalesce(len(f) BETWEEN 2 AND 3 AND regexp_full_match(p, '{_NUM}') AND isfinite(TRY_CAST(p AS DOUBLE)) AND TRY_CAST(p AS DOUBLE) <= 0
      AND g <> '' AND len(list_filter(string_split(g, ' '), lambda w: w <> '')) = k
      AND (b = '' OR (regexp_full_match(b, '{_NUM}') AND isfinite(TRY_CAST(b AS DOUBLE)))), false) AS ok FROM parts)"""
_PT = rf"""parts AS (SELECT line_id, regexp_extract(line, '^((?:[ \t\r]*"(?:[^"]|"")*"[ \t\r]*)|(?:[^"|]|\|[^"|]|\|\|[^"|])*)\|\|\|((?:[ \t\r]*"(?:[^"]|"")*"[ \t\r]*)|(?:[^"|]|\|[^"|]|\|\|[^"|])*)\|\|\|((?:[ \t\r]*"(?:[^"]|"")*"[ \t\r]*)|(?:[^"|]|\|[^"|]|\|\|[^"|])*)$', ['a', 'b', 'c']) AS x, line FROM phrasetable_raw),
  stripped AS (SELECT line_id, trim(x.a, E' \t\r') AS a, trim(x.b, E' \t\r') AS b, trim(x.c, E' \t\r') AS c FROM parts),
  bare AS (SELECT line_id, CASE WHEN a LIKE '"%' THEN replace(a[2:-2], '""', '"') ELSE a END AS source,
    CASE WHEN b LIKE '"%' THEN replace(b[2:-2], '""', '"') ELSE b END AS target,
    CASE WHEN c LIKE '"%' THEN c[2:-2] ELSE c END AS c FROM stripped),
  scored AS (SELECT *, list_filter(regexp_split_to_array(c, '[ \t\r]+'), lambda w: w <> '') AS w FROM bare),
  judged AS (SELECT *, coalesce(trim(source, E' \t\r') <> '' AND trim(target, E' \t\r') <> '' AND len(w) BETWEEN 1 AND 5
    AND len(list_filter(w, lambda v: NOT (regexp_full_match(v, '{_NUM}') AND coalesce(TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 1, false)))) = 0, false) AS ok FROM scored)"""

_ANY = r'^((?:[ \t\r]*"(?:[^"]|"")*"[ \t\r]*)|(?:[^"|]|\|[^"|]|\|\|[^"|])*(?:\|{1,2}$)?)'
_FULL = "trim(CASE WHEN {f} LIKE '\"%' THEN replace({f}[2:-2], '\"\"', '\"') ELSE {f} END, E' \\t\\r') <> ''"
#: Why a line fails, field by field: ``f1 .. f3`` are the fields from the left, ``r1 .. r3`` what follows them.
_REASONS = rf"""a1 AS (SELECT line_id, line, regexp_extract(line, '{_ANY}', 1) AS g1 FROM phrasetable_raw), b1 AS (SELECT *, substr(line, length(g1) + 1) AS r1, trim(g1, E' \t\r') AS f1 FROM a1),
  a2 AS (SELECT *, regexp_extract(substr(r1, 4), '{_ANY}', 1) AS g2 FROM b1), b2 AS (SELECT *, substr(r1, length(g2) + 4) AS r2, trim(g2, E' \t\r') AS f2 FROM a2),
  a3 AS (SELECT *, regexp_extract(substr(r2, 4), '{_ANY}', 1) AS g3 FROM b2), b3 AS (SELECT *, substr(r2, length(g3) + 4) AS r3, trim(g3, E' \t\r') AS f3 FROM a3),
  sc AS (SELECT *, list_filter(regexp_split_to_array(CASE WHEN f3 LIKE '"%' THEN f3[2:-2] ELSE f3 END, '[ \t\r]+'), lambda w: w <> '') AS w FROM b3),
  pr AS (SELECT line_id, CASE WHEN line IS NULL THEN 'null line' WHEN r1 <> '' AND NOT starts_with(r1, '|||') THEN 'source: broken quoting' WHEN r1 = '' THEN 'target: missing' WHEN NOT ({_FULL.format(f='f1')}) THEN 'source: empty'
    WHEN r2 <> '' AND NOT starts_with(r2, '|||') THEN 'target: broken quoting' WHEN r2 = '' THEN 'scores: missing' WHEN NOT ({_FULL.format(f='f2')}) THEN 'target: empty'
    WHEN r3 <> '' AND NOT starts_with(r3, '|||') THEN 'scores: broken quoting' WHEN r3 <> '' THEN 'too many fields'
    WHEN len(w) NOT BETWEEN 1 AND 5 OR len(list_filter(w, lambda v: NOT regexp_full_match(v, '{_NUM}'))) > 0 THEN 'scores: not one to five numbers'
    WHEN len(list_filter(w, lambda v: NOT coalesce(TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 1, false))) > 0 THEN 'scores: not within 0 and 1' END AS reason FROM sc),
  lr AS (SELECT line_id, CASE WHEN line IS NULL THEN 'null line' WHEN len(f) < 2 THEN 'ngram: missing' WHEN NOT regexp_full_match(p, '{_NUM}') THEN 'logprob: not a number' WHEN g = '' THEN 'ngram: empty'
    WHEN len(f) > 3 THEN 'too many fields' WHEN b <> '' AND NOT regexp_full_match(b, '{_NUM}') THEN 'backoff: not a number' WHEN k IS NULL THEN 'ngram: no section above'
    WHEN len(list_filter(string_split(g, ' '), lambda w: w <> '')) <> k THEN 'ngram: wrong number of words' WHEN NOT isfinite(TRY_CAST(p AS DOUBLE)) THEN 'logprob: not finite'
    WHEN TRY_CAST(p AS DOUBLE) > 0 THEN 'logprob: above 0' WHEN b <> '' AND NOT isfinite(TRY_CAST(b AS DOUBLE)) THEN 'backoff: not finite' END AS reason FROM parts)"""

_COPY = """{x} AS (SELECT DISTINCT trim(s, E' \\t') AS s, trim(t, E' \\t') AS t, sc, wa, cnt FROM phrasetable_{x} WHERE s IS NOT NULL AND t IS NOT NULL)"""

ORACLE = {
    "p2_found": f"""WITH {_LM}, lm AS (SELECT line_id FROM judged WHERE NOT ok),
      pt AS (WITH {_PT} SELECT line_id FROM judged WHERE NOT ok)
      SELECT 'phrasetable_raw' AS raw_table, line_id FROM pt UNION ALL SELECT 'lm_raw', line_id FROM lm""",
    "p2_reasons": f"""WITH {_LM}, {_REASONS} SELECT 'phrasetable_raw' AS raw_table, line_id, reason FROM pr WHERE reason IS NOT NULL UNION ALL SELECT 'lm_raw', line_id, reason FROM lr WHERE reason IS NOT NULL""",
    "p2_phrase_pairs": f"""WITH {_PT} SELECT line_id, source, target, CAST(len(w) AS INT) AS n_scores,
      list_max(list_transform(w, lambda v: CAST(v AS DOUBLE))) AS best_score FROM judged WHERE ok""",
    "p2_lm_entries": f"""WITH {_LM} SELECT line_id, file_no, k, regexp_replace(g, ' +', ' ', 'g') AS ngram,
      CAST(p AS DOUBLE) AS logprob, TRY_CAST(nullif(b, '') AS DOUBLE) AS backoff FROM judged WHERE ok""",
    "p6_found": f"""WITH {_PAIRS} SELECT source FROM pairs WHERE source IS NOT NULL GROUP BY source
      HAVING count(DISTINCT pair_id) * 100 >= (SELECT count(DISTINCT pair_id) FROM phrasepairs)""",
    "p6_sources": f"""WITH {_PAIRS} SELECT source, count(DISTINCT pair_id) AS n_records, count(DISTINCT target) AS n_targets,
      round(1.0::DOUBLE / nullif(count(DISTINCT target), 0), 9) AS flat_score FROM pairs WHERE source IS NOT NULL GROUP BY source""",
    "p7_found": f"""WITH {_COPY.format(x='a')}, {_COPY.format(x='b')}, m AS (SELECT s, t, a.s IS NOT NULL AS in_a, b.s IS NOT NULL AS in_b,
        a.sc AS sa, b.sc AS sb, a.wa AS wa, b.wa AS wb, a.cnt AS ca, b.cnt AS cb FROM a FULL JOIN b USING (s, t))
      SELECT s, t, 'only_a' AS diff FROM m WHERE NOT in_b UNION SELECT s, t, 'only_b' FROM m WHERE NOT in_a
      UNION SELECT s, t, 'wa' FROM m WHERE in_a AND in_b AND wa IS DISTINCT FROM wb
      UNION SELECT s, t, 'cnt' FROM m WHERE in_a AND in_b AND ca IS DISTINCT FROM cb
      UNION SELECT s, t, 'sc' FROM m WHERE in_a AND in_b AND ((sa IS NULL) <> (sb IS NULL) OR len(sa) <> len(sb)
        OR len(list_filter(range(1, len(sa) + 1), lambda i: sa[i] IS DISTINCT FROM sb[i]
          AND (isnan(sa[i]) OR isnan(sb[i]) OR sa[i] IS NULL OR sb[i] IS NULL OR abs(sa[i] - sb[i]) > 1e-9))) > 0)""",
}
