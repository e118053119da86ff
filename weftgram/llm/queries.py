"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.llm import cooccur, encoding_repair, frequent, packing, termcounts, tokenize, topn
from weftgram.runtime import table


def rank_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a public vocabulary; the folder is a parameter."""
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def p1_top(spark: SparkSession, sf: str) -> DataFrame:
    return frequent.frequent_values(table(spark, sf, "postings"), "pattern_id", ["sid", "pos"], 0.005).drop("n_total")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_top(spark, sf).select("pattern_id")


def p3_top(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "phrasetable_a").select(
        F.btrim("s", F.lit(" \t")).alias("s"), F.btrim("t", F.lit(" \t")).alias("t"), F.get("sc", F.lit(0)).alias("score")
    )
    return topn.top_n(rows, "s", "t", "score", 3)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_top(spark, sf).select("s", "t")


def _pairs(spark: SparkSession, sf: str, min_lift: int) -> DataFrame:
    pairs = cooccur.cooccurring_pairs(table(spark, sf, "postings"), "pattern_id", "sid", 10, min_lift)
    return pairs.withColumnsRenamed({"item_a": "pattern_a", "item_b": "pattern_b"})


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs with ten common sentences or more, with their surprise under the null."""
    return _pairs(spark, sf, 0)


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pairs(spark, sf).select("pattern_a", "pattern_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, 15).select("pattern_a", "pattern_b")


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    counts = termcounts.term_counts(table(spark, sf, "phrasepairs"), "pair_id", {"source": "source", "target": "target"})
    return counts.drop("n_all")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_terms(spark, sf).filter("mark IS NOT NULL").select("side", "term", "mark")


def p8_ids(spark: SparkSession, sf: str, ranks: str | None = None) -> DataFrame:
    return tokenize.encode_texts(table(spark, sf, "documents"), ranks or rank_path())


def p9_containers(spark: SparkSession, sf: str, ranks: str | None = None) -> DataFrame:
    sizes = tokenize.count_tokens(table(spark, sf, "documents"), ranks or rank_path())
    few = table(spark, sf, "capacities").dropna(subset=["capacity"]).filter("capacity > 0").orderBy("pack_id").collect()  # three rows, fixed
    return packing.pack(sizes, [(r["pack_id"], r["capacity"]) for r in few])


def p10_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return encoding_repair.repair(table(spark, sf, "documents")).filter("garbled").select("doc_id", "restored")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding_repair.repair(table(spark, sf, "documents")).filter("garbled").select("doc_id")


def _vocabulary(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, sf, "documents"), rank_path(name))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_top, p3_found, p3_top, p4_found, p4_counts, p4_pairs, p5_found, p5_terms, p8_ids, p9_containers, p10_found, p10_repaired)
}
#: The same encoder with the vocabulary for many languages.
QUERIES["p8_ids_multi"] = partial(_vocabulary, name="byte_bpe_multi_50k.tiktoken")

_REFS = "refs AS (SELECT DISTINCT pattern_id, sid, pos FROM postings WHERE pattern_id IS NOT NULL AND sid IS NOT NULL AND pos IS NOT NULL)"
_TOP = f"""WITH {_REFS} SELECT pattern_id, count(*) AS n_refs FROM refs GROUP BY pattern_id
  HAVING count(*) >= 0.005 * (SELECT count(*) FROM refs)"""
_BEST = r"""WITH a AS (SELECT trim(s, E' \t') AS s, trim(t, E' \t') AS t, sc[1] AS score FROM phrasetable_a
    WHERE s IS NOT NULL AND t IS NOT NULL AND sc IS NOT NULL AND len(sc) > 0 AND sc[1] IS NOT NULL AND NOT isnan(sc[1])),
  d AS (SELECT s, t, max(score) AS score FROM a GROUP BY s, t),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY s ORDER BY score DESC, t) AS INT) AS rank FROM d)
  SELECT s, t, score, rank FROM r WHERE rank <= 3"""
_PAIRS = """WITH d AS (SELECT DISTINCT pattern_id AS i, sid FROM postings WHERE pattern_id IS NOT NULL AND sid IS NOT NULL),
  f AS (SELECT i, count(*) AS c FROM d GROUP BY i HAVING count(*) >= 10),
  g AS (SELECT d.i, d.sid, f.c FROM d JOIN f ON d.i = f.i), n AS (SELECT count(DISTINCT sid) AS n FROM d),
  p AS (SELECT x.i AS pattern_a, y.i AS pattern_b, x.c AS n_a, y.c AS n_b, count(*) AS n_ab
    FROM g x JOIN g y ON x.sid = y.sid AND x.i < y.i GROUP BY ALL HAVING count(*) >= 10)"""
_TERMS = r"""WITH u AS (SELECT 'source' AS side, pair_id, max(trim(regexp_replace(source, '[ \t]+', ' ', 'g'), ' ')) AS x FROM phrasepairs WHERE pair_id IS NOT NULL GROUP BY pair_id
    UNION ALL SELECT 'target', pair_id, max(trim(regexp_replace(target, '[ \t]+', ' ', 'g'), ' ')) FROM phrasepairs WHERE pair_id IS NOT NULL GROUP BY pair_id),
  w AS (SELECT side, pair_id, unnest(string_split(x, ' ')) AS term FROM u),
  c AS (SELECT side, term, count(*) AS n_occurrences, count(DISTINCT pair_id) AS n_records FROM w WHERE term <> '' GROUP BY side, term),
  m AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records * 20 > (SELECT count(DISTINCT pair_id) FROM phrasepairs) THEN 'common' END AS mark FROM c)"""

ORACLE = {
    "p1_top": _TOP,
    "p1_found": f"SELECT pattern_id FROM ({_TOP})",
    "p3_top": _BEST,
    "p3_found": f"SELECT s, t FROM ({_BEST})",
    "p4_counts": f"{_PAIRS} SELECT pattern_a, pattern_b, n_ab, n_a, n_b, round(n_ab * n::DOUBLE / (n_a::DOUBLE * n_b), 6) AS lift FROM p, n",
    "p4_found": f"{_PAIRS} SELECT pattern_a, pattern_b FROM p, n WHERE n_ab * n >= 15 * n_a * n_b",
    "p5_terms": f"{_TERMS} SELECT side, term, n_occurrences, n_records, mark FROM m",
    "p5_found": f"{_TERMS} SELECT side, term, mark FROM m WHERE mark IS NOT NULL",
}
