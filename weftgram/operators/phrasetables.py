"""Utilities over text phrase tables: ``s, t`` and an array of scores.

Keys are compared without spaces and tabs at both ends; rows with a null key part
take no part. Repeated rows count as often as they occur in ``flatten``, once
elsewhere. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgram.runtime import with_scalars


def stripped(df: DataFrame, s: str = "s", t: str = "t", *more: str) -> DataFrame:
    strip = lambda c: F.btrim(F.col(c), F.lit(" \t"))
    return df.select(strip(s).alias("s"), strip(t).alias("t"), *more).filter("s IS NOT NULL AND t IS NOT NULL")


def flatten(pairs: DataFrame) -> DataFrame:
    """``s, t, p_ts, p_st``: 1 / fan-out of either side.

    Counts are made by aggregation before they are joined to the distinct pairs, so a
    hot source is one row of the count table and not one window.
    """
    counted = pairs.groupBy("s", "t").agg(F.count(F.lit(1)).alias("rows"))
    by_s = counted.groupBy("s").agg(F.sum("rows").alias("ns"))
    by_t = counted.groupBy("t").agg(F.sum("rows").alias("nt"))
    return counted.join(by_s, "s").join(by_t, "t").select("s", "t", "rows", (1 / F.col("ns")).alias("p_ts"), (1 / F.col("nt")).alias("p_st"))


def prune_by_lists(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs both sides of which are listed (``sources.s``, ``targets.t``)."""
    return pairs.join(sources.select("s"), "s", "left_semi").join(targets.select("t"), "t", "left_semi").select(pairs.columns)


def simplify(table: DataFrame, scores: str = "sc") -> DataFrame:
    """Rows of five scores reduced to the first and third."""
    x = F.col(scores)
    return table.withColumn(scores, F.when(F.size(x) == 5, F.array(F.get(x, F.lit(0)), F.get(x, F.lit(2)))).otherwise(x))


def distinct_pairs(table: DataFrame, scores: str = "sc") -> DataFrame:
    """One row per pair; of repeated ones the greatest scores."""
    return table.groupBy("s", "t").agg(F.max(scores).alias(scores))


def intersect(scored: DataFrame, other: DataFrame, scores: str = "sc") -> DataFrame:
    """Pairs of both tables with the scores of the first, five scores reduced to two."""
    return simplify(distinct_pairs(scored, scores), scores).join(other.select("s", "t").distinct(), ["s", "t"], "left_semi")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct items of either table, of both together, and in common."""
    tagged = a.select(*keys).distinct().withColumn("in_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("in_b", F.lit(1)), keys, "full_outer")
    return tagged.agg(
        F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("in_a") == F.col("in_b"), 1)).alias("n_common"),
    )


def overlap_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """``kind, n_a, n_b, n_all, n_common, part_a, part_b`` for sources, targets and pairs."""
    out = None
    for kind, keys in {"source": ["s"], "target": ["t"], "pair": ["s", "t"]}.items():
        row = overlap(a, b, keys).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    share = lambda n: F.col("n_common") / F.nullif(F.col(n), F.lit(0))
    return out.select("kind", "n_a", "n_b", "n_all", "n_common", share("n_a").alias("part_a"), share("n_b").alias("part_b"))


def pattern_overlap(pairs: DataFrame, patterns: DataFrame, side: str = "s") -> DataFrame:
    """One row: types and occurrences of a pattern list (``text, cnt``), and those in the table."""
    held = patterns.join(pairs.select(F.col(side).alias("text")).distinct().withColumn("hit", F.lit(1)), "text", "left")
    return held.agg(
        F.count(F.lit(1)).alias("types"), F.count("hit").alias("types_held"), F.sum("cnt").alias("occurrences"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("cnt"))), F.lit(0)).alias("occurrences_held"),
    )


def lexical_table(points: DataFrame, source: DataFrame, target: DataFrame, null_word: str = "NULL") -> DataFrame:
    """``s_word, t_word, n, w_ts, w_st``: word translation probabilities of alignment points.

    ``points`` is ``sid, s, t`` (0-based), ``source`` and ``target`` are ``sid, tokens``. Words without a
    point are aligned to ``null_word``.
    """
    ws = source.select("sid", F.posexplode("tokens").alias("s", "s_word"))
    wt = target.select("sid", F.posexplode("tokens").alias("t", "t_word"))
    made = points.select("sid", "s", "t").distinct().join(ws, ["sid", "s"]).join(wt, ["sid", "t"]).select("s_word", "t_word")
    lone_s = ws.join(points, ["sid", "s"], "left_anti").select("s_word", F.lit(null_word).alias("t_word"))
    lone_t = wt.join(points, ["sid", "t"], "left_anti").select(F.lit(null_word).alias("s_word"), "t_word")
    counts = made.unionByName(lone_s).unionByName(lone_t).groupBy("s_word", "t_word").agg(F.count(F.lit(1)).alias("n"))
    by_s, by_t = counts.groupBy("s_word").agg(F.sum("n").alias("ns")), counts.groupBy("t_word").agg(F.sum("n").alias("nt"))
    rows = counts.join(by_s, "s_word").join(by_t, "t_word")
    return rows.select("s_word", "t_word", "n", F.round(F.col("n") / F.col("ns"), 7).alias("w_ts"), F.round(F.col("n") / F.col("nt"), 7).alias("w_st"))


def share_of(table: DataFrame, value: str, out: str = "share") -> DataFrame:
    """A column as a share of its own total."""
    return with_scalars(table, table.agg(F.sum(value).alias("__sum"))).withColumn(out, F.col(value) / F.col("__sum")).drop("__sum")


def top_targets(pairs: DataFrame, n: int, score: str) -> DataFrame:
    """The n best targets of each source, ties at the end kept."""
    rank = F.rank().over(Window.partitionBy("s").orderBy(F.desc(score)))
    return pairs.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
