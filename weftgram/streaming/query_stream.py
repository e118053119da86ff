"""Pattern queries over lines as they arrive.

A stateless stream-static join: each line is looked up in a model. Words unknown to the
vocabulary are numbered within their own line (-1, -2, ...), so no state grows across
lines. Null and empty lines give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.sources.corpus import split_words


def line_source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of text files put into a folder."""
    return spark.readStream.text(path)


def local_classes(lines: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """``value, tokens``: classes by a small vocabulary sent along; unknown words get -1, -2, ... by first use."""
    words = split_words(F.col("value"))
    table = F.create_map(*[F.lit(x) for pair in vocab.items() for x in pair])
    known = lines.select("value", words.alias("w"))
    known = known.withColumn("new", F.array_distinct(F.filter("w", lambda x: F.try_element_at(table, x).isNull())))
    return known.select("value", F.transform("w", lambda x: F.coalesce(F.try_element_at(table, x), -F.array_position("new", x).cast("int"))).alias("tokens"))


def find_in_stream(lines: DataFrame, patterns: DataFrame, max_n: int = 4) -> DataFrame:
    """``value, pos, pattern, n, cnt``: known n-grams of every line.

    ``patterns`` is the static side, ``pattern, cnt`` over words.
    """
    tokens = split_words(F.col("value"))
    every = F.flatten(
        F.transform(P.positions(F.least(F.lit(max_n), F.size("tokens"))), lambda n: F.transform(P.windows("tokens", n + 1), lambda w, i: F.struct(w.alias("pattern"), i.alias("pos"))))
    )
    rows = lines.select("value", tokens.alias("tokens")).select("value", F.explode(every).alias("x")).select("value", "x.pos", "x.pattern")
    return rows.join(patterns.select("pattern", "cnt"), "pattern").select("value", "pos", "pattern", F.size("pattern").alias("n"), "cnt")


def count_in_stream(lines: DataFrame, n: int) -> DataFrame:
    """``pattern, cnt``: running n-gram counts, for output mode ``complete`` or ``update``."""
    rows = lines.select(split_words(F.col("value")).alias("tokens")).filter(F.size("tokens") >= n)
    return rows.select(F.explode(P.windows("tokens", n)).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("cnt"))
