"""Stages from text to alignment, each written once and read again if made from the same input and parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.operators import align, mining
from weftgram.runtime import with_scalars
from weftgram.sources import corpus as C


def made_from(spark: SparkSession, path: str) -> str | None:
    """The key that a complete table was written with; None without one."""
    try:
        return spark.read.text(f"{path}.made_from").first()["value"]
    except AnalysisException:
        return None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete table is at the path."""
    return bool(made_from(spark, path))


def _mark(spark: SparkSession, path: str, made: str) -> None:
    spark.createDataFrame([(made,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.made_from")


def content_key(words: DataFrame) -> str:
    """A key of the rows of a table, in whatever order they come."""
    row = F.xxhash64(*words.columns)
    sums = words.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(20,0)")), F.sum(F.hash(*words.columns).cast("bigint"))).first()
    return key(words.dtypes, *sums)


def key(*parts) -> str:
    return hashlib.md5(repr(parts).encode()).hexdigest()


def stage(spark: SparkSession, path: str, key_of: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at path, making and writing it first unless it was made from the same key."""
    if made_from(spark, path) != key_of:
        _mark(spark, path, "")  # what was there before is no longer complete
        make().write.mode("overwrite").parquet(path)
        _mark(spark, path, key_of)
    return spark.read.parquet(path)


def align_corpora(spark: SparkSession, source: DataFrame, target: DataFrame, out: str, max_n: int = 3, least: int = 2, rounds: int = 5, method: str = "em") -> DataFrame:
    """Vocabulary, encoding, patterns and alignment of two corpora (``sid, tokens`` of words)."""
    sides, keys = {}, []
    for name, words in (("source", source), ("target", target)):
        words_key = content_key(words.select("sid", "tokens"))
        patterns_key = key(words_key, max_n, least)
        keys.append(patterns_key)
        vocab = stage(spark, f"{out}/{name}/vocab", words_key, lambda w=words: C.build_vocab(C.word_frequencies(w)))
        encoded = stage(spark, f"{out}/{name}/corpus", words_key, lambda w=words, v=vocab: C.encode(w, v))
        patterns = stage(spark, f"{out}/{name}/patterns", patterns_key, lambda e=encoded: mining.count_ngrams(e, max_n, least))
        sides[name] = stage(spark, f"{out}/{name}/postings", patterns_key, lambda e=encoded, p=patterns: mining.postings(e, p, max_n))

    def make() -> DataFrame:
        ways = {"em": lambda a, b: align.train_em(a, b, rounds), "cooc": lambda a, b: align.train_cooc(a, b)}
        forward, backward = ways[method](sides["source"], sides["target"]), ways[method](sides["target"], sides["source"])
        return align.two_scores(forward, backward)

    return stage(spark, f"{out}/align-{method}", key(*keys, method, rounds if method == "em" else None), make)


def word_error_rate(pairs: DataFrame) -> DataFrame:
    """One row: ``errors, words, wer`` of ``hypothesis, reference`` texts by edit distance over words.

    Each word is replaced by a character of its own in its row, so the built-in distance
    of strings counts words.
    """
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    rows = pairs.select(words("hypothesis").alias("h"), words("reference").alias("r"))
    rows = rows.withColumn("all", F.array_distinct(F.concat("h", "r")))
    # characters from U+4E00 on: one per distinct word of the row
    letter = lambda w: F.decode(F.encode(F.decode(F.unhex(F.hex(F.array_position("all", w) + 0x4E00)), "UTF-16BE"), "UTF-8"), "UTF-8")
    text = lambda c: F.array_join(F.transform(c, letter), "")
    rows = rows.select(F.levenshtein(text("h"), text("r")).alias("errors"), F.size("r").alias("words"))
    return rows.agg(F.sum("errors").alias("errors"), F.sum("words").alias("words")).withColumn("wer", F.col("errors") / F.nullif("words", F.lit(0)))


def position_independent_error_rate(pairs: DataFrame) -> DataFrame:
    """One row: ``errors, words, per`` of ``hypothesis, reference`` texts, whatever the order of words.

    Words that do not meet count once, on the longer side.
    """
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    rows = pairs.select(words("hypothesis").alias("h"), words("reference").alias("r"))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    met = F.aggregate(F.array_distinct("h"), F.lit(0), lambda t, w: t + F.least(count("h", w), count("r", w)))
    per = rows.select((F.greatest(F.size("h"), F.size("r")) - met).alias("errors"), F.size("r").alias("words"))
    return per.agg(F.sum("errors").alias("errors"), F.sum("words").alias("words")).withColumn("per", F.col("errors") / F.nullif("words", F.lit(0)))


def average_runs(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric, mean, runs`` of a table with one row of scores for each run."""
    long = runs.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x"))
    return long.groupBy("x.metric").agg(F.avg("x.value").alias("mean"), F.count("x.value").alias("runs"))


def bleu(pairs: DataFrame, max_n: int = 4) -> DataFrame:
    """One row: corpus BLEU of ``hypothesis, reference`` texts, one reference each."""
    words = lambda c: F.filter(F.split(F.col(c), " "), lambda w: w != "")
    rows = pairs.select(F.monotonically_increasing_id().alias("i"), words("hypothesis").alias("h"), words("reference").alias("r"))
    grams = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_n)), lambda n: F.filter(F.transform(F.sequence(F.lit(0), F.size(c)), lambda i: F.slice(c, i + 1, n)), lambda g: F.size(g) == n)))
    sides = None
    for c in ("h", "r"):
        side = rows.select("i", F.explode(grams(c)).alias("g")).groupBy("i", "g").agg(F.count(F.lit(1)).alias("c")).withColumn("side", F.lit(c))
        sides = side if sides is None else sides.unionByName(side)
    met = sides.groupBy("i", "g").agg(F.sum(F.when(F.col("side") == "h", F.col("c")).otherwise(0)).alias("h"), F.sum(F.when(F.col("side") == "r", F.col("c")).otherwise(0)).alias("r"))
    per = met.groupBy(F.size("g").alias("n")).agg(F.sum(F.least("h", "r")).alias("hit"), F.sum("h").alias("made"))
    precision = per.filter(f"n <= {max_n}").agg(F.avg(F.log(F.col("hit") / F.col("made"))).alias("lp"), F.min("hit").alias("least"), F.count(F.lit(1)).alias("k"))
    sizes = rows.agg(F.sum(F.size("h")).alias("hl"), F.sum(F.size("r")).alias("rl"))
    both = with_scalars(precision, sizes)
    brevity = F.when(F.col("hl") >= F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.col("hl")))
    return both.select(F.when((F.col("k") == max_n) & (F.col("least") > 0), brevity * F.exp("lp")).otherwise(0.0).alias("bleu"))
