"""A mined model as a Python object over its tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.operators import graph, mining, reports
from weftgram.operators.numbered import Numbered
from weftgram.sources import tables


class PatternModel:
    """Accessors over ``patterns``, ``postings`` and ``skip_postings``.

    Keys are lists of tokens. A pattern that is not in the model counts 0 and is not
    contained. Iteration streams the patterns, a partition at a time.
    """

    def __init__(self, patterns: DataFrame, postings: DataFrame | None = None, skip_postings: DataFrame | None = None, tokens: int = 0, gap=P.GAP, contents: DataFrame | None = None, numbered: Numbered | None = None):
        self.patterns, self.postings, self.skip_postings, self.tokens, self.gap, self.contents, self.numbered = patterns, postings, skip_postings, tokens, gap, contents, numbered

    @classmethod
    def train(cls, corpus: DataFrame, gap=P.GAP, **options) -> PatternModel:
        mined = mining.mine(corpus, gap=gap, **options)
        tokens = reports.corpus_tokens(corpus).first()["tokens"]
        return cls(mined.patterns, mined.postings, mined.skip_postings, tokens, gap, mined.contents, mined.numbered)

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokens: int = 0, indexed: bool = True, gap=P.GAP) -> PatternModel:
        """An indexed model can be read without its postings; with them come those of skipgrams and their contents."""
        if indexed and (index := tables.load_index(spark, path)):
            patterns, occurrences, contents = tables.load_model(spark, path), *index
            posts = occurrences.join(patterns.filter("NOT is_skip").select("pattern"), "pattern", "left_semi")
            skips = occurrences.select(F.col("pattern").alias("inst"), "sid", "pos").join(contents, "inst")
            skips = skips.select("pattern", P.skip_content("inst", "pattern", gap).alias("content"), "inst", "sid", "pos")
            return cls(patterns, posts, skips, tokens, gap, contents)
        posts = tables.load_model(spark, path, "postings") if indexed else None
        skips = contents = None
        if indexed:
            try:
                skips = tables.load_model(spark, path, "skip_postings")
            except AnalysisException:
                pass  # a model without skipgrams
            else:
                contents = skips.groupBy("pattern", "inst").agg(F.count(F.lit(1)).alias("c"))
        return cls(tables.load_model(spark, path), posts, skips, tokens, gap, contents)

    def save(self, path: str) -> None:
        """A model in numbers keeps the windows of each sentence once, not each for every pattern on it."""
        if self.numbered and (index := self.numbered.index()):
            tables.save_model(path, self.patterns)
            tables.save_index(path, *index, self.contents)
            return
        tables.drop_index(self.patterns.sparkSession, path)
        tables.save_model(path, self.patterns, self.postings, self.skip_postings)

    def _only(self, df: DataFrame, pattern: list) -> DataFrame:
        return df.filter(F.col("pattern") == F.array(*map(F.lit, pattern)))

    def __len__(self) -> int:
        return self.patterns.count()

    def __contains__(self, pattern: list) -> bool:
        return not self._only(self.patterns, pattern).isEmpty()

    def __getitem__(self, pattern: list) -> int:
        row = self._only(self.patterns, pattern).first()
        return row["cnt"] if row else 0

    def __iter__(self) -> Iterator[list]:
        return (r["pattern"] for r in self.patterns.select("pattern").toLocalIterator())

    def occurrence_count(self, pattern: list) -> int:
        return self[pattern]

    def coverage_count(self, pattern: list) -> int:
        return self[pattern] * len(pattern)

    def coverage(self, pattern: list) -> float:
        return self.coverage_count(pattern) / self.tokens if self.tokens else 0.0

    def indices(self, pattern: list) -> DataFrame:
        """``sid, pos`` of the occurrences."""
        return self._only(self.postings, pattern).select("sid", "pos").distinct()

    def sentences(self, pattern: list) -> DataFrame:
        return self._only(self.postings, pattern).select("sid").distinct()

    def reverse_index(self, sid: int) -> DataFrame:
        """Patterns of a sentence."""
        return self.postings.filter(F.col("sid") == sid).select("pattern").distinct()

    def stats(self) -> DataFrame:
        return reports.report(self.patterns)

    def listing(self) -> DataFrame:
        tokens = self.patterns.sparkSession.createDataFrame([(self.tokens,)], "tokens bigint")
        entropy = mining.skip_entropy(self.contents) if self.contents is not None else None
        return reports.listing(self.patterns, tokens, entropy)

    def query(self, corpus: DataFrame, max_n: int = 9) -> DataFrame:
        tokens = self.patterns.sparkSession.createDataFrame([(self.tokens,)], "tokens bigint")
        return reports.query_mode(mining.find_patterns(corpus, self.patterns, 1, max_n, self.gap), self.patterns, tokens)

    def graph(self, **options) -> DataFrame:
        return graph.build_graph(self.postings, self.skip_postings, gap=self.gap, **options)

    def pmi(self, a: list, b: list, normal: bool = False) -> float | None:
        """PMI (or NPMI) of two patterns by their common sentences; None without any."""
        joint = self.sentences(a).intersect(self.sentences(b)).count()
        if not joint:
            return None
        import math

        value = math.log(joint / (self[a] * self[b]))
        if not normal:
            return value
        total = self.patterns.agg(F.sum("cnt")).first()[0]
        return value / -math.log(joint / total)
