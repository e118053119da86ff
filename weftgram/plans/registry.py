"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgram.plans import align_queries, corpus_queries, data_queries, graph_queries, option_queries, skipgram_queries, table_queries

MODULES = [corpus_queries, graph_queries, skipgram_queries, align_queries, option_queries, table_queries, data_queries]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["pattern_listing"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLE.items()}
