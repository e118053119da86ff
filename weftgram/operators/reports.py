"""Reports over mined models: listing, joint listing, statistics, coverage, queries.

``patterns`` is ``pattern, n, is_skip, cnt``; ``postings`` and ``skip_postings`` have
``pattern, sid, pos``. Empty models give empty reports (totals of 0 rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgram.functions import patterns as P
from weftgram.operators.numbered import Finder
from weftgram.runtime import with_scalars


def corpus_tokens(corpus: DataFrame) -> DataFrame:
    """One row: ``tokens``."""
    return corpus.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("bigint").alias("tokens"))


def listing(patterns: DataFrame, tokens: DataFrame, entropy: DataFrame | None = None) -> DataFrame:
    """Every pattern with counts, coverage and frequency among all, its group, and its length.

    The totals come from one small aggregate by (is_skip, n), joined back.
    """
    per_n = patterns.groupBy("is_skip", "n").agg(F.sum("cnt").alias("occ_n"))
    per_n = per_n.withColumn("occ_g", F.sum("occ_n").over(Window.partitionBy("is_skip")))
    per_n = per_n.withColumn("occ_all", F.sum("occ_n").over(Window.partitionBy(F.lit(0))))  # two rows per length
    rows = with_scalars(patterns.join(F.broadcast(per_n), ["is_skip", "n"]), tokens.select(F.col("tokens").alias("total")))
    covered = F.col("cnt") * F.col("n")
    out = rows.select(
        "n", "pattern", "is_skip", "cnt", covered.alias("tokens"), (covered / F.col("total")).alias("coverage"),
        (F.col("cnt") / F.col("occ_all")).alias("freq_all"), (F.col("cnt") / F.col("occ_g")).alias("freq_group"), (F.col("cnt") / F.col("occ_n")).alias("freq_n"),
    )
    return out if entropy is None else out.join(entropy.select("pattern", "skip_types", "entropy"), "pattern", "left")


def joint_listing(train: DataFrame, test: DataFrame) -> DataFrame:
    """Patterns of a training model with their counts in a test model, 0 where absent."""
    other = test.select("pattern", F.col("cnt").alias("cnt_test"))
    return train.join(other, "pattern", "left").select("pattern", "n", F.col("cnt").alias("cnt_train"), F.coalesce("cnt_test", F.lit(0)).alias("cnt_test"))


def report(patterns: DataFrame) -> DataFrame:
    """Types and occurrences by kind and length; nulls in ``n`` or ``is_skip`` mark totals."""
    return patterns.rollup("is_skip", "n").agg(F.count(F.lit(1)).alias("types"), F.sum("cnt").alias("occurrences"))


def histogram(patterns: DataFrame) -> DataFrame:
    """``cnt, types``: how many patterns occur how often."""
    return patterns.groupBy("cnt").agg(F.count(F.lit(1)).alias("types"))


def span_grid(postings: DataFrame, skip_postings: DataFrame | None = None, gap=P.GAP) -> DataFrame:
    """``pattern, n, is_skip, sid, tok, is_gap``: one row per position that an occurrence spans."""
    grams = postings.select("pattern", F.lit(False).alias("is_skip"), "sid", "pos")
    rows = grams if skip_postings is None else grams.unionByName(skip_postings.select("pattern", F.lit(True).alias("is_skip"), "sid", "pos"))
    spans = rows.select("pattern", F.size("pattern").alias("n"), "is_skip", "sid", "pos", F.posexplode("pattern").alias("i", "x"))
    return spans.select("pattern", "n", "is_skip", "sid", (F.col("pos") + F.col("i")).alias("tok"), (F.col("x") == F.lit(gap)).alias("is_gap"))


def coverage(corpus: DataFrame, postings: DataFrame, skip_postings: DataFrame | None = None, gap=P.GAP) -> DataFrame:
    """One row: tokens covered, encapsulated (in a gap), uncovered, outside every span.

    Each token is first reduced to its marks in one aggregation by (sentence, token).
    """
    grid = span_grid(postings, skip_postings, gap)
    marks = grid.groupBy("sid", "tok").agg(F.max((~F.col("is_gap")).cast("int")).alias("c"), F.max(F.col("is_gap").cast("int")).alias("e"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1)), F.lit(0))
    counted = marks.agg(n(F.col("c") == 1).alias("covered"), n(F.col("e") == 1).alias("encapsulated"), F.count(F.lit(1)).alias("spanned"))
    both = with_scalars(corpus_tokens(corpus), counted)
    return both.select("tokens", "covered", "encapsulated", (F.col("tokens") - F.col("covered")).alias("uncovered"), (F.col("tokens") - F.col("spanned")).alias("outside"))


def coverage_found(corpus: DataFrame, finder: Finder) -> DataFrame:
    """``coverage`` by the patterns of a finder, each sentence looked through where it is read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, _, n, gap, _ in finder.marked(batches):
            sums = len(values), (n > 0).sum(), gap.sum(), ((n > 0) | gap).sum()
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in sums], names)

    names = ["tokens", "covered", "encapsulated", "spanned"]
    rows = corpus.filter(F.size("tokens") >= 1).select("tokens").mapInArrow(count, ", ".join(f"{x} bigint" for x in names))
    sums = rows.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in names))
    return sums.select("tokens", "covered", "encapsulated", (F.col("tokens") - F.col("covered")).alias("uncovered"), (F.col("tokens") - F.col("spanned")).alias("outside"))


def coverage_by_length(corpus: DataFrame, postings: DataFrame, skip_postings: DataFrame | None = None, gap=P.GAP) -> DataFrame:
    """Per kind and length: types, occurrences, covered and encapsulated tokens, shares.

    ``ttr`` is types / covered tokens.
    """
    grid = span_grid(postings, skip_postings, gap)
    per_token = grid.groupBy("is_skip", "n", "sid", "tok").agg(F.max((~F.col("is_gap")).cast("int")).alias("c"), F.max(F.col("is_gap").cast("int")).alias("e"))
    tokens = per_token.groupBy("is_skip", "n").agg(F.sum("c").alias("covered"), F.sum("e").alias("encapsulated"))
    kinds = postings.select("pattern", F.lit(False).alias("is_skip"))
    if skip_postings is not None:
        kinds = kinds.unionByName(skip_postings.select("pattern", F.lit(True).alias("is_skip")))
    types = kinds.groupBy("is_skip", "pattern").count().groupBy("is_skip", F.size("pattern").alias("n")).agg(F.count(F.lit(1)).alias("types"), F.sum("count").alias("occurrences"))
    rows = with_scalars(tokens.join(types, ["is_skip", "n"]), corpus_tokens(corpus))
    return rows.select("is_skip", "n", "types", "occurrences", "covered", "encapsulated", (F.col("covered") / F.col("tokens")).alias("coverage"), (F.col("types") / F.col("covered")).alias("ttr"))


def exclusive_coverage(corpus: DataFrame, postings: DataFrame, xcounts: DataFrame, least_ratio: float = 0.8) -> DataFrame:
    """One row: tokens covered by patterns whose exclusive ratio reaches ``least_ratio``."""
    kept = xcounts.filter(F.col("xratio") >= least_ratio).select("pattern")
    grid = span_grid(postings.join(kept, "pattern", "left_semi"))
    covered = grid.filter("NOT is_gap").select("sid", "tok").distinct().agg(F.count(F.lit(1)).alias("covered"))
    types = kept.agg(F.count(F.lit(1)).alias("types"))
    return with_scalars(with_scalars(corpus_tokens(corpus), covered), types)


def query_mode(found: DataFrame, patterns: DataFrame, tokens: DataFrame, xcounts: DataFrame | None = None) -> DataFrame:
    """``sid, pos, pattern, cnt, coverage`` of patterns found in a text (``mining.find_patterns``).

    With ``graph.exclusive_counts`` also ``xcount, xratio``.
    """
    counts = patterns.select("pattern", "cnt")
    if xcounts is not None:
        counts = counts.join(xcounts.select("pattern", "xcount", "xratio"), "pattern", "left")
    rows = with_scalars(found.join(counts, "pattern"), tokens.select(F.col("tokens").alias("total")))
    return rows.select("sid", "pos", "pattern", "cnt", (F.col("cnt") * F.size("pattern") / F.col("total")).alias("coverage"), *counts.columns[2:])


def select_patterns(
    patterns: DataFrame, min_n: int = 1, max_n: int = 255, least: int = 1, least_freq: float = 0.0, skipgrams: bool = True,
    xcounts: DataFrame | None = None, least_xcount: int = 0, least_xratio: float = 0.0, among: DataFrame | None = None,
) -> DataFrame:
    """The patterns of a model that pass every threshold.

    ``least_freq`` is a share of the number of types in the model. ``among`` is a table
    of patterns (such as one side of an alignment) to be restricted to.
    """
    rows = patterns.filter(F.col("n").between(min_n, max_n) & (F.col("cnt") >= least))
    if not skipgrams:
        rows = rows.filter(~F.col("is_skip"))
    if least_freq > 0:
        types = patterns.agg(F.count(F.lit(1)).alias("types"))
        rows = with_scalars(rows, types).filter(F.col("cnt") / F.col("types") >= least_freq).drop("types")
    if xcounts is not None:
        keep = xcounts.filter((F.col("xcount") >= least_xcount) & (F.col("xratio") >= least_xratio)).select("pattern")
        rows = rows.join(keep, "pattern", "left_semi")
    if among is not None:
        rows = rows.join(among.select("pattern"), "pattern", "left_semi")
    return rows


def coverage_html(corpus: DataFrame, postings: DataFrame, skip_postings: DataFrame | None = None, gap=P.GAP) -> DataFrame:
    """``sid, html``: sentences with each token marked by how many patterns cover it."""
    grid = span_grid(postings, skip_postings, gap)
    marks = grid.groupBy("sid", "tok").agg(F.sum((~F.col("is_gap")).cast("int")).alias("valency"), F.max(F.col("is_gap")).alias("enclosed"), F.max("is_skip").alias("skip"))
    tokens = corpus.select("sid", F.posexplode("tokens").alias("tok", "word"))
    rows = tokens.join(marks, ["sid", "tok"], "left")
    escaped = F.replace(F.replace(F.replace(F.col("word").cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    css = F.concat_ws(" ", F.when(F.coalesce("valency", F.lit(0)) > 0, "covered").otherwise("uncovered"), F.when(F.col("enclosed"), "enclosed"), F.when(F.col("skip"), "skipgram"))
    cell = F.concat(F.lit('<span class="'), css, F.lit('" title="'), F.coalesce("valency", F.lit(0)).cast("string"), F.lit('">'), escaped, F.lit("</span>"))
    return rows.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("tok", cell.alias("h")))).alias("x")).select("sid", F.concat(F.lit("<p>"), F.array_join("x.h", " "), F.lit("</p>")).alias("html"))


def coverage_html_found(corpus: DataFrame, finder: Finder) -> DataFrame:
    """``coverage_html`` by the patterns of a finder, each sentence marked where it is read."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, values, lengths, n, gap, skip in finder.marked(batches):
            kinds, of = np.unique(n.astype(np.int64) << 2 | gap << 1 | skip, return_inverse=True)
            css = lambda k: ("covered" if k >> 2 else "uncovered") + " enclosed" * (k >> 1 & 1) + " skipgram" * (k & 1)
            opening = pa.array([f'<span class="{css(k)}" title="{k >> 2}">' for k in kinds.tolist()]).take(pa.array(of))
            for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                values = pc.replace_substring(values, char, name)
            cells = pc.binary_join_element_wise(opening, values, "</span>", "")
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lines = pc.binary_join(pa.ListArray.from_arrays(ends, cells), " ")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(table["sid"].chunks), pc.binary_join_element_wise("<p>", lines, "</p>", "")], ["sid", "html"])

    return corpus.filter(F.size("tokens") >= 1).select("sid", "tokens").mapInArrow(mark, "sid bigint, html string")
