"""Most frequent values of a column by iceberg multi-hash filtering.

A first pass counts distinct refs in coarse buckets under several hashes; the
counts are exact and bounded in number whatever the number of values. A value
can reach the threshold only if its bucket does under every hash, so the second
pass looks at the few surviving values alone and counts them exactly.

Edge cases: a ref with a null in any part takes no part; repeated refs count
once; ties at the threshold are all kept; an empty table gives an empty frame;
further columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgram.runtime import cut_lineage

#: Hash functions, and the fewest buckets of each.
HASHES, BUCKETS = 3, 4096
#: Buckets of a hash that are tested by a list in the plan; more are joined.
LISTED = 4096


def buckets_for(share: float) -> int:
    """Sixteen buckets for every value that can reach the share, so that most buckets stay below it."""
    return max(BUCKETS, 1 << math.ceil(math.log2(16 / share)))


def _bucket(value: str, seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(value)), F.lit(buckets)).cast("int")


def frequent_values(
    df: DataFrame, value: str, ref: list[str], share: float, hashes: int = HASHES, buckets: int | None = None
) -> DataFrame:
    """``value, n_refs, n_total``: values with at least ``share`` of all distinct refs.

    At most 1 / share buckets of a hash reach the threshold, so what is sent to
    the second pass has a fixed bound, as have the counters.
    """
    buckets = buckets or buckets_for(share)
    rows = df.select(value, *ref).dropna()
    refs = rows.distinct()
    numbered = F.explode(F.array(*(F.lit(h * buckets) + _bucket(value, h, buckets) for h in range(hashes))))
    coarse = cut_lineage(refs.select(numbered.alias("b")).groupBy("b").count())  # at most hashes * buckets rows
    total = (coarse.agg(F.sum("count")).first()[0] or 0) // hashes
    # the share as a fraction, so that a count just at the threshold is kept
    part = Fraction(str(share))
    least = -(-total * part.numerator // part.denominator)
    reached = coarse.filter(F.col("count") >= F.lit(least)).select("b")
    heavy: list[list[int]] = [[] for _ in range(hashes)]
    for r in reached.collect():  # at most hashes / share rows
        heavy[r["b"] // buckets].append(r["b"] % buckets)
    survivors = rows
    for h in range(hashes):
        bucket = _bucket(value, h, buckets)
        if len(heavy[h]) <= LISTED:
            survivors = survivors.filter(bucket.isin(heavy[h]) if heavy[h] else F.lit(False))
        else:
            of_hash = reached.filter(F.floor(F.col("b") / buckets) == h).select((F.col("b") % buckets).alias("__bucket"))
            survivors = survivors.join(F.broadcast(of_hash), bucket == F.col("__bucket"), "left_semi")
    exact = survivors.distinct().groupBy(value).agg(F.count(F.lit(1)).alias("n_refs"))
    return exact.filter(F.col("n_refs") >= F.lit(least)).withColumn("n_total", F.lit(total).cast("bigint"))
