"""Pairs of items that share baskets more often than chance gives.

Pair counts are exact. Chance is a bipartite configuration null in which item i
is in basket s with probability x_i y_s / (1 + x_i y_s), fitted so that every
item keeps its expected number of baskets and every basket its expected size.
The number of baskets a pair shares is then Poisson-binomial; its upper tail
comes from a saddlepoint approximation, and Benjamini-Hochberg control over all
possible pairs gives the surprise.

Scale: an item outside ``min_count .. N / min_lift`` baskets cannot be in any
result pair, so it is left out before pairs are formed. The up to
``min_count - 1`` largest baskets of more than ``GIANT`` items form no pairs either:
a pair needs some other basket as well, so its count without them decides which
pairs are looked up in them. Further baskets of that size are cut into blocks of
about ``GIANT`` items, and pairs of blocks are dealt over all tasks. The null is fitted
on at most ``FIT_CLASSES`` classes of either side; a tail is computed once for all
pairs of one batch with the same classes and count.

Edge cases: rows with a null item or basket take no part; repeated (item, basket)
rows count once; an empty table gives an empty frame; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgram.runtime import cut_lineage, small

#: Items above which a basket counts as giant.
GIANT = 2000
#: Classes of basket sizes, and of item counts, on which the null is fitted.
FIT_CLASSES = 256
#: Width, in ln p, of the bins in which p-values are ranked; q-values are rounded up to a bin.
LN_BIN, LN_BINS = 0.02, 200_000


def _degree_class(c: Column) -> Column:
    """Counts up to three digits as they are, larger ones cut to three digits: under 20,000 classes."""
    unit = F.pow(F.lit(10), F.greatest(F.length(c.cast("string")) - 3, F.lit(0))).cast("bigint")
    return c - c % unit


def fit_null(degrees: np.ndarray, n_items: np.ndarray, sizes: np.ndarray, n_baskets: np.ndarray, rounds: int = 500, tolerance: float = 1e-9):
    """Fitnesses x of the item classes and y of the basket classes by fixed-point rounds."""
    edges = float((degrees * n_items).sum())
    x, y = degrees / math.sqrt(edges), sizes / math.sqrt(edges)
    for _ in range(rounds):
        new_x = degrees / (n_baskets * y / (1 + x[:, None] * y)).sum(1)
        new_y = sizes / (n_items[:, None] * new_x[:, None] / (1 + new_x[:, None] * y)).sum(0)
        moved = max(np.abs(new_x / x - 1).max(), np.abs(new_y / y - 1).max())
        x, y = new_x, new_y
        if moved < tolerance:
            break
    return x, y


def pooled(values: np.ndarray, n: np.ndarray, most: int = FIT_CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Mean value and number of at most ``most`` classes of ascending values.

    Small values keep classes of their own, larger ones share classes of equal ratio.
    """
    values, n = np.asarray(values, float), np.asarray(n, float)
    if len(values) <= most:
        return values, n
    own = most // 2
    top = np.log(values[-1] / values[own])
    cls = np.where(np.arange(len(values)) < own, np.arange(len(values)), own + np.minimum((np.log(np.maximum(values, values[own]) / values[own]) / top * (most - own)).astype(int), most - own - 1))
    _, cls = np.unique(cls, return_inverse=True)
    count = np.bincount(cls, n)
    return np.bincount(cls, n * values) / count, count


def fitness(degrees: np.ndarray, y: np.ndarray, n_baskets: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The x of every degree that gives its expected number of baskets, the y being fixed; by Newton steps on ln x."""
    degrees = np.minimum(np.asarray(degrees, float), n_baskets.sum() * (1 - 1e-9))
    u = np.log(degrees / (n_baskets * y).sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(u[:, None] + np.log(y), -700, 700)))
        step = np.clip(((n_baskets * p).sum(1) - degrees) / np.maximum((n_baskets * p * (1 - p)).sum(1), 1e-300), -2, 2)
        u = u - step
        if np.abs(step).max() < 1e-10:
            break
    return np.exp(u)


def upper_tail_ln(q: np.ndarray, copies: np.ndarray, count: np.ndarray) -> np.ndarray:
    """ln P(X >= count) for X the sum of ``copies[k]`` Bernoulli(q[i, k]) over k."""
    mean = (copies * q).sum(1)
    out = np.zeros(len(count))
    above = count > mean + 1e-9
    full = count > (copies * (q > 0)).sum(1)
    out[full] = -np.inf
    rows = np.flatnonzero(above & ~full)
    if not len(rows):
        return out
    q, c = q[rows], count[rows].astype(float)
    t = np.log(np.maximum(c, 1e-12) / mean[rows])
    for _ in range(60):
        e = q * np.exp(np.minimum(t, 700))[:, None]
        p = e / (1 - q + e)
        first, second = (copies * p).sum(1), (copies * p * (1 - p)).sum(1)
        step = np.clip((first - c) / np.maximum(second, 1e-300), -2, 2)
        t = t - step
        if np.abs(step).max() < 1e-10:
            break
    e = q * np.exp(np.minimum(t, 700))[:, None]
    k0 = (copies * np.log1p(q * np.expm1(np.minimum(t, 700))[:, None])).sum(1)
    p = e / (1 - q + e)
    second = (copies * p * (1 - p)).sum(1)
    w = np.sqrt(np.maximum(2 * (t * c - k0), 1e-12))
    u = -np.expm1(-t) * np.sqrt(np.maximum(second, 1e-300))
    # Mills ratio less 1 / w: exact for small w, a series for large
    small = w < 6
    ws = np.where(small, w, 1.0)
    mills = math.sqrt(math.pi / 2) * np.exp(ws**2 / 2) * np.array([math.erfc(v / math.sqrt(2)) for v in ws]) - 1 / ws
    series = -1 / w**3 + 3 / w**5 - 15 / w**7
    body = np.where(small, mills, series) + 1 / u
    ln = -(w**2) / 2 - math.log(math.sqrt(2 * math.pi)) + np.log(np.maximum(body, 1e-300))
    out[rows] = np.minimum(ln, 0)
    return out


def cooccurring_pairs(df: DataFrame, item: str, basket: str, min_count: int, min_lift: int = 0) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, expected, ln_p, ln_q`` with item_a < item_b.

    Pairs in at least ``min_count`` common baskets and with at least ``min_lift``
    times the ``n_a n_b / n_baskets`` of independence. ``ln_q`` ranks a pair among
    the returned ones against all possible pairs; with a ``min_lift`` it is on the
    safe side.
    """
    held = df.select(F.col(item).alias("i"), F.col(basket).alias("s")).dropna().distinct().persist(StorageLevel.MEMORY_AND_DISK)
    sizes = held.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    items = held.groupBy("i").agg(F.count(F.lit(1)).alias("c"))

    def classes(counts: DataFrame, c: str) -> pd.DataFrame:  # under 20,000 rows whatever the input
        return counts.groupBy(_degree_class(F.col(c)).alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"), F.max(c).alias("most")).orderBy("cls").toPandas()

    basket_classes, item_classes = classes(sizes, "k"), classes(items, "c")
    n_baskets, n_items = int(basket_classes.n.sum()), int(item_classes.n.sum())
    schema = "item_a bigint, item_b bigint, n_ab bigint, n_a bigint, n_b bigint, n_baskets bigint, lift double, expected double, ln_p double"
    if n_baskets == 0:
        return df.sparkSession.createDataFrame([], schema + ", ln_q double")
    mean = lambda c: (c.total / c.n).to_numpy(float)
    sizes_of, copies = pooled(mean(basket_classes), basket_classes.n)
    _, y = fit_null(*pooled(mean(item_classes), item_classes.n), sizes_of, copies)
    x = fitness(mean(item_classes), y, copies)
    cls = item_classes.cls.to_numpy()

    kept_items = items.filter((F.col("c") >= min_count) & (F.col("c") * F.lit(min_lift) <= F.lit(n_baskets)))
    kept = held.join(kept_items.select("i"), "i")
    giants: list = []
    if int(basket_classes.most.max()) > GIANT:
        largest = kept.groupBy("s").count().filter(F.col("count") > GIANT).orderBy(F.desc("count"), "s").limit(min_count - 1)
        giants = [r["s"] for r in largest.collect()]  # under min_count rows
    usual = kept.filter(~F.col("s").isin(giants)) if giants else kept
    def following(lists: DataFrame) -> DataFrame:
        """Pairs of an item and those after it in its list."""
        return lists.select("l", F.posexplode("l").alias("at", "a")).select("a", F.explode(F.slice("l", F.col("at") + 2, F.size("l"))).alias("b"))

    if int(basket_classes.most.max()) <= GIANT:
        pairs = following(usual.groupBy("s").agg(F.sort_array(F.collect_list("i")).alias("l")))
    else:
        large = cut_lineage(usual.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / GIANT).cast("int").alias("nb")).filter("nb > 1"))
        parts = usual.join(small(large), "s", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        parts = parts.withColumn("block", F.pmod(F.xxhash64("i"), F.col("nb")).cast("int"))
        lists = parts.groupBy("s", "block").agg(F.sort_array(F.collect_list("i")).alias("l"), F.first("nb").alias("nb"))
        cut = lists.filter("nb > 1")
        further = cut.filter(F.col("block") + 1 < F.col("nb")).select("s", F.col("l").alias("x"), F.explode(F.sequence(F.col("block") + 1, F.col("nb") - 1)).alias("block"))
        across = further.join(cut.select("s", "block", F.col("l").alias("y")), ["s", "block"])
        across = across.select("y", F.explode("x").alias("u")).select("u", F.explode("y").alias("v"))
        pairs = following(lists).unionByName(across.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).filter(F.col("n_ab") >= min_count - len(giants))
    if giants:
        bit = F.aggregate(F.array(*map(F.lit, giants)), F.struct(F.lit(0).alias("m"), F.lit(1).alias("p")), lambda acc, g: F.struct(F.when(F.col("s") == g, acc["p"]).otherwise(acc["m"]).alias("m"), (acc["p"] * 2).alias("p")))["m"]
        masks = kept.filter(F.col("s").isin(giants)).groupBy("i").agg(F.sum(bit).cast("int").alias("mask"))
        ma, mb = (masks.select(F.col("i").alias(k), F.col("mask").alias(f"mask_{k}")) for k in ("a", "b"))
        joined = counted.join(ma, "a", "left").join(mb, "b", "left")
        both = F.coalesce(F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b"))), F.lit(0))
        counted = joined.select("a", "b", (F.col("n_ab") + both).alias("n_ab")).filter(F.col("n_ab") >= min_count)
    ca, cb = (kept_items.select(F.col("i").alias(k), F.col("c").alias(f"n_{k}")) for k in ("a", "b"))
    sized = counted.join(ca, "a").join(cb, "b")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    sized = sized.filter(wide("n_ab") * F.lit(n_baskets).cast("decimal(19,0)") >= wide("n_a") * wide("n_b") * F.lit(min_lift))

    def against_null(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            out = rows.assign(n_baskets=n_baskets, lift=rows.n_ab * n_baskets / (rows.n_a.astype(float) * rows.n_b))
            at = [np.searchsorted(cls, rows[c].to_numpy(), "right") - 1 for c in ("n_a", "n_b")]
            same, back = np.unique(np.stack([np.minimum(*at), np.maximum(*at), rows.n_ab.to_numpy()]), axis=1, return_inverse=True)
            expected, ln_p = np.zeros(same.shape[1]), np.zeros(same.shape[1])
            step = max(1, 4_000_000 // len(y))
            for lo in range(0, same.shape[1], step):
                part = same[:, lo : lo + step]
                fit = [x[part[k]][:, None] * y for k in (0, 1)]
                q = (fit[0] / (1 + fit[0])) * (fit[1] / (1 + fit[1]))
                expected[lo : lo + step] = (copies * q).sum(1)
                ln_p[lo : lo + step] = upper_tail_ln(q, copies, part[2])
            expected, ln_p = expected[back.ravel()], ln_p[back.ravel()]
            yield out.assign(expected=expected, ln_p=ln_p)[["item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", "lift", "expected", "ln_p"]]

    tested = sized.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b").mapInPandas(against_null, schema)
    tested = cut_lineage(tested)
    held.unpersist()
    return with_q_values(tested, n_items * (n_items - 1) / 2)


def with_q_values(tested: DataFrame, tests: float) -> DataFrame:
    """Add ``ln_q``, the Benjamini-Hochberg q-value of ``ln_p`` among ``tests`` tests.

    P-values are ranked in at most ``LN_BINS`` bins of ``LN_BIN`` and rounded up to
    their bin's end, so a q-value is at most 2 % above the exact one.
    """
    number = F.least(F.floor(-F.col("ln_p") / LN_BIN), F.lit(LN_BINS)).cast("int")
    histogram = tested.groupBy(number.alias("bin")).count().toPandas().sort_values("bin", ascending=False)
    if histogram.empty:
        return tested.withColumn("ln_q", F.lit(None).cast("double"))
    rank = histogram["count"].cumsum().to_numpy(float)
    ln_q = -histogram.bin.to_numpy() * LN_BIN + math.log(max(tests, 1)) - np.log(rank)
    ln_q = np.minimum(np.minimum.accumulate(ln_q[::-1])[::-1], 0)
    table = tested.sparkSession.createDataFrame(pd.DataFrame({"bin": histogram.bin.to_numpy(np.int32), "ln_q": ln_q}), "bin int, ln_q double")
    # at most LN_BINS + 1 rows of 12 bytes
    return tested.withColumn("bin", number).join(F.broadcast(table), "bin").drop("bin")
