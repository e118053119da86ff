"""Top N items within every group by partition lower bounds.

The N-th best distinct item of a group among some of its rows is a lower bound of the
group's N-th best overall. Partitions hand on their rows at or above their own
bound, and whenever ``STATE_ROWS`` of them are held, so a partition of any number of
groups takes bounded memory. The greatest bound of each group is aggregated and
joined to these rows, those below it go, and the survivors are ranked.

Order: score descending (NaN never takes part), then item ascending by its UTF-8
bytes. Of a repeated (group, item) the highest score counts. Rows with a null
group, item or score take no part; an empty table gives an empty frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgram.runtime import cut_lineage, small


#: Rows that a partition holds before it hands them on with the bounds they give.
STATE_ROWS = 1 << 18


def _best(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n best distinct items of each group, in order."""
    # code points order strings as their UTF-8 bytes do
    rows = rows.sort_values(["g", "score", "item"], ascending=[True, False, True], kind="stable")
    rows = rows.drop_duplicates(["g", "item"])
    return rows[rows.groupby("g", sort=False).cumcount() < n]


def local_candidates(n: int):
    """Per partition: rows at or above its bounds, the bound row of a full group marked."""

    def marked(parts: list[pd.DataFrame]) -> pd.DataFrame:
        kept = _best(pd.concat(parts, ignore_index=True), n)
        return kept.assign(bound=kept.groupby("g", sort=False).cumcount().to_numpy() == n - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            for lo in range(0, len(batch), STATE_ROWS):
                waiting.append(_best(batch.iloc[lo : lo + STATE_ROWS], n))
                size += len(waiting[-1])
                if size < STATE_ROWS:
                    continue
                kept = marked(waiting)
                if len(kept) > STATE_ROWS // 2:  # many groups: hand on and start anew
                    yield kept
                    waiting, size = [], 0
                else:
                    waiting, size = [kept.drop(columns="bound")], len(kept)
        if waiting:
            yield marked(waiting)

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """``group, item, score, rank`` with ranks 1 to n."""
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.filter("g IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    local = rows.mapInPandas(local_candidates(n), "g string, item string, score double, bound boolean")
    local = cut_lineage(local)  # read twice: for the bounds, and to be held against them
    order = F.struct((-F.col("score")).alias("down"), "item")
    # the greatest bound of a group, and of equal scores the one with the least item
    bounds = cut_lineage(local.filter("bound").groupBy("g").agg(F.min(order).alias("b")))
    above = local.join(small(bounds), "g", "left").filter(F.col("b").isNull() | (order <= F.col("b")))
    best = above.groupBy("g", "item").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "item")))
    return ranked.filter(F.col("rank") <= n).select(F.col("g").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")
