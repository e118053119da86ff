"""Per-key results when a handful of keys hold most records.

Edge cases: a null key takes no part (but its records count in the total); null
items count a record and no item; repeated deliveries of a record count once;
an empty table gives an empty frame; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgram.operators.accumulate import count_splits, sum_blocks
from weftgram.runtime import with_scalars


def one_blank(c: Column) -> Column:
    """Runs of spaces and tabs made one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


def key_profile(records: DataFrame, record_id: str, key: str, item: str) -> DataFrame:
    """``key, n_records, n_items, flat_score, share`` for every key.

    Distinct (record, key) and distinct (key, item) are taken by hash of the
    whole pair, which spreads a hot key evenly; the splits that result are
    counted by accumulator arrays. ``flat_score`` is 1 / n_items (null without
    items), ``share`` the part of all distinct record ids.
    """
    rows = records.select(F.col(record_id).alias("rid"), one_blank(F.col(key)).alias("key"), one_blank(F.col(item)).alias("item"))
    held = rows.filter("key IS NOT NULL")
    by_record = held.filter("rid IS NOT NULL").select("key", "rid").distinct().select("key", F.lit(1).alias("n_records"), F.lit(0).alias("n_items"))
    by_item = held.filter("item IS NOT NULL").select("key", "item").distinct().select("key", F.lit(0).alias("n_records"), F.lit(1).alias("n_items"))
    measures = ["n_records", "n_items"]
    totals = sum_blocks(count_splits(by_record.unionByName(by_item), "key", measures), ["key"], measures)
    n = rows.filter("rid IS NOT NULL").select("rid").distinct().agg(F.count(F.lit(1)).alias("n_all"))
    return with_scalars(totals, n).select(
        "key", "n_records", "n_items",
        F.when(F.col("n_items") > 0, 1 / F.col("n_items")).alias("flat_score"),
        "n_all", (F.col("n_records") / F.col("n_all")).alias("share"),
    )
