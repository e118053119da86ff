"""Occurrences and record counts of every term, with marks for rare and common ones.

Terms are encoded by a dictionary per input split, counted into block arrays,
and the blocks are summed by range of the global identifiers (see
``operators.accumulate``). A term in a third of all records leaves each split as
one row.

Edge cases: deliveries of one record count once (of differing ones, the greatest
text of each side after blanks are made single); rows with a null record id take
no part in term counts; null and blank texts hold no terms; an empty table gives
an empty frame; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgram.operators.accumulate import SPLIT_KEYS, LocalCounts, sum_blocks
from weftgram.operators.hotkeys import one_blank
from weftgram.runtime import with_scalars


def split_counts(sides: list[str]):
    """Block arrays (occurrences, records) of the texts in columns 0, 1, ... of a split."""
    names = ["side", "term", "n_occurrences", "n_records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = [LocalCounts(2) for _ in sides]

        def emit(i: int) -> pa.RecordBatch:
            terms, (occ, rec) = local[i].take()
            return pa.RecordBatch.from_arrays([pa.array([sides[i]] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(occ), pa.array(rec)], names=names)

        for batch in batches:
            for i in range(len(sides)):
                words = pc.split_pattern(batch.column(i), " ")
                counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
                record = np.repeat(np.arange(len(counts)), counts)
                flat = words.flatten().dictionary_encode()
                kept = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False) if len(flat.dictionary) else np.zeros(0, bool)
                codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                real = kept[codes] if len(codes) else np.zeros(0, bool)
                dictionary = flat.dictionary.to_pylist()
                ids = np.full(len(dictionary), -1, np.int64)
                ids[np.flatnonzero(kept)] = local[i].encode([w for w in dictionary if w != ""])
                own, record = ids[codes[real]], record[real]
                local[i].add(0, own)
                # one presence for each term and record
                present = np.unique(record * (len(local[i].ids) + 1) + own)
                local[i].add(1, present % (len(local[i].ids) + 1))
                if len(local[i].ids) >= SPLIT_KEYS:
                    yield emit(i)
        for i in range(len(sides)):
            if local[i].ids:
                yield emit(i)

    return run


def term_counts(df: DataFrame, record_id: str, sides: dict[str, str], rare: int = 2, common_part: int = 20) -> DataFrame:
    """``side, term, n_occurrences, n_records, n_all, mark`` for every term.

    ``sides`` names a text column for each side. ``mark`` is ``rare`` for terms in
    at most ``rare`` records, ``common`` for those in more than one of
    ``common_part`` of all distinct record ids, else null.
    """
    texts = df.select(F.col(record_id).alias("rid"), *(one_blank(F.col(c)).alias(s) for s, c in sides.items())).filter("rid IS NOT NULL")
    records = texts.groupBy("rid").agg(*(F.max(s).alias(s) for s in sides))
    blocks = records.select(*sides).mapInArrow(split_counts(list(sides)), "side string, term string, n_occurrences bigint, n_records bigint")
    totals = sum_blocks(blocks, ["side", "term"], ["n_occurrences", "n_records"])
    n_all = df.select(record_id).dropna().distinct().agg(F.count(F.lit(1)).alias("n_all"))
    n = F.col("n_records")
    mark = F.when(n <= rare, "rare").when(n * common_part > F.col("n_all"), "common")
    return with_scalars(totals, n_all).select("side", "term", "n_occurrences", "n_records", "n_all", mark.alias("mark"))
