"""Per-key totals by dense accumulator arrays.

The plan does the same for any distribution of keys:

1. every equal input split encodes its keys with a local dictionary and counts
   them by ``numpy.bincount``, so a key holding a third of all rows leaves a
   split as one row;
2. the partial counts meet by hash bucket of the key, where a ranking gives each
   key the global identifier (bucket, rank);
3. each task adds the partial counts of its identifier ranges into dense arrays
   of ``WIDTH`` cells with ``numpy.add.at``.

What a task holds is one array of ``WIDTH`` cells and the distinct keys of one
split, never the rows of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of one accumulator array.
WIDTH = 4096
#: Distinct keys a split collects before it hands on its counts and starts anew.
SPLIT_KEYS = 1 << 18


class LocalCounts:
    """Local dictionary of one input split, with one count array per measure."""

    def __init__(self, measures: int):
        self.ids: dict = {}
        self.counts = [np.zeros(1024, np.int64) for _ in range(measures)]

    def encode(self, keys: list) -> np.ndarray:
        ids = self.ids
        out = np.fromiter((ids.setdefault(k, len(ids)) for k in keys), np.int64, len(keys))
        size = len(self.counts[0])
        if len(ids) > size:
            grow = max(len(ids), 2 * size) - size
            self.counts = [np.concatenate([c, np.zeros(grow, np.int64)]) for c in self.counts]
        return out

    def add(self, measure: int, ids: np.ndarray, weights: np.ndarray | None = None) -> None:
        if len(ids):
            cells = np.bincount(ids) if weights is None else np.bincount(ids, weights).astype(np.int64)
            self.counts[measure][: len(cells)] += cells

    def take(self) -> tuple[list, list[np.ndarray]]:
        n = len(self.ids)
        out = list(self.ids), [c[:n] for c in self.counts]
        self.__init__(len(self.counts))
        return out


def count_splits(rows: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Step 1 over 0/1 or integer columns ``measures``: partial sums per split and key."""
    schema = f"{key} string, " + ", ".join(f"{m} bigint" for m in measures)
    names = [key, *measures]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = LocalCounts(len(measures))

        def emit() -> pa.RecordBatch:
            keys, counts = local.take()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *map(pa.array, counts)], names=names)

        for batch in batches:
            encoded = batch.column(0).dictionary_encode()
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            ids = local.encode(encoded.dictionary.to_pylist())[codes] if len(codes) else codes.astype(np.int64)
            for i in range(len(measures)):
                local.add(i, ids, batch.column(i + 1).to_numpy(zero_copy_only=False))
            if len(local.ids) >= SPLIT_KEYS:
                yield emit()
        if local.ids:
            yield emit()

    return rows.select(F.col(key).cast("string").alias(key), *(F.col(m).cast("bigint").alias(m) for m in measures)).mapInArrow(split, schema)


def sum_blocks(partial: DataFrame, keys: list[str], measures: list[str], buckets: int | None = None) -> DataFrame:
    """Steps 2 and 3: ``keys``, ``bucket``, ``rank`` and the summed ``measures``.

    ``keys`` must hold no nulls. The identifier (bucket, rank) is the same on
    every run. ``buckets`` follows the session's shuffle partitions by default.
    """
    spark = partial.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucketed = partial.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("bucket").orderBy(*keys)
    encoded = bucketed.withColumn("rank", (F.dense_rank().over(order) - 1).cast("int"))
    fields = {f.name: f.dataType.simpleString() for f in partial.schema}
    names = [*keys, "bucket", "rank", *measures]
    schema = ", ".join(f"{n} {fields.get(n, 'int')}" for n in keys) + ", bucket int, rank int, " + ", ".join(f"{m} bigint" for m in measures)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by (bucket, rank); one array of WIDTH cells is open at a time
        at: tuple[int, int] | None = None
        cells = np.zeros((len(measures), WIDTH), np.int64)
        first: list = []
        out_schema: pa.Schema | None = None

        def emit() -> pa.RecordBatch:
            n = sum(len(f) for f in first)
            ranks = np.arange(n, dtype=np.int32) + np.int32(at[1] * WIDTH)
            arrays = pa.Table.from_batches(first).combine_chunks() if first else None
            columns = [arrays.column(k).combine_chunks() for k in keys]
            columns += [pa.array(np.full(n, at[0], np.int32)), pa.array(ranks)]
            columns += [pa.array(cells[i, :n].copy()) for i in range(len(measures))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            out_schema = out_schema or batch.schema
            bucket = batch.column("bucket").to_numpy()
            rank = batch.column("rank").to_numpy()
            block = rank // WIDTH
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                if lo == hi:
                    continue
                here = int(bucket[lo]), int(block[lo])
                if here != at:
                    if at is not None:
                        yield emit()
                    at, first, last = here, [], -1
                    cells[:] = 0
                ids = rank[lo:hi] - here[1] * WIDTH
                for i, m in enumerate(measures):
                    np.add.at(cells[i], ids, batch.column(m).to_numpy()[lo:hi])
                fresh = np.flatnonzero(np.diff(np.concatenate([[last], ids])) != 0)
                if len(fresh):
                    first.append(batch.select(keys).take(pa.array(fresh + lo)))
                    last = int(ids[-1])
        if at is not None:
            yield emit()

    return encoded.select(*names).mapInArrow(accumulate, schema)
