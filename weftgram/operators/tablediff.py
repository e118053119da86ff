"""Differences between two copies of a keyed table by content-defined chunks.

Only the hash of a row's key and the hash of its content are moved. Each copy is
sorted by key hash; a rolling hash over the last keys cuts it into chunks where it
meets a condition, and into smaller chunks within these where it meets a weaker
one, so an inserted or missing row moves only the cuts next to it. Chunks whose
fingerprint is in both copies are equal; of the others the small chunks are
matched in the same way. The keys left are looked up in both copies, and only
their rows are compared field by field.

Edge cases: rows with a null key part take no part; keys are compared without
spaces and tabs at both ends; repeated rows count once, and of rows with one key
and different values the one with the least content hash is kept; an empty copy
makes every row of the other ``only_a`` or ``only_b``; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgram.runtime import cut_lineage

#: Two scores differ if they are further apart than this.
TOLERANCE = 1e-9
#: Keys in the rolling hash; cuts come about every CUT_MASK + 1 rows (MAX_ROWS at the latest), small ones every SMALL_MASK + 1.
WINDOW, CUT_MASK, SMALL_MASK, MAX_ROWS = 2, 63, 3, 4096
#: Buckets of keys sorted on their own, for each shuffle partition.
BUCKETS = 8
#: Fingerprints or keys of unmatched chunks that are sent to every task, at most (20 bytes each).
BROADCAST_ROWS = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def canonical_scores(sc: Column) -> Column:
    """Numbers equal for two vectors only if no element differs beyond the tolerance.

    A score up to 1000 in size becomes its cell on a grid of half the tolerance,
    around the grid's points, any other one the hash of its exact value.
    """
    cell = lambda x: (
        F.when(x.isNull(), F.lit(-(1 << 62)))
        .when(F.isnan(x), F.lit(-(1 << 62) + 1))
        .when(F.abs(x) < 1000, F.floor(x * (2 / TOLERANCE) + 0.5))
        .otherwise(F.xxhash64(x))
    )
    return F.transform(sc, cell)


def hashed_rows(df: DataFrame) -> DataFrame:
    """``kh, h, s, t, sc, wa, cnt``: stripped rows with the hashes of key and content."""
    strip = lambda c: F.btrim(F.col(c), F.lit(" \t"))
    rows = df.select(strip("s").alias("s"), strip("t").alias("t"), F.col("sc").cast("array<double>").alias("sc"), F.col("wa").cast("string").alias("wa"), F.col("cnt").cast("bigint").alias("cnt"))
    rows = rows.filter("s IS NOT NULL AND t IS NOT NULL")
    # the length keeps apart what hashing one value after another would not
    key = F.xxhash64("s", F.length("s"), "t")
    content = F.xxhash64("s", F.length("s"), "t", canonical_scores(F.col("sc")), F.size("sc"), F.col("sc").isNull(), "wa", F.col("wa").isNull(), "cnt", F.col("cnt").isNull())
    return rows.select(key.alias("kh"), content.alias("h"), "s", "t", "sc", "wa", "cnt")


def cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows ``side, bucket, kh, h`` that come sorted by bucket and key hash, one side after the other.

    A row for each small chunk: its fingerprint and that of the chunk around it, each with
    the number of rows, and its key hashes.
    """
    held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # of the open chunk: 2 * bucket + side, key, content
    last = (-1, np.uint64(0))  # bucket and key of the row before it

    def chunks(bucket: np.ndarray, kh: np.ndarray, h: np.ndarray, final: bool) -> tuple[pa.RecordBatch | None, int]:
        """The chunks closed so far, and how many rows they hold."""
        before_b, before_k = np.concatenate([[last[0]], bucket[:-1]]), np.concatenate([[last[1]], kh[:-1]]).astype(np.uint64)
        with np.errstate(over="ignore"):
            # WINDOW keys: the one before, where it is of the same bucket, and this
            rolling = ((np.where(before_b == bucket, before_k, np.uint64(0)) * _P + kh) * _Q) >> np.uint64(40)
            ends = np.append(bucket[1:] != bucket[:-1], final)
            cut, small = ends | (rolling & np.uint64(CUT_MASK) == 0), ends | (rolling & np.uint64(SMALL_MASK) == 0)
            ready = len(kh) if final else (int(np.flatnonzero(cut)[-1]) + 1 if cut.any() else 0)
            if not ready and len(kh) >= MAX_ROWS:
                ready = len(kh)
            if not ready:
                return None, 0
            cut, small = cut[:ready], small[:ready]
            cut[-1] = small[-1] = True
            first, first_small = (np.concatenate([[0], np.flatnonzero(x)[:-1] + 1]) for x in (cut, small))
            mixed = (h[:ready] ^ (h[:ready] >> np.uint64(29))) * _Q
            around = np.searchsorted(first, first_small, "right") - 1
            columns = [(bucket[first_small] & 1).astype(np.int32)]
            for starts, pick in ((first, around), (first_small, slice(None))):
                sizes = np.diff(np.append(starts, ready)).astype(np.int32)
                columns += [np.add.reduceat(x, starts)[pick].view(np.int64) for x in (h[:ready], mixed)] + [sizes[pick]]
        offsets = np.append(first_small, ready).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(kh[:ready].view(np.int64)))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), keys], names=["side", "o1", "o2", "o_rows", "i1", "i2", "i_rows", "keys"]), ready

    for batch in batches:
        if not batch.num_rows:
            continue
        new = 2 * batch.column("bucket").to_numpy().astype(np.int64) + batch.column("side").to_numpy(), batch.column("kh").to_numpy().view(np.uint64), batch.column("h").to_numpy().view(np.uint64)
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        out, ready = chunks(*held, final=False)
        if ready:
            last = (held[0][ready - 1], held[1][ready - 1])
            held = [x[ready:] for x in held]
            yield out
    if len(held[0]):
        yield chunks(*held, final=True)[0]


def _unmatched(chunks: DataFrame, mark: list[str]) -> DataFrame:
    """Fingerprints that are on one side only: an anti-join both ways, in one aggregation by fingerprint.

    Written to the checkpoint folder, and sent to every task if they are few.
    """
    sides = chunks.groupBy(*mark).agg(F.min("side").alias("a"), F.max("side").alias("b"))
    return _small(cut_lineage(sides.filter("a = b").select(*mark)))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def suspect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """``kh``: key hashes of the small chunks that the copies do not share, written to the checkpoint folder.

    ``a`` and ``b`` are ``hashed_rows``. Equal rows meet on their way, so one key may hold any
    share of all rows.
    """
    buckets = BUCKETS * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_sides = None
    for side, rows in ((0, a), (1, b)):
        one = rows.groupBy("kh").agg(F.min("h").alias("h"))
        # the partitioning of the aggregation in finer steps: both copies have the same keys in a bucket
        one = one.select(F.lit(side).alias("side"), F.pmod(F.hash("kh"), F.lit(buckets)).alias("bucket"), "kh", "h").sortWithinPartitions("bucket", "kh")
        sorted_sides = one if sorted_sides is None else sorted_sides.unionByName(one)
    schema = "side int, o1 bigint, o2 bigint, o_rows int, i1 bigint, i2 bigint, i_rows int, keys array<bigint>"
    chunks = sorted_sides.mapInArrow(cut_chunks, schema).persist(StorageLevel.MEMORY_AND_DISK)
    outer, inner = ["o1", "o2", "o_rows"], ["i1", "i2", "i_rows"]
    within = chunks.join(_unmatched(chunks.select("side", *outer), outer), outer, "left_semi")
    rows = within.join(_unmatched(within.select("side", *inner), inner), inner, "left_semi")
    keys = cut_lineage(rows.select(F.explode("keys").alias("kh")).distinct())
    chunks.unpersist()
    return keys


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``s, t, diff``: ``only_a``, ``only_b`` or the name of a differing field."""
    rows_a, rows_b = hashed_rows(a), hashed_rows(b)
    keys = _small(suspect_keys(rows_a, rows_b))
    value = F.struct("h", "sc", "wa", "cnt")
    both = None
    for side, rows in ((0, rows_a), (1, rows_b)):
        found = rows.join(keys, "kh", "left_semi").select("s", "t", F.lit(side).alias("side"), value.alias("v"))
        both = found if both is None else both.unionByName(found)
    of = lambda side: F.min_by(F.when(F.col("side") == side, F.col("v")), F.when(F.col("side") == side, F.col("v.h"))).alias("ab"[side])
    met = both.groupBy("s", "t").agg(of(0), of(1))
    near = F.expr(
        "size(a.sc) = size(b.sc) AND forall(zip_with(a.sc, b.sc, (x, y) -> x <=> y"
        f" OR (x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND abs(x - y) <= {TOLERANCE})), z -> z)"
    )
    same_sc = (F.col("a.sc").isNull() & F.col("b.sc").isNull()) | F.coalesce(near, F.lit(False))
    fields = F.array_compact(F.array(F.when(~same_sc, "sc"), *(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in ("wa", "cnt"))))
    diffs = F.when(F.col("b").isNull(), F.array(F.lit("only_a"))).when(F.col("a").isNull(), F.array(F.lit("only_b"))).otherwise(fields)
    return met.select("s", "t", F.explode(diffs).alias("diff"))
