"""Filling containers of fixed capacity by a plan over the length histogram.

Best fit, longest first, runs over counts of lengths instead of items: equal
containers form a run of consecutive numbers with one remaining room, and one
step fills a whole run. The plan has a few rows per distinct length (at most the
capacity), whatever the number of documents. Each document then takes its place
by its rank among the items of its length.

A document beyond the capacity is cut into full containers and one rest, which is
packed as an item; no other document is split. A document of no tokens needs no
container and gets no row. A null size counts as no tokens; a null document id is
packed like any other; repeated document ids are items of their own; empty tables
give an empty frame.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgram.runtime import cut_lineage

#: Documents of one length ranked in one sort; larger lengths are dealt over several.
RANK_ROWS = 1 << 20
#: Parts in which documents beyond a capacity are numbered.
SALTS = 1024
#: More than any rank within a length.
_RANKS = 1 << 44


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``length, first_rank, items, first_container, per_container, offset``.

    Items ``first_rank ...`` of a length go, ``per_container`` to each, into the
    containers from ``first_container`` on, after the ``offset`` tokens these hold.
    """
    plan = []
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first container, containers)
    rooms: list[int] = []  # sorted
    opened = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_runs:
                open_runs[room] = []
                bisect.insort(rooms, room)
            open_runs[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                add(room - each * length, first, full)
            if full < n and left:  # fewer items than one container takes
                plan.append((length, rank, left, first + full, left, capacity - room))
                add(room - left * length, first + full, 1)
                full, left = full + 1, 0
            add(room, first + full, n - full)
    return plan


def rank_in_length(items: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Add ``rank``, 0 ... within each ``length``, in salted sorts of about ``RANK_ROWS`` rows."""
    most = max(counts.values(), default=0)
    salts = max(1, -(-most // RANK_ROWS))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    ranked = salted.withColumn("own", rank)
    if salts == 1:
        return ranked.withColumn("rank", F.col("own").cast("bigint")).drop("own", "salt")
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("length", "salt", before.alias("before"))
    return ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")


_PIECES = "container bigint, doc_id bigint, token_from bigint, n_tokens int, at int"


def _placer(plan: list[tuple[int, int, int, int, int, int]]):
    """Looks up the planned place of ranked items; the plan has some rows per length."""
    rows = np.array(sorted(plan), np.int64).reshape(-1, 6)
    length, lo, _, first, each, offset = rows.T
    keys = length * _RANKS + lo

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            row = np.searchsorted(keys, size * _RANKS + rank, "right") - 1
            nth = rank - lo[row]
            columns = [
                pa.array(first[row] + nth // each[row]),
                batch.column("doc_id"),
                batch.column("start").cast(pa.int64()),
                batch.column("length"),
                pa.array((offset[row] + nth % each[row] * size).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["container", "doc_id", "token_from", "n_tokens", "at"])

    return place


def full_containers(docs: DataFrame, capacity: int) -> DataFrame:
    """Containers filled by one document each, numbered downwards from -1.

    ``docs`` has ``doc_id, full``. Numbers are running sums within ``SALTS`` parts.
    """
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    running = Window.partitionBy("salt").orderBy("doc_id", "full").rowsBetween(Window.unboundedPreceding, 0)
    numbered = salted.withColumn("own", F.sum("full").over(running) - F.col("full"))
    sums = salted.groupBy("salt").agg(F.sum("full").alias("n"))  # at most SALTS rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = numbered.join(F.broadcast(sums.select("salt", before.alias("before"))), "salt")
    parts = numbered.select("doc_id", (F.col("own") + F.col("before")).alias("first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("part"))
    return parts.select(
        (-1 - F.col("first") - F.col("part")).cast("bigint").alias("container"), "doc_id",
        (F.col("part") * capacity).alias("token_from"), F.lit(capacity).alias("n_tokens"), F.lit(0).alias("at"),
    )


def pack(sizes: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """``pack_id, capacity, container, doc_id, token_from, n_tokens, at`` of every piece.

    ``sizes`` has ``doc_id, n_tokens``; ``at`` is the place in the container.
    ``capacities`` are few and each bounds its own plan.
    """
    spark = sizes.sparkSession
    schema = "pack_id int, capacity int, container bigint, doc_id bigint, token_from bigint, n_tokens int, at int"
    held = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_tokens").cast("bigint").alias("n")).filter("n > 0")
    held = cut_lineage(held)  # two numbers a document, read again for every capacity
    out = spark.createDataFrame([], schema)
    for pack_id, capacity in capacities:
        rest = F.col("n") % capacity
        full = F.floor(F.col("n") / capacity)
        items = held.filter(rest > 0).select("doc_id", rest.cast("int").alias("length"), (full * capacity).alias("start"))
        rows = items.groupBy("length").count().collect()  # at most capacity - 1 rows
        counts = {r["length"]: r["count"] for r in rows}
        plan = plan_best_fit(counts, capacity)
        placed = rank_in_length(items, counts).select("doc_id", "length", "start", "rank").mapInArrow(_placer(plan), _PIECES)
        cut = full_containers(held.filter(full > 0).select("doc_id", full.cast("bigint").alias("full")), capacity)
        out = out.unionByName(placed.unionByName(cut).select(F.lit(pack_id).alias("pack_id"), F.lit(capacity).alias("capacity"), "container", "doc_id", "token_from", "n_tokens", "at"))
    return out
