"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spaces, tabs and carriage returns, as a regular expression class.
BLANK = r"[ \t\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary folder; on a
    cluster, where a machine's folder is not shared, that is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if current is None:
        current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="weftgram-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank``, 0 ... over all rows in an order without ties.

    The rows are sorted by range over all tasks and written once, so that the numbers of
    rows before each partition, one row per partition, hold for what is read again.
    """
    rows = cut_lineage(df.orderBy(*order)).withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__before")))  # one row per partition
    joined = rows.withColumn("__part", part).join(offsets, "__part")
    return joined.select(*df.columns, (F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


#: Text of a frame, in bytes, up to which it is sent to every task.
BROADCAST_BYTES = 24 << 20


def is_small(df: DataFrame) -> bool:
    """Whether a written frame is small enough to be sent to every task: its size is added up, not guessed."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16 * len(df.columns)))
    return (df.agg(F.sum(size.cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """The frame, with a broadcast hint if it ``is_small``; beyond that it is joined by shuffle."""
    return F.broadcast(df) if is_small(df) else df


def spread(df: DataFrame) -> DataFrame:
    """Give a frame read from a few large row groups one task per core.

    Python stages are CPU bound, so an input of fewer splits than cores is dealt
    round robin. Large inputs have more splits than cores and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of an aggregate of exactly one row to every row, as a scalar subquery."""
    value = one_row.select(F.struct(*one_row.columns).alias("v")).scalar()
    joined = df.withColumn("__v", value)
    return joined.select(*df.columns, *(F.col(f"__v.{c}").alias(c) for c in one_row.columns))
