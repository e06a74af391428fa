"""Plan helpers: checked broadcasts and deterministic first rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A dimension may be broadcast up to this many rows, as counted.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def settled(df: DataFrame) -> DataFrame:
    """df computed and written to the checkpoint folder that the session names; only a session on this machine alone may name none.

    Plans that use a result several times then start from it, and a lost executor costs no more than one stage.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        context.setCheckpointDir(place or "file://" + tempfile.mkdtemp(prefix="quirefold-"))
    return df.checkpoint(eager=True)


def first_rows(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key by an explicit order; dropDuplicates would not say which row stays."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def chunks(df: DataFrame, key: str, order: Column, size: int) -> DataFrame:
    """The distinct values of key, in order of first appearance, with chunk and pos: size to a chunk.

    Numbers come from a count of each of the session's ranges of order, which stand in a written table, so no task sees all keys at once.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_at"))
    ranged = settled(first.repartitionByRange(F.col("_at"), F.col(key)).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy("_at", key)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    numbered = ranged.join(F.broadcast(before), "_part").withColumn("_i", F.col("_before") + F.row_number().over(own) - 1)
    return numbered.select(key, F.floor(F.col("_i") / size).cast("int").alias("chunk"), (F.col("_i") % size).cast("int").alias("pos"))
