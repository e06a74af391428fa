"""Helpers shared by the training-data operators: tables, words, staged results and checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"

#: A side may be broadcast up to this many bytes, as counted, never as guessed.
BROADCAST_BYTES = 8 << 20

#: Bytes of an Arrow batch to Python, about: a batch ends with the row that passes them.
ARROW_BYTES = 4 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array: maximal runs of characters that are not SPACES; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def bare(text: Column) -> Column:
    """The text without SPACES."""
    return F.translate(text, SPACES, "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session on this machine alone gets a folder of its own; a cluster is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quirefold-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches to Python end at ARROW_BYTES, so that long texts come few at a time. A value that the session has stays; else it holds from here on, so no job sees it change back."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(ARROW_BYTES))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: While a stage is written: its table replaces the shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stages:
    """Results of stages, written as Parquet to the shared folder and read again.

    A written table cuts the lineage, survives lost executors and carries exact sizes for the next
    join's choice. drop() deletes what no later stage reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"
        bound_batches(spark)
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP)
        try:
            self.spark.conf.set(CLEANUP, "true")
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))

    def _end(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows, at row_bytes each and the weight of each, stay within limit; else df as it is."""
    most = limit // row_bytes
    if df.limit(most + 1).count() > most:
        return df
    if weight is not None and (df.agg(F.sum(weight)).first()[0] or 0) + df.count() * row_bytes > limit:
        return df
    return F.broadcast(df)
