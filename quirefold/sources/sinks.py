"""Sinks: run report, catalogue, undo table, cache snapshot; and the scans that read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.proposal import preimage

#: The columns that the narrow scan of a list view reads.
NARROW = ("item_key", "itemType", "conferenceName", "proceedingsTitle", "journalAbbreviation", "publicationTitle", "publisher", "title", "date")


def scan_items(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Items from Parquet; columns prune the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def item_key(library: str = "library_id", key: str = "key"):
    return F.concat_ws(":", library, key)


def write_report(resolutions: DataFrame, path: str, version: str, timestamp: str) -> None:
    """One JSON line for each item, with the run's version and time."""
    resolutions.withColumns({"version_of_tool": F.lit(version), "timestamp": F.lit(timestamp)}).write.mode("overwrite").json(path)


def report_summary(resolutions: DataFrame) -> DataFrame:
    """One row: items, accepted ones, with a tier, mean confidence of accepted ones."""
    accepted = F.col("acceptance") == "accepted"
    return resolutions.agg(F.count(F.lit(1)).alias("items"), F.count_if(accepted).alias("accepted"), F.count_if(F.col("ccf_tier").isNotNull()).alias("tiered"), F.avg(F.when(accepted, F.col("confidence"))).alias("mean_confidence"))


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    catalogue.write.mode("overwrite").parquet(path)


def write_undo(items: DataFrame, proposals: DataFrame, path: str, time_ms: int) -> None:
    """The rows that proposals would change, kept under the time of the change; written before applying."""
    preimage(items, proposals).withColumn("undo_time", F.lit(time_ms)).write.mode("append").partitionBy("undo_time").parquet(path)


def latest_undo(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last change."""
    table = spark.read.parquet(path)
    last = table.agg(F.max("undo_time")).first()[0]
    return table.where(F.col("undo_time") == last).drop("undo_time")


def write_snapshot(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)
