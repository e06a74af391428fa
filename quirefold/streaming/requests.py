"""Request policies over a log of requests: lifetimes, caches, pacing, breakers and budgets.

All are keyed folds or windows over the log (key, host, url, status, body, ts_ms, retry_after); nothing here
goes to the network. watch_log() applies the latest-response rule to a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import blank, host_family

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000

CACHE_ENTRIES, PUT_CHARS, SNAPSHOT_ENTRY_BYTES, SNAPSHOT_BYTES = 500, 300_000, 600_000, 8 << 20

#: Milliseconds between requests to a host group.
PACING = (("arxiv", 3100), ("dblp", 1100), ("api.semanticscholar.org", 1100), ("duckduckgo", 1500))
PACING_DEFAULT = 300

BREAK_AFTER, BREAK_MS, LIMITED_MS = 2, 45_000, 60_000


def lifetime_ms(status: Column, body: Column, url: Column) -> Column:
    """How long a response stays valid: misses and empty answers briefly, records for a week, preprints a day, else six hours."""
    b = F.regexp_replace(blank(body), r"\s", "")
    empty = b.isin("", "null", "[]") | b.rlike(r"^\[null(,null)*\]$") | b.rlike(r'"total":0[,}]|"notes":\[\]|"total-results":0[,}]|"@total":"?0"?[,}]')
    return (
        F.when(status == 404, 15 * MINUTE).when(empty, 15 * MINUTE).when(url.rlike(r"/works/10\.|/article/view/|/v\d+/[^/?]+\.html"), 7 * DAY)
        .when(url.rlike(r"arxiv\.org/(?:api/query|abs/)"), DAY).otherwise(6 * HOUR).cast("long")
    )


def cache_latest(log: DataFrame, now_ms: int, entries: int = CACHE_ENTRIES, put_chars: int = PUT_CHARS) -> DataFrame:
    """The cache after a log: the latest response of each key that was small enough and has not expired, the most recent entries."""
    stored = log.where((F.length(blank(F.col("body"))) <= put_chars) & F.col("status").isin(200, 404))
    latest = stored.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts_ms"), F.desc("url")))).where("_n = 1").drop("_n")
    valid = latest.withColumn("expires_ms", F.col("ts_ms") + lifetime_ms(F.col("status"), F.col("body"), F.col("url"))).where(F.col("expires_ms") > now_ms)
    return valid.orderBy(F.desc("ts_ms"), "key").limit(entries)


def snapshot(cache: DataFrame, now_ms: int, entry_bytes: int = SNAPSHOT_ENTRY_BYTES, total_bytes: int = SNAPSHOT_BYTES, entries: int = CACHE_ENTRIES) -> DataFrame:
    """The entries (key, ts_ms, expires_ms, bytes) that a snapshot keeps: newest first, skipping what would not fit, until enough.

    The cache is bounded, so its entries are folded as one array.
    """
    item = F.struct((-F.col("ts_ms")).alias("neg"), "key", "expires_ms", F.col("bytes").cast("long").alias("bytes"))
    folded = F.aggregate(
        "es", F.expr("named_struct('n', 0, 'sum', 0L, 'keys', cast(array() as array<string>))"),
        lambda a, e: F.when((e["expires_ms"] > now_ms) & (e["bytes"] <= entry_bytes) & (a["sum"] + e["bytes"] <= total_bytes) & (a["n"] < entries),
                            F.struct((a["n"] + 1).alias("n"), (a["sum"] + e["bytes"]).alias("sum"), F.concat(a["keys"], F.array(e["key"])).alias("keys"))).otherwise(a))
    keys = cache.agg(F.array_sort(F.collect_list(item)).alias("es")).select(F.explode(folded["keys"]).alias("key"))
    return cache.join(keys, "key", "left_semi")


def single_flight(log: DataFrame) -> DataFrame:
    """The first request of each key; the others share its answer."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("ts_ms", "url"))).where("_n = 1").drop("_n")


def paced(log: DataFrame) -> DataFrame:
    """log with start_ms: when a request may start if each host group runs one at a time at its interval.

    start = max(ts, previous start + interval) unrolls to a running maximum of ts - n * interval.
    """
    family = host_family(F.col("host"))
    gap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PACING for x in p]), F.col("family")), F.lit(PACING_DEFAULT))
    order = Window.partitionBy("family").orderBy("ts_ms", "key")
    numbered = log.withColumn("family", family).withColumn("_gap", gap.cast("long")).withColumn("_n", F.row_number().over(order))
    lead = F.max(F.col("ts_ms") - F.col("_n") * F.col("_gap")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start_ms", lead + F.col("_n") * F.col("_gap")).drop("_gap", "_n")


def breaker(log: DataFrame) -> DataFrame:
    """log (host, ts_ms, status, retry_after_ms, key) with allowed: false where the host's circuit was open.

    Limited (429, 403) answers open it for their wait; the second failure in a row for 45 seconds. A refused
    request has no answer and changes nothing. The state depends on earlier decisions, so each host is folded in order.
    """
    schema = "host string, ts_ms long, status int, retry_after_ms long, key string, allowed boolean"

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, until, failures = object(), 0, 0
        for part in parts:  # sorted by host and time; the state goes from batch to batch, so a host's log is never held whole
            allowed = []
            for own, ts, status, wait in zip(part["host"], part["ts_ms"], part["status"], part["retry_after_ms"]):
                if own != host:
                    host, until, failures = own, 0, 0
                allowed.append(bool(ts >= until))
                if not allowed[-1]:
                    continue
                if status in (429, 403):
                    until = ts + (LIMITED_MS if status == 403 or pd.isna(wait) else int(wait))
                elif status == 0 or status >= 500:
                    failures += 1
                    until = ts + BREAK_MS if failures >= BREAK_AFTER else until
                elif 200 <= status < 300:
                    failures = 0
            yield part.assign(allowed=allowed)

    ordered = log.select("host", "ts_ms", "status", "retry_after_ms", "key").repartition("host").sortWithinPartitions("host", "ts_ms", "key")
    return ordered.mapInPandas(fold, schema)


def within_budgets(requests: DataFrame, item_limit: int = 28, source_limit: int = 6) -> DataFrame:
    """The requests (item_key, source, ord) that their source's and then their item's budget allow, in order."""
    ranked = requests.withColumn("_s", F.row_number().over(Window.partitionBy("item_key", "source").orderBy("ord"))).where(F.col("_s") <= source_limit)
    return ranked.withColumn("_i", F.row_number().over(Window.partitionBy("item_key").orderBy("ord"))).where(F.col("_i") <= item_limit).drop("_s", "_i")


def counters(log: DataFrame) -> DataFrame:
    """One row of run counters over a log with allowed."""
    return log.agg(
        F.count_if("allowed").alias("requests"), (F.count(F.lit(1)) - F.count_distinct("key")).alias("deduplicated"), F.count_if(F.col("allowed") & (F.col("status") == 429)).alias("rate_limited"),
        F.count_if(~F.col("allowed")).alias("circuit_skips"), F.count_if(F.col("allowed") & (F.col("status") == 0)).alias("timeouts"))


def watch_log(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of the log (with ts timestamp) as the latest response of each key, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])
