"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N-1 in the order of a 64-bit hash of their key columns (ties: the key columns
themselves), which does not depend on files, partitions or the number of buckets. A generalised Feistel
network over Z_a x Z_b with a * b >= N permutes the numbers; results of N or more are permuted again
(cycle walking) until they fall below N. Row number i goes to shard p(i) mod S, slot p(i) div S, so
that shards differ by one row at most, slots have no gaps, and locate() finds a row's place, and
row_number() the row at a place, by arithmetic alone.
"""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, read

SHARDS = 40
SEED = 20260101
ROUNDS = 4

#: Numbering buckets, a power of two: the top bits of the hash. It bounds the table of offsets.
BUCKET_BITS = 12

#: Copies of one row that are dealt out together.
CHUNK = 10_000

#: Enough walks: below 64 * 64 rows the walk visits each number outside at most once; beyond, a walk goes
#: on with a chance under 1 / sqrt(N) a step. A walk that is longer still is an error, never a wrong place.
MAX_WALKS = 64


def _domain(n: int) -> tuple[int, int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    return a, b, min(a * b - n, MAX_WALKS)


def permuted(x: str, n: int, seed: int = SEED) -> Column:
    """p(x) as a column, for a SQL expression x of row numbers below n."""
    a, b, walks = _domain(n)
    keys = f"sequence(0L, {ROUNDS - 1}L)"

    def once(v: str) -> str:
        left = f"pmod(s.l + pmod(xxhash64(s.r, k * 2 + {seed}L), {a}L), {a}L)"
        return f"""aggregate({keys}, named_struct('l', {v} % {a}L, 'r', {v} div {a}L), (s, k) -> named_struct(
            'l', {left}, 'r', pmod(s.r + pmod(xxhash64({left}, k * 2 + 1 + {seed}L), {b}L), {b}L)), s -> s.r * {a}L + s.l)"""

    first = once(f"cast({x} as bigint)")
    if not walks:
        return F.expr(first)
    walked = f"aggregate(sequence(1, {walks}), {first}, (y, _) -> if(y < {n}L, y, {once('y')}), y -> if(y < {n}L, y, raise_error('a cycle walk did not end')))"
    return F.expr(walked)


def _hash(value: int, key: int) -> int:
    """Spark's xxhash64(value, key) of two longs."""
    h = xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def _forward(x: int, a: int, b: int, seed: int) -> int:
    r, left = divmod(x, a)
    for k in range(ROUNDS):
        left = (left + _hash(r, 2 * k + seed) % a) % a
        r = (r + _hash(left, 2 * k + 1 + seed) % b) % b
    return r * a + left


def _backward(y: int, a: int, b: int, seed: int) -> int:
    r, left = divmod(y, a)
    for k in reversed(range(ROUNDS)):
        r = (r - _hash(left, 2 * k + 1 + seed) % b) % b
        left = (left - _hash(r, 2 * k + seed) % a) % a
    return r * a + left


def locate(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of row number row among n rows."""
    a, b, _ = _domain(n)
    y = _forward(row, a, b, seed)
    while y >= n:
        y = _forward(y, a, b, seed)
    return y % shards, y // shards


def row_number(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a place; the inverse of locate()."""
    a, b, _ = _domain(n)
    x = _backward(slot * shards + shard, a, b, seed)
    while x >= n:
        x = _backward(x, a, b, seed)
    return x


def feistel_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED, stages: Stages | None = None) -> DataFrame:
    """Every row of df, with row_number long, shard int and slot long.

    All columns are key columns and must be groupable: project to what identifies a row first. Nulls
    are values like others. Rows equal in all columns are interchangeable; they are counted before the
    shuffle and dealt out afterwards, so that a row with many copies loads no single task. An empty
    table gives no rows. Columns of df called row_number, shard or slot, or that begin with "_q_", are an error: rename them before.
    """
    if clash := [c for c in df.columns if c.lower() in ("row_number", "shard", "slot") or c.lower().startswith("_q_")]:
        raise ValueError(f"columns with reserved names: {', '.join(clash)}")
    stages = stages or Stages(df.sparkSession)
    keys = df.columns
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_q_n")).withColumn("_q_h", F.xxhash64(*keys))
    counted = counted.withColumn("_q_bucket", F.shiftright("_q_h", 64 - BUCKET_BITS))
    order = Window.partitionBy("_q_bucket").orderBy("_q_h", *keys).rowsBetween(Window.unboundedPreceding, 0)
    ranked = stages.keep(counted.withColumn("_q_upto", F.sum("_q_n").over(order)), "ranked")
    sizes = ranked.groupBy("_q_bucket").agg(F.sum("_q_n").alias("_q_size"))  # 2 ** BUCKET_BITS rows at most
    before = Window.orderBy("_q_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_q_bucket", F.coalesce(F.sum("_q_size").over(before), F.lit(0)).alias("_q_before"))
    n = ranked.agg(F.coalesce(F.sum("_q_n"), F.lit(0))).first()[0]
    at = ranked.join(F.broadcast(offsets), "_q_bucket").withColumn("_q_first", F.col("_q_before") + F.col("_q_upto") - F.col("_q_n"))
    few = at.where(F.col("_q_n") <= CHUNK).select(*keys, F.explode(F.sequence("_q_first", F.col("_q_first") + F.col("_q_n") - 1)).alias("row_number"))
    if ranked.where(F.col("_q_n") > CHUNK).isEmpty():
        rows = few
    else:
        last = F.col("_q_first") + F.col("_q_n") - 1
        chunks = at.where(F.col("_q_n") > CHUNK).select(*keys, last.alias("_q_last"), F.explode(F.sequence("_q_first", last, F.lit(CHUNK))).alias("_q_from"))
        many = chunks.repartition("_q_from").select(*keys, F.explode(F.sequence("_q_from", F.least("_q_last", F.col("_q_from") + CHUNK - 1))).alias("row_number"))
        rows = few.unionByName(many)
    placed = rows.withColumn("_q_p", permuted("row_number", n, seed) if n else F.lit(None).cast("long"))
    return placed.select(*keys, "row_number", (F.col("_q_p") % shards).cast("int").alias("shard"), F.expr(f"_q_p div {shards}L").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return feistel_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
