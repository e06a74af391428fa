"""Connected components by alternating large and small stars, in DataFrame operations.

Each step replaces edges by edges towards the smallest known neighbour; the number of edges never grows,
and every component ends as a star around its smallest vertex. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, small


def _large_star(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """The neighbour tables are stages of their own: a vertex with very many neighbours then meets a plain join, which can be split."""
    both = edges.union(edges.select("v", "u"))
    least = stages.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
    return both.join(small(least, 16), "u").where("v > u").select("v", "m").distinct().toDF("u", "v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select("v", "m")
    return moved.union(least.select("u", "m")).distinct().toDF("u", "v")


def components(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """(id, root) for every vertex of edges (u, v) but the roots themselves; root: the smallest id of the component."""
    now = stages.keep(edges.where("u <> v").select("u", "v").distinct(), f"{name}0")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen, step = None, 0
    while (found := mark(now)) != seen:
        seen, step = found, step + 1
        now = stages.keep(_small_star(_large_star(now, stages, f"{name}{step}-least")), f"{name}{step}")
        stages.drop(f"{name}{step - 1}", f"{name}{step}-least")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
