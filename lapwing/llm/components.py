"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import cut


#: Edges that a task of a round has, and the tasks that a round has at least.
EDGES, LEAST_TASKS = 1 << 16, 16


def _pointed(directed: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest node among u and its neighbours; the minimum is pre-aggregated."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return directed.join(least, directed["u"] == least["k"]).select("u", "v", "m")


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _pointed(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.coalesce(tasks).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    p = _pointed(down)
    return p.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").coalesce(tasks).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another.

    Ids are 64-bit integers. Loops, repeated edges and nulls are ignored; no edges give no rows.
    Each round is two grouped minima with joins (large components are split by the adaptive
    skew join), checkpointed in the shared folder, and leaves every component a star at the end. A round has as
    many tasks as its edges ask for: each task of a shuffle writes files of its own, however few its edges are.
    """
    e = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _mark(e)
    while before[0]:
        tasks = max(LEAST_TASKS, before[0] // EDGES)
        e = cut(_small_star(_large_star(e.coalesce(tasks), tasks), tasks).coalesce(tasks))
        after = _mark(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
