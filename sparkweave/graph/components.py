"""Connected components by alternating large-star and small-star rounds.

Each round is one window over the adjacency and one ``distinct``; no vertex ever
receives its whole component, so hubs and long chains need O(log n) rounds and no
driver memory. Lineage is cut each round by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.session import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
    return both.withColumn("m", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = F.min("v").over(Window.partitionBy("u"))
    tied = down.withColumn("m", low)
    moved = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(tied.select("u", F.col("m").alias("v")))


def component_stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(u, v)``: each non-minimal vertex with its component's least vertex.

    Self-edges and nulls are ignored and repeated edges count once; an empty input gives an empty result.
    """
    now = written(
        edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "cc",
    )
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now
        seen = mark
        after = written(_small_star(_large_star(now)).distinct(), "cc")
        drop_written(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices(id)`` and ``edges(u, v)`` -> ``(id, component)``, the component being its least vertex id."""
    stars = component_stars(edges)
    return vertices.select("id").join(stars.withColumnsRenamed({"u": "id", "v": "component"}), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
