"""What the two near-duplicate operators share: from candidate buckets to groups, without all pairs of a bucket.

Candidates are rows ``(key, id)``; ids that share a key are to be compared. Groups are the connected
components of the pairs that a check confirms. To find them it is enough to compare every id with the least id of its
bucket, join up what is confirmed, and then compare only the pairs of a bucket that are still in different groups. A bucket
of thousands of copies thus costs one comparison a member, and yet no pair is left out that could join two groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.graph.components import component_stars
from sparkweave.session import drop_written, written


def bucket_groups(rows: DataFrame, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows(key, id)`` -> ``(id, group)`` for ids in a group of two or more, ``group`` being its least id.

    ``confirm`` gets distinct pairs ``(a, b)``, a < b, and returns those that are near duplicates.
    """
    w = Window.partitionBy("key")
    shared = rows.withColumn("lead", F.min("id").over(w)).withColumn("last", F.max("id").over(w)).where("lead <> last").select("key", "id", "lead")
    shared = written(shared, "buckets")
    first = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    sure = written(confirm(first), "pairs")
    stars = component_stars(sure.toDF("u", "v"))

    # Second and last look: members of the groups other than a bucket's largest, against all of other groups.
    group = F.coalesce("v", "id")
    at = shared.join(stars, shared["id"] == stars["u"], "left").select("key", "id", "lead", group.alias("g"))
    sizes = at.groupBy("key", "g").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "g"))["g"].alias("main")).where("groups > 1").select("key", "main")
    at = written(at.join(several, "key"), "open")
    small = at.where("g <> main").select("key", F.col("id").alias("x"), F.col("g").alias("gx"))
    meet = small.join(at, "key").where("g <> gx and (g = main or x < id)")
    rest = meet.where("least(x, id) <> lead").select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
    more = written(confirm(rest), "pairs")
    if more.isEmpty():
        out = stars
    else:
        out = component_stars(stars.union(more.toDF("u", "v")))
    for t in (shared, at, sure, more):
        drop_written(t)
    least = out.select(F.col("u").alias("id"), F.col("v").alias("group"))
    return least.union(out.select("v", "v").distinct())
