"""Reachability, connected components and strongly connected components of DataFrames.

Each has a distributed loop, whose state is a table in the shared folder from round to round, and below a counted size
a numpy one with the same result. ``most_edges=0`` forces the distributed loop.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.graph import local
from sparkweave.graph.components import component_stars
from sparkweave.session import drop_written, inputs_are_small, written


def _fetched(most: int, *tables: DataFrame):
    """The tables' columns as arrays if none has more than ``most`` rows, else None. Rows are counted first, so that nothing of a larger table is sent to the driver;
    while inputs are small, one job a table tells and fetches."""
    out, most = [], local.bounded(most)
    if most <= 0 or not inputs_are_small() and any(t.limit(most + 1).count() > most for t in tables):
        return None
    for t in tables:
        columns = local.arrays(t.limit(most + 1))
        if len(columns[0]) > most:
            return None
        out.append(columns)
    return out


def reach(seeds: DataFrame, edges: DataFrame, most_edges: int = local.MOST_EDGES) -> DataFrame:
    """``seeds(id)``, ``edges(u, v)`` -> ``(id)``: what the seeds reach along edges, the seeds among it. Nulls and repeats don't matter."""
    seeds = seeds.select(F.col("id").cast("long")).where("id is not null").distinct()
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v").distinct()
    if found := _fetched(most_edges, edges, seeds):
        (u, v), (s,) = found
        return local.frame(seeds.sparkSession, id=local.reach(s, u, v))
    edges = written(edges, "edges")
    fronts = [written(seeds, "front")]
    jumps = _Jumps(edges)
    for n in itertools.count(1):
        seen = fronts[0]
        for f in fronts[1:]:
            seen = seen.union(f)
        steps = edges if n <= PLAIN_ROUNDS else edges.union(jumps.doubled())
        front = fronts[-1] if n != PLAIN_ROUNDS + 1 else seen
        new = front.join(steps, front["id"] == steps["u"]).select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti")
        fronts.append(written(new, "front"))
        if fronts[-1].isEmpty():
            jumps.drop()
            drop_written(edges)
            return seen


#: Rounds of a loop that go edge by edge; after them chains are shortened.
PLAIN_ROUNDS = 6
#: Rounds of trimming that take single vertices; after them whole chains go.
TRIM_ROUNDS = 12


class _Jumps:
    """Shortcuts along chains: vertices with one edge out, and the vertices 1, 2, 4, ... such edges further.

    With them a loop that would take a round for each vertex of a chain takes as many as the chain's length has binary digits.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.edges, self.levels = edges, []

    def doubled(self) -> DataFrame:
        """All shortcuts so far and the next longer ones."""
        if not self.levels:
            one = self.edges.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("_n")).where("_n = 1").select("u", "v")
            self.levels.append(written(one, "jumps"))
        last = self.levels[-1]
        self.levels.append(written(last.join(last.toDF("v", "w"), "v").select("u", F.col("w").alias("v")).where("u <> v"), "jumps"))
        out = self.levels[0]
        for x in self.levels[1:]:
            out = out.union(x)
        return out

    def ends(self) -> DataFrame:
        """``(u, v)``: where the chain that starts at each vertex with one edge out comes to, one vertex of it where it goes in a circle."""
        one = self.edges.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("_n")).where("_n = 1").select("u", "v")
        now = written(one, "ends")
        for _ in range(max(1, now.count()).bit_length()):
            far = written(now.join(now.toDF("v", "w"), "v", "left").select("u", F.coalesce("w", "v").alias("v")), "ends")
            drop_written(now)
            now = far
        return now

    def drop(self) -> None:
        for x in self.levels:
            drop_written(x)


def components(vertices: DataFrame, edges: DataFrame, most_edges: int = local.MOST_EDGES) -> DataFrame:
    """``vertices(id)``, ``edges(u, v)`` -> ``(id, component)``, the component being its least vertex; an edge between unknown vertices counts."""
    if found := _fetched(most_edges, edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")):
        ids, labels = local.components(*found[0])
        stars = local.frame(vertices.sparkSession, u=ids, v=labels)
    else:
        stars = component_stars(edges)
    return vertices.select("id").join(stars.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def strong_components(edges: DataFrame, most_edges: int = local.MOST_EDGES) -> DataFrame:
    """``edges(u, v)`` -> ``(id, component)`` of the vertices in strongly connected components of two or more; self-edges don't count.

    Distributed: vertices without an edge in or out are trimmed until none is left; then the least vertex is spread
    forwards, and from each vertex that kept its own label backwards among those of its label. What meets both is a component; it is taken out, and so on.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct()
    if found := _fetched(most_edges, edges):
        ids, labels = local.strong(*found[0])
        return local.frame(edges.sparkSession, id=ids, component=labels)
    rest = written(edges, "rest")
    done: DataFrame | None = None
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            break
        colour = written(rest.select(F.col("u").alias("id")).distinct().withColumn("c", F.col("id")), "colour")
        jumps = _Jumps(rest)
        for k in itertools.count(1):  # spread the least label forwards
            steps = rest if k <= PLAIN_ROUNDS else rest.union(jumps.doubled())
            came = colour.join(steps, colour["id"] == steps["u"]).select(F.col("v").alias("id"), "c")
            new = written(colour.union(came).groupBy("id").agg(F.min("c").alias("c")), "colour")
            still = new.join(colour.withColumnRenamed("c", "old"), "id").where("c <> old").isEmpty()
            drop_written(colour)
            colour = new
            if still:
                break
        jumps.drop()
        cu, cv = colour.toDF("u", "cu"), colour.toDF("v", "cv")
        back = written(rest.join(cu, "u").join(cv, "v").where("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v")), "back")
        roots = colour.where("id = c").select("id")
        found = reach(roots, back, 0).join(colour, "id").select("id", F.col("c").alias("component"))
        found = written(found, "scc")
        left = written(rest.join(found.select(F.col("id").alias("u")), "u", "left_anti").join(found.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v"), "rest")
        for t in (rest, back, colour):
            drop_written(t)
        rest = left
        done = found if done is None else done.union(found)
    if done is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).limit(0)
    sizes = done.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return done.join(sizes.select("component"), "component", "left_semi").select("id", "component")


def _trimmed(rest: DataFrame) -> DataFrame:
    """The edges without vertices that have no edge in or none out, again and again; long chains to or from such a vertex go at once."""
    for k in itertools.count(1):
        n = rest.count()
        if k > TRIM_ROUNDS:
            for u, v in (("u", "v"), ("v", "u")):
                way = rest.select(F.col(u).alias("u"), F.col(v).alias("v"))
                ends = _Jumps(way).ends()
                stop = ends.join(way.select(F.col("u").alias("v")).distinct(), "v", "left_anti").select("u")  # chains into a vertex without a way on
                less = written(way.join(stop, "u", "left_anti").select(F.col("u").alias(u), F.col("v").alias(v)).select("u", "v"), "rest")
                drop_written(ends)
                drop_written(rest)
                rest = less
        inner = rest.join(rest.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(rest.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v")
        inner = written(inner, "rest")
        drop_written(rest)
        rest = inner
        if rest.count() == n:
            return rest
