"""Mixing sources to target weights by Pfair scheduling of blocks.

The documents of a source, in a pseudo-random order, form blocks. One block is emitted per
slot. With weight ``w`` block ``j`` of a source is released at slot ``floor(j / w)`` and due at slot
``ceil((j + 1) / w)``; of the released blocks the one due first is emitted. With weights that add up
to 1 this keeps every source, at every slot, within less than one block of ``w * slot``.

Weights are rationals ``k / period``, so the schedule repeats after ``period`` slots. The driver
schedules one period; block ``q * k + m`` then stands at slot ``q * period + slot_of[m]`` for any q, so
the schedule's size depends on the sources and the period, not on the data.
When a source runs out, a new phase begins in which the others share its weight in proportion.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.ranks import ranked
from sparkweave.session import written

#: Documents of a block; slots of a period; exponent of the default weights (1: as the sources are, 0: all equal).
BLOCK, PERIOD, ALPHA = 32, 1000, 0.7
#: A larger schedule is joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 500_000


def shares(weights: list[float], period: int) -> list[int]:
    """Integers of at least 1 that add up to the period, in proportion to the weights as nearly as that allows."""
    if len(weights) > period:
        raise ValueError("a period has at least one slot for each source")
    total, free = math.fsum(weights), period - len(weights)
    exact = [w / total * period - 1 for w in weights]
    base = [max(0.0, x) for x in exact]
    scale = free / math.fsum(base) if math.fsum(base) else 0
    base = [x * scale for x in base]
    out = [math.floor(x) for x in base]
    for k in sorted(range(len(base)), key=lambda i: (out[i] - base[i], i))[: free - sum(out)]:
        out[k] += 1
    return [x + 1 for x in out]


def pfair(parts: list[int]) -> list[list[int]]:
    """Slots of each task's blocks over one period, ``parts[i]`` blocks of task i, by earliest deadline among the released.

    Ties go to the lower index. Every block stands in ``[release, deadline)``; raises if one could not (it always can).
    """
    period = sum(parts)
    release = lambda i, j: j * period // parts[i]
    due = lambda i, j: -(-(j + 1) * period // parts[i])
    waiting = [(0, i, 0) for i in range(len(parts))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in parts]
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(i, j), i, j))
        deadline, i, j = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        slots[i].append(t)
        if j + 1 < parts[i]:
            heapq.heappush(waiting, (release(i, j + 1), i, j + 1))
    return slots


def schedule(blocks: list[int], weights: list[float], period: int = PERIOD) -> list[tuple[int, int, int, int, int, int, int, list[int]]]:
    """Phases ``(phase, source, first block, last block + 1, first slot, k, period, slots of a period)`` until all blocks are emitted."""
    done, start, phase, out = [0] * len(blocks), 0, 0, []
    period = max(period, 20 * len(blocks))
    while any(d < b for d, b in zip(done, blocks)):
        live = [i for i, b in enumerate(blocks) if done[i] < b]
        parts = shares([weights[i] for i in live], period if len(live) > 1 else 1)
        slots, n = pfair(parts), sum(parts)
        ends = [((r := blocks[i] - done[i]) - 1) // k * n + s[(r - 1) % k] + 1 for i, k, s in zip(live, parts, slots)]
        end = min(ends)
        for i, k, s in zip(live, parts, slots):
            q, rest = divmod(end, n)
            count = q * k + sum(x < rest for x in s)
            out.append((phase, i, done[i], done[i] + count, start, k, n, s))
            done[i] += count
        start, phase = start + end, phase + 1
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict | None = None, alpha: float = ALPHA, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """``(doc_id, source, block, phase, slot, release, deadline, position)``: where each document stands in the mixed stream.

    ``weights``: target weight by source; without it ``count ** alpha``. Sources without a positive weight get none of the
    stream and are left out. Weights are rounded to multiples of 1 / period, at least one. ``release`` and ``deadline`` are
    the slots between which the block must be emitted. ``position`` orders documents inside a block. A null source is a
    source of its own; rows that repeat an id or tie are documents of their own; null or long texts do not matter here; an empty
    table gives an empty result and further columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"))
    counts = [(r["source"], r["count"]) for r in slim.groupBy("source").count().collect()]
    counts.sort(key=lambda x: (x[0] is not None, x[0] or ""))
    wanted = weights if weights is not None else {s: n**alpha for s, n in counts}
    counts = [(s, n) for s, n in counts if wanted.get(s, 0) > 0]
    rows = []
    for phase, i, first, last, start, k, n, slots in schedule([-(-c // block) for _, c in counts], [float(wanted[s]) for s, _ in counts], period):
        if last > first:
            rows.append((phase, counts[i][0], i, first, last, start, k, n, slots))
    table = spark.createDataFrame(rows, "phase int, of string, source_no int, first long, last long, start long, k long, n long, slots array<int>")
    if sum(len(r[-1]) for r in rows) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    order = ranked(slim, "source", F.xxhash64("doc_id"), ["doc_id"], sum(n for _, n in counts), "rank").withColumn("block", F.floor(F.col("rank") / block))
    joined = order.join(table, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("last")))
    j = F.col("block") - F.col("first")
    turn, at = F.floor(j / F.col("k")), j % F.col("k")
    return joined.select(
        "doc_id", "source", "block", "phase",
        (F.col("start") + turn * F.col("n") + F.get("slots", at.cast("int"))).alias("slot"),
        (F.col("start") + F.expr("(block - first) * n div k")).alias("release"),
        (F.col("start") + F.expr("((block - first + 1) * n + k - 1) div k")).alias("deadline"),
        (F.col("rank") % block).cast("int").alias("position"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source: str = "source", **params) -> DataFrame:
    """The documents in mixed order; sources without a positive weight are left out, as in :func:`mix`.

    What remains when only one source is left can't be mixed any more and stands at the end of the stream. Columns are
    those of ``docs``. Rows whose id repeats are placed together, at the first of their places; rows with a null id too. An empty table
    gives an empty one.
    """
    placed = mix(docs, id_col, source, **params).select(F.col("doc_id").alias("_id"), "slot", "position")
    kept = placed.groupBy("_id").agg(F.min(F.struct("slot", "position")).alias("_at")).select("_id", F.col("_at.slot").alias("_slot"), F.col("_at.position").alias("_position"))
    columns = [docs[c] for c in docs.columns]
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_id"])).orderBy(kept["_slot"], kept["_position"]).select(*columns)


def with_places(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the place of each row in its stream, from 0 on, in a new column.

    A table that was written in mixed order and read again is in the order of its files and their rows; any other DataFrame is
    written first. Places grow along the stream, whatever tasks read it; rows that were filtered out leave gaps.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation":  # no table of files, though it may come from one in another order
        docs = written(docs, "stream")
    meta = docs.metadataColumn("_metadata")
    at = docs.select("*", meta["file_path"].alias(name + "_f"), meta["row_index"].alias(name + "_r"))
    sizes = at.groupBy(name + "_f").agg((F.max(name + "_r") + 1).alias("_n"))
    number = F.regexp_extract(name + "_f", r"part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(number.asc_nulls_first(), F.col(name + "_f")).rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    starts = sizes.select(F.col(name + "_f").alias(name + "_g"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name + "_b"))
    starts = F.broadcast(starts) if len(docs.inputFiles()) <= BROADCAST_ROWS else starts
    placed = at.join(starts, F.col(name + "_f") == F.col(name + "_g")).withColumn(name, F.col(name + "_b") + F.col(name + "_r"))
    return placed.drop(*(name + x for x in ("_f", "_g", "_b", "_r")))


def deviation(parts: list[int]) -> Fraction:
    """Largest |blocks emitted - weight * slots| over a period, for tests."""
    period, worst = sum(parts), Fraction(0)
    for k, slots in zip(parts, pfair(parts)):
        for t in range(period + 1):
            worst = max(worst, abs(sum(s < t for s in slots) - Fraction(k * t, period)))
    return worst
