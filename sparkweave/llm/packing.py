"""Packing by best-fit decreasing, exact over the whole table at any size.

Best-fit decreasing looks at lengths only. The lengths are integers up to the window
capacity, so a table of any size has at most ``capacity`` distinct ones: one task gets
their counts, runs best-fit decreasing on runs of equal pieces and equal windows, and
returns intervals "pieces of length L with ranks [lo, hi) go, m at a time, to windows from b on".
The pieces then find their windows by a join on (length, rank). A mixed stream is packed in sections, one
after the other, so that its order remains.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.ranks import ranked
from sparkweave.session import written

#: Words a window holds; documents of a section of a stream.
CAPACITY, SECTION = 2048, 65_536
#: More intervals than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 500_000


class CapacityTree:
    """Segment tree over the remaining capacities 0..capacity, with the number of open windows of each."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open window has."""
        k = least + self.size
        if self.count[k]:
            return least
        while k > 1:
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """``{length: pieces}`` -> intervals ``(length, rank_lo, rank_hi, pieces a window, first window)``, windows opened.

    A piece goes to the open window with the least sufficient remaining capacity, of several the one that came to
    that capacity first; without one it opens a window. A window so chosen stays the tightest until another such
    piece doesn't fit, so it takes pieces ``remaining // length`` at a time, and windows of equal capacity are one run.
    """
    tree, runs = CapacityTree(capacity), {}
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(capacity_left: int, lo: int, hi: int) -> None:
        if hi > lo:
            run = runs.setdefault(capacity_left, deque())
            if run and run[-1][1] == lo:
                run[-1] = (run[-1][0], hi)
            else:
                run.append((lo, hi))
            tree.add(capacity_left, hi - lo)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} can't be packed in windows of {capacity}")
        done, n = 0, counts[length]
        while done < n:
            left = tree.tightest(length)
            if left is None:
                left, m = capacity, capacity // length
                lo, hi = opened, opened + -(-(n - done) // m)
                opened = hi
            else:
                m = left // length
                lo, end = runs[left].popleft()
                hi = min(end, lo + -(-(n - done) // m))
                tree.add(left, lo - hi)
                if hi < end:
                    runs[left].appendleft((hi, end))
            take = min(n - done, (hi - lo) * m)
            out.append((length, done, done + take, m, lo))
            full, rest = divmod(take, m)
            put(left - m * length, lo, lo + full)
            if rest:
                put(left - rest * length, lo + full, hi)
            done += take
    return out, opened


def word_count(text: str):
    """Words of a text: maximal runs without white space; 0 for null and blank texts."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0))


def _intervals(counts):
    """Best-fit decreasing on the counts of lengths of one section, for ``applyInPandas``."""

    def run(section):
        import pandas as pd

        rows, opened = best_fit_decreasing(dict(zip(section["length"].tolist(), section["n"].tolist())), int(section["capacity"].iloc[0]))
        out = pd.DataFrame(rows, columns=["of", "lo", "hi", "m", "first"])
        out.insert(0, "part", section["section"].iloc[0])
        return out.assign(opened=opened)

    return counts.groupBy("section").applyInPandas(run, "part long, of int, lo long, hi long, m long, first long, opened long")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, order: str | None = None, section: int = SECTION) -> DataFrame:
    """One row per window: ``(window_id, used, n_pieces, doc_ids, starts, lengths)``.

    Lengths count words. A document longer than ``capacity`` is first cut into full windows and a rest. Pieces of one
    length are ranked by a hash of the id, then id and start, so rows that repeat an id are pieces of their own and
    ties do not change which windows arise. Null and blank texts have no words and are in no window; a null id is kept
    as null in the list. An empty table gives an empty result; further columns are ignored, whatever their names.
    The pieces of a window are listed longest first.

    ``order``: a column of places in a stream (longs from 0 on, null: 0). The stream is then packed in sections of so many places, each for itself, windows are
    numbered section after section, and pieces of one length are ranked by place: a stretch of windows has the documents of a
    stretch of the stream. Without it the whole table is one section.
    """
    # Counting reads the texts, so it is done once; all that follows works on a few numbers a document.
    place = F.coalesce(F.col(order).cast("long"), F.lit(0)) if order else F.lit(0).cast("long")
    lengths = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(text).alias("_n"), place.alias("place")).where("_n > 0"), "lengths")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / capacity).cast("int")), lambda i: i * capacity)
    pieces = lengths.withColumn("start", F.explode(cuts)).select(
        "doc_id", "start", F.least(F.col("_n") - F.col("start"), F.lit(capacity)).alias("length"), "place", F.floor(F.col("place") / section).alias("section"),
    )
    counts = pieces.groupBy("section", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("capacity", F.lit(capacity))
    table = written(_intervals(counts), "intervals")
    opened = table.groupBy("part").agg(F.max("opened").alias("opened"))
    before = F.coalesce(F.sum("opened").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over one row a section
    bases = opened.select(F.col("part").alias("_part"), before.alias("base"))
    small = table.count() <= BROADCAST_ROWS
    table = table.join(F.broadcast(bases) if small else bases, F.col("part") == F.col("_part")).select("part", "of", "lo", "hi", "m", (F.col("first") + F.col("base")).alias("first"))
    if small:
        table = F.broadcast(table)
    classed = pieces.withColumn("class", F.col("section") * (capacity + 1) + F.col("length"))
    if order:  # a class has the pieces of one section only, so it needs no buckets
        numbered = ranked(classed, "class", F.col("place"), ["doc_id", "start"], 1)
    else:
        numbered = ranked(classed, "class", F.xxhash64("doc_id", "start"), ["doc_id", "start"], lengths.count())
    on = (F.col("section") == F.col("part")) & (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    placed = numbered.join(table, on)
    item = F.struct((-F.col("length")).alias("k"), "rank", "doc_id", "start", "length")
    window = placed.select((F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("m"))).cast("long").alias("window_id"), item.alias("_p"))
    packed = window.groupBy("window_id").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return packed.select(
        "window_id", F.aggregate("_p", F.lit(0), lambda a, p: a + p["length"]).cast("long").alias("used"), F.size("_p").cast("long").alias("n_pieces"),
        F.col("_p.doc_id").alias("doc_ids"), F.col("_p.start").alias("starts"), F.col("_p.length").alias("lengths"),
    )
