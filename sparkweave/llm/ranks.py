"""Exact ranks within groups, without putting a whole group into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers, on average; the number of buckets follows from it and the row count.
ROWS_A_BUCKET = 200_000


def ranked(df: DataFrame, group: str, order: Column, ties: list[str], rows: int, name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row within ``group`` (nulls are a group), by the long ``order``, then ``ties``.

    Buckets are ranges of ``order``, so the rank is the same for any number of buckets:
    rows are numbered within a bucket and the counts of the buckets before it are added.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / ROWS_A_BUCKET)))
    bucket = F.shiftright(F.col("_order"), 64 - bits) if bits else F.lit(0).cast("long")
    keyed = df.withColumn("_order", order).withColumn("_bucket", bucket)
    counts = keyed.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_group", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_bucket").orderBy("_order", *ties)
    numbered = keyed.withColumn("_row", F.row_number().over(within) - 1)
    on = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_of"))
    return numbered.join(offsets, on).withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).drop("_order", "_bucket", "_row", "_before", "_group", "_of")
