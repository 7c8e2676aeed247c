"""Ranks and running sums inside groups that may hold any share of the rows.

A group's rows are dealt over buckets by their order key; per-bucket totals get a prefix sum, and
the position inside a bucket is a window over that bucket alone.  No task sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 20_000


def order_key(*parts: Column) -> Column:
    """32 hex digits that shuffle rows in the same way in every engine."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))


def buckets_for(rows: int) -> int:
    """A power of 16, so that the first hex digits of an order key are the bucket."""
    n = 1
    while rows / 16**n > BUCKET_ROWS:
        n += 1
    return n


def running_before(df: DataFrame, group: str, key: str, digits: int, amount: Column, ties: list[str], out: str) -> DataFrame:
    """`df` with the sum of `amount` over the rows of the group that come earlier by (key, ties).

    Ties that agree in all of `ties` are interchangeable.  group must not be null.
    """
    rows = df.withColumn("_bucket", F.substring(key, 1, digits)).withColumn("_amount", amount)
    totals = rows.groupBy(group, "_bucket").agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(group, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return placed.join(starts, [group, "_bucket"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_bucket", "_amount", "_start", "_inside")
