"""Running sums and maxima over an order that no single task could scan.

Rows are range-partitioned by their order, each partition is scanned alone, and what earlier partitions
hold comes from one small row for each partition (and group), so a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..tables import written

#: Bits of monotonically_increasing_id below the partition's number.
_BITS = 33


def running(df: DataFrame, order: list[str], values: dict[str, tuple[Callable, Column]], group: list[str] | None = None) -> DataFrame:
    """`df` with, for each `out: (F.sum or F.max, column)`, that aggregate of the rows earlier in `order`.

    Within a group only, where columns are given; they must not be null.  Rows that are equal in the
    order take any order among each other.  The first row has null.
    """
    group = group or []
    names = {f"_running_v{k}": (out, f) for k, (out, (f, _)) in enumerate(values.items())}
    rows = df.withColumns({v: c for v, (_, c) in zip(names, values.values(), strict=True)})
    sorted_rows = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_running_at", F.monotonically_increasing_id())
    rows = written(sorted_rows, "running").withColumn("_running_p", F.shiftright("_running_at", _BITS))
    heads = rows.groupBy("_running_p", *group).agg(*[f(v).alias(v) for v, (_, f) in names.items()])
    partitions = Window.partitionBy(*group).orderBy("_running_p") if group else Window.orderBy("_running_p")
    earlier = partitions.rowsBetween(Window.unboundedPreceding, -1)
    before = heads.select("_running_p", *group, *[f(v).over(earlier).alias(f"_head{v}") for v, (_, f) in names.items()])
    inside = Window.partitionBy("_running_p", *group).orderBy("_running_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({f"_inside{v}": f(v).over(inside) for v, (_, f) in names.items()}).join(before, ["_running_p", *group])
    merged = {out: _merged(f, F.col(f"_head{v}"), F.col(f"_inside{v}")) for v, (out, f) in names.items()}
    return placed.select(*[c for c in df.columns if c not in merged], *[c.alias(out) for out, c in merged.items()])


def _merged(f: Callable, a: Column, b: Column) -> Column:
    return F.greatest(a, b) if f is F.max else F.coalesce(a + b, a, b)


def running_max(df: DataFrame, order: list[str], out: str, value: Column, part: str, parts: int | None = None) -> DataFrame:
    """`df` with the largest `value`, a whole number, of the rows earlier in `order`, and the number of a row's range of that order.

    As `running` without groups, but a range is scanned as it is written, so rows are shuffled once.
    """
    ranges = [parts] if parts else []
    rows = df.repartitionByRange(*ranges, *order).sortWithinPartitions(*order).withColumn(out, value.cast("long"))
    schema = StructType([*rows.schema.fields]).add(part, LongType())
    placed = written(rows.mapInArrow(lambda batches: _scanned(batches, out, part), schema), "running", tidy=True)
    heads = placed.groupBy(part).agg(F.max(value.cast("long")).alias("_own"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = heads.select(part, F.max("_own").over(earlier).alias("_before"))
    return placed.join(before, part).withColumn(out, F.greatest("_before", out)).select(*df.columns, out, part)


def _scanned(batches: Iterator[pa.RecordBatch], out: str, part: str) -> Iterator[pa.RecordBatch]:
    """The last column is replaced by the maximum of what came before, and the range's number follows."""
    none, number = np.iinfo(np.int64).min, TaskContext.get().partitionId()
    most = none
    for b in batches:
        values = b.column(out).fill_null(none).to_numpy(zero_copy_only=False)
        seen = np.maximum.accumulate(np.concatenate([[most], values]))
        most = seen[-1]
        columns = [*b.columns[:-1], pa.array(seen[:-1], mask=seen[:-1] == none), pa.array(np.full(b.num_rows, number, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, part])


def numbered(df: DataFrame, order: list[str], group: list[str], out: str) -> DataFrame:
    """`df` with the number of each row within its group, from 1."""
    placed = running(df, order, {out: (F.sum, F.lit(1))}, group)
    return placed.withColumn(out, F.coalesce(out, F.lit(0)) + 1)
