"""Positions and offsets of rows in a long order, by ranges: no task holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import spare
from inkwell.sources.stored import stored


#: Rows that a task sorts at once: some dozen MB for each sort of it.
ROWS_A_TASK = 100_000


def tasks_for(*tables: DataFrame) -> int:
    """So many tasks that each has about ROWS_A_TASK of the rows of all tables, which are counted."""
    return max(1, -(-sum(t.count() for t in tables) // ROWS_A_TASK))


def dealt(rows: DataFrame, by: Sequence[str], tasks: int) -> DataFrame:
    """rows dealt by by to so many tasks, which are not put together again, so that a task's memory does not grow with the table."""
    return rows.repartition(tasks, *by) if by else rows


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[Column], size: Column | None = None, position: str = "position", start: str = "start", tasks: int | None = None) -> DataFrame:
    """rows with position (int, from 1) among those of one by, in the given order (nulls first), and with size given, start: the sizes before it added up.

    Rows are dealt by ranges of by and order and sorted there; each range counts its rows and adds up its sizes, and what the ranges
    before it have is added to each row's own.  So a group of any size is the work of as many tasks as it has ranges, and
    all without by is no single task either.  The windows that remain hold one range, or one row for each range.
    Rows that tie in all of order are divided as well; they follow each other in any order.  A column named position or start is written over.
    tasks: ranges, as many as shuffles have partitions if not given.  A null size counts as 0.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = rows.drop(position, *([start] if size is not None else []))
    keys = spare([f"_k{i}" for i in range(len(order))], rows.columns)
    tie, at, range_, own, first, total, shift, before = spare(["_tie", "_at", "_range", "_own", "_first", "_total", "_shift", "_before"], [*rows.columns, *keys])
    keyed = rows.withColumns(dict(zip(keys, order, strict=True)) | {tie: F.monotonically_increasing_id(), total: F.coalesce(size, F.lit(0)).cast("long") if size is not None else F.lit(0).cast("long")})
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = keyed.repartitionByRange(n, *by, *keys, tie).sortWithinPartitions(*by, *keys, tie).drop(tie, *keys)
    # the upper bits of this number are the range, the lower ones the place in it
    placed = stored(ranges.withColumn(at, F.monotonically_increasing_id()), "order").withColumn(range_, F.shiftright(at, 33))
    sums = placed.groupBy(*by, range_).agg(F.count(F.lit(1)).alias(own), F.sum(total).alias(total), F.min(at).alias(first))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    other = [f"{c}_" for c in spare([f"_by{i}" for i in range(len(by))], rows.columns)]
    shifts = sums.select(*(F.col(c).alias(o) for c, o in zip(by, other, strict=True)), F.col(range_).alias(f"{range_}_"), (F.coalesce(F.sum(own).over(earlier), F.lit(0)) - F.col(first) + 1).alias(shift), F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    same = F.col(range_) == F.col(f"{range_}_")
    for c, o in zip(by, other, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    joined = placed.join(shifts, same).withColumn(position, (F.col(at) + F.col(shift)).cast("int"))
    if size is not None:
        inside = Window.partitionBy(*by, range_).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        joined = joined.withColumn(start, F.col(before) + F.coalesce(F.sum(total).over(inside), F.lit(0)))
    return joined.select(*rows.columns, position, *([start] if size is not None else []))
