"""Row numbers over a whole table, or within groups of it, without moving a group to one task.

A table is dealt out by ranges of the order.  Each range's rows are numbered where they
are; the sizes of the ranges before it, one number for each range and group that meet,
shift them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import sent, settled

_ROW = (1 << 33) - 1


def _dealt(df: DataFrame, *order: Column) -> DataFrame:
    """df by ranges of the order, with each row's range and place in it; written once, so that both stay as they are."""
    placed = df.orderBy(*order).withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)))
    return settled(placed)


def number_rows(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with its rows' numbers from 0 in an order that has no ties."""
    dealt = _dealt(df, *order)
    before, shifts = 0, []
    for task, n in sorted(dealt.groupBy("_task").agg(F.count("*")).collect()):
        shifts.append((task, before))
        before += n
    shift = df.sparkSession.createDataFrame(shifts, "_task int, _before long")
    return dealt.join(F.broadcast(shift), "_task").withColumn(name, F.col("_row") + F.col("_before")).drop("_task", "_row", "_before")


def number_within(df: DataFrame, name: str, by: str, *order: Column) -> DataFrame:
    """df with its rows' numbers from 1 within each value of a column (not null), in an order that has no ties.

    A group may be in many ranges, and a range may hold many groups: for each that meet
    there is one row that says how many of the group's rows are in the ranges before.
    """
    return _numbered(_dealt(df, F.col(by), *order), name, by).drop("_task", "_row")


def running_sums(df: DataFrame, name: str, value: str, number: str, by: str, *order: Column) -> DataFrame:
    """number_within, and the sums of a column's values up to each row.

    Sums are made within the part of a group that a range has, and the sums of its earlier
    parts are added: no task sees more of a group than its range.
    """
    placed = _numbered(_dealt(df, F.col(by), *order), number, by)
    upto = Window.partitionBy(by, "_task").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(by, "_task").agg(F.sum(value).alias("_s")).select(by, "_task", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_base"))
    summed = placed.withColumn(name, F.sum(value).over(upto)).join(sent(before), [by, "_task"])
    return summed.withColumn(name, F.col(name) + F.col("_base")).drop("_task", "_row", "_base")


def _numbered(dealt: DataFrame, name: str, by: str) -> DataFrame:
    met = dealt.groupBy(by, "_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = met.select(by, "_task", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return dealt.join(sent(shift), [by, "_task"]).withColumn(name, F.col("_row") + F.col("_shift")).drop("_shift")
