"""Numbers and running totals in an order over a whole table, without a window that holds the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def range_totals(rows: DataFrame, group: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over each and those before it, in the order of ``order``, in its group.

    Rows are dealt by ranges of (group, order); each range sums its rows, and is counted from where those before it in
    its group end. So a group may be any share of the table.
    """
    placed = checkpointed(rows.withColumn("_weight", weight).repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*group, "_range").agg(F.sum("_weight").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range only
    firsts = sums.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_range").alias("__range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.sum("_weight").over(Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] + [F.col("_range") == F.col("__range")]
    return placed.withColumn(name, inside).join(firsts, on).withColumn(name, F.col(name) + F.col("_first")).select(*rows.columns, name)


def range_numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with the number (from 1) of each in the order of ``order`` among those of its group."""
    return range_totals(rows, group, order, F.lit(1), name)


def running_sums(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``rows`` (one for each value of ``order``) with each of ``columns`` as its sum over all rows up to this one."""
    placed = checkpointed(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range only
    firsts = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns]).select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({c: F.sum(c).over(inside) for c in columns}).join(firsts, "_range")
    return summed.withColumns({c: F.col(c) + F.col(f"_{c}") for c in columns}).select(*rows.columns)
