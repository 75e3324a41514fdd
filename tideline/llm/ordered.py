"""Ranks and running totals in one global order, shared out over all tasks.

A window without a partition key would read every row in one task.  Here rows are dealt out by range, each range
is summed on its own, and only the totals of the ranges (one row a task) are added up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.scratch import materialize

_BITS = 33


def _before(ends: DataFrame, values: list[str]) -> DataFrame:
    """Sums of the ranges before each range; ``ends`` has a row a task, which bounds the broadcast."""
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.broadcast(ends.select("_range", *[(F.sum(v).over(w) - F.col(v)).alias(f"_before_{v}") for v in values]))


def running_totals(df: DataFrame, order: list[str | Column], values: list[str], name: str) -> DataFrame:
    """``df`` with ``total_<v>`` for each of ``values``: its sum over all rows up to and with this one in ``order``."""
    placed = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    before = _before(placed.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values]), values)
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = [(F.sum(v).over(w) + F.col(f"_before_{v}")).alias(f"total_{v}") for v in values]
    return placed.join(before, "_range").select(*df.columns, *totals)


def global_rank(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``rank``, 0 to n - 1 in ``order``; rows equal in ``order`` are ranked as they come."""
    at = F.monotonically_increasing_id()
    spread = df.withColumn("_tie", at)  # so that even rows that are equal throughout spread over several ranges
    placed = materialize(spread.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("_at", at), name)
    placed = placed.withColumn("_range", F.shiftright("_at", _BITS)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)))
    before = _before(placed.groupBy("_range").agg(F.count("*").alias("n")), ["n"])
    return placed.join(before, "_range").select(*df.columns, (F.col("_before_n") + F.col("_row")).alias("rank"))
