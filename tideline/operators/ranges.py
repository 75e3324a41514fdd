"""Running totals and medians over values dealt out by range, so that no group is gathered in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.sources.stored import stored


def running(counts: DataFrame, order: list[str], n: str, name: str, key: tuple[str, ...] = ()) -> DataFrame:
    """``counts(*key, *order, n)`` with ``upto``, the sum of ``n`` over the key's rows up to and with this one, and ``total``, over all of them.

    Rows are dealt out by range of key and order; each range is summed on its own, and a key's ranges (a row each) are added up.
    """
    dealt = stored(counts.repartitionByRange(*key, *order).withColumn("part", F.spark_partition_id()), name)
    w = Window.partitionBy(*key, F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = dealt.groupBy(*key, "part").agg(F.sum(n).alias("size"))
    parts = parts.withColumn("before", F.sum("size").over(w) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy(*key, F.lit(0))))
    within = Window.partitionBy(*key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*key, "part")])  # a null key is a key
    placed = dealt.withColumn("seen", F.sum(n).over(within)).alias("d").join(parts.alias("p"), same)
    return placed.select(*[f"d.{c}" for c in counts.columns], (F.col("d.seen") + F.col("p.before")).alias("upto"), "p.total")


def quantiles(rows: DataFrame, key: tuple[str, ...], value: str, shares: tuple[float, ...], name: str) -> DataFrame:
    """(*key, count, q0, q1, ...) of the values that are not null: for each share the value at share * (count - 1), interpolated."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    placed = running(counts, [value], "n", name, key)

    def quantile(share: float) -> Column:
        at = F.lit(share) * (F.col("total") - 1)
        held = lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))
        part = F.max(at - F.floor(at))
        return held(F.floor(at)) * (1 - part) + held(F.ceil(at)) * part

    return placed.groupBy(*key).agg(F.max("total").alias("count"), *[quantile(s).alias(f"q{i}") for i, s in enumerate(shares)])
