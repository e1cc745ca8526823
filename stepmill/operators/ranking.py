"""Sums and positions along one order over all rows, on many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.session import cut


def running_sum(df: DataFrame, order: list, of: str) -> DataFrame:
    """``df`` with ``upto``: the sum of ``of`` up to and including each row in ``order``.

    The rows are range-partitioned once and written; the sums of the
    partitions, one number each, are added up in a window over that many rows,
    and a window inside each partition gives the rest.
    """
    named = [(f"_k{i}", c if isinstance(c, Column) else F.col(c)) for i, c in enumerate(order)]
    keyed = df.select("*", *[c.alias(n) for n, c in named])
    keys = [n for n, _ in named]
    laid = cut(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()))
    sums = laid.groupBy("_pid").agg(F.sum(of).alias("_part"))
    before = sums.select("_pid", F.coalesce(F.sum("_part").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return laid.withColumn("_in", F.sum(of).over(inside)).join(F.broadcast(before), "_pid").withColumn("upto", F.col("_in") + F.col("_before")).drop("_pid", "_in", "_before", *keys)


def position(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``pos``, the place from 0 of every row in ``order``, which must tell all rows apart."""
    return running_sum(df.withColumn("_one", F.lit(1)), order, "_one").withColumn("pos", F.col("upto") - 1).drop("upto", "_one")
