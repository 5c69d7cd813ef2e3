"""Running sums over a whole ordered table, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenor.functions.storage import materialize


def running(rows: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` over all rows before this one in ``order``, which must be total.

    Rows are range-partitioned and summed inside their partition; only one number of each partition is summed over all.
    """
    dealt = materialize(rows.withColumn("_w", weight).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    own = F.sum("_w").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    each = dealt.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = each.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row for each shuffle partition
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.coalesce(own, F.lit(0)) + F.col("_before")).drop("_w", "_part", "_before")
