"""Running totals over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.session import store


def running_total(df: DataFrame, order: list[str], value: str, into: str) -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` over all rows before this one in the order, 0 for the first.

    Rows are range-partitioned; only one sum for each partition meets on one task. Null values count as 0.
    The order must be total for a defined result.
    """
    v = F.coalesce(F.col(value), F.lit(0)).cast("long")
    placed = store(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_v", v))
    sums = placed.groupBy("_part").agg(F.sum("_v").alias("_s"))
    # One row a partition: as many as tasks, not as rows.
    starts = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_base"))
    within = F.sum("_v").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(F.broadcast(starts), "_part").withColumn(into, F.col("_base") + F.coalesce(within, F.lit(0))).drop("_part", "_v", "_base")


def place_in_group(df: DataFrame, key: str, order: list[str], into: str) -> DataFrame:
    """``df``, stored, with ``into``: the place of each row among those of its key in the order, from 0.

    Rows are range-partitioned by key and order, so a key of very many rows spans many tasks; counts by task and key meet
    in a small window. The order must be total within a key for a defined result.
    """
    placed = store(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(F.col(key).alias("_key"), "_part", (F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order)) - 1
    numbered = placed.withColumn("_within", within)
    # A row a task and key that it holds.
    return numbered.join(F.broadcast(base), (numbered["_part"] == base["_part"]) & numbered[key].eqNullSafe(base["_key"])).select(*df.columns, (F.col("_base") + F.col("_within")).alias(into))
