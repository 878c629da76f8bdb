"""Ranks over a whole table without gathering its rows in one task.

The distinct values are counted with map-side combining, cut into ranges that follow each other, and summed up inside each range; a range
starts where the totals of the ranges before it end. Only those totals, one row a range, are looked at in one place. Rows get
their value's rank by a join, so a value that most rows share is one row of the ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.session import materialize


def with_rank(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` with ``rank() over (order by order)`` as bigint ``name``: ties share the place of their first, nulls come first.

    The ranges are written once, since drawing them again could cut elsewhere.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_order", order)
    counts = keyed.groupBy("_order").agg(F.count(F.lit(1)).alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counts.repartitionByRange(parts, "_order").withColumn("_range", F.spark_partition_id()), "ranks")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_total"))
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(before.orderBy("_range")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_n").over(before.partitionBy("_range").orderBy("_order")), F.lit(0))
    ranks = ranged.withColumn("_inside", inside).join(starts, "_range").select(F.col("_order").alias("_key"), (F.col("_start") + F.col("_inside") + 1).alias("_rank"))
    return keyed.join(ranks, F.col("_order").eqNullSafe(F.col("_key"))).select(*(df[c] for c in df.columns), F.col("_rank").alias(name))
