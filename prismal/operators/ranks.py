"""Ranks over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with each row's place, from 0, in the order of a column.

    Rows are sorted in ranges of that column; a range starts where the earlier ones' counts, a row for each, end. The
    number of ranges is given, so that no later step joins some, and both uses of the sorted rows see the same ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, by).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    starts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = starts.select("_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") - F.col("_low") + F.col("_before")).drop("_part", "_at", "_low", "_before")
