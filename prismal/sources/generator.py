"""A synthetic cube, computed where it is read."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import FDataset


def cube(spark: SparkSession, nx: int, ny: int, nz: int, partitions: int | None = None) -> FDataset:
    """(x, y, z) -> value: the quadrants' bases 3, 2, 4 and 1 times z / (nz - 1); z varies fastest."""
    if min(nx, ny, nz) <= 0:
        raise ValueError("sizes must be positive")
    df = spark.range(0, nx * ny * nz, 1, partitions) if partitions else spark.range(nx * ny * nz)
    x, y, z = F.floor(F.col("id") / (ny * nz)), F.floor(F.col("id") / nz) % ny, F.col("id") % nz
    left, low = x < nx // 2, y < ny // 2
    base = F.when(left & low, 3.0).when(left, 2.0).when(low, 4.0).otherwise(1.0)
    factor = F.lit(1.0) if nz == 1 else z / F.lit(float(nz - 1))
    df = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), (base * factor).alias("value"))
    return FDataset(df, ["x", "y", "z"], ["value"], "cube")
