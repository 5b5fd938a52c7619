"""Slopes along a track, and a polynomial fit of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dataset import FDataset


def slopes(track: FDataset, value: str, name: str = "slope") -> FDataset:
    """d value / d last coordinate by central differences within the other coordinates; the first and last take their neighbour's. One sort by them."""
    keys, x = track.domain[:-1], track.domain[-1]
    w = Window.partitionBy(*keys).orderBy(x)
    rise = F.lead(value).over(w) - F.lag(value).over(w)
    run = F.lead(x).over(w) - F.lag(x).over(w)
    df = track.df.withColumn("_central", rise / F.nullif(run.cast("double"), F.lit(0.0)))
    ends = F.coalesce("_central", F.lead("_central").over(w), F.lag("_central").over(w))
    return FDataset(df.withColumn(name, ends).drop("_central"), track.domain, [*track.range, name], track.id)


def polynomial(df: DataFrame, x: str, y: str, degree: int = 3) -> list[float]:
    """Least-squares coefficients, highest first, from sums that one aggregate row holds."""
    import numpy as np

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    about = rows.agg(F.avg("x").alias("middle"), F.stddev_pop("x").alias("spread")).first()
    middle, spread = about["middle"] or 0.0, about["spread"] or 1.0
    # Powers of x as it is would lose the digits of a track far from 0.
    power = lambda k: F.pow((F.col("x") - middle) / spread, F.lit(float(k)))
    sums = [F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(power(k) * F.col("y")).alias(f"t{k}") for k in range(degree + 1)]
    row = rows.agg(*sums).first()
    a = np.array([[row[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], float)
    found = np.linalg.solve(a, np.array([row[f"t{i}"] for i in range(degree + 1)], float))
    return np.polynomial.Polynomial(found)(np.polynomial.Polynomial([-middle / spread, 1 / spread])).coef[::-1].tolist()


def range_partition(c: Column, count: int, low: float, high: float) -> Column:
    """Which of `count` equal ranges a value is in; null and the upper end are in the last."""
    i = ((c - low) / ((high - low) / count)).cast("int")
    return F.when(c.isNull() | (c >= high), F.lit(count - 1)).otherwise(i)
