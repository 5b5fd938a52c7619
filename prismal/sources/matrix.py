"""Text matrices: one file an image, comma-separated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import FDataset
from ..functions import geo
from .granules import numbered


def _cells(line, separator: str):
    return F.transform(F.split(F.trim(line), separator), lambda x: F.trim(x).cast("double"))


def read_matrices(spark: SparkSession, paths: str | list[str], separator: str = ",") -> DataFrame:
    """path, row, col, value of every cell. A file is read whole, as its line numbers are the rows."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n").alias("lines"))
    rows = files.select("path", F.posexplode("lines").alias("row", "line"))
    return rows.select("path", "row", F.posexplode(_cells(F.col("line"), separator)).alias("col", "value"))


def image(spark: SparkSession, path: str) -> FDataset:
    """(iy, iw) -> radiance."""
    df = read_matrices(spark, path).select(F.col("row").alias("iy"), F.col("col").alias("iw"), F.col("value").alias("radiance"))
    return FDataset(df, ["iy", "iw"], ["radiance"], "image")


def wavelengths(spark: SparkSession, path: str) -> FDataset:
    """iw -> wavelength from the first row of a matrix; the other rows aren't split."""
    first = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n", 2)[0].alias("line"))
    df = first.select(F.posexplode(_cells(F.col("line"), ",")).alias("iw", "wavelength"))
    return FDataset(df, ["iw"], ["wavelength"], "wavelengths")


def index_cube(spark: SparkSession, base: str, count: int = 4200, stride: int = 1, pattern: str = "img%04d.txt") -> FDataset:
    """(ix, iy, iw) -> radiance of numbered images. The list is made first, so only its files are opened."""
    granules = numbered(spark, base, count, stride, pattern).df
    paths = [r.uri for r in granules.collect()]  # a file name for each image
    # Whole paths, as Spark spells them: escaped, and with a scheme.
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    cells = read_matrices(spark, paths).withColumn("_path", plain(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))))
    named = granules.select("ix", plain(F.col("uri")).alias("_path"))
    df = cells.join(F.broadcast(named), "_path").select("ix", F.col("row").alias("iy"), F.col("col").alias("iw"), F.col("value").alias("radiance"))
    return FDataset(df, ["ix", "iy", "iw"], ["radiance"], "pushbroom")


def named_cube(spark: SparkSession, base: str, images: int, count: int = 4200) -> FDataset:
    """About `images` of all images, evenly spaced."""
    return index_cube(spark, base, count, max(1, count // images))


def cube(spark: SparkSession, base: str, wavelength_file: str, count: int = 4200, stride: int = 1) -> FDataset:
    """(x, y, wavelength) -> radiance: images, wavelengths in place of their positions, metres in place of pixels."""
    ds = index_cube(spark, base, count, stride).substitute(wavelengths(spark, wavelength_file))
    return ds.substitute_by(["ix", "iy"], ["x", "y"], geo.scene_xy)
