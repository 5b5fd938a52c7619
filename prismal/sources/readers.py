"""From lists of granules to whole cubes, as named and cached datasets."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import config
from ..operators.dataset import FDataset
from . import granules, matrix, netcdf

# Channels of equal size (nanometres) of the geostationary imager, and the numbers in their files' names.
CHANNELS = {1370.0: 4, 2200.0: 6, 3900.0: 7, 6200.0: 8, 6900.0: 9, 7300.0: 10, 8400.0: 11, 9600.0: 12, 10300.0: 13, 11200.0: 14, 12300.0: 15, 13300.0: 16}


def geostationary_granules(spark: SparkSession, base: str, pattern: str = "OR_ABI-L1b-RadF-M3C%02d_*.nc") -> FDataset:
    """wavelength -> uri of the channels whose files are in a folder: names are looked up, as they hold times of day."""
    from pyspark.sql import functions as F

    files = granules.list_files(spark, base, pattern.replace("%02d", "??"))
    number = F.regexp_extract("path", pattern.replace("%02d", r"(\d\d)").replace("*", ".*") + "$", 1).try_cast("int")
    channels = spark.createDataFrame([(n, w) for w, n in CHANNELS.items()], "_number int, wavelength double")
    found = files.withColumn("_number", number).join(F.broadcast(channels), "_number").groupBy("wavelength").agg(F.min("path").alias("uri"))
    return FDataset(found, ["wavelength"], ["uri"], "granules")


def geostationary(spark: SparkSession, images: FDataset | None = None, variable: str = "Rad", section: str = "", stride: tuple[int, int] | None = None, cache: bool = True) -> FDataset:
    """(x, y, wavelength) -> radiance of a list of images, wavelength -> uri, whose coordinates are angles."""
    images = images or geostationary_granules(spark, config.get(spark, "geostationary.base"))
    cube = netcdf.read_granules(images, ("y", "x"), variable=variable, section=section or config.get(spark, "geostationary.section"), stride=stride, coordinates=True)
    cube = cube.group_by_variable("x", "y", *images.domain).rename("geostationary")
    return cube.cached() if cache else cube


def swath(spark: SparkSession, bands: FDataset, geolocation: FDataset | str = "", names: tuple[str, ...] = ("ix", "iy"), cache: bool = True, coordinates: bool = False) -> FDataset:
    """(band, longitude, latitude) -> radiance of a list of sections, band -> uri; pixels are replaced by their places.

    With coordinates, pixels are told by the values of their coordinates' variables, not by their indices.
    """
    table = geolocation or config.get(spark, "swath.geolocation")
    table = table if isinstance(table, FDataset) else netcdf.geolocation(spark, table)
    cube = netcdf.read_granules(bands, names, coordinates=coordinates).substitute(table).rename("swath")
    return cube.cached() if cache else cube


def pushbroom(spark: SparkSession, base: str = "", wavelength_file: str = "wavelength.txt", count: int = 4200, cache: bool = True) -> FDataset:
    """(x, y, wavelength) -> radiance of numbered text matrices."""
    base = base or config.get(spark, "pushbroom.base")
    cube = matrix.cube(spark, base, f"{base}/{wavelength_file}", count, int(config.get(spark, "pushbroom.stride"))).rename("pushbroom")
    return cube.cached() if cache else cube
