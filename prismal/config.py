"""Settings of a session: spark.prismal.<key>, or the defaults here."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "geostationary.base": "",
    "geostationary.section": "",
    "pushbroom.base": "",
    "pushbroom.stride": "1",
    "pushbroom.images": "4200",
    "swath.stride": "1",
    "swath.geolocation": "",
    "file.cache.dir": "",
    "store.endpoint": "",
    "store.region": "",
}


def get(spark: SparkSession, key: str) -> str:
    """The value of a known key; empty if nothing is set."""
    return spark.conf.get(f"spark.prismal.{key}", DEFAULTS[key])
