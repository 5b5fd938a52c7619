"""Lists of granules, and readers that put each granule's dataset in its place."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import FDataset
from ..operators.ranks import ranked


def numbered(spark: SparkSession, base: str, count: int = 4200, stride: int = 1, pattern: str = "img%04d.txt") -> FDataset:
    """ix -> uri of numbered files; the stride is applied where the list is made. Numbers in names start at 1."""
    df = spark.range(0, count, stride).select(F.col("id").cast("int").alias("ix"), F.format_string(f"{base}/{pattern}", F.col("id") + 1).alias("uri"))
    return FDataset(df, ["ix"], ["uri"], "granules")


def listed(spark: SparkSession, rows: list[tuple[float, str]], key: str = "wavelength") -> FDataset:
    """key -> uri from a literal list."""
    return FDataset(spark.createDataFrame([(float(k), u) for k, u in rows], f"{key} double, uri string"), [key], ["uri"], "granules")


def sections(spark: SparkSession, file: str, bands: list[tuple[float, str, int]], rows: int = 2030, columns: int = 1354, stride: int = 1) -> FDataset:
    """band -> uri of a variable's section in one file; bands are (number, variable, position)."""
    df = spark.createDataFrame([(float(b), v, k) for b, v, k in bands], "band double, variable string, k int")
    uri = F.format_string(f"{file}!/%s#(%d,0:{rows - 1}:{stride},0:{columns - 1}:{stride})", "variable", "k")
    return FDataset(df.select("band", uri.alias("uri")), ["band"], ["uri"], "granules")


def from_listing(files: DataFrame, pattern: str, prefix: str = "", key: str = "path") -> FDataset:
    """index -> (key, a column for each named group) of a list of keys that match a whole pattern.

    Named groups are written (?<name>...). Keys are ranked by ranges of their order, so no task sees them all.
    """
    names = re.findall(r"\(\?<([A-Za-z]\w*)>", pattern)
    numbered_groups = {m[1]: i for i, m in enumerate(re.finditer(r"\((?!\?)|\(\?<([A-Za-z]\w*)>", pattern), 1) if m[1]}
    found = files.select(F.col(key).alias("key")).filter(F.col("key").startswith(prefix) & F.col("key").rlike(f"^(?:{pattern})$"))
    plain = re.sub(r"\(\?<[A-Za-z]\w*>", "(", pattern)
    groups = [F.regexp_extract("key", f"^(?:{plain})$", numbered_groups[n]).alias(n) for n in names]
    df = ranked(found, "key", "index").select("index", "key", *groups)
    return FDataset(df, ["index"], ["key", *names], "listing")


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path of each file under a folder, in any store that Spark reads; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", "modificationTime")


def with_reader(granules: FDataset, read: Callable, domain: list[str] | None = None, range: list[str] | None = None) -> FDataset:
    """k -> uri to (k, inner domain) -> range.

    `read` turns the list of granules into a dataset, as netcdf.read_granules() does; or, with a domain and a range
    given, a table with a uri column into samples that keep the other columns.
    """
    if domain is None:
        found = read(granules)
        if found.domain[: granules.arity] != granules.domain:
            raise ValueError(f"the reader lost {granules.domain}")
        return found
    df = read(granules.df).select(*granules.domain, *domain, *range)
    return FDataset(df, [*granules.domain, *domain], range, granules.id)
