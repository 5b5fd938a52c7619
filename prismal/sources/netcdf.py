"""Arrays of files as datasets: one image, or the images that a list of granules names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .. import config
from ..operators.dataset import FDataset
from . import tables
from .arrays import opened
from .sections import Range, parse, spell, whole, with_stride

#: Cells that a task reads at most, where the first kept dimension can be cut; rows of a batch.
TASK_CELLS, BATCH_ROWS = 4_000_000, 65_536


def parse_uri(uri: str) -> tuple[str, str, list[Range] | None]:
    """`file!/variable#(section)` in its parts."""
    file, _, rest = uri.partition("!/")
    variable, _, section = rest.partition("#")
    return file, variable, parse(section.strip("()")) if section else None


def pieces(section: list[Range], kept: list[int]) -> list[list[Range]]:
    """A section cut along its first kept dimension."""
    if not kept:
        return [section]
    first, out = section[kept[0]], []
    rows = max(1, TASK_CELLS // max(1, math.prod(r.count for r in section) // first.count))
    for at in range(0, first.count, rows):
        last = min(at + rows, first.count) - 1
        part = Range(first.first + at * first.stride, first.first + last * first.stride, first.stride)
        out.append([part if i == kept[0] else r for i, r in enumerate(section)])
    return out


def cells(arrays, variable: str, piece: list[Range], origin: list[Range], kept: list[int], names: list[str] | None) -> Iterator[list[np.ndarray]]:
    """Columns of coordinates and values, a batch at a time. A coordinate is its variable's value if `names` has one that the file has, else its index in the origin section."""
    values = arrays.read(variable, tuple(slice(r.first, r.last + 1, r.stride) for r in piece)).reshape(-1)
    shape, axes = [piece[i].count for i in kept], []
    for i, name in zip(kept, names or [None] * len(kept), strict=True):
        own = np.arange(piece[i].count) + (piece[i].first - origin[i].first) // origin[i].stride
        found = arrays.coordinate(name) if name else None
        axes.append(own if found is None else found[piece[i].first + np.arange(piece[i].count) * piece[i].stride])
    for at in range(0, len(values), BATCH_ROWS):
        places = np.unravel_index(np.arange(at, min(at + BATCH_ROWS, len(values))), shape) if shape else []
        yield [*[axis[p] for axis, p in zip(axes, places, strict=True)], values[at : at + BATCH_ROWS]]


def _kept(section: list[Range], wanted: int) -> list[int]:
    """Dimensions of more than one place, or all if as many are wanted."""
    kept = list(range(len(section))) if len(section) == wanted else [i for i, r in enumerate(section) if r.count > 1]
    if len(kept) != wanted:
        raise ValueError(f"{len(kept)} dimensions are kept of {spell(section)}; {wanted} are named")
    return kept


class _Part(InputPartition):
    def __init__(self, section: str):
        self.section = section


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.file, self.variable, found = parse_uri(options["path"])
        self.variable = options.get("variable") or self.variable
        self.cache, self.schema = options.get("cache", ""), schema
        section = parse(options["section"].strip("()")) if options.get("section") else found
        if section is None:
            with opened(self.file, self.cache) as arrays:
                section = whole(arrays.shape(self.variable))
        strides = options.get("stride")
        self.section = with_stride(section, tuple(map(int, strides.split(",")))) if strides else section
        self.kept = _kept(self.section, len(schema.fields) - 1)

    def partitions(self) -> list[_Part]:
        """Pieces of the section along its first kept dimension."""
        return [_Part(spell(p)) for p in pieces(self.section, self.kept)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * len(self.kept) + [pa.float64()]
        with opened(self.file, self.cache) as arrays:
            for columns in cells(arrays, self.variable, parse(partition.section), self.section, self.kept, None):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], self.schema.names)


class NetcdfSource(DataSource):
    """Options: path (`file!/variable#(section)`), variable, section, stride, cache. The schema names the kept dimensions (int) and the value (double)."""

    @classmethod
    def name(cls) -> str:
        return "prismal_netcdf"

    def schema(self) -> str:
        return "i0 int, i1 int, value double"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)


def image(spark: SparkSession, uri: str, stride: tuple[int, ...] | None = None, names: tuple[str, ...] = ("iy", "ix"), value: str = "radiance", section: str = "") -> FDataset:
    """Index coordinates -> value of a section of one variable; the section is that given, or the uri's, or all."""
    file, variable, _ = parse_uri(uri)
    if file.endswith(tables.SUFFIX):
        named = f"{file}!/{variable}#({section.strip('()')})" if section else uri
        one = FDataset(spark.createDataFrame([(0, named)], "_image int, _uri_of string"), ["_image"], ["_uri_of"])
        return FDataset(read_granules(one, names, value, stride=stride).df.drop("_image"), list(names), [value], "image")
    spark.dataSource.register(NetcdfSource)
    reader = spark.read.format("prismal_netcdf").schema(", ".join([f"{n} int" for n in names] + [f"{value} double"])).option("cache", config.get(spark, "file.cache.dir"))
    if stride:
        reader = reader.option("stride", ",".join(map(str, stride)))
    if section:
        reader = reader.option("section", section)
    return FDataset(reader.load(uri), list(names), [value], "image")


def read_granules(granules: FDataset, names: tuple[str, ...], value: str = "radiance", variable: str = "", section: str = "", stride: tuple[int, ...] | None = None, coordinates: bool = False) -> FDataset:
    """k -> uri to (k, inner coordinates) -> value of the arrays that the uris name.

    The uri is `file!/variable#(section)`; a section given counts for uris without one, and none for all of an array. Shapes
    are looked up by the tasks, which cut each array into pieces; these are dealt out and read, one a task at a time.
    Columns of Parquet tables are scanned by Spark, for which the list's uris are looked at here; rows are the first dimension.
    With coordinates, a dimension has the values of its 1-D variable, if the file has one of that name. A uri that can't
    be opened is an error.
    """
    spark, keys, uri = granules.df.sparkSession, granules.domain, granules.range[0]
    if dict(granules.df.dtypes)[uri] != "string":
        raise ValueError(f"{uri} is no text")
    file = F.split(F.col(uri), "!/", 2)[0]
    of_tables = [r[0] for r in granules.df.select(F.when(file.endswith(tables.SUFFIX), F.col(uri)).alias("u")).distinct().collect()]
    if any(of_tables):
        columns: dict[tuple[str, str], dict[str, list[Range] | None]] = {}
        for u in sorted(filter(None, of_tables)):
            path, own, cut = parse_uri(u)
            columns.setdefault((path, own or variable), {})[u] = cut or (parse(section.strip("()")) if section else None)
        found = [tables.read(granules.df, keys, uri, *of, cuts, stride, names, value, coordinates) for of, cuts in columns.items()]
        if None in of_tables:
            rest = granules.filter(~F.coalesce(file.endswith(tables.SUFFIX), F.lit(False)))
            found.append(read_granules(rest, names, value, variable, section, stride, coordinates).df)
        return FDataset(reduce(DataFrame.unionByName, found), [*keys, *names], [value], granules.id)
    cache, wanted = config.get(spark, "file.cache.dir"), len(names)
    key_fields = [granules.df.schema[k] for k in keys]

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row[-1] is None:
                    raise ValueError("a granule without a uri")
                file, own, cut = parse_uri(row[-1])
                if cut is None and section:
                    cut = parse(section.strip("()"))
                if cut is None:
                    with opened(file, cache) as arrays:
                        cut = whole(arrays.shape(own or variable))
                cut = with_stride(cut, stride) if stride else cut
                rows += [(*row[:-1], file, own or variable, spell(cut), spell(p)) for p in pieces(cut, _kept(cut, wanted))]
            yield pd.DataFrame(rows, columns=[*keys, "_file", "_variable", "_section", "_piece"])

    planned = StructType([*key_fields, *[StructField(c, StringType()) for c in ("_file", "_variable", "_section", "_piece")]])
    parts = granules.df.select(*keys, uri).mapInPandas(plan, planned).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = DoubleType() if coordinates else IntegerType()
    schema = StructType([*key_fields, *[StructField(n, kind) for n in names], StructField(value, DoubleType())])
    arrow = [pa.float64() if coordinates else pa.int32()] * wanted + [pa.float64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, own, cut, piece = (batch.column(c)[i].as_py() for c in ("_file", "_variable", "_section", "_piece"))
                origin = parse(cut)
                with opened(file, cache) as arrays:
                    for columns in cells(arrays, own, parse(piece), origin, _kept(origin, wanted), list(names) if coordinates else None):
                        same = pa.array([i] * len(columns[-1]), pa.int64())
                        out = [batch.column(k).take(same) for k in keys] + [pa.array(c, k) for c, k in zip(columns, arrow, strict=True)]
                        yield pa.RecordBatch.from_arrays(out, [*keys, *names, value])

    return FDataset(parts.mapInArrow(read, schema), [*keys, *names], [value], granules.id)


def geolocation(spark: SparkSession, file: str, section: str = "", names: tuple[str, str] = ("longitude", "latitude")) -> FDataset:
    """(ix, iy) -> (longitude, latitude) of a swath's pixels."""
    lon, lat = (image(spark, f"{file}!/{n}" + (f"#({section})" if section else ""), names=("ix", "iy"), value=n) for n in names)
    return lon.natural_join(lat)


def calibrated(raw: DataFrame, value: str, scale: float, offset: float) -> DataFrame:
    """Counts to radiances; counts over 32767 are fill values."""
    c = F.col(value)
    return raw.withColumn(value, F.when(c > 32767, float("nan")).otherwise(scale * (c - offset)))
