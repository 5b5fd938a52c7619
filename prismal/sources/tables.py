"""Columns of Parquet tables, files or folders, as arrays: Spark scans them, wherever they are, and no task holds a column."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .sections import Range, spell, whole, with_stride

SUFFIX = ".parquet"
_CUT = ("_f0", "_l0", "_s0", "_f1", "_l1", "_s1")


def opened(spark: SparkSession, file: str, column: str) -> tuple[DataFrame, bool]:
    """The table, and whether the column is one of lists."""
    try:
        table = spark.read.parquet(file.replace("s3://", "s3a://", 1) if file.startswith("s3://") else file)
    except AnalysisException as e:
        raise ValueError(f"can't open {file}: {e}") from e
    if column not in table.columns:
        raise ValueError(f"can't open {file}: no column {column!r}")
    return table, isinstance(table.schema[column].dataType, ArrayType)


def shape(table: DataFrame, column: str, lists: bool) -> tuple[int, ...]:
    found = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.col(f"`{column}`"))), F.lit(0)) if lists else F.lit(1)).first()
    return tuple(found) if lists else (found[0],)


def kept(section: list[Range], wanted: int) -> tuple[int, ...]:
    """Dimensions of more than one place; if fewer than wanted, the first of the others as well, so that tables of one row are read."""
    some = [i for i, r in enumerate(section) if r.count > 1]
    some = sorted([*some, *[i for i in range(len(section)) if i not in some][: max(0, wanted - len(some))]])
    if len(some) != wanted:
        raise ValueError(f"{len(some)} dimensions are kept of {spell(section)}; {wanted} are named")
    return tuple(some)


def placed(table: DataFrame, *columns: Column) -> DataFrame:
    """Columns with each row's place, `_i`: that within its file, after the rows of the files whose names are before it."""
    rows = table.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), *columns)
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    counts = table.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(starts), "_file").withColumn("_i", F.col("_row") + F.col("_before")).drop("_file", "_row", "_before")


def read(granules: DataFrame, keys: list[str], uri: str, file: str, column: str, cuts: dict[str, list[Range] | None], stride: tuple[int, ...] | None, names: tuple[str, ...], value: str, coordinates: bool) -> DataFrame:
    """(keys, names, value) of the granules whose uris name sections of this column; one scan for all of them."""
    spark = granules.sparkSession
    table, lists = opened(spark, file, column)
    if any(cut is None for cut in cuts.values()):
        all_of_it = whole(shape(table, column, lists))
        cuts = {u: cut or all_of_it for u, cut in cuts.items()}
    by_kept: dict[tuple[int, ...], list[tuple]] = {}
    for u, cut in cuts.items():
        if len(cut) != 1 + lists:
            raise ValueError(f"{spell(cut)} is no section of {file}!/{column}")
        cut = with_stride(cut, stride) if stride else cut
        dims = kept(cut, len(names))
        if all(r.count > 0 for r in cut):
            row, col = (*cut, Range(0, 0))[:2]
            by_kept.setdefault(dims, []).append((u, row.first, row.last, row.stride, col.first, col.last, col.stride))
        else:
            by_kept.setdefault(dims, [])
    return reduce(DataFrame.unionByName, [_read(granules, keys, uri, table, column, lists, found, dims, names, value, coordinates) for dims, found in by_kept.items()])


def _read(granules, keys, uri, table, column, lists, cuts, dims, names, value, coordinates) -> DataFrame:
    kind = "double" if coordinates else "int"
    own = names[dims.index(0)] if coordinates and 0 in dims and names[dims.index(0)] in table.columns else None
    rows = placed(table, F.col(f"`{column}`").alias("_values"), *([F.col(f"`{own}`").cast("double").alias("_own")] if own else []))
    listed = granules.sparkSession.createDataFrame(cuts, "_uri string, " + ", ".join(f"{c} long" for c in _CUT))
    listed = granules.join(F.broadcast(listed), F.col(uri) == F.col("_uri")).select(*[F.col(k).alias(f"_key_{k}") for k in keys], *_CUT)
    i, (f0, l0, s0, f1, l1, s1) = F.col("_i"), map(F.col, _CUT)
    met = rows.join(F.broadcast(listed), (i >= f0) & (i <= l0) & ((i - f0) % s0 == 0))  # a row for each granule
    out = [F.col("_own") if own else ((i - f0) / s0).cast("long")]
    if lists and any(c[4] != c[5] for c in cuts):
        places = F.transform(F.sequence(f1, l1, s1), lambda j: F.struct(((j - f1) / s1).cast("long").alias("_j"), F.get("_values", j.cast("int")).alias("_v")))
        met = met.select("*", F.inline(places))
    else:
        met = met.withColumn("_j", F.lit(0)).withColumn("_v", F.get("_values", f1.cast("int")) if lists else F.col("_values"))
    out.append(F.col("_j"))
    return met.select(*[F.col(f"_key_{k}").alias(k) for k in keys], *[out[d].cast(kind).alias(n) for d, n in zip(dims, names, strict=True)], F.col("_v").cast("double").alias(value))
