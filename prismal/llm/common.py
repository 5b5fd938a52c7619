"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: White space to str.split() that isn't white space to WORD.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key counts as hot if it has this many rows, and more than one in HOT_SHARE of all rows.
HOT_ROWS, HOT_SHARE, SALTS = 1000, 1000, 32


def words(text: str | None) -> list[str]:
    """The words of a text, none for null."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def fold(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.encode().lower().decode()  # bytes know ASCII letters only


def folded(text: Column) -> Column:
    """fold() as a column; null counts as empty. lower() is the cheap form where a text is ASCII only."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Arrow batches (64 MB of texts at most, by Spark's own setting) in pieces, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def arrow_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """As slices(), for columns that pandas would change: integers beside nulls."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Folders made here, by application.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; set here only for a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own_dirs.get(spark.sparkContext.applicationId)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = _own_dirs[spark.sparkContext.applicationId] = f"file://{tempfile.mkdtemp(prefix='prismal-')}"
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


class Scratch:
    """Tables that materialize() writes while this is open; they are deleted when it closes, or earlier by discard()."""

    def __init__(self):
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        self._outer = _scratch.set((*_scratch.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _scratch.reset(self._outer)
        self.discard(*[df for df, _ in self.tables])

    def discard(self, *tables: DataFrame) -> None:
        for df, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]


_scratch: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())
#: Spark's own setting that removes the shuffle files of an execution as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512


def materialize(df: DataFrame, tag: str, keep: bool = False, codec: str = "snappy", by: str | None = None, batch: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage and outlives lost executors.

    It belongs to the innermost open Scratch; with keep, to the one around that, if any. The shuffle files behind it
    are removed once it is written, as nothing reads them again. by: a column whose values have folders of their own.
    batch: rows of texts that a Python worker is given at a time. The session's settings are as before afterwards.
    """
    spark = df.sparkSession
    path, settings = new_path(spark, tag), {_CLEANUP: "true"} | ({_BATCH: str(batch)} if batch else {})
    was = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        write = df.write.option("compression", codec)
        (write.partitionBy(by) if by else write).parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    owners = _scratch.get()[: -1 if keep else None]
    if owners:
        owners[-1].tables.append((out, path))
    return out


def hot_keys(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Keys with more than total / HOT_SHARE rows: fewer than HOT_SHARE of them can exist, so they may be broadcast."""
    return counts.filter(F.col(count) > max(HOT_ROWS, total // HOT_SHARE)).select(key)


def hot_rows(rows: DataFrame, on: str) -> DataFrame | None:
    """The hot keys of a column, found by an exact count with partial sums; None if there are none. Give a written table, which is read twice.

    Under HOT_SHARE of them can exist, so they are collected.
    """
    total = rows.count()
    if total <= HOT_ROWS:
        return None
    found = hot_keys(rows.groupBy(on).agg(F.count(F.lit(1)).alias("_n")), on, "_n", total)
    keys = found.collect()
    return rows.sparkSession.createDataFrame(keys, found.schema) if keys else None


def salted_join(left: DataFrame, right: DataFrame, on: str, spread: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """A join where left's rows of hot keys are dealt over SALTS keys by the hash of the column `spread`, and right's rows for them repeated as often."""
    if hot is None:
        return left.join(right, on, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    right = right.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [on, "_salt"], how).drop("_salt")


def skew_join(left: DataFrame, right: DataFrame, on: str, spread: str, how: str = "inner") -> DataFrame:
    """Joins where one key may hold a third of left's rows and right has few rows for each key.

    Hot keys of left are found by an exact count and dealt out, see salted_join(). Left is read twice; give a materialized table.
    """
    return salted_join(left, right, on, spread, hot_rows(left, on), how)


#: Cells of a bitmap that bitmap_construct_agg() makes at a time, and the largest bitmap: 2**29 cells are 64 MB, whatever the input.
BLOCK, MAX_CELLS = 32768, 1 << 29


def bitmap(hashes: DataFrame, column: str, rows: int, a_row: int = 16) -> np.ndarray:
    """A one-function Bloom filter of a column of 64-bit hashes, as bytes on the driver, for in_bitmap().

    It has a power of two of cells, about `a_row` for each of `rows`, MAX_CELLS at most; a filter too small lets more
    hashes through, never fewer.
    """
    cells = BLOCK
    while cells < min(rows * a_row, MAX_CELLS):
        cells *= 2
    cell = F.col(column).bitwiseAND(F.lit(cells - 1))
    blocks = hashes.select(cell.alias("cell")).groupBy(F.expr(f"cell div {BLOCK}").alias("block")).agg(F.bitmap_construct_agg(F.col("cell") % BLOCK).alias("bits"))
    out = np.zeros(cells // 8, np.uint8)
    for row in blocks.collect():
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[row["block"] * (BLOCK // 8) :][: BLOCK // 8] = part[: len(out)]
    return out


def flagged(df: DataFrame, column: str, keys: DataFrame, a_row: int = 16) -> DataFrame:
    """df with `flag`: false proves that a column's 64-bit hash isn't in the column of that name of keys, a written table.

    As bitmap(), without Python: its blocks of 4 KB are rows, joined by broadcast, MAX_CELLS / 8 bytes at most. Columns of
    df must not be named flag, block, bits or cell.
    """
    cells, rows = BLOCK, keys.count()
    while cells < min(rows * a_row, MAX_CELLS):
        cells *= 2
    cell = F.col(column).bitwiseAND(F.lit(cells - 1)).alias("cell")
    blocks = keys.select(cell).groupBy(F.expr(f"cell div {BLOCK}").alias("block")).agg(F.bitmap_construct_agg(F.col("cell") % BLOCK).alias("bits"))
    blocks = materialize(blocks, "blocks", keep=True)
    out = df.withColumn("cell", cell).withColumn("block", F.expr(f"cell div {BLOCK}")).join(F.broadcast(blocks), "block", "left")
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast(cell % {BLOCK} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.getbit(byte, (F.col("cell") % 8).cast("int")) == 1
    return out.withColumn("flag", F.coalesce(bit, F.lit(False))).drop("cell", "block", "bits")


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = hashes.astype(np.int64) & (len(bits) * 8 - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 != 0


class WordHashes(dict):
    """word -> 64-bit hash; a worker remembers a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


#: What this worker remembers, under the name of its kind.
_remembered: dict[str, object] = {}


def remembered(kind: str, make: Callable[[], object]):
    """What a worker remembers from one batch or task to the next, of one kind at a time.

    Workers outlive stages, so what an earlier one remembered would stay beside what the next one needs.
    """
    if kind not in _remembered:
        forget()
        _remembered[kind] = make()
    return _remembered[kind]


def forget() -> None:
    """Frees what this worker remembers, and gives what is free back to the system, which allocators would rather keep."""
    _remembered.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(remembered("word hashes", WordHashes).__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words: polynomials, joined by doubling, then mixed."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    base, done, out, power = 0x9E3779B97F4A7C15, 0, None, words
    size = 1
    while True:
        if k & size:
            n = len(words) - done - size + 1
            shifted = power[done : done + n]
            out = shifted.copy() if out is None else out[:n] * np.uint64(pow(base, size, 1 << 64)) + shifted
            done += size
        if done == k:
            return mixed(out)
        power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2
