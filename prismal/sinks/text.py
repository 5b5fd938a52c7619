"""Text of datasets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..operators.dataset import FDataset


def lines(ds: FDataset) -> Iterator[str]:
    """What the dataset is, then all samples in order of their domain, a line each. Partitions come from the executors one after the other."""
    yield f"{ds.info()}\n"
    outer, inner = ds.domain, ds.columns[len(ds.domain) :]
    for row in ds.ordered().df.toLocalIterator():
        yield f"({', '.join(str(row[c]) for c in outer)}) -> ({', '.join(str(row[c]) for c in inner)})\n"


def stream(ds: FDataset, size: int = 1 << 16) -> Iterator[bytes]:
    """lines() in chunks of about `size` bytes; nothing else is held."""
    held = bytearray()
    for line in lines(ds):
        held += line.encode()
        if len(held) >= size:
            yield bytes(held)
            held.clear()
    if held:
        yield bytes(held)


def encode(ds: FDataset) -> bytes:
    """stream() as one object, for small datasets."""
    return b"".join(stream(ds))


def write(ds: FDataset, path: str) -> None:
    """CSV parts by the executors, each sorted, in ranges of the domain; nested functions as JSON."""
    from pyspark.sql import functions as F

    df = ds.df
    if ds.nested:
        df = df.withColumn(ds.nested.column, F.to_json(ds.nested.column))
    df.repartitionByRange(*ds.domain).sortWithinPartitions(*ds.domain).write.option("header", True).csv(path)


def write_matrices(ds: FDataset, base: str, pattern: str = "img%04d.txt") -> DataFrame:
    """(image, row, column) -> value as text matrices, a file for each image, by the executors; what sources/matrix.py reads.

    Numbers in names start at 1. Returns uri and the number of cells; the files are written as that is computed.
    """
    image, row, column = ds.domain
    value = ds.range[0]

    def put(key, rows):
        import pandas as pd

        from ..sources import store

        cells = rows.pivot(index=row, columns=column, values=value).sort_index().sort_index(axis=1)
        uri = f"{base}/{pattern % (int(key[0]) + 1)}"
        store.write(uri, "".join(",".join(map(repr, line)) + "\n" for line in cells.to_numpy(float).tolist()).encode())
        return pd.DataFrame([(uri, len(rows))], columns=["uri", "cells"])

    return ds.df.select(image, row, column, value).groupBy(image).applyInPandas(put, "uri string, cells long")
