"""Files of named arrays, by the suffix of their names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

from .store import local_copy


class NetcdfArrays:
    """NetCDF and HDF files; needs netCDF4. Scale and offset are applied; fill values and values out of range are NaN."""

    def __init__(self, path: str):
        import netCDF4

        self.file = netCDF4.Dataset(path)

    def shape(self, variable: str) -> tuple[int, ...]:
        return tuple(self.file.variables[variable].shape)

    def read(self, variable: str, cut: tuple[slice, ...]) -> np.ndarray:
        return np.ma.filled(np.ma.asarray(self.file.variables[variable][cut], dtype=float), np.nan)

    def coordinate(self, name: str) -> np.ndarray | None:
        found = self.file.variables.get(name)
        return np.ma.filled(np.ma.asarray(found[:], dtype=float), np.nan) if found is not None and len(found.shape) == 1 else None

    def close(self) -> None:
        self.file.close()


class NumpyArrays:
    """NumPy archives (.npz)."""

    def __init__(self, path: str):
        self.file = np.load(path)

    def shape(self, variable: str) -> tuple[int, ...]:
        return self.file[variable].shape

    def read(self, variable: str, cut: tuple[slice, ...]) -> np.ndarray:
        return self.file[variable][cut].astype(float)

    def coordinate(self, name: str) -> np.ndarray | None:
        found = self.file[name] if name in self.file.files else None
        return found.astype(float) if found is not None and found.ndim == 1 else None

    def close(self) -> None:
        self.file.close()


class ParquetArrays:
    """A Parquet file: a column of numbers is an array, one of equally long lists a matrix of a row for each."""

    def __init__(self, path: str):
        import pyarrow.parquet as pq

        self.file, self._read = pq.ParquetFile(path), {}

    def _column(self, variable: str) -> np.ndarray:
        if variable not in self._read:
            column = self.file.read(columns=[variable]).column(0).combine_chunks()
            rows = len(column)
            self._read[variable] = column.flatten().to_numpy().astype(float).reshape(rows, -1) if hasattr(column, "flatten") and hasattr(column.type, "value_type") else column.to_numpy(zero_copy_only=False).astype(float)
        return self._read[variable]

    def shape(self, variable: str) -> tuple[int, ...]:
        return self._column(variable).shape

    def read(self, variable: str, cut: tuple[slice, ...]) -> np.ndarray:
        return self._column(variable)[cut]

    def coordinate(self, name: str) -> np.ndarray | None:
        return self._column(name) if name in self.file.schema_arrow.names and self._column(name).ndim == 1 else None

    def close(self) -> None:
        self.file.close()


#: Suffix -> reader; every other file is taken for NetCDF.
FORMATS = {".npz": NumpyArrays, ".parquet": ParquetArrays}


@contextmanager
def opened(uri: str, cache: str = "") -> Iterator[NetcdfArrays | NumpyArrays | ParquetArrays]:
    """The arrays of a uri, closed at the end. What can't be opened is a ValueError that names the uri."""
    try:
        found = next((kind for suffix, kind in FORMATS.items() if uri.endswith(suffix)), NetcdfArrays)(local_copy(uri, cache))
    except (OSError, ValueError) as e:
        raise ValueError(f"can't open {uri}: {e}") from e
    try:
        yield found
    finally:
        found.close()
