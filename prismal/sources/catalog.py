"""Datasets by name."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.dataset import FDataset


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark, self._makers, self._made = spark, {}, {}

    def register(self, id: str, maker: Callable[[SparkSession], FDataset]) -> None:
        self._makers[id] = maker
        self._drop(id)

    def _drop(self, id: str) -> None:
        """Lets go of a cached dataset that another one replaces."""
        if (was := self._made.pop(id, None)) is not None:
            was.release()

    def add(self, ds: FDataset) -> FDataset:
        """A dataset that is there already, also to SQL."""
        if (was := self._made.get(ds.id)) is not None and was.df is not ds.df:
            self._drop(ds.id)
        self._made[ds.id] = ds.as_view(ds.id)
        return ds

    def get(self, id: str) -> FDataset:
        if id not in self._made:
            if id not in self._makers:
                raise LookupError(f"no dataset {id}")
            self._made[id] = self._makers[id](self.spark).rename(id)
        return self._made[id]

    def describe(self, path: str) -> str:
        """Registers what a JSON descriptor names: id, uri, reader (a Spark format), options, domain and range."""
        about = json.loads(Path(path).read_text())

        def maker(spark: SparkSession) -> FDataset:
            df: DataFrame = spark.read.format(about.get("reader", "parquet")).options(**about.get("options", {})).load(about["uri"])
            return FDataset(df.select(*about["domain"], *about["range"]), about["domain"], about["range"], about["id"])

        self.register(about["id"], maker)
        return about["id"]
