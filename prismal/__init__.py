"""Functional-data-model analytics on Spark DataFrames."""

from .functions.bins import BinAxis, BinGrid
from .operators.dataset import FDataset, Nested
from .sources.catalog import Catalog

__all__ = ["BinAxis", "BinGrid", "Catalog", "FDataset", "Nested"]
