"""Datasets as functions from coordinates to values, over lazy DataFrames.

A flat dataset has columns of its domain and of its range. A curried one has the first coordinates as columns and an
array of structs of all the rest. Nothing is sorted until a sink asks for an order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.bins import BinAxis, BinGrid
from ..functions.transforms import Transform, transform_for
from .ranks import ranked

_NAN = float("nan")
_OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


@dataclass(frozen=True)
class Nested:
    """The array column of a curried dataset, and the names of its structs' fields."""

    column: str
    domain: list[str]
    range: list[str]


@dataclass(frozen=True)
class FDataset:
    df: DataFrame
    domain: list[str]
    range: list[str]
    id: str = ""
    nested: Nested | None = field(default=None)
    dropped: tuple[DataFrame, DataFrame, int] | None = field(default=None, repr=False, compare=False)

    def __post_init__(self):
        nested = [self.nested.column] if self.nested else []
        if missing := [c for c in (*self.domain, *self.range, *nested) if c not in self.df.columns]:
            raise ValueError(f"no columns {missing} in {self.df.columns}")

    @property
    def arity(self) -> int:
        return len(self.domain)

    @property
    def columns(self) -> list[str]:
        return [*self.domain, *self.range, *([self.nested.column] if self.nested else [])]

    def _with(self, df: DataFrame, **kw) -> FDataset:
        return replace(self, df=df, **kw)

    # Filters

    def filter(self, predicate: Column | str) -> FDataset:
        return self._with(self.df.filter(predicate))

    def select(self, expression: str) -> FDataset:
        """A selection as text: `name op value`."""
        from ..plans.query import parse_selection

        return self.select_op(*parse_selection(expression))

    def select_op(self, name: str, op: str, value) -> FDataset:
        """=~ and !=~ match whole values against a pattern; ~ keeps the samples nearest to a number."""
        if name not in (*self.domain, *self.range):
            raise ValueError(f"{name} is no scalar of this dataset; samples within nested functions can't be selected")
        c = F.col(name)
        if op in ("=~", "!=~"):
            hit = c.cast("string").rlike(f"^(?:{value})$")
            return self.filter(hit if op == "=~" else ~hit)
        kind = dict(self.df.dtypes)[name]
        if kind != "string" and isinstance(value, str):
            value = float(value)
            if kind in ("tinyint", "smallint", "int", "bigint") and value.is_integer():
                value = int(value)  # of the column's kind, so that the scan can use it
        if op == "~":
            best = self.df.agg(F.min_by(c, F.struct(F.abs(c - float(value)), c)).alias("_nearest"))
            return self._with(self.df.join(F.broadcast(best), c == F.col("_nearest"), "left_semi"))  # one row
        return self.filter(_OPERATORS[op](c, F.lit(value)))

    def contains(self, name: str, *values) -> FDataset:
        return self.filter(F.col(name).isin(*values))

    def gbox(self, lon1: float, lat1: float, lon2: float, lat2: float, scale: float = 1.0, names: tuple[str, str] = ("ix", "iy")) -> FDataset:
        """Pixels of a box of a geostationary image. The corners' pixels are literals, so the filter reaches the scan."""
        y2, x1 = geo.index_of(lat1, lon1, scale)
        y1, x2 = geo.index_of(lat2, lon2, scale)
        x1, x2, y1, y2 = (int(v + 0.5) for v in (x1, x2, y1, y2))
        ix, iy = map(F.col, names)
        return self.filter((ix >= x1) & (ix < x2) & (iy >= y1) & (iy < y2))

    def stride(self, *steps: int, first: tuple[int, ...] | None = None, index: bool = True) -> FDataset:
        """Every n-th value of each coordinate. Without index, values are ranked, for which the distinct ones are sorted in ranges."""
        names, out = self.domain[: len(steps)], self.df
        for i, (name, step) in enumerate(zip(names, steps, strict=True)):
            if index:
                out = out.filter(F.pmod(F.col(name) - (first[i] if first else 0), F.lit(step)) == 0)
            else:
                ranks = ranked(out.select(name).distinct(), name, "_rank")
                out = out.join(ranks.filter(F.col("_rank") % step == 0).drop("_rank"), name, "left_semi")
        return self._with(out)

    def project(self, *names: str) -> FDataset:
        """The domain stays; of the range, the named variables do."""
        kept = [c for c in self.range if c in names]
        return replace(self, df=self.df.select(*self.domain, *kept), range=kept, nested=None)

    def _order(self) -> list[str] | None:
        """All columns, coordinates first: an order in which only copies are alike. None if there are columns without an order."""
        rest = [c for c in self.df.columns if c not in self.domain]
        return None if any("map<" in kind or "variant" in kind or "interval" == kind for _, kind in self.df.dtypes) else [*self.domain, *rest]

    def _undropped(self) -> tuple[DataFrame, int]:
        """What drop() was called on, and how many it dropped, if no other step came since."""
        return self.dropped[1:] if self.dropped and self.dropped[0] is self.df else (self.df, 0)

    def take(self, n: int) -> FDataset:
        """The first n samples: each task keeps as many (after drop(), those dropped as well), and so does the one that joins theirs."""
        df, gone = self._undropped()
        return self._with(df.orderBy(*(self._order() or self.domain)).offset(gone).limit(n))

    def drop(self, n: int) -> FDataset:
        """All but the first n samples, in no order: a filter by the last of those, which are found as in take(). No task sees all samples."""
        if n <= 0:
            return self
        (df, gone), order = self._undropped(), self._order()
        if order is None:
            return self._with(self.df.orderBy(*self.domain).offset(n))
        key, columns = F.struct(*[F.col(f"`{c}`") for c in order]), df.columns
        head = df.select(key.alias("_key")).orderBy("_key").limit(gone + n)
        edge = head.groupBy(F.col("_key").alias("_edge")).agg(F.count(F.lit(1)).alias("_gone")).orderBy(F.desc("_edge")).limit(1)
        met = df.select(key.alias("_key")).crossJoin(F.broadcast(edge))  # one row
        fields = [F.col("_key")[c].alias(c) for c in columns]
        # Copies of the last one that stay: counted, and made again.
        copies = met.filter(F.col("_key") == F.col("_edge")).groupBy("_edge", "_gone").agg(F.count(F.lit(1)).alias("_all")).select(F.col("_edge").alias("_key"), (F.col("_all") - F.col("_gone")).alias("_left")).filter("_left > 0")
        copies = copies.select("_key", "_left", F.explode(F.expr("sequence(0L, (_left - 1) div 65536)")).alias("_block")).select("_key", F.explode(F.expr("sequence(1L, least(65536L, _left - 65536 * _block))")))
        left = met.filter(F.col("_key") > F.col("_edge")).select(*fields).unionByName(copies.select(*fields))
        return self._with(left, dropped=(left, df, gone + n))

    def first(self) -> FDataset:
        return self.take(1)

    # Restructuring

    def uncurry(self) -> FDataset:
        """Narrow: an inline of the arrays. What curry() made of flat samples without a step between is read back as it was."""
        if self.nested is None:
            return self
        n = self.nested
        df = self.df.select(*self.domain, *self.range, F.inline(n.column))
        return FDataset(df, [*self.domain, *n.domain], [*self.range, *n.range], self.id)

    def curry(self, n: int, column: str = "samples") -> FDataset:
        """One row for each value of the first n coordinates; one shuffle by these."""
        if not 0 < n < self.arity:
            raise ValueError(f"curry({n}) of {self.arity} coordinates")
        inner = self.domain[n:]
        arrays = F.array_sort(F.collect_list(F.struct(*inner, *self.range))).alias(column)
        return FDataset(self.df.groupBy(*self.domain[:n]).agg(arrays), self.domain[:n], [], self.id, Nested(column, inner, self.range))

    def group_by_variable(self, *names: str, column: str = "samples") -> FDataset:
        """All coordinates: another order of the domain, without a shuffle. Some: grouped by them, the others nested."""
        flat = self.uncurry()
        rest = [c for c in flat.domain if c not in names]
        ordered = FDataset(flat.df.select(*names, *rest, *flat.range), [*names, *rest], flat.range, self.id)
        return ordered if not rest else ordered.curry(len(names), column)

    def transpose(self, column: str = "samples", flat: bool = False) -> FDataset:
        """a -> (b, c) -> f to (b, c) -> a -> f; flat, to (b, c, a) -> f, without a shuffle and without an array of all that a (b, c) has."""
        if self.nested is None:
            raise ValueError("a curried dataset is asked for")
        outer = self.domain if flat else []
        return self.group_by_variable(*self.nested.domain, *outer, column=column)

    def pivot(self, values: list, names: list[str], variable: str | None = None, agg: Callable[[Column], Column] = F.max) -> FDataset:
        """The range at each value of a variable, by conditional aggregates in one shuffle; missing ones are null. agg joins samples of one key, as F.sum."""
        flat = self.uncurry()
        variable = variable or flat.domain[-1]
        keys, value = [c for c in flat.domain if c != variable], flat.range[0]
        # A domain value is in a function once, which max() picks.
        aggs = [agg(F.when(F.col(variable) == F.lit(v), F.col(value))).alias(n) for v, n in zip(values, names, strict=True)]
        needed = flat.df.filter(F.col(variable).isin(*values))
        return FDataset(needed.groupBy(*keys).agg(*aggs), keys, list(names), self.id)

    def rgb_pivot(self, r, g, b, variable: str | None = None) -> FDataset:
        return self.pivot([r, g, b], ["r", "g", "b"], variable)

    def rename(self, id: str) -> FDataset:
        return replace(self, id=id)

    def rename_variable(self, old: str, new: str) -> FDataset:
        named = [new if c == old else c for c in self.domain], [new if c == old else c for c in self.range]
        return replace(self, df=self.df.withColumnRenamed(old, new), domain=named[0], range=named[1])

    def xy_transform(self, x: str = "x", y: str = "y") -> FDataset:
        """Push-broom indices (ix, iy) to metres."""
        return self.substitute_by([self.domain[0], self.domain[1]], [x, y], lambda ix, iy: geo.scene_xy(ix, iy))

    # Combining functions

    def substitute(self, table: FDataset, how: str = "inner") -> FDataset:
        """The table's domain, part of this one's, is replaced by the table's range. Unmatched samples go, or keep nulls with how="left".

        Spark broadcasts the table if its measured size allows; else both sides are shuffled by the key.
        """
        at = self.domain.index(table.domain[0])
        kept = [c for c in self.domain if c not in table.domain]
        at = min(at, len(kept))
        domain = [*kept[:at], *table.range, *kept[at:]]
        joined = self.df.join(table.df.select(*table.domain, *table.range), table.domain, how)
        nested = [self.nested.column] if self.nested else []
        return replace(self, df=joined.select(*domain, *self.range, *nested), domain=domain)

    def substitute_by(self, old: list[str], new: list[str], f: Callable[..., tuple[Column, ...]], once: bool = False) -> FDataset:
        """As substitute(), by a formula on the old coordinates; no join.

        once: for long formulas, which what follows isn't to repeat: they are computed behind a border for the optimizer.
        """
        made = dict(zip(new, f(*map(F.col, old)), strict=True))
        at = self.domain.index(old[0])
        kept = [c for c in self.domain if c not in old]
        domain = [*kept[:at], *new, *kept[at:]]
        nested = [self.nested.column] if self.nested else []
        if once:
            rest = [c for c in (*domain, *self.range, *nested) if c not in made]
            df = self.df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()])))).select(*domain, *self.range, *nested)
            return replace(self, df=df, domain=domain)
        df = self.df.select(*[made[c].alias(c) if c in made else F.col(c) for c in domain], *self.range, *nested)
        return replace(self, df=df, domain=domain)

    def substitute_nested(self, table: FDataset) -> FDataset:
        """The table's domain within nested functions, as a swath's pixels, is replaced by its range: k -> (a, b) -> f to k -> (lon, lat) -> f.

        The samples are joined flat and nested again, one shuffle by the outer coordinates; uncurry() undoes that for nothing.
        """
        if self.nested is None or not set(table.domain) <= set(self.nested.domain):
            raise ValueError(f"no nested domain with {table.domain}")
        flat = self.uncurry().substitute(table)
        return flat.group_by_variable(*self.domain, *[c for c in flat.domain if c not in self.domain]).curry(self.arity, self.nested.column)

    def transformed(self, transform: Transform) -> FDataset:
        """The first two coordinates by a named transform."""
        return self.substitute_by(self.domain[:2], list(transform.new), transform.to, once=True)

    def compose(self, f: Callable[[Column], dict[str, Column]]) -> FDataset:
        """A computed dataset applied to the range: of a nested function, or of one variable."""
        made = f(F.col(self.nested.column if self.nested else self.range[0]))
        return FDataset(self.df.select(*self.domain, *[c.alias(n) for n, c in made.items()]), self.domain, list(made), self.id)

    def make_rgb(self, r: float, g: float, b: float) -> FDataset:
        """(r, g, b) of each spectrum at three wavelengths, by equality; all are NaN if one is missing.

        Flat samples need no arrays: conditional sums in one shuffle, as in pivot().
        """
        if self.nested:
            return self.compose(lambda spectrum: rgb_of(spectrum, self.nested.domain[0], self.nested.range[0], (r, g, b)))
        keys, w, v = self.domain[:-1], F.col(self.domain[-1]), F.col(self.range[0])
        found = self.df.groupBy(*keys).agg(*[F.max(F.when(w == F.lit(float(x)), v)).alias(n) for x, n in zip((r, g, b), "rgb", strict=True)])
        whole = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
        return FDataset(found.select(*keys, *[F.when(whole, F.col(n)).otherwise(_NAN).cast("double").alias(n) for n in "rgb"]), keys, ["r", "g", "b"], self.id)

    def eval(self, *values, strict: bool = False, grid: BinGrid | None = None) -> FDataset:
        """The sample at a place: an equality filter, which reaches the scan. With a grid, at the node of its bin."""
        if grid:
            found = [a.index_of(v) for a, v in zip(grid.axes, values, strict=True)]
            values = [None if i is None else a.start + i * a.step for a, i in zip(grid.axes, found, strict=True)]
        hit = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(self.domain, values, strict=True)])
        out = self._with(self.df.filter(hit).limit(1))
        if strict and out.df.isEmpty():
            raise LookupError(f"no sample at {values}")
        return out

    def natural_join(self, other: FDataset, how: str = "inner") -> FDataset:
        """a -> b and a -> c to a -> (b, c)."""
        if self.domain != other.domain:
            raise ValueError(f"domains {self.domain} and {other.domain}")
        if clash := set(self.range) & set(other.range):
            raise ValueError(f"both have {sorted(clash)}")
        return replace(self, df=self.df.join(other.df.select(*other.domain, *other.range), self.domain, how), range=[*self.range, *other.range])

    def _neighbours(self, at: DataFrame, place: str) -> DataFrame:
        """Places of a table beside the samples before and after them.

        The last coordinate is cut into ranges of about as many samples, so that one key of the domain's other
        coordinates is sorted by many tasks. What a range lacks comes from the nearest one with a sample, of which
        there is a row for each key and range.
        """
        x, *keys = self.domain[::-1]
        sample = F.struct(F.col(x).alias("x"), *self.range)
        cuts = self._cuts(x)

        def cut(c: Column, low: int = 0, high: int = len(cuts)) -> Column:  # by halves
            mid = (low + high) // 2
            return F.lit(low) if low == high else F.when(c < cuts[mid], cut(c, low, mid)).otherwise(cut(c, mid + 1, high))

        rows = self.df.select(*keys, F.col(x).cast("double").alias("_at"), sample.alias("_s"), F.lit(None).cast("double").alias(place))
        asked = at.select(*keys, F.col(place).cast("double").alias("_at"), F.lit(None).cast(rows.schema["_s"].dataType).alias("_s"), F.col(place).cast("double").alias(place))
        both = rows.unionByName(asked).withColumn("_cut", cut(F.col("_at")))
        up = Window.partitionBy(*keys, "_cut").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy(*keys, "_cut").orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
        near = both.select(*keys, "_cut", place, F.last("_s", True).over(up).alias("_before"), F.last("_s", True).over(down).alias("_after")).filter(F.col(place).isNotNull())
        where = F.when(F.col("_s").isNotNull(), F.col("_at"))
        edges = both.groupBy(*keys, "_cut").agg(F.max_by("_s", where).alias("_high"), F.min_by("_s", where).alias("_low"))
        earlier = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(*keys).orderBy(F.col("_cut").desc()).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_cut").alias("_of"), F.last("_high", True).over(earlier).alias("_earlier"), F.last("_low", True).over(later).alias("_later"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_cut") == F.col("_of"))
        return near.join(edges, same).select(*keys, place, F.coalesce("_before", "_earlier").alias("before"), F.coalesce("_after", "_later").alias("after"))

    def _cuts(self, x: str, most: int = 200) -> list[float]:
        """Ends of ranges with about as many values of a coordinate each, from one pass; as many ranges as shuffles have partitions."""
        n = min(most, int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        number = self.df.select(F.col(x).cast("double").alias("x")).filter("x is not null and not isnan(x)")
        return sorted(set(number.approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []

    def nearest(self, at: DataFrame, place: str) -> FDataset:
        """For each place, the sample nearest along the last coordinate; the lower of two as near."""
        found = self._neighbours(at, place)
        low, high = F.col(place) - F.col("before.x"), F.col("after.x") - F.col(place)
        s = F.when(F.col("after").isNull() | (low <= high), F.col("before")).otherwise(F.col("after"))
        keys = self.domain[:-1]
        return FDataset(found.select(*keys, place, *[s[c].alias(c) for c in self.range]), [*keys, place], self.range, self.id)

    def linear(self, at: DataFrame, place: str) -> FDataset:
        """For each place, the range interpolated between its neighbours; null outside."""
        found = self._neighbours(at, place)
        a, b = F.col("before.x").cast("double"), F.col("after.x").cast("double")
        part = F.when(b > a, (F.col(place) - a) / F.nullif(b - a, F.lit(0.0))).when(a == b, F.lit(0.0))
        keys = self.domain[:-1]
        out = [(F.col(f"before.{c}") + part * (F.col(f"after.{c}") - F.col(f"before.{c}"))).alias(c) for c in self.range]
        return FDataset(found.select(*keys, place, *out), [*keys, place], self.range, self.id)

    def nodes(self, grid: BinGrid) -> DataFrame:
        """The samples on a grid's nodes, with their indices i0 and i1: a cell-centred look-up of the grid's places."""
        a, b = (replace(axis, center=True).index(c) for axis, c in zip(grid.axes, self.domain, strict=True))
        return self.df.select(a.alias("i0"), b.alias("i1"), *self.range).filter("i0 is not null and i1 is not null")

    def nearest_2d(self, at: DataFrame, places: tuple[str, str], grid: BinGrid) -> FDataset:
        """For each place, the sample of the grid's node that is nearest along both axes (halves go up); places off the grid drop out. One equi-join."""
        indices = [replace(axis, center=True).index(c).alias(f"i{k}") for k, (axis, c) in enumerate(zip(grid.axes, places, strict=True))]
        found = at.select(*places, *indices).join(self.nodes(grid), ["i0", "i1"])
        return FDataset(found.select(*places, *self.range), list(places), self.range, self.id)

    def bilinear(self, at: DataFrame, places: tuple[str, str], grid: BinGrid) -> FDataset:
        """For each place, the range interpolated between the four nodes around it; null outside and beside missing nodes.

        Each place meets its corners in one equi-join by their indices; corners without weight aren't asked for.
        """
        offsets = [(F.col(c).cast("double") - axis.start) / axis.step for axis, c in zip(grid.axes, places, strict=True)]
        low = [F.least(F.floor(o), F.lit(axis.count - 1)) for axis, o in zip(grid.axes, offsets, strict=True)]
        part = [o - i for o, i in zip(offsets, low, strict=True)]
        corners = [F.struct((low[0] + i).alias("i0"), (low[1] + j).alias("i1"), ((part[0] if i else 1 - part[0]) * (part[1] if j else 1 - part[1])).alias("w")) for i in (0, 1) for j in (0, 1)]
        asked = at.select(*places).distinct().select(*places, F.inline(F.filter(F.array(*corners), lambda c: c["w"] != 0)))
        nodes = self.nodes(grid).withColumn("_there", F.lit(1))
        met = asked.join(nodes, ["i0", "i1"], "left").groupBy(*places)
        sums = [F.when(F.count(F.lit(1)) == F.count("_there"), F.sum(F.col("w") * F.col(c))).alias(c) for c in self.range]
        return FDataset(met.agg(*sums), list(places), self.range, self.id)

    def union(self, other: FDataset, distinct: bool = False) -> FDataset:
        """Samples of both; copies stay unless distinct."""
        both = self.df.select(*self.columns).unionByName(other.df.select(*self.columns))
        return self._with(both.distinct() if distinct else both)

    # Gridding

    def group_by_bin(self, grid: BinGrid, aggs: dict[str, Column] | None = None, by: list[str] | None = None, keep: list[str] | None = None, first: Column | None = None) -> FDataset:
        """Samples by bin, one shuffle with partial sums; those outside are dropped before it. Keys are the nodes.

        by: the binned coordinates, by default the last ones; other coordinates in keep stay keys. Without aggs the
        first sample of a bin counts: by the order `first` if given, then its coordinates and its range.
        """
        by = by or self.domain[-len(grid.axes) :]
        keep = keep if keep is not None else [c for c in self.domain if c not in by]
        binned = self.df
        for axis, c in zip(grid.axes, by, strict=True):
            binned = binned.withColumn(f"_bin_{c}", axis.index(c))
        binned = binned.filter(reduce(lambda a, b: a & b, [F.col(f"_bin_{c}").isNotNull() for c in by]))
        order = F.struct(*([] if first is None else [first.alias("_first")]), *by, *[F.col(c) for c in self.range])
        aggs = aggs or {c: F.min_by(F.col(c), order) for c in self.range}
        found = binned.groupBy(*keep, *[f"_bin_{c}" for c in by]).agg(*[a.alias(n) for n, a in aggs.items()])
        nodes = [axis.node(F.col(f"_bin_{c}")).alias(c) for axis, c in zip(grid.axes, by, strict=True)]
        return FDataset(found.select(*keep, *nodes, *aggs), [*keep, *by], list(aggs), self.id)

    def nearest_in_bin(self, grid: BinGrid, by: list[str] | None = None) -> FDataset:
        """The sample nearest to the middle of each bin; ties go to the least coordinates."""
        by = by or self.domain[-len(grid.axes) :]
        dist = F.lit(0.0)
        for axis, c in zip(grid.axes, by, strict=True):
            off = F.col(c).cast("double") - axis.node(axis.index(c)) - F.lit(0.0 if axis.center else axis.step / 2)
            dist = dist + off * off
        order = F.struct(dist, *by, *self.range)
        return self.group_by_bin(grid, {c: F.min_by(F.col(c), order) for c in self.range}, by)

    def resample(self, grid: BinGrid) -> FDataset:
        return self.uncurry().group_by_bin(grid) if self.nested is None else self._resample_curried(grid)

    def _resample_curried(self, grid: BinGrid, first: Column | None = None) -> FDataset:
        """Whole nested functions go to the bins of the outer coordinates."""
        column = self.nested.column
        as_range = FDataset(self.df, self.domain, [column], self.id)
        return replace(as_range.group_by_bin(grid, first=first), nested=self.nested, range=[])

    def resample_range(self, grid: BinGrid) -> FDataset:
        """Each nested function is resampled: its outer coordinates join the key of the group."""
        return self.uncurry().group_by_bin(grid)

    def geo_subset(self, low: tuple[float, float], high: tuple[float, float], count: int, transform: Transform | FDataset | None = None, first: Column | None = None) -> FDataset:
        """Resampled on a longitude-latitude grid of about `count` cells; the first sample of a cell counts, by the order `first` of the new coordinates if given.

        Datasets of more than two coordinates are curried, so that whole spectra go to their cells. Unless the first
        coordinate is a longitude, the first two are replaced: by `transform`, a formula or a table of a swath's
        pixels, or by what the dataset's id asks for.
        """
        ds = self.curry(2) if self.nested is None and self.arity > 2 else self
        if not ds.domain[0].lower().startswith("lon"):
            found = transform if transform is not None else transform_for(ds.id, ds.domain[0])
            ds = ds.substitute(found) if isinstance(found, FDataset) else ds.transformed(found)
        grid = BinGrid.from_extents(low, high, count)
        return ds.group_by_bin(grid, by=ds.domain[:2], first=first) if ds.nested is None else ds._resample_curried(grid, first)

    def bounding_box(self, low: tuple[float, float], high: tuple[float, float], shape: int | tuple[int, int]) -> FDataset:
        grid = BinGrid.from_extents(low, high, shape) if isinstance(shape, int) else BinGrid.of_shape(low, high, shape)
        return self.resample(grid)

    # Order, partitions and caches

    def ordered(self) -> FDataset:
        return self._with(self.df.orderBy(*self.domain))

    def partition_by_range(self, n: int) -> FDataset:
        return self._with(self.df.repartitionByRange(n, self.domain[0]))

    def partition_by_set(self, axis: BinAxis, n: int) -> FDataset:
        return self._with(self.df.repartition(n, F.coalesce(axis.index(self.domain[0]), F.lit(axis.count))))

    def cached(self) -> FDataset:
        """Computed and kept; release() lets it go."""
        df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        return self._with(df)

    def release(self) -> FDataset:
        self.df.unpersist()
        return self

    @staticmethod
    def from_samples(spark: SparkSession, samples: list[tuple], schema: str, arity: int, id: str = "") -> FDataset:
        """Of local samples, dealt out by ranges of the first coordinate; the first `arity` columns of the schema are the domain."""
        df = spark.createDataFrame(samples, schema)
        ds = FDataset(df, df.columns[:arity], df.columns[arity:], id)
        n = min(max(1, len(samples)), spark.sparkContext.defaultParallelism)
        return ds.partition_by_range(n) if samples else ds

    def as_view(self, name: str) -> FDataset:
        self.df.createOrReplaceTempView(name)
        return replace(self, id=name)

    def collect(self) -> list:
        return self.ordered().df.collect()

    def count(self) -> int:
        return self.df.count()

    def map_range(self, **columns: Column) -> FDataset:
        """New values of variables of the range; keys and partitioning stay."""
        return replace(self, df=self.df.withColumns(columns), range=[*self.range, *[c for c in columns if c not in self.range]])

    def transform(self, f: Callable[[DataFrame], DataFrame], domain: list[str] | None = None, range: list[str] | None = None) -> FDataset:
        return FDataset(self.df.transform(f), domain or self.domain, self.range if range is None else range, self.id)

    def _repr_png_(self) -> bytes | None:
        """What a notebook shows of an image; other datasets have their text."""
        from ..sinks import image

        return image.encode(self) if self.nested is None and self.arity == 2 and len(self.range) in (1, 3) else None

    def info(self) -> str:
        inner = f" -> ({', '.join(self.nested.domain)}) -> ({', '.join(self.nested.range)})" if self.nested else ""
        return f"{self.id or 'dataset'}: ({', '.join(self.domain)})" + (f" -> ({', '.join(self.range)})" if self.range else "") + inner


def rgb_of(spectrum: Column, wavelength: str, value: str, at: tuple[float, float, float]) -> dict[str, Column]:
    """Three values of an array of structs, found by equality; all NaN if one is missing."""

    def value_at(x: float) -> Column:
        return F.get(F.filter(spectrum, lambda s: s[wavelength] == F.lit(float(x))), F.lit(0))[value].cast("double")

    found = [value_at(x) for x in at]
    whole = found[0].isNotNull() & found[1].isNotNull() & found[2].isNotNull()
    return {n: F.when(whole, c).otherwise(_NAN) for n, c in zip("rgb", found, strict=True)}


def rgb_at(values: str, positions: tuple[int | None, int | None, int | None]) -> dict[str, Column]:
    """As rgb_of() for a dense array whose positions are known: no generator and no shuffle."""
    found = [F.lit(None).cast("double") if p is None else F.get(F.col(values), F.lit(p)).cast("double") for p in positions]
    whole = found[0].isNotNull() & found[1].isNotNull() & found[2].isNotNull()
    return {n: F.when(whole, c).otherwise(_NAN) for n, c in zip("rgb", found, strict=True)}
