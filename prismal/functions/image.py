"""Intensities: rescaling, percentile stretch, bytes and packed colours. NaN counts as missing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of a pass over the values, and values that are sorted at once.
RANGES, SORTED = 1024, 100_000


def clean(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def percentiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Exact percentiles of columns, interpolated between the nearest ranks, at (n - 1) * p; None without values.

    Passes over the data: counts of RANGES ranges, partial before they shuffle, tell in which range a rank is, until so few
    values are left there that they can be sorted. No task holds a column's distinct values.
    """
    if any(not 0 <= p <= 1 for ps in wanted.values() for p in ps):
        raise ValueError("a percentile is between 0 and 1")
    ends = df.agg(*[f(clean(F.col(c).cast("double"))).alias(f"{n}{i}") for i, c in enumerate(wanted) for n, f in (("low", F.min), ("high", F.max), ("n", F.count))]).first()
    out: dict[str, list[float | None]] = {}
    for i, (column, ps) in enumerate(wanted.items()):
        low, high, n = (ends[f"{k}{i}"] for k in ("low", "high", "n"))
        values = df.select(clean(F.col(column).cast("double")).alias("v")).filter("v is not null")
        ranks = {k for p in ps for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))} if n else set()
        found = _at_ranks(values, sorted(ranks), low, high, n)
        places = [(n - 1) * p for p in ps]
        out[column] = [None if not n else _between(found[math.floor(x)], found[math.ceil(x)], x) for x in places]
    return out


def _between(low: float, high: float, place: float) -> float:
    return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high


def _at_ranks(values: DataFrame, ranks: list[int], low: float, high: float, n: int) -> dict[int, float]:
    """The values of the column v, all within low and high, that have these ranks."""
    if not ranks or low == high:
        return dict.fromkeys(ranks, low)
    step = high / RANGES - low / RANGES
    if n <= SORTED or not low < low + step < high or not math.isfinite(step):
        rows = values.groupBy("v").count().orderBy("v") if n > SORTED else values.orderBy("v").withColumn("count", F.lit(1))
        out, before = {}, 0
        for row in rows.toLocalIterator():  # few values, or many copies of few
            while len(out) < len(ranks) and ranks[len(out)] < before + row["count"]:
                out[ranks[len(out)]] = row["v"]
            before += row["count"]
            if len(out) == len(ranks):
                break
        return out
    at = F.least(F.greatest(F.floor((F.col("v") - low) / step), F.lit(0)), F.lit(RANGES - 1))
    about = values.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    out, before = {}, 0
    for row in sorted(about.collect(), key=lambda r: r["at"]):  # RANGES rows at most
        own = [k for k in ranks if before <= k < before + row["n"]]
        if own:
            inside = values.filter((F.col("v") >= row["low"]) & (F.col("v") <= row["high"]))
            out |= {k + before: v for k, v in _at_ranks(inside, [k - before for k in own], row["low"], row["high"], row["n"]).items()}
        before += row["n"]
    return out


def rescale(c, low, high, out_low: float, out_high: float) -> Column:
    """Linear from low..high to out_low..out_high, clamped; a range of no width gives out_low."""
    c = F.col(c) if isinstance(c, str) else c
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    width = F.when(high > low, high - low)
    inside = F.lit(float(out_low)) + (c - low) / width * F.lit(float(out_high) - float(out_low))
    return F.when(F.isnan(c), c).when(width.isNull() | (c <= low), F.lit(float(out_low))).when(c >= high, F.lit(float(out_high))).otherwise(inside)


def with_stretch(df: DataFrame, columns: list[str], p: float) -> DataFrame:
    """Each column stretched from its own percentiles p and 1 - p, which are computed here, to 0..1: a projection."""
    if not 0 <= p < 0.5:
        raise ValueError("a stretch is at least 0 and under 0.5")
    edges = percentiles(df, {c: [p, 1 - p] for c in columns})
    of = lambda c: [F.lit(e).cast("double") for e in edges[c]]
    return df.select(*[rescale(c, *of(c), 0, 1).alias(c) if c in edges else c for c in df.columns])


def to_byte(c, low, high) -> Column:
    """low..high to -128..127, truncated; NaN and null are 0."""
    return F.coalesce(clean(rescale(c, low, high, -128, 127)), F.lit(0.0)).cast("int").cast("tinyint")


def to_level(c, low, high) -> Column:
    """low..high to 0..255, truncated; NaN and null are 0."""
    return F.coalesce(clean(rescale(c, low, high, 0, 255)), F.lit(0.0)).cast("int")


def packed_argb(r, g, b) -> Column:
    """Opaque colour in one signed int, from levels."""
    r, g, b = (F.col(x) if isinstance(x, str) else x for x in (r, g, b))
    return F.lit(-16777216) + r * 65536 + g * 256 + b
