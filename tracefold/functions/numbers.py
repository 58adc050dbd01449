"""Numeric expressions: safe ratios, clipped logarithms, bins, entropy, stable shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin edges.
COUNT_EDGES = (0, 1, 3, 10, 30)
RATE_EDGES = (0.0, 0.01, 0.2, 0.5, 0.8, 1.0)
GAP_EDGES = (0, 60, 300, 1800, 21600, 86400, 604800)
ENTROPY_EDGES = (0.0, 0.2, 0.8, 1.5, 2.5, 4.0)


def number(c: Column) -> Column:
    """The value as a double; null if it is none."""
    return c.try_cast("double")


def finite(c: Column, default: float = 0.0) -> Column:
    """Null, NaN and infinities become the default."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(default)).otherwise(c)


def log1p(c: Column | str) -> Column:
    """Of a column or, for plans of hundreds of columns, of a name: one expression text instead of a call for each of its parts. So with the bins."""
    if isinstance(c, str):
        return F.expr(f"log1p(greatest(`{c}`, 0.0D))")
    return F.log1p(F.greatest(c, F.lit(0.0)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def clip(c: Column, low: float = 0.0, high: float = 1000.0) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _bin_text(c: str, edges: Sequence[float], op: str) -> Column:
    return F.expr(" + ".join(f"cast({c} {op} {e if isinstance(e, int) else f'{e!r}D'} as int)" for e in edges))


def bin_left(c: Column | str, edges: Sequence[float]) -> Column:
    """How many edges are at or below the value."""
    if isinstance(c, str):
        return _bin_text(f"`{c}`", edges, ">=")
    out = F.lit(0)
    for e in edges:
        out = out + (c >= F.lit(e)).cast("int")
    return out


def bin_right(c: Column, edges: Sequence[float]) -> Column:
    """How many edges are below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + (c > F.lit(e)).cast("int")
    return out


def count_bin(c: Column | str) -> Column:
    return bin_left(c, COUNT_EDGES)


def gap_bin(c: Column | str) -> Column:
    return bin_left(c, GAP_EDGES)


def rate_bin(c: Column | str) -> Column:
    if isinstance(c, str):
        return _bin_text(f"least(greatest(`{c}`, 0.0D), 1.0D)", RATE_EDGES, ">")
    return bin_right(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), RATE_EDGES)


def entropy_bin(c: Column | str) -> Column:
    return bin_left(c, ENTROPY_EDGES)


def list_entropy(values: Column) -> Column:
    """Shannon entropy (bits) of an array's values, 0 if empty. 1e-10 inside the logarithm, so one value gives just below 0."""
    n = F.size(values)
    share = lambda v: F.size(F.filter(values, lambda x: x == v)) / n
    parts = F.transform(F.array_distinct(values), lambda v: share(v) * F.log2(share(v) + 1e-10))
    return F.when(n > 0, -F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def shard(key: Column, shards: int) -> Column:
    """A shard number that is the same in every run."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(shards)).cast("int")


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(c, -30.0, 30.0)))


# Upper ends of scale buckets.
RANGES = ((1.0, "range_le_1"), (10.0, "range_1_to_10"), (100.0, "range_10_to_100"), (1e3, "range_100_to_1e3"), (1e4, "range_1e3_to_1e4"), (1e6, "range_1e4_to_1e6"))


def range_bucket(max_abs: Column, least: Column) -> Column:
    """The scale of a column with this largest absolute value and least value."""
    out = F.when(least < 0, F.lit("signed"))
    for high, name in RANGES:
        out = out.when(max_abs <= high, F.lit(name))
    return out.otherwise(F.lit("range_gt_1e6"))


# Upper ends of orders of magnitude.
MAGNITUDES = ((1.0, "10^0_or_less"), (10.0, "10^1"), (100.0, "10^2"), (1e3, "10^3"), (1e4, "10^4"), (1e5, "10^5"), (1e6, "10^6"))


def magnitude_group(max_abs: Column) -> Column:
    out = F.when(max_abs <= MAGNITUDES[0][0], F.lit(MAGNITUDES[0][1]))
    for high, name in MAGNITUDES[1:]:
        out = out.when(max_abs <= high, F.lit(name))
    return out.otherwise(F.lit("gt_10^6"))
