"""Exact quantiles of whole columns without a task that holds one: sorted ranges of distinct values and the counts before them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.storage import written


def distinct_counts(long: DataFrame) -> DataFrame:
    """(column_name, x, c) of long (column_name, x), nulls left out; written once, in ranges sorted by both."""
    counts = long.where("x is not null").groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("c"))
    ranged = counts.repartitionByRange("column_name", "x").withColumn("_part", F.spark_partition_id())
    return written(ranged, "values")


def of_counts(counts: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(column_name, n, p): the quantiles at these shares, linear between neighbouring ranks, of what `distinct_counts` gave."""
    sizes = counts.groupBy("column_name", "_part").agg(F.sum("c").alias("size"))  # a row per range and column
    before = Window.partitionBy("column_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumns({"before": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(Window.partitionBy("column_name"))}).drop("size")
    within = Window.partitionBy("_part", "column_name").orderBy("x")
    placed = counts.join(F.broadcast(base), ["column_name", "_part"]).withColumn("upto", F.col("before") + F.sum("c").over(within))
    at = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    holds = lambda rank: (rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto"))
    picks = [F.max(F.when(holds(f(at(q))), F.col("x"))).alias(f"{k}{i}") for i, q in enumerate(shares) for k, f in (("lo", F.floor), ("hi", F.ceil))]
    found = placed.groupBy("column_name").agg(F.max("n").alias("n"), *picks)

    def between(i: int, q: float):
        low, high, pos = F.col(f"lo{i}"), F.col(f"hi{i}"), at(q)
        return F.when(low == high, low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)

    return found.select("column_name", "n", F.array(*(between(i, q) for i, q in enumerate(shares))).alias("p"))


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, x) of the columns as doubles; NaN counts as null."""
    value = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), value(c).alias("x")) for c in columns)))
    return df.select(pairs.alias("p")).select("p.*")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Of each column its quantiles; of one without values, nulls."""
    rows = of_counts(distinct_counts(long_form(df, columns)), shares).collect()  # a row per column
    found = {r["column_name"]: [None if x is None or math.isnan(x) else x for x in r["p"]] for r in rows}
    return {c: found.get(c, [None] * len(shares)) for c in columns}
