"""Shards and splits by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.numbers import shard
from tracefold.names import fresh
from tracefold.storage import written

RATIOS = (0.75, 0.08, 0.17)


def shards(df: DataFrame, key: str, n: int = 256) -> DataFrame:
    return df.withColumn("shard_id", shard(F.col(key), n))


def numbered_in_order(df: DataFrame, order: Sequence[Column], number: str = "_rn", rows: str = "_n") -> DataFrame:
    """df with each row's number from 1 in a total order and the number of rows, without a task that sees all of them.

    The two names must be new; no other column of df, whatever its name, is touched.
    """
    if clash := {number.lower(), rows.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at_name = fresh(df, "_at")
    ranged = written(spread.withColumn(at_name, F.monotonically_increasing_id()), "ranges")
    part_name, base_name = (fresh(ranged, x) for x in ("_part", "_base"))
    part, at = F.shiftright(at_name, 33), F.col(at_name).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias(part_name)).agg(F.count(F.lit(1)).alias("size"))  # a row per range
    w = Window.orderBy(part_name)
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = sizes.select(part_name, F.coalesce(F.sum("size").over(before), F.lit(0)).alias(base_name), F.sum("size").over(whole).alias(rows))
    placed = ranged.withColumn(part_name, part).join(F.broadcast(base), part_name)
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), F.col(rows), (F.col(base_name) + at + 1).alias(number))


def by_time(df: DataFrame, time: str, sequence: str, ratios: Sequence[float] = RATIOS, within: str | None = None) -> DataFrame:
    """df with `split`: the first floor(n r) rows in time are train, the next val, the rest test; undated rows come last. A column `split` is replaced.

    within: rows are split for each value of that column; else over all. The overall split numbers rows from sorted
    ranges and the sizes of the ranges before, so it needs no single task; the ranges are written once and read twice, so both
    readings see the same ones.
    """
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must add up to 1")
    order = [F.col(time).asc_nulls_last(), F.col(sequence)]
    rn, n = fresh(df, "_rn"), fresh(df, "_n")
    if within:
        w = Window.partitionBy(within)
        numbered = df.withColumns({rn: F.row_number().over(w.orderBy(*order)), n: F.count(F.lit(1)).over(w)})
    else:
        numbered = numbered_in_order(df, order, rn, n)
    first = F.floor(F.col(n).cast("double") * float(ratios[0]))
    second = first + F.floor(F.col(n).cast("double") * float(ratios[1]))
    return numbered.withColumn("split", F.when(F.col(rn) <= first, "train").when(F.col(rn) <= second, "val").otherwise("test")).drop(rn, n)


def split_stats(split: DataFrame, within: str) -> DataFrame:
    """Rows of each split for each value of a column."""
    return split.groupBy(within).agg(*(F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")), F.count(F.lit(1)).alias("total_rows"))


def boundaries(split: DataFrame, time: str) -> DataFrame:
    """First and last time of each split."""
    return split.groupBy("split").agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count(F.lit(1)).alias("rows"))


def split_info(split: DataFrame, time: str) -> DataFrame:
    """One row: train_end, val_end, test_start (the end of val), test_end and the rows of each split.

    An empty train or val split ends where the one before does, and at the last time of all if there is none before.
    """
    last = lambda *names: F.max(F.when(F.col("split").isin(*names), F.col(time)))
    out = split.agg(
        F.coalesce(last("train"), F.max(time)).alias("train_end"),
        F.coalesce(last("train", "val"), F.max(time)).alias("val_end"),
        F.max(time).alias("test_end"),
        *(F.count_if(F.col("split") == s).alias(f"{s}_records") for s in ("train", "val", "test")),
    )
    return out.withColumn("test_start", F.col("val_end")).select("train_end", "val_end", "test_start", "test_end", "train_records", "val_records", "test_records")


def in_time_order(df: DataFrame, *columns: str) -> DataFrame:
    """Rows sorted over all by the columns, nulls last: ranges of the first column, each sorted."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in columns))


def first_in_time(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The first n rows by the columns, nulls last; every task keeps n rows at most."""
    return in_time_order(df, *columns).limit(n)


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by a hash of (key, seed): the same ones in every run; every task passes on n rows at most."""
    name = fresh(df, "_order")
    return df.withColumn(name, F.xxhash64(F.col(key), F.lit(seed))).orderBy(name, key).limit(n).drop(name)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated order."""
    name = fresh(df, "_rn")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) == 1).drop(name)


def balanced_sample(df: DataFrame, group: str, n: int, order: str) -> DataFrame:
    """n rows: max(n / groups, 1) of each group by the order column, then others by it. Tasks pass on only rows that may stay."""
    groups = df.select(group).distinct().count()
    quota = max(n // max(groups, 1), 1)
    name = fresh(df, "_rn")
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col(name) <= n)
    return ranked.orderBy((F.col(name) > quota).cast("int"), order).limit(n).drop(name)


def hold_out(df: DataFrame, column: str, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of other values, rows of these values)."""
    inside = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return df.where(~inside), df.where(inside)
