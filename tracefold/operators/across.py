"""Joins of tables by entity and time: the latest row before, and all rows near.

`as_of` puts both tables in one order and carries the last right row along, so nothing is paired and each row moves once. `near` pairs rows within a bounded
distance through buckets of time as wide as that distance: a left row looks into its own bucket and the neighbours it reaches, a right row stands in one.

An entity with a large share of all rows need not be one task: `near` spreads it over its buckets, and `as_of` can cut it into pieces of time
(`cut`), where the last right row of the pieces before comes in by a join with a row a piece.

Rows without an entity or a time match nothing; left rows are all kept by `as_of`. Times may be timestamps or numbers, the same kind on both sides.
Columns that the right table brings get a suffix where the left has the name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(df: DataFrame, time: str) -> Column:
    """Microseconds of a timestamp; a number as it is."""
    kind = df.schema[time].dataType.typeName()
    return F.unix_micros(F.col(f"`{time}`").cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(f"`{time}`").cast("long")


def _renamed(left: DataFrame, right: DataFrame, suffix: str) -> list[tuple[str, str]]:
    """(column of right, its name beside left's)."""
    taken, out = {c.lower() for c in left.columns}, []
    for c in right.columns:
        name = c
        while name.lower() in taken:
            name += suffix
        taken.add(name.lower())
        out.append((c, name))
    return out


def _all(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, right_by: Sequence[str] | None = None, right_time: str | None = None, tie: Sequence[str] = (), strict: bool = False, within: int | None = None, cut: int | None = None, suffix: str = "_before") -> DataFrame:
    """Every left row with the columns of the latest right row of its entity at its time or before (`strict`: before), null where there is none.

    tie: columns of right that tell which of several rows of one time is the latest. within: no match further back than this (microseconds, or the
    times' own unit). cut: length of a piece of time, in the same unit.
    """
    names = [f"k{i}" for i in range(len(by))]
    right_time = right_time or time
    side = lambda df, keys, at, row, rank: df.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(names, keys, strict=True)), _number(df, at).alias("t"), F.lit(rank).alias("side"), *row)
    found = F.struct(_number(right, right_time).alias("t"), F.struct(*(F.col(f"`{c}`") for c in tie), F.lit(0).alias("none")).alias("tie"), _all(right).alias("row"))
    mine = side(left, by, time, [_all(left).alias("left"), F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType).alias("right")], 0 if strict else 2)
    there = side(right, right_by or by, right_time, [F.lit(None).cast(left.select(_all(left).alias("x")).schema["x"].dataType).alias("left"), found.alias("right")], 1)
    usable = " and ".join(f"{k} is not null" for k in names) + " and t is not null"
    both = mine.unionByName(there.where(usable))
    group = list(names)
    if cut:
        group.append("piece")
        both = both.withColumn("piece", F.floor(F.col("t") / F.lit(cut)))
    both = both.repartition(*group)
    so_far = f"over (partition by {', '.join(group)} order by t, side, right.tie rows between unbounded preceding and current row)"
    rows = both.selectExpr("*", f"last(right, true) {so_far} as last").where(F.col("left").isNotNull()).drop("right", "side")
    if cut:
        ends = both.where("right is not null").groupBy(*group).agg(F.expr("max_by(right, struct(t, right.tie))").alias("right"))
        pieces = both.where(usable).select(*group).distinct().join(ends, group, "left")
        before = f"over (partition by {', '.join(names)} order by piece rows between unbounded preceding and 1 preceding)"
        carried = pieces.selectExpr(*group, f"last(right, true) {before} as earlier").where("earlier is not null")
        rows = rows.join(carried, group, "left").withColumn("last", F.coalesce("last", "earlier"))
    valid = F.expr(usable)
    if within is not None:
        valid = valid & (F.col("t") - F.col("last.t") <= F.lit(within))
    match = F.when(valid, F.col("last.row"))
    return rows.select(*(F.col("left").getField(c).alias(c) for c in left.columns), *(match.getField(c).alias(n) for c, n in _renamed(left, right, suffix)))


def near(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, before: int, after: int, right_by: Sequence[str] | None = None, right_time: str | None = None, suffix: str = "_near") -> DataFrame:
    """Pairs of rows of one entity with the right time from `before` before the left one to `after` after it, both ends included (microseconds, or the times' own unit)."""
    width = max(1, before + after)
    names = [f"k{i}" for i in range(len(by))]
    keys = lambda df, columns: [F.col(f"`{c}`").alias(k) for k, c in zip(names, columns, strict=True)]
    x = left.select(*keys(left, by), _number(left, time).alias("t"), _all(left).alias("left")).where("t is not null")
    reach = F.sequence(F.floor((F.col("t") - before) / width), F.floor((F.col("t") + after) / width))  # two buckets, or three
    x = x.select(*names, "t", "left", F.explode(reach).alias("bucket"))
    right_time = right_time or time
    y = right.select(*keys(right, right_by or by), _number(right, right_time).alias("u"), _all(right).alias("right")).where("u is not null").withColumn("bucket", F.floor(F.col("u") / width))
    met = x.join(y, [*names, "bucket"]).where((F.col("u") >= F.col("t") - before) & (F.col("u") <= F.col("t") + after))
    return met.select(*(F.col("left").getField(c).alias(c) for c in left.columns), *(F.col("right").getField(c).alias(n) for c, n in _renamed(left, right, suffix)))


def with_context(events: DataFrame, logins: DataFrame, flows: DataFrame, minutes: int = 60, cut_days: int | None = 1) -> DataFrame:
    """API events (client_ip, time) with their source's last login before (`login_` columns) and the flows of the source within `minutes` around (number and share of attacks).

    logins: ip, login_timestamp, event_id, login_successful. flows: src_ip, event_timestamp, label_binary. events need an event_id of their own.
    """
    day, minute = 86_400_000_000, 60_000_000
    seen = logins.select("ip", "login_timestamp", F.col("event_id").alias("login_event_id"), "login_successful")
    out = as_of(events, seen, ["client_ip"], "time", ["ip"], "login_timestamp", ["login_event_id"], cut=cut_days * day if cut_days else None).drop("ip")
    around = near(events.select("event_id", "client_ip", "time"), flows.select("src_ip", "event_timestamp", "label_binary"), ["client_ip"], "time", minutes * minute, minutes * minute, ["src_ip"], "event_timestamp")
    counts = around.groupBy("event_id").agg(F.count(F.lit(1)).alias("flows_near"), F.avg(F.coalesce((F.col("label_binary") == 1).cast("double"), F.lit(0.0))).alias("attack_share_near"))
    return out.join(counts, "event_id", "left").fillna(0, ["flows_near"]).fillna(0.0, ["attack_share_near"])
