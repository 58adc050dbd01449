"""Sums, distinct values and entropy over the range of time before each row, by arrivals and expiries.

A row counts in the ranges of the rows after its own time, until the range's length has passed. So each row becomes an arrival (+1 after its
time) and, for every range, an expiry (-1 after its time and that length), and a range's sum at a row is the running sum of all changes
before it. Running sums take one step a change, where a moving frame is summed anew for each row, and hold no range in memory.

Distinct values and entropy come from the changed terms only: one running sum by value gives each value's count before and after a change, so whether it
came or went, and by how much n log2 n changed. With N values in a range the entropy is log2 N less the sum of n log2 n over N. That sum is kept as
whole and fractional parts in integers, so what leaves takes out just what it brought.

All is done within one partitioning by entity, into as many tasks as the rows ask for (ROWS_A_TASK): a row becomes several changes that are sorted a few times,
so what a task holds is a large multiple of what it was sent, and sizes of shuffles say little about it. An entity with a large share of all rows can be cut into pieces of time (`cut`): pieces are
summed alone, and a row for each piece carries what came before it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EARLIEST = -(1 << 62)
_FRACTION = float(1 << 40)
ROWS_A_TASK = 1 << 16  # on average; the rows of an entity stay together
SMOOTHING = 1e-10  # fixed value: added to a share inside its logarithm


def _terms(n: str) -> tuple[str, str]:
    """n log2 n as whole number and 2^-40ths."""
    g = f"(case when {n} > 1 then {n} * log2(cast({n} as double)) else 0.0D end)"
    return f"floor({g})", f"floor(({g} - floor({g})) * {_FRACTION!r}D + 0.5D)"


def _entropy(n: str, distinct: str, whole: str, fraction: str) -> str:
    """Bits, with SMOOTHING inside the logarithm to its first order; 0 without values, just below 0 with one."""
    mean = f"({whole} + {fraction} / {_FRACTION!r}D) / {n}"
    one, each = math.log2(1 + SMOOTHING), SMOOTHING / math.log(2)
    return f"case when {n} = 0 then 0.0D when {distinct} = 1 then {-one!r}D else log2(cast({n} as double)) - {mean} - {distinct} * {each!r}D end"


def over_ranges(df: DataFrame, entity: str, micros: Column, spans: Mapping[str, int], totals: Mapping[str, Column], diverse: Mapping[str, str] | None = None, cut: int | None = None, dealt: bool = False) -> DataFrame:
    """df with the sums of `totals` and the values of `diverse` over each span before a row's time, rows of the same time left out.

    spans: microseconds by suffix. totals: what a row adds (a whole number), by prefix; the columns are prefix + suffix. diverse: a column by name;
    the columns are unique_{name}{suffix} and entropy_{name}{suffix}, null values left out. cut: microseconds of a piece of time. dealt: df is partitioned by the entity already, as a bucketed table is.
    Rows without a time are kept, count nowhere and see nothing. Columns of these names are replaced.
    """
    diverse, suffixes = dict(diverse or {}), list(spans)
    made = [f"{t}{s}" for t in totals for s in suffixes] + [f"{k}_{d}{s}" for d in diverse for s in suffixes for k in ("unique", "entropy")]
    kept = [c for c in df.columns if c not in made]
    at = lambda k, shift: F.struct(F.lit(k).alias("kind"), F.coalesce(micros + shift, F.lit(_EARLIEST)).alias("key"))
    arrival, expiries = at(0, 0), [at(i + 1, spans[s]) for i, s in enumerate(suffixes)]
    there = micros.isNotNull()
    tasks = 0 if dealt and not cut else max(2, math.ceil(df.count() / ROWS_A_TASK))
    own = df if cut or dealt else df.repartition(tasks, F.col(f"`{entity}`"))  # the only exchange of what follows
    events = own.select(
        F.col(f"`{entity}`").alias("e"),
        F.struct(*(F.col(f"`{c}`") for c in kept if c != entity), F.lit(0).alias("none")).alias("row"),
        *(F.when(there, v).otherwise(0).cast("long").alias(f"t{i}") for i, v in enumerate(totals.values())),
        *(F.when(there, F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(diverse.values())),
        F.explode(F.when(there, F.array(arrival, *expiries)).otherwise(F.array(arrival))).alias("x"),
    )
    plain = [f"t{i}" for i in range(len(totals))] + [f"v{i}" for i in range(len(diverse))]
    events = events.select("e", F.when(F.col("x.kind") == 0, F.col("row")).alias("row"), *plain, "x.kind", "x.key")
    sign = [f"case when kind = 0 then 1 when kind = {i + 1} then -1 else 0 end" for i in range(len(suffixes))]
    group = ["e"]
    if cut:
        group = ["e", "piece"]
        events = events.withColumn("piece", F.floor(F.col("key") / F.lit(cut))).repartition(tasks, *group)

    def carried(by: list[str], values: dict[str, str]) -> DataFrame:
        """Of each piece, the sums of all pieces before it."""
        sums = events.groupBy(*by, "piece").agg(*(F.expr(f"sum({v}) as {k}") for k, v in values.items()))
        before = f"over (partition by {', '.join(by)} order by piece rows between unbounded preceding and 1 preceding)"
        return sums.select(*by, "piece", *(F.expr(f"coalesce(sum({k}) {before}, 0) as {k}_before") for k in values))

    columns = ["e", "row", *plain, "kind", "key", *group[1:]]
    for i in range(len(diverse)):
        v = f"v{i}"
        steps = {f"x{i}_{j}": f"case when {v} is null then 0 else {s} end" for j, s in enumerate(sign)}
        base = dict.fromkeys(steps, "0")
        if cut:
            more = carried(["e", v], steps).withColumnsRenamed({"e": "ce", v: "cv", "piece": "cp"})
            same = F.col("e").eqNullSafe(F.col("ce")) & F.col(v).eqNullSafe(F.col("cv")) & (F.col("piece") == F.col("cp"))
            events = events.join(more, same, "left")
            base = {k: f"coalesce({k}_before, 0)" for k in steps}
        so_far = f"over (partition by {', '.join([*group, v])} order by key, kind rows between unbounded preceding and current row)"
        events = events.selectExpr(*columns, *(f"{x} as {k}" for k, x in steps.items()), *(f"{x} as b{k}" for k, x in base.items()))
        events = events.selectExpr("*", *(f"sum({k}) {so_far} + b{k} as {k.replace('x', 'n')}" for k in steps))
        changes = []
        for j in range(len(suffixes)):
            n, was = f"n{i}_{j}", f"(n{i}_{j} - x{i}_{j})"
            (whole, part), (whole_was, part_was) = _terms(n), _terms(was)
            changes += [f"cast({n} > 0 as int) - cast({was} > 0 as int) as u{i}_{j}", f"{whole} - {whole_was} as w{i}_{j}", f"{part} - {part_was} as p{i}_{j}"]
        columns += [*steps]
        events = events.selectExpr(*columns, *changes)
        columns += [f"{k}{i}_{j}" for j in range(len(suffixes)) for k in "uwp"]

    values = {f"s{i}_{j}": f"t{i} * {s}" for i in range(len(totals)) for j, s in enumerate(sign)}
    values |= {f"{k}{i}_{j}": f"{k}{i}_{j}" for i in range(len(diverse)) for j in range(len(suffixes)) for k in "xuwp"}
    earlier = f"over (partition by {', '.join(group)} order by key range between unbounded preceding and 1 preceding)"
    sums = [f"coalesce(sum({v}) {earlier}, 0) as {k}" for k, v in values.items()]
    rows = events.selectExpr("e", "row", "kind", *group[1:], *sums).where("kind = 0")
    if cut:
        more = carried(["e"], values).withColumnsRenamed({"e": "ce", "piece": "cp"})
        rows = rows.join(more, F.col("e").eqNullSafe(F.col("ce")) & (F.col("piece") == F.col("cp")), "left")
        rows = rows.selectExpr("e", "row", *(f"{k} + coalesce({k}_before, 0) as {k}" for k in values))

    out = [F.col("e").alias(c) if c == entity else F.col("row").getField(c).alias(c) for c in kept]
    out += [F.col(f"s{i}_{j}").alias(f"{t}{s}") for i, t in enumerate(totals) for j, s in enumerate(suffixes)]
    for i, d in enumerate(diverse):
        for j, s in enumerate(suffixes):
            found = _entropy(*(f"{k}{i}_{j}" for k in "xuwp"))
            out += [F.expr(f"cast(u{i}_{j} as int)").alias(f"unique_{d}{s}"), F.expr(found).alias(f"entropy_{d}{s}")]
    return rows.select(*out)
