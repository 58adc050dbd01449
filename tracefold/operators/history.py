"""Strictly past behaviour of each entity as window functions over one shuffle by entity.

Two kinds of past: by position (all earlier rows in the order of time and a tie-breaking sequence) and by time (a range
of whole days that ends just before the row's own time, so rows of the same time don't count). Rows without an entity or
a time have no past and are left out of every result here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracefold.functions import numbers as N
from tracefold.names import fresh
from tracefold.operators.ranges import over_ranges

DAY = 86_400_000_000


@dataclass(frozen=True)
class History:
    """Names of the columns: the entity, its time, an id that breaks ties, and an outcome (1 is success)."""

    entity: str = "user_id"
    time: str = "login_timestamp"
    sequence: str = "event_id"
    outcome: str = "login_successful"
    days: Sequence[int] = (1, 7, 30)
    novelty: Sequence[str] = ("ip", "device", "country", "region", "city", "geo_token", "context_token")
    priors: dict[str, str] = field(default_factory=lambda: {"ip_token": "current_ip_token_prior", "device_token": "current_device_token_prior", "geo_token": "current_geo_token_prior", "context_token": "current_context_prior"})
    diversity: Sequence[str] = ("ip_token", "device_token", "geo_token", "context_token")

    def micros(self) -> Column:
        return F.unix_micros(F.col(self.time).cast("timestamp"))

    def rows(self, us: str) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(us, self.sequence)

    def of_value(self, column: str, us: str) -> WindowSpec:
        return Window.partitionBy(self.entity, column).orderBy(us, self.sequence)

    def timed(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Rows with an entity and a time, and the name of a new column with the time in microseconds."""
        us = fresh(df, "_us")
        return df.where(F.col(self.entity).isNotNull() & F.col(self.time).isNotNull()).withColumn(us, self.micros()), us


def _seconds(now: Column, then: Column) -> Column:
    return F.coalesce((now - then) / 1e6, F.lit(0.0))


Late = list[dict[str, Column]]


class _Step:
    """What a group of features needs. `begin` finds or makes the time in microseconds; `end` adds what follows from the windows' columns and drops what was made.

    Alone, a step does both. In `features` one column of the time serves all, so that windows of one order share a sort, and what follows from their
    columns (`late`) is added after all of them, so that rows are narrow while they are sorted.
    """

    def __init__(self, df: DataFrame, h: History, us: str | None, late: Late | None):
        self.late, self.own = late, us is None
        self.df, self.us = h.timed(df) if us is None else (df, us)

    def end(self, df: DataFrame, *following: dict[str, Column], drop: Sequence[str] = ()) -> DataFrame:
        for i, columns in enumerate(following):
            if self.late is None:
                df = df.withColumns(columns)
            else:
                self.late[i] |= columns
        return df.drop(*drop, *([self.us] if self.own else []))


def gaps(df: DataFrame, h: History, us: str | None = None, late: Late | None = None) -> DataFrame:
    """Seconds since the last event, success and failure (anything but a success; 0 without one), their logarithm and bin, and whether there is a past."""
    step = _Step(df, h, us, late)
    at, ok, rows = F.col(step.us), F.coalesce(F.col(h.outcome) == 1, F.lit(False)), h.rows(step.us)
    past = rows.rowsBetween(Window.unboundedPreceding, -1)
    last = {
        "login": F.lag(at).over(rows),
        "success": F.last(F.when(ok, at), ignorenulls=True).over(past),
        "failure": F.last(F.when(~ok, at), ignorenulls=True).over(past),
    }
    out = step.df.withColumns({"has_prior_login": (F.row_number().over(rows) > 1).cast("int")} | {f"seconds_since_prev_{k}": _seconds(at, c) for k, c in last.items()})
    return step.end(out, {f"seconds_since_prev_{k}_{kind}": f(f"seconds_since_prev_{k}") for k in last for kind, f in (("log", N.log1p), ("bin", N.gap_bin))})


def streaks(df: DataFrame, h: History, us: str | None = None, late: Late | None = None) -> DataFrame:
    """Lengths of the runs of successes and of failures (anything else) that end just before the row."""
    step = _Step(df, h, us, late)
    rn, rows = fresh(step.df, "_rn"), h.rows(step.us)
    timed = step.df.withColumn(rn, F.row_number().over(rows))
    past = rows.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.coalesce(F.col(h.outcome) == 1, F.lit(False))
    since = lambda breaks: F.col(rn) - 1 - F.coalesce(F.last(F.when(breaks, F.col(rn)), ignorenulls=True).over(past), F.lit(0))
    out = timed.withColumns({"prior_success_streak": since(~ok), "prior_failure_streak": since(ok)})
    return step.end(out, {f"{k}_{kind}": f(k) for k in ("prior_success_streak", "prior_failure_streak") for kind, f in (("log", N.log1p), ("bin", N.count_bin))}, drop=[rn])


def novelty(df: DataFrame, h: History, columns: Sequence[str] | None = None, us: str | None = None, late: Late | None = None) -> DataFrame:
    """Whether the row holds the entity's first occurrence of a value."""
    step = _Step(df, h, us, late)
    return step.end(step.df.withColumns({f"is_new_{c}": (F.row_number().over(h.of_value(c, step.us)) == 1).cast("int") for c in columns or h.novelty}))


def continuity(df: DataFrame, h: History, columns: Sequence[str] | None = None, us: str | None = None, late: Late | None = None) -> DataFrame:
    """Whether a value is that of the row before."""
    step = _Step(df, h, us, late)
    return step.end(step.df.withColumns({f"prev_login_same_{c}": N.flag(F.col(c) == F.lag(c).over(h.rows(step.us))) for c in columns or h.novelty}))


def prior_rates(df: DataFrame, h: History, names: dict[str, str] | None = None, us: str | None = None, late: Late | None = None) -> DataFrame:
    """How many, and what share, of the earlier rows hold the row's value."""
    step, names = _Step(df, h, us, late), names or h.priors
    rn = fresh(step.df, "_rn")
    out = step.df.withColumn(rn, F.row_number().over(h.rows(step.us)) - 1)
    out = out.withColumns({f"{p}_count": F.row_number().over(h.of_value(c, step.us)) - 1 for c, p in names.items()})
    out = out.withColumns({f"{p}_rate": F.coalesce(N.ratio(F.col(f"{p}_count"), F.col(rn)), F.lit(0.0)) for p in names.values()})
    more = {}
    for p in names.values():
        more |= {f"{p}_count_log": N.log1p(f"{p}_count"), f"{p}_count_bin": N.count_bin(f"{p}_count"), f"{p}_rate_bin": N.rate_bin(f"{p}_rate")}
    return step.end(out, more, drop=[rn])


def rolling(df: DataFrame, h: History, counts: bool = True, columns: Sequence[str] | None = None, cut_days: float | None = None, us: str | None = None, late: Late | None = None, dealt: bool = False) -> DataFrame:
    """Over each range of days: counts and rates of events, successes (1) and failures (0); distinct values and entropy of columns.

    Linear in the events of an entity, with no list of a range (see `ranges`). cut_days: entities are cut into pieces of so many days, so one with a large
    share of all rows is shared among tasks; the result is the same.
    """
    columns = h.diversity if columns is None else columns
    step, ok = _Step(df, h, us, late), F.col(h.outcome)
    named = {{"context_token": "context_tokens"}.get(c, f"{c}s"): c for c in columns}
    totals = {"login_count": F.lit(1), "success_count": N.flag(ok == 1), "failure_count": N.flag(ok == 0)} if counts else {}
    spans = {f"_window{d}": round(d * DAY) for d in h.days}
    out = over_ranges(step.df, h.entity, F.col(step.us), spans, totals, named, round(cut_days * DAY) if cut_days else None, dealt)
    rates, rest = {}, {}
    for d in h.days:
        for k in ("login", "success", "failure") if counts else ():
            n = f"{k}_count_window{d}"
            rest |= {f"log_{k}_count_window{d}": N.log1p(n), f"{k}_count_bin_window{d}": N.count_bin(n)}
        for k in ("success", "failure") if counts else ():
            rates[f"{k}_rate_window{d}"] = F.expr(f"coalesce(try_divide({k}_count_window{d}, login_count_window{d}), 0.0D)")
            rest[f"{k}_rate_bin_window{d}"] = N.rate_bin(f"{k}_rate_window{d}")
        for name in named:
            unique, entropy = f"unique_{name}_window{d}", f"entropy_{name}_window{d}"
            rest |= {f"log_unique_{name}_window{d}": N.log1p(unique), f"unique_{name}_bin_window{d}": N.count_bin(unique), f"entropy_{name}_bin_window{d}": N.entropy_bin(entropy)}
    return step.end(out, rates, rest)


def rolling_counts(df: DataFrame, h: History, cut_days: float | None = None) -> DataFrame:
    """Counts and rates of events, successes (1) and failures (0) in each range of days."""
    return rolling(df, h, columns=(), cut_days=cut_days)


def rolling_diversity(df: DataFrame, h: History, columns: Sequence[str] | None = None, cut_days: float | None = None) -> DataFrame:
    """Distinct values and entropy of columns in each range of days."""
    return rolling(df, h, False, columns, cut_days)


def calendar(df: DataFrame, h: History) -> DataFrame:
    t = F.col(h.time).cast("timestamp")
    return df.withColumns({"hour_of_day": F.hour(t), "day_of_week": F.weekday(t), "is_weekend": (F.weekday(t) >= 5).cast("int")})


def inclusive_count(df: DataFrame, h: History, days: int, name: str) -> DataFrame:
    """Rows in the range that ends with the row's own time, itself included: those of `ranges` and those of the same time."""
    timed, us = h.timed(df)
    before = fresh(timed, "_before")
    out = over_ranges(timed, h.entity, F.col(us), {"": round(days * DAY)}, {before: F.lit(1)})
    return out.withColumn(name, F.col(before) + F.count(F.lit(1)).over(Window.partitionBy(h.entity, us))).drop(us, before)


def features(df: DataFrame, h: History | None = None, cut_days: float | None = None, dealt: bool = False) -> DataFrame:
    """All behavioural features; one exchange by entity serves every step (with cut_days the rolling ones take their own), none if df is `dealt` by it."""
    h = h or History()
    late: Late = [{}, {}]
    timed, us = h.timed(df)
    out = rolling(timed, h, cut_days=cut_days, us=us, late=late, dealt=dealt)
    for step in (gaps, streaks, continuity, prior_rates, novelty):
        out = step(out, h, us=us, late=late)
    df = calendar(out, h).drop(us).withColumns(late[0]).withColumns(late[1])
    level = sum((F.col(c) != "unknown").cast("int") for c in ("country", "region", "city") if c in df.columns)
    aliases = {f"current_{k}_prior_{x}": F.col(f"current_{t}_prior_{x}") for k, t in (("ip", "ip_token"), ("device", "device_token"), ("country", "geo_token")) for x in ("count", "rate")}
    return df.withColumns({"geo_resolution_level": level} | aliases)


def blocks(h: History | None = None) -> dict[str, list[str]]:
    """Feature names by block."""
    h = h or History()
    own = {"ip_token": "ip_tokens", "device_token": "device_tokens", "geo_token": "geo_tokens", "context_token": "context_tokens"}
    return {
        "temporal": ["has_prior_login", *(f"seconds_since_prev_{k}{x}" for k in ("login", "success", "failure") for x in ("", "_log", "_bin")), "hour_of_day", "day_of_week", "is_weekend"],
        "streaks": [f"prior_{k}_streak{x}" for k in ("success", "failure") for x in ("", "_log", "_bin")],
        "novelty": [f"is_new_{c}" for c in h.novelty],
        "continuity": [f"prev_login_same_{c}" for c in h.novelty],
        "priors": [f"{p}_{x}" for p in h.priors.values() for x in ("count", "count_log", "count_bin", "rate", "rate_bin")] + ["geo_resolution_level"],
        "rates": [f"{a}_window{d}" for d in h.days for k in ("login", "success", "failure") for a in (f"{k}_count", f"log_{k}_count", f"{k}_count_bin")] + [f"{k}_rate{x}_window{d}" for d in h.days for k in ("success", "failure") for x in ("", "_bin")],
        "diversity": [f"{a}_window{d}" for d in h.days for c in h.diversity for a in (f"unique_{own[c]}", f"log_unique_{own[c]}", f"unique_{own[c]}_bin", f"entropy_{own[c]}", f"entropy_{own[c]}_bin")],
        "aliases": [f"current_{k}_prior_{x}" for k in ("ip", "device", "country") for x in ("count", "rate")],
    }
