"""Sessions and incidents of sources: the same functions serve batches and streams, and give the same rows.

A session is a run of a source's events with gaps below a limit, by Spark's own session window. An incident is such a run of suspicious events; a stream keeps
the open ones of each source as state, joins those that a late event connects, tells when one has reached `most` events, and closes it by a timer once the
watermark says that nothing can extend it. Each open incident has such a timer, so no state outlives the watermark; Spark's own expiry of state counts processing
time and can't be mixed with timers of event time.

Repeated events (same event_id, where there is one) count once: a stream forgets ids that the watermark has passed. Events without a source, time or id are left out. Events later
than the watermark are left out of a stream; a batch has none. Events of one time are as any others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracefold.operators.alerts import with_signal

INCIDENT = "client_ip string, kind string, first_us long, last_us long, events long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds(span: str) -> int:
    """Of "10 minutes" and the like."""
    found = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", span)
    if not found:
        raise ValueError(f"no span of time: {span}")
    return int(found[1]) * _SECONDS[found[2]]


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events with `time` under a watermark, each id once."""
    there = events.withColumn("time", F.to_timestamp("event_timestamp")).where("time is not null and client_ip is not null")
    there = there.withWatermark("time", late) if events.isStreaming else there
    if "event_id" not in events.columns:
        return there
    there = there.where("event_id is not null")
    return there.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else there.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """client_ip, start, end, events, signals, paths: of each session its events, suspicious ones and distinct paths (estimated). It ends `gap` after its last event."""
    flagged = with_signal(timed(events, late))
    out = flagged.groupBy("client_ip", F.session_window("time", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("events"), F.count("security_finding").alias("signals"), F.approx_count_distinct("path").alias("paths")
    )
    return out.select("client_ip", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events", "signals", "paths")


class _Incidents(StatefulProcessor):
    """State of a source: its open incidents (first, last, events, told), few as all lie within the watermark's delay and a gap of now. Times in microseconds."""

    def __init__(self, gap: int, most: int):
        self.gap, self.most = gap * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first_us long, last_us long, events long, told boolean")

    def _rows(self, key: tuple, kind: str, found: list[list]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame([(key[0], kind, first, last, n) for first, last, n, _ in found], columns=["client_ip", "kind", "first_us", "last_us", "events"])

    def _put(self, runs: list[list]) -> None:
        if runs:
            self.open.put([tuple(r) for r in runs])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs = [list(r) for r in self.open.get()]
        runs += [[int(t), int(t), 1, False] for frame in rows for t in frame["us"]]
        merged: list[list] = []
        for run in sorted(runs, key=lambda r: r[0]):
            if merged and run[0] - merged[-1][1] < self.gap:
                last = merged[-1]
                last[1], last[2], last[3] = max(last[1], run[1]), last[2] + run[2], last[3] or run[3]
            else:
                merged.append(run)
        reached = [r for r in merged if r[2] >= self.most and not r[3]]
        for r in reached:
            r[3] = True
        self._put(merged)
        for r in merged:
            self.handle.registerTimer((r[1] + self.gap) // 1000 + 1)
        yield from self._rows(key, "escalated", reached)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        runs = [list(r) for r in self.open.get()]
        self._put([r for r in runs if r[1] + self.gap > now])
        yield from self._rows(key, "closed", [r for r in runs if r[1] + self.gap <= now])

    def close(self) -> None:
        pass


def incidents(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", most: int = 10) -> DataFrame:
    """client_ip, kind, first_time, last_time, events: a row `closed` for each run of suspicious events and, where it reached `most`, one `escalated`.

    A batch gives each run as it ended. A stream tells an escalation when it happens, so that row has what was there by then; it sets the session's state store to
    RocksDB, which timers need.
    """
    flagged = with_signal(timed(events, late)).where("security_finding is not null").select("client_ip", "time", F.unix_micros("time").alias("us"))
    if events.isStreaming:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        made = flagged.groupBy("client_ip").transformWithStateInPandas(_Incidents(seconds(gap), most), INCIDENT, outputMode="Append", timeMode="EventTime")
    else:
        order = Window.partitionBy("client_ip").orderBy("us")
        runs = flagged.withColumn("new", F.coalesce((F.col("us") - F.lag("us").over(order) >= seconds(gap) * 1_000_000).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
        closed = runs.groupBy("client_ip", "run").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("events"))
        made = closed.withColumn("kind", F.explode(F.when(F.col("events") >= most, F.array(F.lit("closed"), F.lit("escalated"))).otherwise(F.array(F.lit("closed")))))
    return made.select("client_ip", "kind", F.timestamp_micros("first_us").alias("first_time"), F.timestamp_micros("last_us").alias("last_time"), "events")
