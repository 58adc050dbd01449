"""Range sums by arrival and expiry, whole and cut into pieces of time, against loops; columns whose names clash."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracefold.operators import flows, history, split
from tracefold.operators.ranges import over_ranges

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def rows():
    random.seed(11)
    made = []
    for i in range(300):
        t = None if i % 29 == 0 else random.choice([0, 1, 2, 3, 5, 8]) * DAY // 2 + random.choice([0, 0, 1, 7])
        made.append((i, "hot" if i % 3 else random.choice(["a", "b", None]), t, random.choice("xyz") if i % 7 else None, i % 4))
    return made


@pytest.mark.parametrize("cut", [None, DAY, 3 * DAY])
def test_ranges_against_a_loop(spark, rows, cut):
    df = spark.createDataFrame(rows, "id long, who string, t long, v string, w long").repartition(3)
    got = over_ranges(df, "who", F.col("t"), {"_1": DAY, "_3": 3 * DAY}, {"n": F.lit(1), "w": F.col("w")}, {"v": "v"}, cut)
    assert got.columns[:5] == df.columns
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    for i, who, t, v, w in rows:
        r = found[i]
        assert (r["who"], r["t"], r["v"], r["w"]) == (who, t, v, w)
        for days in (1, 3):
            seen = [] if t is None else [x for x in rows if x[1] == who and x[2] is not None and t - days * DAY <= x[2] < t]
            assert (r[f"n_{days}"], r[f"w_{days}"]) == (len(seen), sum(x[4] for x in seen))
            values = [x[3] for x in seen if x[3] is not None]
            shares = [values.count(k) / len(values) for k in set(values)]
            assert r[f"unique_v_{days}"] == len(shares)
            assert abs(r[f"entropy_v_{days}"] + sum(s * math.log2(s + 1e-10) for s in shares)) < 1e-11
            assert (r[f"entropy_v_{days}"] < 0) == (len(shares) == 1)


def test_entropy_forgets_what_has_left(spark):
    """A million earlier rows leave no trace in the sums of a later, quiet range."""
    n = 1_000_000
    busy = spark.range(n).select(F.lit("u").alias("who"), F.col("id").alias("t"), F.pmod(F.xxhash64("id"), F.lit(5000)).cast("string").alias("v"))
    quiet = spark.createDataFrame([("u", 3 * n + i, x) for i, x in enumerate("aab" * 3)] + [("u", 3 * n + 100, "z")], "who string, t long, v string")
    last = over_ranges(busy.union(quiet), "who", F.col("t"), {"": n}, {"n": F.lit(1)}, {"v": "v"}, cut=n // 4).where(F.col("t") == 3 * n + 100).collect()[0]
    assert last["n"] == 9 and last["unique_v"] == 2
    assert abs(last["entropy_v"] + 2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)) < 1e-9


def test_no_list_and_no_moving_frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, who string, t long, v string, w long")
    plan = over_ranges(df, "who", F.col("t"), {"_1": DAY}, {"n": F.lit(1)}, {"v": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert f"{-DAY}" not in plan  # frames start at the first row, so they are running sums


@pytest.fixture(scope="module")
def clashing(spark):
    start = datetime(2024, 1, 1)
    made = [(i, f"u{i % 3}", start + timedelta(hours=7 * i % 50), i % 2, "abc"[i % 3], i, -i, i + 1, i + 2, i + 3, i + 4, i + 5) for i in range(40)]
    extra = "_id long, _n long, _rn long, _us long, _part long, _order long, row long"
    return spark.createDataFrame(made, f"event_id long, user_id string, ts timestamp, ok int, kind string, {extra}")


def test_clashing_names_survive(spark, clashing):
    h = history.History(time="ts", outcome="ok", novelty=("kind",), priors={"kind": "kind_prior"}, diversity=("kind",))
    steps = [lambda d: f(d, h) for f in (history.gaps, history.streaks, history.novelty, history.continuity, history.prior_rates, history.rolling)]
    steps += [lambda d: history.rolling(d, h, cut_days=1), lambda d: history.inclusive_count(d, h, 1, "seen")]
    steps += [lambda d: split.by_time(d, "ts", "event_id"), lambda d: split.by_time(d, "ts", "event_id", within="user_id"), lambda d: split.keep_first(d, ["event_id"], ["ts"])]
    steps += [lambda d: split.sample(d, 40, "event_id"), lambda d: split.balanced_sample(d, "kind", 40, "event_id")]
    steps += [lambda d: flows.rolling(d.withColumn("protocol", F.lit(6)), "user_id", "ts", label="ok")]
    want = sorted(map(tuple, clashing.collect()))
    for step in steps:
        assert sorted(map(tuple, step(clashing).select(*clashing.columns).collect())) == want
    with pytest.raises(ValueError, match="_rn"):
        split.numbered_in_order(clashing, [F.col("ts")])


def test_flows_without_a_time_are_kept(spark):
    df = spark.createDataFrame([(1, "a", datetime(2024, 1, 1), 6, 1), (2, "a", None, 6, 1), (3, "a", datetime(2024, 1, 1, 0, 30), 17, 0)], "id long, who string, t timestamp, protocol int, label_binary int")
    got = {r.id: r for r in flows.rolling(df, "who", "t", (1.0,)).collect()}
    assert {i: r.flow_count_1h for i, r in got.items()} == {1: 0, 2: 0, 3: 1}
    assert got[3].attack_rate_1h == 1.0 and got[2].attack_rate_1h == 0.0


def test_tasks_follow_the_rows(spark, rows, monkeypatch):
    """Small shuffles aren't merged into few tasks, whose memory would grow with the table."""
    monkeypatch.setattr("tracefold.operators.ranges.ROWS_A_TASK", 20)
    df = spark.createDataFrame(rows, "id long, who string, t long, v string, w long").withColumn("who", F.col("id").cast("string"))
    got = over_ranges(df, "who", F.col("t"), {"_1": DAY}, {"n": F.lit(1)}, {"v": "v"})
    assert got.rdd.getNumPartitions() == len(rows) / 20
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).collect()[0][0] < 60
