"""As-of and interval joins against loops, whole and cut into pieces of time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracefold.operators import across

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(12)
    key = lambda: random.choice(["hot", "hot", "hot", "a", None])
    left = [(i, key(), random.choice([None, *range(0, 200)]), "l") for i in range(200)]
    right = [(1000 + i, key(), random.choice([None, *range(0, 200)]), i % 3) for i in range(120)] + [(5000, "only right", 5, 0)]
    return left, right, spark.createDataFrame(left, "id long, who string, t long, row string").repartition(4), spark.createDataFrame(right, "id long, who string, t long, left int").repartition(3)


@pytest.mark.parametrize("cut", [None, 7, 50])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("within", [None, 5])
def test_as_of_against_a_loop(tables, cut, strict, within):
    left, right, x, y = tables
    got = across.as_of(x, y, ["who"], "t", tie=["left", "id"], strict=strict, within=within, cut=cut)
    assert got.columns == ["id", "who", "t", "row", "id_before", "who_before", "t_before", "left"]
    found = {r.id: (r.id_before, r.t_before, r.left) for r in got.collect()}
    assert len(found) == len(left)
    for i, who, t, _ in left:
        past = [] if who is None or t is None else [r for r in right if r[1] == who and r[2] is not None and (r[2] < t or r[2] == t and not strict)]
        best = max(past, key=lambda r: (r[2], r[3], r[0]), default=None)
        if best and within is not None and t - best[2] > within:
            best = None
        assert found[i] == ((best[0], best[2], best[3]) if best else (None, None, None)), (i, who, t)


@pytest.mark.parametrize(("before", "after"), [(0, 0), (3, 0), (0, 4), (10, 7)])
def test_near_against_a_loop(tables, before, after):
    left, right, x, y = tables
    got = sorted((r.id, r.id_near) for r in across.near(x, y, ["who"], "t", before, after).collect())
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] is not None and a[1] == b[1] and a[2] is not None and b[2] is not None and a[2] - before <= b[2] <= a[2] + after)
    assert got == want


def test_as_of_moves_rows_once_and_pairs_nothing(tables):
    _, _, x, y = tables
    plan = across.as_of(x, y, ["who"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_empty_tables(tables):
    left, _, x, y = tables
    for cut in (None, 10):
        assert across.as_of(x, y.limit(0), ["who"], "t", cut=cut).where("id_before is null").count() == len(left)
        assert across.as_of(x.limit(0), y, ["who"], "t", cut=cut).count() == 0
    assert across.near(x, y.limit(0), ["who"], "t", 1, 1).count() == 0


def test_context_of_api_events(spark):
    at = lambda m: datetime(2024, 1, 1, 12) + timedelta(minutes=m)
    events = spark.createDataFrame([("e1", "s", at(0)), ("e2", "s", at(60 * 30)), ("e3", "other", at(0)), ("e4", None, at(0))], "event_id string, client_ip string, time timestamp")
    logins = spark.createDataFrame([(1, "s", at(-3000), 0), (2, "s", at(-2), 1), (3, "s", at(5), 0)], "event_id long, ip string, login_timestamp timestamp, login_successful int")
    flows = spark.createDataFrame([("s", at(-30), 1), ("s", at(30), 0), ("s", at(70), 1), ("s", at(60 * 30 - 60), None)], "src_ip string, event_timestamp timestamp, label_binary int")
    got = {r.event_id: (r.login_event_id, r.flows_near, r.attack_share_near) for r in across.with_context(events, logins, flows).collect()}
    assert got == {"e1": (2, 2, 0.5), "e2": (3, 1, 0.0), "e3": (None, 0, 0.0), "e4": (None, 0, 0.0)}
    assert across.with_context(events, logins, flows, cut_days=None).agg(F.sum("flows_near")).collect()[0][0] == 3
