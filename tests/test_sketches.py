"""Profiles from kept sketches against exact ones, and a new day without the old ones."""

import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tracefold.operators import sketches


@pytest.fixture(scope="module")
def data(spark):
    random.seed(8)
    rows = [(i % 9, random.gauss(50, 20), float(random.randrange(40)), None if i % 3 else random.expovariate(1), str(i % 777) if i % 10 else "x") for i in range(30_000)]
    rows += [(None, float("nan"), None, float("inf"), "5")]
    return rows, spark.createDataFrame(rows, "day int, a double, few double, `b.c` double, text string").repartition(6)


COLUMNS = ["a", "few", "b.c", "text"]


def number(x):
    try:
        return None if x is None or math.isnan(float(x)) else float(x)
    except ValueError:
        return None


def test_merged_sketches_within_their_error(data):
    rows, df = data
    got = {r.column_name: r for r in sketches.merged(sketches.of_parts(df, COLUMNS, F.col("day"))).collect()}
    for i, c in enumerate(COLUMNS):
        values = sorted(x for r in rows if (x := number(r[i + 1])) is not None)
        finite, r = [x for x in values if math.isfinite(x)], got[c]
        mean = math.fsum(finite) / len(finite)
        assert (r.total_rows, r.non_null_count, r.min, r.max) == (len(rows), len(values), values[0], values[-1])
        assert abs(r.mean - mean) < 1e-9 * max(1, abs(mean)) and abs(r.std - math.sqrt(math.fsum((x - mean) ** 2 for x in finite) / len(finite))) < 1e-6
        assert abs(r.missing_ratio - (1 - len(values) / len(rows))) < 1e-12 and abs(r.zero_ratio - values.count(0) / len(values)) < 1e-12
        assert abs(r.unique_count - len(set(values))) <= 0.024 * len(set(values)) + 1
        for q in sketches.SHARES:
            x = r[f"p{round(100 * q)}"]
            low, high = sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)
            assert low - sketches.rank_error() <= q <= high + sketches.rank_error(), (c, q)


def test_a_new_day_needs_no_old_rows(spark, data, tmp_path):
    _, df = data
    path = str(tmp_path / "sketches")
    for day in (0, 1, 1):  # the second run of day 1 changes nothing
        sketches.store(sketches.of_parts(df.where(F.col("day") == day), COLUMNS, F.col("day")), path)
    assert sketches.stored(spark, path).count() == 2 * len(COLUMNS)
    both = {r.column_name: r for r in sketches.merged(sketches.stored(spark, path)).collect()}
    whole = {r.column_name: r for r in sketches.merged(sketches.of_parts(df.where("day < 2"), COLUMNS, F.lit(0))).collect()}
    for c in COLUMNS:
        assert (both[c].total_rows, both[c].min, both[c].max) == (whole[c].total_rows, whole[c].min, whole[c].max)
        assert abs(both[c].unique_count - whole[c].unique_count) <= 0.024 * whole[c].unique_count + 1
        assert abs(both[c].std - whole[c].std) < 1e-9
    by_day = sketches.merged(sketches.stored(spark, path), by=["day"])
    assert by_day.count() == 2 * len(COLUMNS)
    shutil.rmtree(tmp_path / "sketches" / "day=0")  # parts can go one by one
    assert sketches.merged(spark.read.parquet(path)).count() == len(COLUMNS)


def test_columns_without_values_and_empty_tables(spark):
    none = spark.createDataFrame([(1, None), (2, None)], "day int, x double")
    r = sketches.merged(sketches.of_parts(none, ["x"], F.col("day"))).collect()[0]
    assert (r.total_rows, r.non_null_count, r.unique_count, r.p50, r["mean"], r["std"]) == (2, 0, 0, None, None, None)
    mixed = sketches.merged(sketches.of_parts(none.union(spark.createDataFrame([(3, 7.0)], none.schema)), ["x"], F.col("day"))).collect()[0]
    assert (mixed.unique_count, mixed.p50, mixed["mean"], mixed["std"]) == (1, 7.0, 7.0, 0.0)
    assert sketches.merged(sketches.of_parts(none.limit(0), ["x"], F.col("day"))).count() == 0


def test_one_exchange_of_sketches(data):
    _, df = data
    plan = sketches.of_parts(df, COLUMNS, F.col("day"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_kll_sketch_agg" in plan
