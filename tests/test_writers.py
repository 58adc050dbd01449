"""Writers: hot shards, even files, buckets that spare exchanges, and batches of a stream that are run twice."""

import json

import pytest
from pyspark.sql import functions as F

from tracefold.operators import history
from tracefold.sources import sinks
from tracefold.streaming import sharded


def files(folder):
    return sorted(p for p in folder.rglob("part-*.parquet"))


@pytest.fixture
def small_pieces(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "65536")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32768")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_shard_has_several_sorted_files(spark, tmp_path, small_pieces):
    df = spark.range(60_000).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 40 + 1).cast("int").alias("shard_id"), F.xxhash64("id").alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("t")).repartition(8)
    sinks.shards(df, str(tmp_path / "s"), sort=["x"])
    hot = files(tmp_path / "s" / "shard_id=0")
    assert len(hot) > 2 and min(len(files(d)) for d in (tmp_path / "s").glob("shard_id=*")) < len(hot)  # those that hash beside the hot one are split with it
    for f in hot:
        x = [r.x for r in spark.read.parquet(str(f)).select("x").collect()]
        assert x == sorted(x)
    again = spark.read.parquet(str(tmp_path / "s"))
    assert again.count() == 60_000 and again.select("shard_id", "x").exceptAll(df.select("shard_id", "x")).count() == 0


def test_normalized_tables_have_even_files(spark, tmp_path, small_pieces):
    lopsided = spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).repartitionByRange(8, F.when(F.col("id") < 39_990, 0).otherwise(F.col("id")))
    sinks.normalized(lopsided, str(tmp_path / "n"), sort=["id"], file_rows=3000)
    counts = [spark.read.parquet(str(f)).count() for f in files(tmp_path / "n")]
    assert sum(counts) == 40_000 and max(counts) <= 3000 and all(f.name.endswith(".zstd.parquet") for f in files(tmp_path / "n"))


def test_features_of_a_bucketed_table_need_no_exchange(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 13).cast("string").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 4000).alias("login_timestamp"), (F.col("id") % 3 > 0).cast("int").alias("login_successful"), *(F.concat(F.lit(c[0]), F.col("id") % 5).alias(c) for c in ("ip", "device", "country", "region", "city", "ip_token", "device_token", "geo_token", "context_token")))
    spark.sql(f"create database if not exists writers location '{tmp_path}/warehouse'")
    sinks.bucketed(rows, "writers.logins", "user_id", 6)
    read = spark.table("writers.logins")
    got = history.features(read, dealt=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = history.features(rows)
    assert got.count() == 400 and got.select(*want.columns).exceptAll(want).count() == 0
    spark.sql("drop database writers cascade")


def test_batches_run_twice_give_the_same_shards(spark, tmp_path):
    def put(i, ids):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"id": x, "user": f"u{x % 7}" if x % 11 else None}) + "\n" for x in ids))

    def run():
        stream = spark.readStream.schema("id long, user string").json(str(tmp_path / "in"))
        sharded.write_shards(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "user", 4, once=True).awaitTermination()
        return sorted(r.id for r in sharded.table(spark, str(tmp_path / "out")).collect())

    put(0, range(50))
    assert run() == list(range(50))
    put(1, range(50, 80))
    assert run() == list(range(80))
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # killed after its rows were written and before it was committed
    for crc in (tmp_path / "checkpoint" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    assert run() == list(range(80))
    half = spark.createDataFrame([(x, f"u{x % 7}") for x in range(90, 100)], "id long, user string")
    for rows in (half.limit(4), half, half):  # a batch cut short and run again
        sharded.write_batch(rows, 9, str(tmp_path / "out"), "user", 4)
    kept = sorted(r.id for r in sharded.table(spark, str(tmp_path / "out")).collect())
    assert kept == [*range(80), *range(90, 100)]
    sharded.compacted(spark, str(tmp_path / "out"), str(tmp_path / "even"))
    even = spark.read.parquet(str(tmp_path / "even"))
    assert even.count() == 90 and even.select("user", "shard_id").distinct().groupBy("user").count().where("count > 1").count() == 0
