"""The log source through rotation, truncation and restarts; sessions and incidents of streams against batches."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracefold.sources.tail import Tail, TailReader
from tracefold.streaming import incidents


class Log:
    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.path, self.options = spark, folder, str(folder / "log"), options

    def add(self, *lines, end="\n"):
        with open(self.path, "a") as f:
            f.write("".join(x + "\n" for x in lines[:-1]) + (lines[-1] + end if lines else ""))

    def run(self):
        """All lines so far, by a query that starts anew from its checkpoint."""
        self.spark.dataSource.register(Tail)
        df = self.spark.readStream.format("tail").options(path=self.path, partitionBytes="64", **self.options).load()
        q = df.writeStream.format("json").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.value for r in self.spark.read.schema("value string").json(str(self.folder / "out")).collect())


def test_rotation_and_truncation_lose_and_repeat_nothing(spark, tmp_path):
    log = Log(spark, tmp_path, settleSeconds="0")
    first = [f"first {i:04d}" for i in range(40)]
    log.add(*first)
    log.add("half", end="")
    assert log.run() == first  # the line being written waits
    log.add(" whole", "late in the first")
    os.rename(log.path, log.path + ".1")  # rotated before it was read to its end
    second = [f"second {i:04d}" for i in range(30)]
    log.add(*second)
    want = sorted([*first, "half whole", "late in the first", *second])
    assert log.run() == want
    os.rename(log.path + ".1", log.path + ".2")
    os.rename(log.path, log.path + ".1")
    with open(log.path + ".3.gz", "w") as f:
        f.write("compressed\n")
    third = [f"third {i:04d}" for i in range(5)]
    log.add(*third)
    assert log.run() == sorted(want + third)
    with open(log.path, "w"):  # truncated and written anew, beyond its old length
        pass
    fourth = [f"fourth {i:04d} longer than before" for i in range(20)]
    log.add(*fourth)
    assert log.run() == sorted(want + third + fourth)
    assert log.run() == sorted(want + third + fourth)


def test_ranges_are_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "log").write_text("".join(f"line {i} {'x' * (i % 50)}\n\n" for i in range(300)))
    for size in (1, 7, 64, 1000, 1 << 20):
        reader = TailReader(str(tmp_path / "log"), size, 10.0, True)
        parts = reader.partitions({}, reader.latestOffset())
        got = [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()]
        assert got == [f"line {i} {'x' * (i % 50)}".rstrip() for i in range(300)]
    spark.dataSource.register(Tail)
    df = spark.readStream.format("tail").options(path=str(tmp_path / "log"), partitionBytes="2000").load().withColumn("task", F.spark_partition_id())
    q = df.writeStream.format("memory").queryName("tasks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(distinct task) n, count(*) c from tasks").collect()[0] == (-(-os.path.getsize(tmp_path / "log") // 2000), 300)


def test_lost_files_are_an_error_unless_allowed(tmp_path):
    (tmp_path / "log").write_text("a\nb\n")
    reader = TailReader(str(tmp_path / "log"), 100, 0.0, True)
    parts = reader.partitions({}, reader.latestOffset())
    os.remove(tmp_path / "log")
    with pytest.raises(FileNotFoundError, match="before it was read"):
        list(reader.read(parts[0]))
    assert list(TailReader(str(tmp_path / "log"), 100, 0.0, False).read(parts[0])) == [] and reader.latestOffset() == {}


SCHEMA = "event_id string, event_timestamp string, client_ip string, path string, query string"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def batches():
    """Three files; events within 10 minutes of order, some repeated, and one that is too late."""
    random.seed(9)
    made, at = [], 0.0
    for i in range(240):
        at += random.choice([0.2, 1, 3, 12, 45])
        late = random.choice([0, 0, 2, 6])
        made.append((f"id{i}", (START + timedelta(minutes=at - late)).isoformat(), f"10.0.0.{random.choice([1, 1, 1, 2])}", "/search", random.choice(["id=1' or 1=1", "q=books"])))
    made += [(None, START.isoformat(), "10.0.0.1", "/search", "id=1' or 1=1"), ("no time", None, "10.0.0.1", "/", ""), ("no source", START.isoformat(), None, "/", "")]
    thirds = [made[:80] + made[70:75], made[78:160] + made[150:160], made[158:]]
    end = [("last", (START + timedelta(days=30)).isoformat(), "10.9.9.9", "/search", "q=books")]
    too_late = [("too late", START.isoformat(), "10.0.0.1", "/search", "id=1' or 1=1")]
    return made, [*thirds, end, too_late, [("more", (START + timedelta(days=60)).isoformat(), "10.9.9.9", "/search", "q=books")]]


def streamed(spark, folder, batches, made, name):
    """Rows of a query over files that come one after the other, started anew for each."""
    (folder / "in").mkdir()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for i, rows in enumerate(batches):
        (folder / "in" / f"{i}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))
        df = made(spark.readStream.schema(SCHEMA).json(str(folder / "in")))
        q = df.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(folder / "out"))


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", incidents.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_streamed_sessions_equal_batch(spark, tmp_path, batches):
    made, files = batches
    got = streamed(spark, tmp_path, files, lambda e: incidents.sessions(e, "20 minutes"), "sessions")
    want = incidents.sessions(spark.createDataFrame(made, SCHEMA), "20 minutes")
    rows = lambda df: sorted(map(tuple, df.where("client_ip <> '10.9.9.9'").collect()))
    assert rows(got) == rows(want) and want.count() > 10


def test_streamed_incidents_equal_batch(spark, tmp_path, batches):
    made, files = batches
    got = streamed(spark, tmp_path, files, lambda e: incidents.incidents(e, "20 minutes", most=4), "incidents")
    want = incidents.incidents(spark.createDataFrame(made, SCHEMA), "20 minutes", most=4)
    closed = lambda df: sorted(map(tuple, df.where("kind = 'closed'").collect()))
    assert closed(got) == closed(want) and want.where("kind = 'closed'").count() > 10
    told = got.where("kind = 'escalated'").collect()
    full = want.where("kind = 'escalated'").collect()
    assert len(told) == len(full) > 0 and all(any(f.client_ip == t.client_ip and f.first_time <= t.last_time <= f.last_time and 4 <= t.events <= f.events for f in full) for t in told)


def test_batches_of_incidents_without_rows_and_bad_spans(spark):
    assert incidents.incidents(spark.createDataFrame([], SCHEMA)).count() == 0 == incidents.sessions(spark.createDataFrame([], SCHEMA)).count()
    with pytest.raises(ValueError, match="span"):
        incidents.seconds("soon")
