"""Alerts and abuse counts over a stream of access-log events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracefold.operators.alerts import EVENT_SCHEMA, alerts, with_signal
from tracefold.sources.tail import Tail


def follow(spark: SparkSession, path: str) -> DataFrame:
    """Events of one growing JSON-lines file."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("path", path).load().select(F.from_json("value", EVENT_SCHEMA).alias("e")).select("e.*")


def rolled(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder to which JSON-lines files are added."""
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def write_alerts(events: DataFrame, path: str, checkpoint: str, once: bool = False, predictions: str | None = None) -> StreamingQuery:
    """Appends alerts as JSON; with a checkpoint each event gives its alert once, also after a restart."""
    writer = alerts(events, predictions).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def abuse_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events with a signal by source and window; rows later than the watermark are left out."""
    timed = events.withColumn("time", F.to_timestamp("event_timestamp")).withWatermark("time", late)
    flagged = with_signal(timed).where("security_finding is not null")
    return flagged.groupBy(F.window("time", width), "client_ip").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("path").alias("paths"))
