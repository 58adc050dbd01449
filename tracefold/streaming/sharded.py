"""Shards of a stream: each batch adds its rows to the shards it touches, once, however often it is run.

A batch writes only folders shard_id=s/batch=b of its own number, and replaces them if they are there. Rows of a batch that was cut short are thus replaced
when it runs again, and other batches' rows are never read or moved. `compacted` brings the many small files of old batches together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracefold.functions.numbers import shard
from tracefold.sources.sinks import FILE_ROWS, shards


def write_batch(rows: DataFrame, number: int, path: str, key: str, n: int = 256) -> None:
    """Puts a batch's rows into its folders of the shards of `key`. Rows of a null key have a shard as others; an empty batch changes nothing."""
    dealt = rows.withColumns({"shard_id": shard(F.coalesce(F.col(key).cast("string"), F.lit("")), n), "batch": F.lit(number).cast("long")})
    out = dealt.hint("rebalance", "shard_id").sortWithinPartitions("shard_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS)
    out.partitionBy("shard_id", "batch").parquet(path)


def write_shards(stream: DataFrame, path: str, checkpoint: str, key: str, n: int = 256, once: bool = False) -> StreamingQuery:
    """Follows a stream into shards; a restart from the checkpoint repeats its last batch at most, under the same number."""
    writer = stream.writeStream.foreachBatch(lambda rows, number: write_batch(rows, number, path, key, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def table(spark: SparkSession, path: str) -> DataFrame:
    """All rows so far, with shard_id."""
    return spark.read.parquet(path).drop("batch")


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """Another table of the same rows with even files per shard."""
    shards(table(spark, path), to)
