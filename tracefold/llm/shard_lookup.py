"""Lookup of many ids in sorted-string-table shards, as a Spark job.

Wanted ids and the first id of every shard are put in one order by range partitioning, written once with the number of their range,
and each wanted id takes the last shard that starts at it or before; what starts in an earlier range comes in by a join with a row a range.
A task then walks its ids in order and opens a shard when it reaches it: footer, index and Bloom filter once, and for an id
that passes the filter the blocks which binary search names. Ids are met once each and ranges are of like size, so no shard
is a hot task, and nothing is broadcast.

An id that stands several times in `wanted` counts once; a null id finds the entries of null ids; ids that no shard holds
give a row with nulls. Entries of a repeated id are numbered from 0 in the order of their texts. No wanted rows give no rows, no shards
give nulls only. Other columns play no part. The entries found for one id are in memory together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import scratch
from tracefold.llm.token_shards import ShardReader, id_of

MOST_IDS = 1 << 20  # token ids in a batch that a task gives out
FOUND = pa.schema([("doc_id", pa.int64()), ("entry", pa.int32()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])


def first_ids(shards: DataFrame) -> DataFrame:
    """path and first id of every shard, from its index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            firsts = [id_of(ShardReader(p).index[0][0]) for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(firsts, pa.int64())], names=["path", "id"])

    return shards.select("path").repartition(max(1, shards.count())).mapInArrow(read, "path string, id long")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of (id, path) in the order of ids; a reader at a time."""
    at: str | None = None
    reader: ShardReader | None = None
    rows: list[tuple] = []
    held = 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

    for batch in batches:
        for doc_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if path is not None and path != at:
                at, reader = path, ShardReader(path)
            entries = reader.get(doc_id) if path is not None else []
            for number, ids in enumerate(entries):
                rows.append((doc_id, number, len(ids), ids.astype("int64")))
                held += len(ids) + 1
            if not entries:
                rows.append((doc_id, None, None, None))
                held += 1
            if held >= MOST_IDS:
                yield batch_of(rows)
                rows, held = [], 0
    if rows:
        yield batch_of(rows)


def lookup(shards: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, entry, n_tokens, ids of every entry of the wanted ids; nulls beside an id that has none."""
    ids = wanted.select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct().select("id", F.lit(1).alias("side"), F.lit(None).cast("string").alias("path"))
    starts = first_ids(shards).select("id", F.lit(0).alias("side"), "path")
    both = ids.unionByName(starts).repartitionByRange(F.col("id").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    both = scratch(both, "lookup")
    ends = both.where("side = 0").groupBy("part").agg(F.max(F.struct(F.col("id").isNotNull().alias("is"), "id", "path")).alias("end"))
    parts = both.select("part").distinct().join(ends, "part", "left")  # a row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("part", F.last("end.path", ignorenulls=True).over(before).alias("earlier"))
    within = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "side")
    placed = both.join(carried, "part").withColumn("path", F.coalesce(F.last("path", ignorenulls=True).over(within), "earlier")).where("side = 1")
    return placed.select("id", "path").mapInArrow(_found, "doc_id long, entry int, n_tokens long, ids array<long>")
