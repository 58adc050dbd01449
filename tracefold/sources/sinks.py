"""Sinks: Parquet by shard or split, and small JSON reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tracefold.operators.api_views import static_view
from tracefold.operators.columns import by_transform, largest, markdown
from tracefold.operators.profiling import groups
from tracefold.operators.split import split_stats


FILE_ROWS = 5_000_000


def shards(df: DataFrame, path: str, sort: list[str] | None = None, mode: str = "overwrite", file_rows: int = FILE_ROWS) -> None:
    """A folder per shard_id, with one sorted file, or several where a shard is large: partitions are rebalanced to the advisory size, so a hot shard is shared among tasks."""
    dealt = df.hint("rebalance", "shard_id")
    ordered = dealt.sortWithinPartitions("shard_id", *(sort or []))
    ordered.write.mode(mode).option("maxRecordsPerFile", file_rows).partitionBy("shard_id").parquet(path)


def normalized(df: DataFrame, path: str, sort: list[str] | None = None, mode: str = "overwrite", file_rows: int = FILE_ROWS) -> None:
    """A normalised table: files of even size, whatever the input's splits were, compressed with zstd, each sorted so that ranges of the sort columns skip files' row groups."""
    even = df.hint("rebalance")
    ordered = even.sortWithinPartitions(*sort) if sort else even
    ordered.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)


def bucketed(df: DataFrame, table: str, by: str, buckets: int, sort: list[str] | None = None, mode: str = "overwrite") -> None:
    """A table of the catalogue dealt by a column once; what groups or ranks by it later, such as `history.features(..., dealt=True)`, needs no exchange.

    All rows of a value are in one bucket, so `buckets` should be well above what the largest value fills.
    """
    dealt = df.repartition(buckets, by)
    dealt.write.mode(mode).bucketBy(buckets, by).sortBy(*(sort or [by])).format("parquet").saveAsTable(table)


def splits(df: DataFrame, path: str, mode: str = "overwrite", within: str | None = None) -> None:
    """A folder per split; with `within`, also split_stats, the rows of each split for each value of that column, as CSV."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    if within:
        _csv(split_stats(df.sparkSession.read.parquet(path), within).orderBy(within), f"{path.rstrip('/')}_stats")


def labelled(df: DataFrame, path: str, view: str = "request_response") -> None:
    """All rows with a known label, the same in their static view, and the static view of the rest, in folders of their own."""
    known = "coalesce(try_cast(label_known as int), 0) = 1"
    df.where(known).write.mode("overwrite").parquet(f"{path}/features_labeled")
    static_view(df.sparkSession.read.parquet(f"{path}/features_labeled"), view).write.mode("overwrite").parquet(f"{path}/features_static")
    static_view(df.where(f"not ({known})"), view).write.mode("overwrite").parquet(f"{path}/unlabeled_validation")


def _csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*flat).write.mode("overwrite").options(header=True, escape='"').csv(path)


def predictions(df: DataFrame, path: str, name: str) -> None:
    """Scored rows as Parquet, and from those as CSV."""
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    _csv(df.sparkSession.read.parquet(f"{path}/{name}.parquet"), f"{path}/{name}.csv")


def profile(profiled: DataFrame, path: str) -> None:
    """A recommended profile: statistics as CSV, columns by each grouping as JSON, the largest columns, and a summary."""
    spark = profiled.sparkSession
    _csv(profiled.orderBy("column_name").coalesce(1), f"{path}/stats")  # a row per column
    rows = spark.read.options(header=True, escape='"').csv(f"{path}/stats").count()
    for by in ("dtype", "range_bucket", "magnitude_group", "semantic_group", "transform_recommendation"):
        if by in profiled.columns:
            report(spark, {r[by]: r["columns"] for r in groups(profiled, by).collect()}, f"{path}/by_{by}")
    if "transform_steps" in profiled.columns:
        report(spark, {r["transform_recommendation"]: {"columns": r["columns"], "steps": r["steps"]} for r in by_transform(profiled).collect()}, f"{path}/processing_recommendations")
    report(spark, {"columns": rows, "largest": [r["column_name"] for r in largest(profiled).collect()]}, f"{path}/summary")


def fine_groups(fine: DataFrame, path: str) -> None:
    """Classes of columns: rows as CSV, columns and advice by class as JSON, and a report as Markdown."""
    spark = fine.sparkSession
    _csv(fine.orderBy("column_name").coalesce(1), f"{path}/columns")
    per = fine.groupBy("fine_grained_group").agg(F.sort_array(F.collect_list("column_name")).alias("columns"), F.first("fine_grained_why").alias("why"), F.first("fine_grained_best_practice").alias("best_practice"))
    report(spark, {r["fine_grained_group"]: {"columns": r["columns"], "why": r["why"], "best_practice": r["best_practice"]} for r in per.orderBy("fine_grained_group").collect()}, f"{path}/groups")
    spark.createDataFrame([(markdown(fine),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def checks(scored: DataFrame, summary: dict, path: str) -> None:
    """Scored cases as CSV and their summary as JSON."""
    _csv(scored.coalesce(1), f"{path}/cases")
    report(scored.sparkSession, summary, f"{path}/summary")


def report(spark: SparkSession, content: dict, path: str) -> None:
    """A small JSON document."""
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(path)
