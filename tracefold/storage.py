"""Intermediate tables: Parquet under ``spark.checkpoint.dir``, a folder that every executor and the driver reach.

They stand where a result is used twice or lineage must be cut, so a lost executor costs a re-read and no recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder in the cluster's shared one. Without that setting a temporary folder serves, on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if "root" not in _local:
            _local["root"] = tempfile.mkdtemp(prefix="tracefold-")
        root = _local["root"]
    return f"{root.rstrip('/')}/tracefold-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df under the shared folder, in a folder for each value of a column if one is named, and reads it back with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` made and that nothing will read any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_all(spark: SparkSession) -> None:
    """Removes the application's intermediate tables; results that still read them can't be computed after it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def dropped_at_the_end(spark: SparkSession) -> Iterator[SparkSession]:
    """Jobs inside may leave intermediate tables; they go when the block ends, so write results inside it."""
    try:
        yield spark
    finally:
        drop_all(spark)
