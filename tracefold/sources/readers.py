"""Sources. CSV comes as text, to be cast by the operators; files of a folder are read together."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.names import fresh

HTTP = "struct<headers: map<string, string>, method: string, url: string, body: string, Attack_Tag: string>"
REPLY = "struct<status: string, headers: map<string, string>, status_code: string, body: string>"
HTTPS_FILES = {"flows": "flows.csv", "aggregated_flows": "aggregated_flows.csv", "samples": "samples.csv"}


def csv(spark: SparkSession, path: str | Sequence[str], breaks_in_quotes: bool = True) -> DataFrame:
    """All columns as text. breaks_in_quotes: quoted values may hold line breaks; a file is then read by one task. Large files without any split if told so."""
    return spark.read.options(header=True, inferSchema=False, multiLine=breaks_in_quotes, escape='"').csv(path)


def csv_stream(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The files of a folder, as they come, a few at a time; all columns as text."""
    return spark.readStream.options(header=True, maxFilesPerTrigger=8).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def numbered(df: DataFrame, name: str = "record_index") -> DataFrame:
    """A table just read, with its file's name and each row's number in its file from 0, whatever the splits.

    A split's rows follow each other in one task; the rows of the splits before, a row per split, are broadcast.
    """
    file, block, at_name = (fresh(df, x) for x in ("_file", "_block", "_at"))
    at = df.select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(at_name))
    first, rows, earlier = (fresh(at, x) for x in ("_first", "_rows", "_before"))
    splits = at.groupBy(file, block).agg(F.min(at_name).alias(first), F.count(F.lit(1)).alias(rows))
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn(earlier, F.coalesce(F.sum(rows).over(before), F.lit(0))).drop(rows)
    return at.join(F.broadcast(splits), [file, block]).withColumn(name, F.col(at_name) - F.col(first) + F.col(earlier)).drop(file, block, at_name, first, earlier)


def _stem(file_name: str) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def any_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet file or folder, by its suffix."""
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith(".csv"):
        return csv(spark, path)
    raise ValueError(f"no reader for {path}")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """The CSV and Parquet files of a folder as one table; columns that one kind lacks are null."""
    names = _names(spark, path)
    found = [f for suffixes, f in (((".csv",), csv), ((".parquet", ".pq"), lambda s, p: s.read.parquet(*p))) if any(n.lower().endswith(suffixes) for n in names)]
    parts = [f(spark, [f"{path}/{n}" for n in names if n.lower().endswith((".csv",) if f is csv else (".parquet", ".pq"))]) for f in found]
    if not parts:
        raise FileNotFoundError(f"no CSV or Parquet files in {path}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _names(spark: SparkSession, path: str) -> list[str]:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().getName() for x in jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jpath))


def network_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flows with their file and an id of file and row number. Flow files are numbers and short labels, so they split at lines."""
    df = numbered(csv(spark, path, breaks_in_quotes=False))
    return df.withColumn("event_id", F.concat_ws(":", _stem("source_file"), F.col("record_index").cast("string"))).drop("record_index")


def https_csv(spark: SparkSession, folder_path: str, view: str = "flows") -> DataFrame:
    """The file of a view; FileNotFoundError if the folder has none."""
    if HTTPS_FILES[view] not in _names(spark, folder_path):
        raise FileNotFoundError(f"{folder_path} has no {HTTPS_FILES[view]}")
    return csv(spark, f"{folder_path}/{HTTPS_FILES[view]}", breaks_in_quotes=False).withColumn("source_file", F.lit(HTTPS_FILES[view]))


def api_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Events of JSON arrays of {request, response}, with the file they come from and their index in it; other JSON is refused."""
    _require_arrays(spark, path)
    return numbered(spark.read.schema(f"request {HTTP}, response {REPLY}").json(path, multiLine=True))


def _require_arrays(spark: SparkSession, path: str | Sequence[str]) -> None:
    """Raises for a file that is empty or starts with something else than [. The tasks look, whatever the number of files.

    Files are cut at commas, so no task holds more than a piece; the first piece of a file's first split decides.
    """
    text = spark.read.text(path, lineSep=",")
    pieces = text.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    firsts = pieces.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("first"))
    begins = F.regexp_replace("first", r"^[\uFEFF\s]+", "").startswith("[")
    seen, wrong = firsts.agg(F.count(F.lit(1)), F.min(F.when(~begins, F.col("file_path")))).collect()[0]
    if wrong:
        raise ValueError(f"expected a list in {wrong.rsplit('/', 1)[-1]}")
    empty = len(text._jdf.inputFiles()) - seen  # files listed of which no task reads a byte
    if empty:
        raise ValueError(f"expected a list in every file, but {empty} hold nothing")


def archive_7z(spark: SparkSession, path: str) -> DataFrame:
    raise NotImplementedError("7z archives aren't read; unpack them and read the JSON")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank lines are left out; rows without an event_id get file:line, lines from 1 with blank ones counted."""
    lines = numbered(spark.read.text(path)).where(F.trim("value") != "")
    made = F.concat_ws(":", "source_file", (F.col("record_index") + 1).cast("string"))
    df = lines.select(F.from_json("value", schema).alias("e"), made.alias("_line")).select("e.*", "_line")
    own = F.coalesce(F.col("event_id"), F.col("_line")) if "event_id" in df.columns else F.col("_line")
    return df.withColumn("event_id", own).drop("_line")


def profile_csv(spark: SparkSession, path: str) -> DataFrame:
    """A column profile as `sinks.profile` writes it."""
    numbers = [f"{c} double" for c in ("missing_ratio", "zero_ratio", "negative_ratio", "convertible_ratio", "min", "p25", "p50", "p75", "p95", "p99", "max", "mean", "std", "max_abs_reference")]
    kinds = dict(x.split() for x in ["total_rows long", "non_null_count long", "unique_count long", "unique_count_is_approximate boolean", *numbers])
    df = spark.read.options(header=True, inferSchema=False, escape='"').csv(path)
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c in df.columns if c in kinds})


def split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One split of a table written by `sinks.splits`; only its files are read. FileNotFoundError if it has none."""
    if f"split={name}" not in _names(spark, path):
        raise FileNotFoundError(f"{path} has no split {name}")
    return spark.read.parquet(path).where(F.col("split") == name)


def shard(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("shard_id") == number)


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
