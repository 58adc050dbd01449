"""Column profiles, transform recommendations, and scaling by them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import numbers as N
from tracefold.operators.quantiles import distinct_counts, of_counts, quantiles

# Words in a column's name and the group they stand for, in order.
GROUP_WORDS = (
    ("flags", ("flag",)), ("transport", ("port", "protocol")), ("timing", ("duration", "active", "idle")), ("directionality", ("ratio", "share", "imbalance")),
    ("timing", ("rate", "_per_s", "_per_second")), ("volume", ("pkt", "packet")), ("volume", ("byte", "len", "header")),
)
LABELS = ("protocol", "dst_port", "label_binary", "label_known")


def semantic_group(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.isin(*LABELS), F.lit("identifier_or_label"))
    for group, words in GROUP_WORDS:
        out = out.when(low.rlike("|".join(words)), F.lit(group))
    return out.otherwise(F.lit("other_numeric"))


def recommendation(name: Column, group: Column, low: Column, high: Column, p95: Column, p99: Column, distinct: Column) -> Column:
    """How to scale a column with these statistics."""
    tail = (p99 + 1) / (F.greatest(p95, F.lit(0.0)) + 1)
    extreme = (high + 1) / (F.greatest(p99, F.lit(0.0)) + 1)
    return (
        F.when((distinct <= 2) & (low >= 0) & (high <= 1), "keep_binary_indicator")
        .when(group == "identifier_or_label", "keep_raw_for_metadata_or_training_label_only")
        .when((low >= 0) & (high <= 1), "keep_bounded_ratio")
        .when(low < 0, "robust_scale_signed_feature")
        .when(F.lower(name).contains("flag"), "keep_indicator_and_optional_log1p_count")
        .when(group.isin("volume", "timing") & ((p99 > 100) | (tail > 1.5) | (extreme > 5)), "clip_high_percentile_then_log1p_then_standardize")
        .when(group == "directionality", "clip_ratio_then_standardize")
        .when(high <= 100, "keep_raw_or_standardize")
        .otherwise("standardize_after_basic_cleaning")
    )


EXACT = ("double", "bigint", "int", "smallint", "tinyint")  # types whose text, read as a double, is what a cast gives; a float's is not
SHARES = (0.25, 0.5, 0.75, 0.95, 0.99)


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, x): each value as a double. A column's place in the list stands for its name, as it is grouped faster."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    value = lambda c: F.col(f"`{c}`").cast("double") if kinds.get(c) in EXACT else N.number(F.col(f"`{c}`").cast("string"))
    return df.select(F.posexplode(F.array(*map(value, columns))).alias("column_name", "x"))


def profile(df: DataFrame, columns: Sequence[str], most_distinct: int | None = None) -> DataFrame:
    """A row per column: counts, ratios, exact quantiles, moments, scale and recommendation.

    most_distinct: a column with more values has the unique_count 0 and unique_count_is_approximate, for rules that expect a cap.
    Counts and moments are partial aggregates, and quantiles come from sorted ranges, so no task holds a column.
    """
    long = long_numbers(df, columns)
    stats = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("x").alias("non_null_count"), F.avg(F.col("x").isNull().cast("double")).alias("missing_ratio"), F.avg((F.col("x") == 0).cast("double")).alias("zero_ratio"),
        F.avg((F.col("x") < 0).cast("double")).alias("negative_ratio"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
    )
    counts = distinct_counts(long)
    unique = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    stats = stats.join(F.broadcast(unique), "column_name", "left").join(F.broadcast(of_counts(counts, SHARES).drop("n")), "column_name", "left")  # a row per column
    stats = stats.withColumn("column_name", F.element_at(F.array(*map(F.lit, columns)), F.col("column_name") + 1))
    stats = stats.withColumns({f"p{round(100 * q)}": F.col("p")[i] for i, q in enumerate(SHARES)} | {"unique_count": F.coalesce("unique_count", F.lit(0))}).drop("p")
    if most_distinct is not None:
        over = F.col("unique_count") > most_distinct
        stats = stats.withColumns({"unique_count_is_approximate": over | (F.col("non_null_count") == 0), "unique_count": F.when(over, 0).otherwise(F.col("unique_count"))})
    stats = stats.withColumns({"convertible_ratio": F.col("non_null_count") / F.greatest("total_rows", F.lit(1)), "max_abs_reference": F.greatest(F.abs("min"), F.abs("p99"), F.abs("max")), "semantic_group": semantic_group(F.col("column_name"))})
    empty = F.col("non_null_count") == 0
    return stats.withColumns(
        {
            "range_bucket": F.when(empty, "all_missing").otherwise(N.range_bucket(F.col("max_abs_reference"), F.col("min"))),
            "magnitude_group": F.when(empty, "all_missing").otherwise(N.magnitude_group(F.col("max_abs_reference"))),
            "transform_recommendation": F.when(empty, "drop_or_investigate").otherwise(recommendation(F.col("column_name"), F.col("semantic_group"), F.col("min"), F.col("max"), F.col("p95"), F.col("p99"), F.col("unique_count"))),
        }
    )


def groups(profiled: DataFrame, by: str) -> DataFrame:
    return profiled.groupBy(by).agg(F.sort_array(F.collect_list("column_name")).alias("columns"))


def _scaled(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Columns less their mean, over their population deviation (1 if it is 0); statistics in one pass, then constants."""
    df = df.withColumns(made)
    aggs = [f(F.col(c)).alias(f"{k}_{i}") for i, c in enumerate(made) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(made):
        mean, std = row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 0.0
        out[c] = ((F.coalesce(F.col(c), F.lit(0.0)) - mean) / (std if std and math.isfinite(std) else 1.0)).cast("float")
    return df.withColumns(out)


def clip_log_zscore(df: DataFrame, columns: Sequence[str], quantile: float = 0.99) -> DataFrame:
    """z-scores of log1p of values clipped to [0, quantile]."""
    high = {c: max(0.0, p[0] or 0.0) for c, p in quantiles(df, columns, [quantile]).items()}
    return _scaled(df, {f"{c}_z": F.log1p(N.clip(F.col(c).cast("double"), 0.0, high[c])) for c in columns})


def zscore(df: DataFrame, columns: Sequence[str], low: float | None = None, high: float | None = None) -> DataFrame:
    bound = lambda c: N.clip(c, low, high) if low is not None and high is not None else c
    return _scaled(df, {f"{c}_z": bound(F.col(c).cast("double")) for c in columns})


def sentinel_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether a value is none of the negative sentinels, and the z-score with those at 0."""
    flags = {f"{c}_valid": N.flag(F.col(c) >= 0).cast("byte") for c in columns}
    return _scaled(df.withColumns(flags), {f"{c}_z": F.when(F.col(c) >= 0, F.col(c).cast("double")).otherwise(0.0) for c in columns})


def presence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_present": N.flag(F.col(c) > 0).cast("byte") for c in columns})


def robust_profile(df: DataFrame, columns: Sequence[str], least_scale: float = 1e-6) -> dict[str, tuple[float, float]]:
    """(median, interquartile range) of each column; a range below the least is 1."""
    out = {}
    for c, found in quantiles(df, columns, (0.25, 0.5, 0.75)).items():
        low, mid, high = (x or 0.0 for x in found)
        out[c] = (mid, high - low if high - low >= least_scale else 1.0)
    return out


def block_risk(profiled: dict[str, tuple[float, float]]) -> Column:
    """1 - exp(-mean deviation) over a block's columns, deviations from the median in ranges, at most 5 each."""
    parts = [F.least(F.abs(F.col(c).cast("double") - mid) / scale, F.lit(5.0)) for c, (mid, scale) in profiled.items()]
    return 1 - F.exp(-(sum(parts[1:], parts[0]) / float(len(parts))))


def fused_risk(blocks: dict[str, tuple[float, Column]]) -> Column:
    """The weighted sum of block scores, within [0, 1]."""
    return N.clip(sum((w * c for w, c in blocks.values()), F.lit(0.0)), 0.0, 1.0)
