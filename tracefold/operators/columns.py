"""Rules on profiled columns: what a column measures, how to prepare it and why, and its finer class.

Everything is an expression over a profile (a row per column, as `profiling.profile` gives it), so profiles of any number of tables
are classified together. Names are those of the raw files, with spaces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups of raw column names, their texts, and the classes with reasons and advice.
RAW_GROUPS = (
    ("metadata_or_label", r"^(timestamp|label)$"), ("transport_context", r"^(protocol|dst port)$"), ("flag_features", "flag"), ("timing", "iat|duration|active|idle"), ("rate", "pkts/s|byts/s"),
    ("directionality_ratio", "ratio|share|imbalance"), ("signed_or_sentinel_window", "init .*win|win.*init "), ("flow_volume", "subflow|tot |totlen"), ("packet_shape", "len|size|header"), ("flow_volume", "pkt|packet"),
)
GROUP_REASONS = {
    "metadata_or_label": "Column is metadata or supervision, not a behavioral numeric feature.",
    "transport_context": "Column describes routing or protocol context rather than flow magnitude.",
    "flag_features": "Column represents sparse control or handshake flags.",
    "timing": "Column measures duration or inter-arrival timing behavior.",
    "rate": "Column is a per-second rate and is usually volatile with heavy right tail.",
    "directionality_ratio": "Column compares forward and backward behavior and can become unstable.",
    "signed_or_sentinel_window": "Column contains signed values that likely include sentinel semantics.",
    "flow_volume": "Column measures counts or totals that reflect traffic volume.",
    "packet_shape": "Column describes packet or segment size distribution.",
    "other_numeric": "Column is numeric but does not match a strong semantic family.",
}
TRANSFORM_REASONS = {
    "metadata_or_target_only": "Keep for time split or target mapping only; do not feed raw into the model.",
    "drop_constant_feature": "Column has no usable variance in this analyzed file.",
    "keep_binary_indicator": "Observed values are effectively binary already.",
    "bucketize_transport_context": "Raw identifier values are shortcut-prone; coarse buckets generalize better.",
    "treat_negative_as_sentinel_then_scale": "Negative values should be treated carefully instead of applying direct log1p.",
    "keep_indicator_and_drop_raw_count_if_sparse": "Presence usually matters more than exact count for sparse flags.",
    "clip_then_log1p_flag_count": "Rare larger counts benefit from compression after clipping.",
    "clip_ratio_then_standardize": "Ratios need clipping because small denominators can inflate them.",
    "clip_high_percentile_then_log1p_then_standardize": "Observed tail is long enough that raw scale would dominate training.",
    "standardize_after_basic_cleaning": "Distribution looks numeric and usable after inf handling and scaling.",
    "keep_raw_or_standardize": "Observed range is already small and stable.",
}
TRANSFORM_STEPS = {
    "metadata_or_target_only": ["Use only for metadata, sorting, splitting, or labels", "Never feed raw values into the model matrix"],
    "drop_constant_feature": ["Drop from training features", "Keep only in analysis output if needed for audit"],
    "keep_binary_indicator": ["Keep as 0/1 indicator", "Skip scaling unless the downstream model requires a fully standardized matrix"],
    "bucketize_transport_context": ["Convert protocol to coarse indicators such as is_tcp or is_udp", "Map dst_port to coarse buckets such as system, registered, or dynamic"],
    "treat_negative_as_sentinel_then_scale": ["Treat negative values as sentinel or invalid if domain semantics confirm that", "Add validity indicator", "Scale valid values with robust scaling or z-score"],
    "keep_indicator_and_drop_raw_count_if_sparse": ["Create presence indicator", "Drop raw count if it remains near-binary and sparse"],
    "clip_then_log1p_flag_count": ["Clip high counts at p99 or p99.5", "Apply log1p to clipped count", "Optionally standardize transformed value"],
    "clip_ratio_then_standardize": ["Clip to safe upper bound using p99 or domain cap", "Fill divide-by-zero artifacts safely", "Standardize if fed directly to the model"],
    "clip_high_percentile_then_log1p_then_standardize": ["Replace inf or invalid values with NaN", "Clip at p99 or p99.5", "Apply log1p", "Standardize if the downstream model is scale-sensitive"],
    "standardize_after_basic_cleaning": ["Replace inf with NaN if present", "Fill or impute missing values safely", "Standardize the cleaned feature"],
    "keep_raw_or_standardize": ["Keep raw value", "Optionally standardize for linear models"],
}
NO_STEPS = ["Inspect distribution before training"]
CLASSES = {
    "transport_protocol_category": ("Very low-cardinality protocol code; behaves as a categorical routing context feature.", "Convert to one-hot or coarse indicators such as is_tcp and is_udp."),
    "transport_port_high_cardinality": ("Destination port is a high-cardinality identifier with shortcut risk.", "Bucketize into coarse port families or audited service groups, not raw scaling."),
    "constant_zero_or_constant_value": ("The column has no usable variance in this dataset snapshot.", "Drop from training features."),
    "signed_sentinel_tcp_window": ("Negative values indicate sentinel or invalid markers rather than true signed magnitude.", "Create validity flag, mask sentinel values, then scale only valid magnitudes."),
    "rare_binary_transport_flag": ("Binary transport flag with very sparse positives.", "Keep as 0/1 indicator; no additional scaling needed."),
    "binary_transport_flag": ("Binary transport flag with enough positives to be directly useful.", "Keep as 0/1 indicator."),
    "small_count_flag": ("Flag-like count with limited support beyond pure binary.", "Keep presence indicator and optionally a clipped log-count view."),
    "denominator_sensitive_ratio_spike": ("Most rows are bounded near 0-1 but a tiny minority spikes sharply because of small denominators.", "Clip the upper tail aggressively, then standardize the clipped ratio."),
    "bounded_or_mild_ratio": ("Ratio feature with relatively bounded support.", "Clip to a safe range if needed and standardize."),
    "packet_floor_zero_inflated": ("Many flows have a structural zero minimum, with a compact positive range when present.", "Keep the raw shape signal, optionally add a presence indicator, and standardize."),
    "packet_ceiling_mtu_like": ("Upper quantiles sit near Ethernet payload ceilings, so the feature captures bounded packet-size structure.", "Standardize after basic cleaning; avoid unnecessary log compression."),
    "packet_shape_with_rare_header_outlier": ("The bulk of the distribution is moderate, but a very small number of rows create extreme header-related outliers.", "Prefer clipping plus standardization if those outliers hurt training; otherwise standardize."),
    "moderate_packet_shape_continuous": ("Continuous packet-size structure feature with moderate spread.", "Standardize after cleaning missing and infinite values."),
    "broad_packet_shape_continuous": ("Packet-shape feature with a wider but still interpretable physical range.", "Standardize, with optional mild clipping if outliers destabilize the model."),
    "rate_with_infinite_risk": ("Per-second rate can explode to infinity when duration is tiny or malformed.", "Replace inf with NaN, clip high percentiles, apply log1p, then standardize."),
    "extreme_positive_rate": ("Rate feature is strongly right-skewed with extreme upper tail.", "Clip the high tail, apply log1p, and standardize."),
    "zero_inflated_extreme_timing": ("Most rows are zero or near-zero, but nonzero rows jump to very large values.", "Clip, apply log1p, and standardize; optionally add a nonzero indicator."),
    "saturated_timeout_like_timing": ("Median timing is tiny while upper percentiles cluster near a hard cap or timeout ceiling.", "Treat as heavy-tailed timing: clip near p99, log1p, and standardize."),
    "burst_gap_heavy_tail_timing": ("Inter-arrival timing has a strong burst-versus-gap pattern with a heavy right tail.", "Clip, apply log1p, and standardize."),
    "moderate_timing_continuous": ("Timing feature is continuous but less pathological than the extreme-tail timing families.", "Standardize, adding clipping if later diagnostics show instability."),
    "always_positive_count_with_rare_huge_tail": ("Every row has a positive count, but a small minority of flows are orders of magnitude larger.", "Clip the upper tail, apply log1p, and standardize."),
    "zero_moderate_with_extreme_volume_tail": ("Many rows are zero or small, while a tiny minority explodes to very large bytes or packet totals.", "Clip, apply log1p, and standardize; optional nonzero indicator can help."),
    "small_count_with_rare_large_flow": ("The normal operating range is tiny, but rare very large flows produce a long tail.", "Keep a clipped raw or log1p view; avoid raw unbounded scale."),
    "general_positive_volume": ("Positive traffic magnitude feature with enough skew to benefit from compression.", "Clip high values, apply log1p, and standardize."),
    "other_numeric_needs_manual_review": ("The column did not match a stronger fine-grained family safely.", "Inspect the raw semantics and training impact manually."),
}
c = F.col


def raw_group(name: Column) -> Column:
    """What a raw column measures, by its name; the first rule that holds."""
    low = F.lower(name)
    out = F.when(low.rlike(RAW_GROUPS[0][1]), F.lit(RAW_GROUPS[0][0]))
    for group, pattern in RAW_GROUPS[1:]:
        out = out.when(low.rlike(pattern), F.lit(group))
    return out.otherwise(F.lit("other_numeric"))


def _over(a: str, b: Column) -> Column:
    return (c(a) + 1) / (b + 1)


def heavy_tail() -> Column:
    """Whether the upper percentiles or the maximum stand far beyond what is below them."""
    return (c("p99") > 100) | (_over("p99", F.greatest("p95", F.lit(0.0))) > 1.5) | (_over("max", F.greatest("p99", F.lit(0.0))) > 5)


def _constant() -> Column:
    return (~c("unique_count_is_approximate") & (c("unique_count") <= 1)) | (c("min") == c("max"))


def transform(group: Column) -> Column:
    flag = F.when((c("zero_ratio") >= 0.95) | (c("unique_count") <= 3), "keep_indicator_and_drop_raw_count_if_sparse").otherwise("clip_then_log1p_flag_count")
    return (
        F.when(group == "metadata_or_label", "metadata_or_target_only")
        .when(_constant(), "drop_constant_feature")
        .when((c("unique_count") <= 2) & (c("min") >= 0) & (c("max") <= 1), "keep_binary_indicator")
        .when(group == "transport_context", "bucketize_transport_context")
        .when(c("min") < 0, "treat_negative_as_sentinel_then_scale")
        .when(group == "flag_features", flag)
        .when(group == "directionality_ratio", "clip_ratio_then_standardize")
        .when(group.isin("timing", "rate", "flow_volume") & heavy_tail(), "clip_high_percentile_then_log1p_then_standardize")
        .when((group == "packet_shape") | (c("max") > 100), "standardize_after_basic_cleaning")
        .otherwise("keep_raw_or_standardize")
    )


def _text(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def recommended(profile: DataFrame) -> DataFrame:
    """A profile with raw semantic_group, transform_recommendation, grouping_rationale and transform_steps."""
    df = profile.withColumn("semantic_group", raw_group(c("column_name")))
    df = df.withColumn("transform_recommendation", F.when(c("non_null_count") == 0, "drop_or_investigate").otherwise(transform(c("semantic_group"))))
    why = F.concat(
        _text(GROUP_REASONS, c("semantic_group"), "Column was grouped by heuristic semantic rules."),
        F.lit(" Observed range bucket is `"), c("range_bucket"), F.lit("`. "),
        _text(TRANSFORM_REASONS, c("transform_recommendation"), "Transform was selected from profile heuristics."),
    )
    steps = F.create_map(*(x for k, v in TRANSFORM_STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return df.withColumns({"grouping_rationale": why, "transform_steps": F.coalesce(F.element_at(steps, c("transform_recommendation")), F.array(*map(F.lit, NO_STEPS)))})


def by_transform(recommended_profile: DataFrame) -> DataFrame:
    """A row per recommendation: its columns in order and its steps."""
    return recommended_profile.groupBy("transform_recommendation").agg(F.sort_array(F.collect_list("column_name")).alias("columns"), F.first("transform_steps").alias("steps"))


def _fine_class() -> Column:
    group, infinite = c("semantic_group"), F.lit(float("inf"))
    known = lambda *names: F.coalesce(F.forall(F.array(*(c(n).cast("double") for n in names)), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    over = lambda a, b: F.when(known(a, b), (c(a) + 1) / (c(b) + 1)).otherwise(infinite)
    tail, spike, centre = over("p99", "p95"), over("max", "p99"), over("p95", "p50")
    flag = F.when((c("unique_count") <= 2) & (c("min") >= 0) & (c("max") <= 1), F.when(c("zero_ratio") >= 0.95, "rare_binary_transport_flag").otherwise("binary_transport_flag")).otherwise("small_count_flag")
    shape = (
        F.when((c("zero_ratio") >= 0.75) & (c("p95") <= 125), "packet_floor_zero_inflated")
        .when((c("p95") >= 1200) & (c("p99") >= 1400), "packet_ceiling_mtu_like")
        .when((spike > 100) & (c("p99") < 5000), "packet_shape_with_rare_header_outlier")
        .when(c("p99") <= 1000, "moderate_packet_shape_continuous")
        .otherwise("broad_packet_shape_continuous")
    )
    timing = (
        F.when((c("zero_ratio") >= 0.85) & (centre > 1000), "zero_inflated_extreme_timing")
        .when((centre > 10000) & (c("p99") >= 1e7), "saturated_timeout_like_timing")
        .when((tail > 2) | (spike > 5), "burst_gap_heavy_tail_timing")
        .otherwise("moderate_timing_continuous")
    )
    volume = (
        F.when((c("zero_ratio") == 0) & (c("p50") <= 3) & (spike > 100), "always_positive_count_with_rare_huge_tail")
        .when((c("zero_ratio") >= 0.25) & (spike > 100), "zero_moderate_with_extreme_volume_tail")
        .when((c("p99") <= 50) & (c("max") >= 1000), "small_count_with_rare_large_flow")
        .otherwise("general_positive_volume")
    )
    constant = (~c("unique_count_is_approximate") & (c("unique_count") == 1)) | (c("min") == c("max"))
    return (
        F.when(group == "transport_context", F.when(F.lower("column_name") == "protocol", "transport_protocol_category").otherwise("transport_port_high_cardinality"))
        .when(constant, "constant_zero_or_constant_value")
        .when((group == "signed_or_sentinel_window") | (c("negative_ratio") > 0), "signed_sentinel_tcp_window")
        .when(group == "flag_features", flag)
        .when(group == "directionality_ratio", F.when((c("p99") <= 1) & (c("max") > 10), "denominator_sensitive_ratio_spike").otherwise("bounded_or_mild_ratio"))
        .when(group == "packet_shape", shape)
        .when(group == "rate", F.when(known("max"), "extreme_positive_rate").otherwise("rate_with_infinite_risk"))
        .when(group == "timing", timing)
        .when(group == "flow_volume", volume)
        .otherwise("other_numeric_needs_manual_review")
    )


def fine_groups(recommended_profile: DataFrame) -> DataFrame:
    """A profile with fine_grained_group, why it is of that class, and what to do with it."""
    text = lambda i: _text({k: v[i] for k, v in CLASSES.items()}, c("fine_grained_group"), "")
    return recommended_profile.withColumn("fine_grained_group", _fine_class()).withColumns({"fine_grained_why": text(0), "fine_grained_best_practice": text(1)})


def largest(profile: DataFrame, n: int = 20) -> DataFrame:
    """The columns of the largest absolute values, ties by name."""
    return profile.orderBy(F.desc_nulls_last("max_abs_reference"), "column_name").limit(n)


def plain_name(name: str) -> str:
    """A name by which raw and renamed columns meet."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower().replace("/", "_per_")).strip("_")


def joined(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dataset_column, and the profile) of the columns that the profile has under their plain name; a profile has a row per column and is broadcast."""
    names = profile.sparkSession.createDataFrame([(x, plain_name(x)) for x in columns], "dataset_column string, _plain string")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("column_name")), "/", "_per_"), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return names.join(F.broadcast(profile.withColumn("_plain", plain)), "_plain").drop("_plain")


def markdown(fine: DataFrame) -> str:
    """A report of the classes, a table each."""
    rows = fine.orderBy("fine_grained_group", "column_name").collect()  # a row per profiled column
    out, last = ["# Fine-grained column groups", ""], None
    for r in rows:
        if r["fine_grained_group"] != last:
            last = r["fine_grained_group"]
            out += ["", f"## {last}", "", f"- Why: {r['fine_grained_why']}", f"- Best practice: {r['fine_grained_best_practice']}", "", "| Column | Semantic group | zero_ratio | p50 | p95 | p99 | max |", "|---|---|---:|---:|---:|---:|---:|"]
        out.append(f"| `{r['column_name']}` | `{r['semantic_group']}` | {r['zero_ratio'] or 0:.4f} | {r['p50']} | {r['p95']} | {r['p99']} | {r['max']} |")
    return "\n".join(out) + "\n"
