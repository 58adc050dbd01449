"""Network and HTTPS flows: normalised rows and row-level features."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import numbers as N
from tracefold.functions import text as T
from tracefold.names import fresh
from tracefold.operators.ranges import over_ranges
from tracefold.operators.split import numbered_in_order

NETWORK_KEYS = ("dst_port", "protocol", "timestamp", "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "label")
NETWORK_DEFAULTS = (
    "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts", "flow_byts_per_s", "flow_bytes_per_s", "flow_pkts_per_s", "fwd_pkt_len_mean", "bwd_pkt_len_mean", "fwd_header_len",
    "bwd_header_len", "down_up_ratio", "active_mean", "idle_mean", "protocol", "dst_port", "syn_flag_cnt", "ack_flag_cnt", "rst_flag_cnt", "urg_flag_cnt",
)
HTTPS_DEFAULTS = ("bytes", "bytes_rev", "packets", "packets_rev", "duration", "roundtrips", "roundtrips_per_sec", "bytes_per_sec", "packets_per_sec", "dst_port", "protocol")
BLOCKS = {
    "transport": ["is_tcp", "is_udp", "is_icmp", "is_system_port", "is_registered_port", "is_dynamic_port"],
    "volume": ["total_packets", "total_packets_log1p", "total_bytes", "total_bytes_log1p", "bytes_per_packet", "bytes_per_packet_log1p", "avg_packet_length_delta", "avg_packet_length_delta_abs_log1p"],
    "directionality": [
        "fwd_packet_share", "bwd_packet_share", "fwd_byte_share", "bwd_byte_share", "packet_imbalance", "byte_imbalance", "fwd_bwd_packet_ratio", "fwd_bwd_packet_ratio_log1p", "fwd_bwd_bytes_ratio",
        "fwd_bwd_bytes_ratio_log1p", "header_length_ratio", "header_length_ratio_log1p", "down_up_ratio_clipped", "down_up_ratio_log1p",
    ],
    "timing": ["flow_duration_log1p", "flow_bytes_per_second_log1p", "flow_packets_per_second_log1p", "active_mean_log1p", "idle_mean_log1p", "active_idle_ratio", "active_idle_ratio_log1p"],
    "flags": ["tcp_flag_pressure_log1p", "syn_flag_share", "ack_flag_share", "reset_flag_present", "urgent_flag_present"],
}


def snake_case(name: str) -> str:
    out = name.strip().replace("/", "_per_").replace("(", "").replace(")", "").replace("-", "_").replace(".", "_")
    return re.sub(r"[^0-9A-Za-z]+", "_", out).strip("_").lower()


def renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*(snake_case(c) for c in df.columns))


def require(df: DataFrame, columns: tuple[str, ...]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def with_defaults(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.lit(0.0) for c in columns if c not in df.columns})


def normalize_network(df: DataFrame, text_columns: tuple[str, ...] = ("label", "timestamp", "source_file", "event_id"), label_mode: str = "family") -> DataFrame:
    """Snake-cased names, day-first times, finite numbers, tokens and labels. Rows that repeat the header go."""
    df = renamed(df)
    require(df, NETWORK_KEYS)
    df = df.where(F.coalesce(F.trim("label") != "Label", F.lit(True)))
    df = df.withColumns({c: N.finite(N.number(F.col(c))) for c in df.columns if c not in text_columns})
    df = df.withColumns({"event_timestamp": F.try_to_timestamp("timestamp", F.lit("dd/MM/yyyy HH:mm:ss")).cast("timestamp_ntz"), "dst_port": F.col("dst_port").cast("int"), "protocol": F.col("protocol").cast("int"), "attack_label_raw": T.strip(F.col("label"))}).drop("label", "timestamp")
    df = df.withColumns({"protocol_token": T.protocol_token(F.col("protocol")), "port_token": T.port_token(F.col("dst_port")), "attack_family": T.attack_family(F.col("attack_label_raw"))})
    df = df.withColumns({"transport_token": F.concat_ws("|", "protocol_token", "port_token"), "label_binary": (F.col("attack_family") != "Benign").cast("int"), "label_known": F.lit(1)})
    target = {"binary": F.col("label_binary").cast("string"), "family": F.col("attack_family")}.get(label_mode, F.col("attack_label_raw"))
    return df.withColumn("target_label", target)


def network_features(df: DataFrame) -> DataFrame:
    """The derived flow features of each row; no shuffle."""
    df = with_defaults(df, NETWORK_DEFAULTS)
    c = F.col
    packets, size = c("tot_fwd_pkts") + c("tot_bwd_pkts"), c("totlen_fwd_pkts") + c("totlen_bwd_pkts")
    flags = c("syn_flag_cnt") + c("ack_flag_cnt") + c("rst_flag_cnt") + c("urg_flag_cnt")
    share = {f"{side}_{kind}_share": N.ratio(c(column), total) for kind, total, columns in (("packet", packets, ("tot_fwd_pkts", "tot_bwd_pkts")), ("byte", size, ("totlen_fwd_pkts", "totlen_bwd_pkts"))) for side, column in zip(("fwd", "bwd"), columns, strict=True)}
    ratios = {
        "fwd_bwd_packet_ratio": N.ratio(c("tot_fwd_pkts"), c("tot_bwd_pkts")),
        "fwd_bwd_bytes_ratio": N.ratio(c("totlen_fwd_pkts"), c("totlen_bwd_pkts")),
        "header_length_ratio": N.ratio(c("fwd_header_len"), c("bwd_header_len")),
        "active_idle_ratio": N.ratio(c("active_mean"), c("idle_mean")),
        "down_up_ratio_clipped": c("down_up_ratio"),
    }
    delta = c("fwd_pkt_len_mean") - c("bwd_pkt_len_mean")
    rate = F.when(c("flow_byts_per_s") > 0, c("flow_byts_per_s")).otherwise(c("flow_bytes_per_s"))
    values = {
        "total_packets": packets, "total_packets_log1p": N.log1p(packets), "total_bytes": size, "total_bytes_log1p": N.log1p(size), "flow_duration_log1p": N.log1p(c("flow_duration")),
        "bytes_per_packet": N.ratio(size, packets), "bytes_per_packet_log1p": F.log1p(F.greatest(N.ratio(size, packets), F.lit(0.0))),
        **share, "packet_imbalance": share["fwd_packet_share"] - share["bwd_packet_share"], "byte_imbalance": share["fwd_byte_share"] - share["bwd_byte_share"],
        "flow_bytes_per_second_log1p": N.log1p(rate), "flow_packets_per_second_log1p": N.log1p(c("flow_pkts_per_s")), "avg_packet_length_delta": delta, "avg_packet_length_delta_abs_log1p": N.log1p(F.abs(delta)),
        "active_mean_log1p": N.log1p(c("active_mean")), "idle_mean_log1p": N.log1p(c("idle_mean")), "tcp_flag_pressure_log1p": N.log1p(flags), "syn_flag_share": N.ratio(c("syn_flag_cnt"), flags), "ack_flag_share": N.ratio(c("ack_flag_cnt"), flags),
    }
    for name, value in ratios.items():
        log = name.removesuffix("_clipped")
        values |= {name: N.clip(value), f"{log}_log1p": N.log1p(N.clip(value))}
    indicators = {
        "reset_flag_present": c("rst_flag_cnt") > 0, "urgent_flag_present": c("urg_flag_cnt") > 0, "is_tcp": c("protocol") == 6, "is_udp": c("protocol") == 17, "is_icmp": c("protocol") == 1,
        "is_system_port": c("dst_port") <= 1023, "is_registered_port": c("dst_port").between(1024, 49151), "is_dynamic_port": c("dst_port") >= 49152,
    }
    return df.withColumns({k: N.finite(v.cast("double")) for k, v in values.items()} | {k: N.flag(v) for k, v in indicators.items()})


def normalize_https(df: DataFrame, view: str = "flows", label_mode: str = "binary", text_columns: tuple[str, ...] = ("src_ip", "dst_ip", "src_port", "tls_sni", "tls_ja3", "scenario", "time_first", "time_last")) -> DataFrame:
    """HTTPS flows or samples with tool and application of the scenario and a key of the service."""
    df = renamed(df)
    needed = ("src_ip", "dst_ip", "dst_port", "protocol", "time_first", "time_last", "bytes", "bytes_rev", "packets", "packets_rev", "scenario", "class")
    require(df, needed + {"aggregated_flows": ("roundtrips",), "samples": ("duration",)}.get(view, ()))
    df = df.withColumns({c: N.finite(N.number(F.col(c))) for c in df.columns if c not in text_columns})
    df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in ("src_ip", "dst_ip", "src_port", "tls_sni", "tls_ja3")})
    first, last = F.try_to_timestamp("time_first"), F.try_to_timestamp("time_last")
    df = df.withColumns({"event_timestamp": first, "scenario": T.strip(F.coalesce("scenario", F.lit("unknown"))), "dst_port": F.col("dst_port").cast("int"), "protocol": F.col("protocol").cast("int"), "class": F.col("class").cast("int"), "input_view": F.lit(view)})
    if "duration" not in df.columns:
        df = df.withColumn("duration", F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(last) - F.unix_micros(first)) / 1e6, F.lit(0.0))))
    df = df.withColumns({"label_binary": F.col("class"), "label_known": F.lit(1), "attack_tool": T.scenario_tool(F.col("scenario")), "target_app": T.scenario_app(F.col("scenario")), "attack_label_raw": F.col("scenario"), "service_key": T.service_key(F.col("tls_sni"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"))})
    target = {"binary": F.col("label_binary").cast("string"), "tool": F.col("attack_tool"), "app": F.col("target_app")}.get(label_mode, F.col("scenario"))
    return df.withColumn("target_label", target)


def rate_with_fallback(df: DataFrame, given: str, total: Column, duration: Column, name: str, scope: str | None = None, used: bool | None = None) -> DataFrame:
    """log1p of the given rate if any row of the scope (the table, or each value of a column) has one, else of total / duration.

    used: whether the table has one, if that is known already.
    """
    own, computed = N.log1p(F.col(given)), F.log1p(F.greatest(N.ratio(total, duration), F.lit(0.0)))
    if scope:
        use = F.max(F.col(given) != 0).over(Window.partitionBy(scope))
        return df.withColumn(name, N.finite(F.when(use, own).otherwise(F.when(duration != 0, computed))))
    if used is None:
        used = rates_used(df, [given])[given]
    return df.withColumn(name, N.finite(own if used else F.when(duration != 0, computed)))


def rates_used(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """Whether any row has a rate other than 0, for all of them in one pass."""
    row = df.agg(*(F.coalesce(F.max(F.col(n) != 0), F.lit(False)).alias(n) for n in names)).collect()[0]
    return row.asDict()


def https_features(df: DataFrame, scope: str | None = None) -> DataFrame:
    df = with_defaults(df, HTTPS_DEFAULTS)
    c = F.col
    size, packets = c("bytes") + c("bytes_rev"), c("packets") + c("packets_rev")
    df = df.withColumns({"total_bytes": size, "total_packets": packets, "bytes_per_packet": N.finite(N.ratio(size, packets)), "bytes_ratio_rev_to_fwd": N.finite(N.ratio(c("bytes_rev"), c("bytes"))), "packets_ratio_rev_to_fwd": N.finite(N.ratio(c("packets_rev"), c("packets")))})
    used = {} if scope else rates_used(df, ["bytes_per_sec", "packets_per_sec", "roundtrips_per_sec"])
    for given, total, name in (("bytes_per_sec", size, "bytes_per_second_log1p"), ("packets_per_sec", packets, "packets_per_second_log1p"), ("roundtrips_per_sec", c("roundtrips"), "roundtrips_per_second_log1p")):
        df = rate_with_fallback(df, given, total, c("duration"), name, scope, used.get(given))
    text = lambda x: F.coalesce(c(x), F.lit("")) if x in df.columns else F.lit("")
    return df.withColumns({"duration_log1p": N.log1p(c("duration")), "is_tcp": N.flag(c("protocol") == 6), "is_tls_port": N.flag(c("dst_port") == 443), "has_tls_sni": N.flag(text("tls_sni") != ""), "has_tls_ja3": N.flag(text("tls_ja3") != ""), "is_benign_scenario": N.flag(text("scenario").startswith("backbone_capture_"))})


HTTPS_FEATURES = [
    "total_bytes", "total_packets", "bytes_per_packet", "bytes_ratio_rev_to_fwd", "packets_ratio_rev_to_fwd", "bytes_per_second_log1p", "packets_per_second_log1p", "duration_log1p", "roundtrips_per_second_log1p",
    "is_tcp", "is_tls_port", "has_tls_sni", "has_tls_ja3", "is_benign_scenario",
]
HTTPS_FIRST = [
    "event_id", "source_file", "input_view", "event_timestamp", "time_first", "time_last", "duration", "service_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tls_sni", "tls_ja3", "scenario",
    "attack_tool", "target_app", "attack_label_raw", "label_binary", "label_known", "target_label",
]
NETWORK_FIRST = ["event_id", "source_file", "event_timestamp", "dst_port", "protocol", "protocol_token", "port_token", "transport_token", "attack_label_raw", "attack_family", "label_binary", "label_known", "target_label"]


def in_front(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that df has, in that order, then the rest."""
    first = [c for c in names if c in df.columns]
    return df.select(*(F.col(f"`{c}`") for c in [*first, *(c for c in df.columns if c not in first)]))


def annotated_https(normalized: DataFrame, file: str) -> DataFrame:
    """Normalised HTTPS flows in order of time and service, with source_file and an event_id of the file and the place in that order."""
    ties = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(normalized.columns)))  # of all columns, so only equal rows may swap
    order = [F.col("event_timestamp").asc_nulls_last(), F.col("service_key").asc_nulls_last(), ties]
    rn, n = fresh(normalized, "_rn"), fresh(normalized, "_n")
    df = numbered_in_order(normalized, order, rn, n)
    stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    df = df.withColumns({"source_file": F.lit(file.rsplit("/", 1)[-1]), "event_id": F.concat_ws(":", F.lit(stem), (F.col(rn) - 1).cast("string"))}).drop(rn, n)
    return in_front(df, HTTPS_FIRST)


def transport_context(df: DataFrame) -> DataFrame:
    """Coarse indicators of protocol and port; a missing protocol is none of the known ones, a missing port is invalid."""
    protocol, port = F.coalesce(F.col("protocol"), F.lit(0)), F.coalesce(F.col("dst_port"), F.lit(-1))
    made = {
        "is_tcp": protocol == 6, "is_udp": protocol == 17, "is_icmp": protocol == 1, "is_other_protocol": ~protocol.isin(1, 6, 17),
        "is_system_port": port.between(0, 1023), "is_registered_port": port.between(1024, 49151), "is_dynamic_port": port >= 49152, "is_invalid_port": port < 0,
    }
    return df.withColumns({k: v.cast("byte") for k, v in made.items()})


def rolling(df: DataFrame, entity: str, time: str, hours: tuple[float, ...] = (0.01, 0.1, 1.0), label: str = "label_binary", protocol: str = "protocol") -> DataFrame:
    """Of each flow, over the entity's flows in the hours before it (not at its own time): their number, share of attacks, and entropy of tcp, udp, icmp and others.

    Running sums over one exchange by entity (see `ranges`). Flows without a time are kept: they count nowhere and have zeros.
    """
    kinds = [F.coalesce(F.col(protocol) == k, F.lit(False)) for k in (6, 17, 1)]
    kinds.append(~(kinds[0] | kinds[1] | kinds[2]))
    own = "_"
    while any(c.lower().startswith((f"{own}attacks", f"{own}kind")) for c in df.columns):
        own += "_"
    suffixes = {f"_{h:g}h".replace(".", "_"): round(h * 3_600_000_000) for h in hours}
    totals = {"flow_count": F.lit(1), f"{own}attacks": N.flag(F.col(label) == 1)} | {f"{own}kind{i}": k.cast("int") for i, k in enumerate(kinds)}
    out = over_ranges(df, entity, F.unix_micros(F.col(time).cast("timestamp")), suffixes, totals)
    done = {}
    for s in suffixes:
        n = F.col(f"flow_count{s}")
        share = [F.coalesce(N.ratio(F.col(f"{own}kind{i}{s}").cast("double"), n), F.lit(0.0)) for i in range(len(kinds))]
        part = [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share]
        done |= {f"attack_rate{s}": F.coalesce(N.ratio(F.col(f"{own}attacks{s}").cast("double"), n), F.lit(0.0)), f"protocol_entropy{s}": sum(part[1:], part[0])}
    return out.withColumns(done).drop(*(f"{t}{s}" for t in totals if t != "flow_count" for s in suffixes))
