"""Queries on the test tables, each beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions import numbers as N
from tracefold.functions import text as T
from tracefold.operators import alerts, api, descent, flows, history, metrics, profiling, retrieval, split, tabular

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


H = history.History(entity="user_id", time="ts", sequence="event_id", outcome="ok", novelty=("event_type",), priors={"event_type": "type_prior"}, diversity=("event_type",))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outcomes: an error is a failure."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", (F.col("event_type") != "error").cast("int").alias("ok"))


E = "e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok FROM events)"
PAST = "OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {d} DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def _bins(column: str, edges, op: str) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {column} {op} {e} THEN 1 ELSE 0 END" for e in edges) + " AS INTEGER)"


_counts_sql = ", ".join(
    f"CAST(count(*) {PAST.format(d=d)} AS BIGINT) AS login_count_window{d}, CAST(count(*) FILTER (WHERE ok = 1) {PAST.format(d=d)} AS BIGINT) AS success_count_window{d}, CAST(count(*) FILTER (WHERE ok = 0) {PAST.format(d=d)} AS BIGINT) AS failure_count_window{d}" for d in (1, 7, 30)
)


@query(
    f"WITH {E}, c AS (SELECT event_id, user_id, {_counts_sql} FROM e) SELECT *, "
    + ", ".join(f"round(CASE WHEN login_count_window{d} = 0 THEN 0 ELSE failure_count_window{d} / CAST(login_count_window{d} AS DOUBLE) END, 6) AS failure_rate_window{d}, {_bins(f'login_count_window{d}', N.COUNT_EDGES, '>=')} AS login_count_bin_window{d}" for d in (1, 7, 30))
    + " FROM c"
)
def user_rolling_counts(spark, sf_dir):
    df = history.rolling_counts(logins(spark, sf_dir), H)
    return df.select("event_id", "user_id", *(c for d in H.days for c in (f"login_count_window{d}", f"success_count_window{d}", f"failure_count_window{d}", r6(f"failure_rate_window{d}"), f"login_count_bin_window{d}")))


@query(
    f"""WITH {E}, pairs AS (SELECT a.event_id, b.event_type, w.d FROM e a CROSS JOIN (VALUES (1), (7), (30)) w(d)
    JOIN e b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - to_days(w.d)),
    c AS (SELECT event_id, d, event_type, count(*) AS n FROM pairs GROUP BY ALL),
    t AS (SELECT event_id, d, count(*) AS u, sum(n) AS total FROM c GROUP BY ALL),
    h AS (SELECT c.event_id, c.d, any_value(u) AS u, -sum(n / CAST(total AS DOUBLE) * log2(n / CAST(total AS DOUBLE) + 1e-10)) AS h FROM c JOIN t ON c.event_id = t.event_id AND c.d = t.d GROUP BY ALL)
    SELECT e.event_id, """
    + ", ".join(f"CAST(coalesce(max(u) FILTER (WHERE d = {d}), 0) AS INTEGER) AS unique_event_types_window{d}, round(coalesce(max(h) FILTER (WHERE d = {d}), 0), 6) + 0.0 AS entropy_event_types_window{d}" for d in (1, 7, 30))
    + " FROM e LEFT JOIN h ON e.event_id = h.event_id GROUP BY e.event_id"
)
def user_rolling_diversity(spark, sf_dir):
    df = history.rolling_diversity(logins(spark, sf_dir), H)
    return df.select("event_id", *(c for d in H.days for c in (f"unique_event_types_window{d}", (F.round(F.col(f"entropy_event_types_window{d}"), 6) + 0.0).alias(f"entropy_event_types_window{d}"))))


@query(
    f"""WITH {E}, w AS (SELECT event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER o AS p, last_value(CASE WHEN ok = 1 THEN epoch_us(ts) END IGNORE NULLS) OVER b AS s,
    last_value(CASE WHEN ok <> 1 THEN epoch_us(ts) END IGNORE NULLS) OVER b AS f FROM e
    WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT event_id, p IS NOT NULL AS has, coalesce((us - p) / 1e6, 0) AS a, coalesce((us - s) / 1e6, 0) AS b, coalesce((us - f) / 1e6, 0) AS c FROM w)
    SELECT event_id, CAST(has AS INTEGER) AS has_prior_login, round(a, 6) AS seconds_since_prev_login, round(b, 6) AS seconds_since_prev_success, round(c, 6) AS seconds_since_prev_failure,
    {_bins("a", N.GAP_EDGES, ">=")} AS seconds_since_prev_login_bin, round(ln(1 + a), 6) AS seconds_since_prev_login_log FROM g"""
)
def user_gaps(spark, sf_dir):
    df = history.gaps(logins(spark, sf_dir), H)
    return df.select("event_id", "has_prior_login", *(r6(f"seconds_since_prev_{k}") for k in ("login", "success", "failure")), "seconds_since_prev_login_bin", r6("seconds_since_prev_login_log"))


@query(
    f"""WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM e),
    s AS (SELECT event_id, rn - 1 - coalesce(max(CASE WHEN ok <> 1 THEN rn END) OVER b, 0) AS a, rn - 1 - coalesce(max(CASE WHEN ok = 1 THEN rn END) OVER b, 0) AS f FROM n
    WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, CAST(a AS INTEGER) AS prior_success_streak, CAST(f AS INTEGER) AS prior_failure_streak, {_bins("a", N.COUNT_EDGES, ">=")} AS prior_success_streak_bin FROM s"""
)
def user_streaks(spark, sf_dir):
    return history.streaks(logins(spark, sf_dir), H).select("event_id", "prior_success_streak", "prior_failure_streak", "prior_success_streak_bin")


@query(
    f"""WITH {E} SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS is_new_event_type,
    CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS prev_login_same_event_type FROM e"""
)
def user_novelty_continuity(spark, sf_dir):
    df = history.continuity(history.novelty(logins(spark, sf_dir), H), H)
    return df.select("event_id", "is_new_event_type", "prev_login_same_event_type")


@query(
    f"""WITH {E}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS c FROM e),
    q AS (SELECT event_id, c, CASE WHEN p = 0 THEN 0 ELSE c / CAST(p AS DOUBLE) END AS r FROM n)
    SELECT event_id, CAST(c AS INTEGER) AS type_prior_count, round(r, 6) AS type_prior_rate, {_bins("least(greatest(r, 0), 1)", N.RATE_EDGES, ">")} AS type_prior_rate_bin FROM q"""
)
def user_prior_rates(spark, sf_dir):
    return history.prior_rates(logins(spark, sf_dir), H).select("event_id", "type_prior_count", r6("type_prior_rate"), "type_prior_rate_bin")


@query("SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM events")
def user_calendar(spark, sf_dir):
    return history.calendar(logins(spark, sf_dir), H).select("event_id", "hour_of_day", "day_of_week", "is_weekend")


@query(f"WITH {E} SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS events_7d FROM e")
def inclusive_rolling_count(spark, sf_dir):
    return history.inclusive_count(logins(spark, sf_dir), H, 7, "events_7d").select("event_id", "events_7d")


DRESSED = {"ip": "props", "ip_token": "props"} | dict.fromkeys(("device", "country", "region", "city", "device_token", "geo_token", "context_token"), "event_type")


def _login_sql() -> str:
    """All 159 features: positions, ranges by self-join, bins."""
    h = history.History()
    b6 = lambda x: f"round({x}, 6) + 0.0"
    log1p = lambda x: b6(f"ln(1 + greatest({x}, 0))")
    out: dict[str, str] = {"has_prior_login": "CAST(rn > 1 AS INTEGER)"}
    for k in ("login", "success", "failure"):
        gap = f"coalesce((us - last_{k}) / 1e6, 0)"
        out |= {f"seconds_since_prev_{k}": b6(gap), f"seconds_since_prev_{k}_log": log1p(gap), f"seconds_since_prev_{k}_bin": _bins(gap, N.GAP_EDGES, ">=")}
    out |= {"hour_of_day": "CAST(hour(ts) AS INTEGER)", "day_of_week": "CAST(isodow(ts) - 1 AS INTEGER)", "is_weekend": "CAST(isodow(ts) >= 6 AS INTEGER)"}
    for k in ("success", "failure"):
        n = f"(rn - 1 - {k}_broken)"
        out |= {f"prior_{k}_streak": f"CAST({n} AS INTEGER)", f"prior_{k}_streak_log": log1p(n), f"prior_{k}_streak_bin": _bins(n, N.COUNT_EDGES, ">=")}
    for c in h.novelty:
        out |= {f"is_new_{c}": f"CAST(nth_{DRESSED[c]} = 1 AS INTEGER)", f"prev_login_same_{c}": f"CAST(coalesce({DRESSED[c]} = last_{DRESSED[c]}, false) AS INTEGER)"}
    for c, p in h.priors.items():
        n, rate = f"(nth_{DRESSED[c]} - 1)", f"(CASE WHEN rn = 1 THEN 0 ELSE (nth_{DRESSED[c]} - 1) / CAST(rn - 1 AS DOUBLE) END)"
        out |= {f"{p}_count": f"CAST({n} AS INTEGER)", f"{p}_count_log": log1p(n), f"{p}_count_bin": _bins(n, N.COUNT_EDGES, ">="), f"{p}_rate": b6(rate), f"{p}_rate_bin": _bins(rate, N.RATE_EDGES, ">")}
    out["geo_resolution_level"] = "CAST(3 * CAST(event_type <> 'unknown' AS INTEGER) AS INTEGER)"
    for k, t in (("ip", "ip_token"), ("device", "device_token"), ("country", "geo_token")):
        out |= {f"current_{k}_prior_{x}": out[f"current_{t}_prior_{x}"] for x in ("count", "rate")}
    for d in h.days:
        total = f"coalesce(login_{d}, 0)"
        for k in ("login", "success", "failure"):
            n = f"coalesce({k}_{d}, 0)"
            out |= {f"{k}_count_window{d}": f"CAST({n} AS BIGINT)", f"log_{k}_count_window{d}": log1p(n), f"{k}_count_bin_window{d}": _bins(n, N.COUNT_EDGES, ">=")}
        for k in ("success", "failure"):
            rate = f"(CASE WHEN {total} = 0 THEN 0 ELSE {k}_{d} / CAST({total} AS DOUBLE) END)"
            out |= {f"{k}_rate_window{d}": b6(rate), f"{k}_rate_bin_window{d}": _bins(rate, N.RATE_EDGES, ">")}
        for c in h.diversity:
            name = {"context_token": "context_tokens"}.get(c, f"{c}s")
            u, e = f"coalesce(u_{DRESSED[c]}_{d}, 0)", f"coalesce(h_{DRESSED[c]}_{d}, 0)"
            out |= {f"unique_{name}_window{d}": f"CAST({u} AS INTEGER)", f"log_unique_{name}_window{d}": log1p(u), f"unique_{name}_bin_window{d}": _bins(u, N.COUNT_EDGES, ">=")}
            out |= {f"entropy_{name}_window{d}": b6(e), f"entropy_{name}_bin_window{d}": _bins(e, N.ENTROPY_EDGES, ">=")}
    # a single value's entropy is just below 0, which its bin tells
    spread = "\n".join(
        f"""c_{v} AS (SELECT event_id, d, {v} AS v, count(*) AS n FROM pairs WHERE {v} IS NOT NULL GROUP BY ALL),
    t_{v} AS (SELECT event_id, d, count(*) AS u, sum(n) AS total FROM c_{v} GROUP BY ALL),
    h_{v} AS (SELECT event_id, {", ".join(f"max(u) FILTER (WHERE d = {d}) AS u_{v}_{d}, max(h) FILTER (WHERE d = {d}) AS h_{v}_{d}" for d in h.days)} FROM
      (SELECT c.event_id, c.d, any_value(u) AS u, -sum(n / CAST(total AS DOUBLE) * log2(n / CAST(total AS DOUBLE) + 1e-10)) AS h FROM c_{v} c JOIN t_{v} t ON c.event_id = t.event_id AND c.d = t.d GROUP BY ALL) GROUP BY event_id),"""
        for v in ("props", "event_type")
    )
    return f"""WITH e AS (SELECT *, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok FROM events),
    r AS (SELECT *, row_number() OVER o AS rn, lag(us) OVER o AS last_login, lag(props) OVER o AS last_props, lag(event_type) OVER o AS last_event_type,
      last_value(CASE WHEN ok = 1 THEN us END IGNORE NULLS) OVER p AS last_success, last_value(CASE WHEN ok <> 1 THEN us END IGNORE NULLS) OVER p AS last_failure,
      row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS nth_props, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth_event_type
      FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, coalesce(max(CASE WHEN ok <> 1 THEN rn END) OVER p, 0) AS success_broken, coalesce(max(CASE WHEN ok = 1 THEN rn END) OVER p, 0) AS failure_broken
      FROM r WINDOW p AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    pairs AS (SELECT a.event_id, w.d, b.ok, b.props, b.event_type FROM e a CROSS JOIN (VALUES (1), (7), (30)) w(d) JOIN e b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - to_days(w.d)),
    {spread}
    counts AS (SELECT event_id, {", ".join(f"count(*) FILTER (WHERE d = {d}) AS login_{d}, count(*) FILTER (WHERE d = {d} AND ok = 1) AS success_{d}, count(*) FILTER (WHERE d = {d} AND ok = 0) AS failure_{d}" for d in h.days)} FROM pairs GROUP BY event_id)
    SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {", ".join(f"{x} AS {name}" for name, x in out.items())}
    FROM s LEFT JOIN counts USING (event_id) LEFT JOIN h_props USING (event_id) LEFT JOIN h_event_type USING (event_id)"""


@query(_login_sql())
def login_features(spark, sf_dir):
    """All behavioural features over events dressed as logins; doubles to six digits."""
    df = table(spark, sf_dir, "events")
    df = df.select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("login_timestamp"), (F.col("event_type") != "error").cast("int").alias("login_successful"), *(F.col(v).alias(k) for k, v in DRESSED.items()))
    out = history.features(df)
    kinds, names = dict(out.dtypes), [c for block in history.blocks().values() for c in block]
    return out.select("event_id", "user_id", *((F.round(F.col(c), 6) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in names))


_split_sql = "CASE WHEN rn <= floor(n * CAST(0.75 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.75 AS DOUBLE)) + floor(n * CAST(0.08 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split"


@query(f"SELECT event_id, {_split_sql} FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)")
def time_split_global(spark, sf_dir):
    return split.by_time(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "split")


@query(f"SELECT event_id, {_split_sql} FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def time_split_per_user(spark, sf_dir):
    return split.by_time(table(spark, sf_dir, "events"), "ts", "event_id", within="user_id").select("event_id", "split")


@query(
    f"""SELECT user_id, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train_rows, CAST(count(*) FILTER (WHERE split = 'val') AS BIGINT) AS val_rows, CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS test_rows, CAST(count(*) AS BIGINT) AS total_rows
    FROM (SELECT user_id, {_split_sql} FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY user_id"""
)
def split_stats(spark, sf_dir):
    return split.split_stats(split.by_time(table(spark, sf_dir, "events"), "ts", "event_id", within="user_id"), "user_id")


@query(f"SELECT split, min(o_orderdate) AS first_time, max(o_orderdate) AS last_time, CAST(count(*) AS BIGINT) AS rows FROM (SELECT o_orderdate, {_split_sql} FROM (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)) GROUP BY split")
def split_boundaries(spark, sf_dir):
    return split.boundaries(split.by_time(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey"), "o_orderdate")


@query()
def shard_assign(spark, sf_dir):
    return split.shards(table(spark, sf_dir, "events"), "user_id", 16).groupBy("shard_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"))


@query("SELECT source, CAST(min(doc_id) AS BIGINT) AS doc_id FROM documents GROUP BY source")
def dedupe_keep_first(spark, sf_dir):
    return split.keep_first(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


def line_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the place of flows."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_quantity").alias("tot_fwd_pkts"), (c("l_tax") * 100).alias("tot_bwd_pkts"), c("l_extendedprice").alias("totlen_fwd_pkts"), (c("l_discount") * 1000).alias("totlen_bwd_pkts"), (c("l_suppkey") % 60000).alias("dst_port"),
        F.when(c("l_returnflag") == "R", 6).when(c("l_returnflag") == "A", 17).otherwise(1).alias("protocol"), c("l_quantity").alias("syn_flag_cnt"), (c("l_discount") * 100).alias("rst_flag_cnt"),
    )


_L = """l AS (SELECT l_orderkey, l_linenumber, l_quantity AS fp, l_tax * 100 AS bp, l_extendedprice AS fb, l_discount * 1000 AS bb, l_suppkey % 60000 AS port, CASE l_returnflag WHEN 'R' THEN 6 WHEN 'A' THEN 17 ELSE 1 END AS protocol, l_quantity AS syn, l_discount * 100 AS rst FROM lineitem)"""


@query(f"WITH {_L} SELECT l_orderkey, l_linenumber, round(fp + bp, 6) AS total_packets, round(ln(1 + fp + bp), 6) AS total_packets_log1p, round(fb + bb, 6) AS total_bytes, round(coalesce(ln(1 + (fb + bb) / nullif(fp + bp, 0)), 0), 6) AS bytes_per_packet_log1p FROM l")
def flow_volume_features(spark, sf_dir):
    return flows.network_features(line_flows(spark, sf_dir)).select("l_orderkey", "l_linenumber", r6("total_packets"), r6("total_packets_log1p"), r6("total_bytes"), r6("bytes_per_packet_log1p"))


@query(
    f"""WITH {_L} SELECT l_orderkey, l_linenumber, round(coalesce(least(greatest(fp / nullif(bp, 0), 0), 1000), 0), 6) AS fwd_bwd_packet_ratio, round(coalesce(ln(1 + least(greatest(fb / nullif(bb, 0), 0), 1000)), 0), 6) AS fwd_bwd_bytes_ratio_log1p,
    round(coalesce(fp / nullif(fp + bp, 0), 0), 6) AS fwd_packet_share, round(coalesce(fp / nullif(fp + bp, 0) - bp / nullif(fp + bp, 0), 0), 6) + 0.0 AS packet_imbalance, round(coalesce(syn / nullif(syn + rst, 0), 0), 6) AS syn_flag_share FROM l"""
)
def flow_ratio_features(spark, sf_dir):
    return flows.network_features(line_flows(spark, sf_dir)).select("l_orderkey", "l_linenumber", *(r6(c) for c in ("fwd_bwd_packet_ratio", "fwd_bwd_bytes_ratio_log1p", "fwd_packet_share", "syn_flag_share")), (F.round("packet_imbalance", 6) + 0.0).alias("packet_imbalance"))


@query(
    f"""WITH {_L} SELECT l_orderkey, l_linenumber, CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'other_protocol' END || '|' || CASE WHEN port < 0 THEN 'invalid_port' WHEN port <= 1023 THEN 'system_port' WHEN port <= 49151 THEN 'registered_port' ELSE 'dynamic_port' END AS transport_token,
    CASE WHEN port <= 1023 THEN 1 ELSE 0 END AS is_system_port, CASE WHEN protocol = 6 THEN 1 ELSE 0 END AS is_tcp, CASE WHEN rst > 0 THEN 1 ELSE 0 END AS reset_flag_present FROM l"""
)
def flow_transport(spark, sf_dir):
    df = flows.network_features(line_flows(spark, sf_dir))
    return df.select("l_orderkey", "l_linenumber", F.concat_ws("|", T.protocol_token(F.col("protocol")), T.port_token(F.col("dst_port"))).alias("transport_token"), "is_system_port", "is_tcp", "reset_flag_present")


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN max(l_discount <> 0) OVER (PARTITION BY l_suppkey) THEN ln(1 + greatest(l_discount, 0)) ELSE coalesce(ln(1 + greatest(l_extendedprice / nullif(l_quantity, 0), 0)), 0) END, 6) AS rate_log1p FROM lineitem"""
)
def rate_with_fallback(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return flows.rate_with_fallback(df, "l_discount", F.col("l_extendedprice"), F.col("l_quantity"), "rate", "l_suppkey").select("l_orderkey", "l_linenumber", r6("rate", "rate_log1p"))


_profiled = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_profile_sql = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS non_null_count, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_ratio, CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.5), 6) AS p50,
    round(quantile_cont({c}, 0.95), 6) AS p95, round(quantile_cont({c}, 0.99), 6) AS p99, round(max({c}), 6) AS max, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM lineitem"""
    for c in _profiled
)


@query(
    f"""WITH p AS ({_profile_sql}) SELECT *, 'other_numeric' AS semantic_group, CASE WHEN min < 0 THEN 'signed' WHEN max <= 1 THEN 'range_le_1' WHEN max <= 10 THEN 'range_1_to_10' WHEN max <= 100 THEN 'range_10_to_100' WHEN max <= 1000 THEN 'range_100_to_1e3' WHEN max <= 10000 THEN 'range_1e3_to_1e4' WHEN max <= 1000000 THEN 'range_1e4_to_1e6' ELSE 'range_gt_1e6' END AS range_bucket,
    CASE WHEN unique_count <= 2 AND min >= 0 AND max <= 1 THEN 'keep_binary_indicator' WHEN min >= 0 AND max <= 1 THEN 'keep_bounded_ratio' WHEN min < 0 THEN 'robust_scale_signed_feature' WHEN max <= 100 THEN 'keep_raw_or_standardize' ELSE 'standardize_after_basic_cleaning' END AS transform_recommendation FROM p"""
)
def numeric_profile(spark, sf_dir):
    p = profiling.profile(table(spark, sf_dir, "lineitem"), _profiled)
    return p.select("column_name", "non_null_count", r6("zero_ratio"), "unique_count", *(r6(c) for c in ("min", "p50", "p95", "p99", "max")), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "semantic_group", "range_bucket", "transform_recommendation")


@query(
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.99) AS p FROM lineitem), x AS (SELECT l_orderkey, l_linenumber, ln(1 + least(greatest(l_extendedprice, 0), p)) AS v FROM lineitem, q),
    s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM x) SELECT l_orderkey, l_linenumber, round(CAST(CAST((v - m) / d AS FLOAT) AS DOUBLE), 3) + 0.0 AS z FROM x, s"""
)
def clip_log_zscore(spark, sf_dir):
    return profiling.clip_log_zscore(table(spark, sf_dir, "lineitem"), ["l_extendedprice"]).select("l_orderkey", "l_linenumber", (F.round(F.col("l_extendedprice_z").cast("double"), 3) + 0.0).alias("z"))


@query(
    """WITH x AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS valid, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE 0.0 END AS v FROM customer),
    s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM x) SELECT c_custkey, CAST(valid AS INTEGER) AS valid, round(CAST(CAST((v - m) / d AS FLOAT) AS DOUBLE), 3) + 0.0 AS z FROM x, s"""
)
def sentinel_scale(spark, sf_dir):
    df = profiling.sentinel_scale(table(spark, sf_dir, "customer"), ["c_acctbal"])
    return df.select("c_custkey", F.col("c_acctbal_valid").cast("int").alias("valid"), (F.round(F.col("c_acctbal_z").cast("double"), 3) + 0.0).alias("z"))


@query(
    """WITH p AS (SELECT quantile_cont(l_quantity, 0.5) AS m1, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS s1, quantile_cont(l_extendedprice, 0.5) AS m2, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS s2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(1 - exp(-(least(abs(l_quantity - m1) / s1, 5) + least(abs(l_extendedprice - m2) / s2, 5)) / 2), 6) AS risk FROM lineitem, p"""
)
def block_risk_score(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    risk = profiling.block_risk(profiling.robust_profile(df, ["l_quantity", "l_extendedprice"]))
    return df.select("l_orderkey", "l_linenumber", F.round(risk, 6).alias("risk"))


@query("SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END), 6) AS alert_rate FROM events")
def risk_summary(spark, sf_dir):
    return metrics.risk_summary(table(spark, sf_dir, "events"), "value", F.col("value") >= 100).select(*(r6(c) for c in ("mean", "median", "p90", "p95", "alert_rate")))


@query("SELECT round(quantile_cont(value, 0.95), 6) AS threshold FROM events")
def alert_threshold(spark, sf_dir):
    return metrics.alert_threshold(table(spark, sf_dir, "events"), "value", 0.05).select(r6("threshold"))


@query(
    """SELECT c_custkey, CASE WHEN t IN ('', '-', '--', 'n/a', 'na', 'nan', 'none', 'null') THEN 'unknown' ELSE regexp_replace(t, '\\s+', ' ', 'g') END AS segment FROM (SELECT c_custkey, lower(trim(coalesce(c_mktsegment, 'unknown'))) AS t FROM customer)"""
)
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.clean(F.col("c_mktsegment")).alias("segment"))


_url = {"host": "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", "path": "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", "query": "^[^?#]*\\?([^#]*)"}
_U = "u AS (SELECT page_id, url, html, " + ", ".join(f"regexp_extract(url, '{p}', 1) AS {k}" for k, p in _url.items()) + " FROM pages)"


@query(f"WITH {_U} SELECT page_id, host, path, query, CAST(greatest(0, len(path) - len(replace(path, '/', '')) - CASE WHEN starts_with(path, '/') THEN 1 ELSE 0 END) AS INTEGER) AS depth, CASE WHEN regexp_full_match(host, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}(:[0-9]+)?') THEN 1 ELSE 0 END AS host_is_ip FROM u")
def url_split(spark, sf_dir):
    u = F.col("url")
    df = table(spark, sf_dir, "pages").select("page_id", T.url_host(u).alias("host"), T.url_path(u).alias("path"), T.url_query(u).alias("query"))
    return df.withColumns({"depth": T.path_depth(F.col("path")), "host_is_ip": T.host_is_ip(F.col("host"))})


@query(
    f"""WITH {_U}, s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u)
    SELECT page_id, '/' || array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '{{num}}' WHEN regexp_full_match(lower(x), '[0-9a-f]{{8,}}|[0-9a-f]{{8}}-[0-9a-f-]{{13,}}') THEN '{{hex}}'
    WHEN len(x) >= 24 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') THEN '{{token}}' ELSE lower(x) END), '/') AS path_template FROM s"""
)
def url_path_template(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.path_template(T.url_path(F.col("url"))).alias("path_template"))


_scan = "url_decode(replace(url_decode(replace(url_decode(replace(url, '+', ' ')), '+', ' ')), '+', ' '))"


@query(f"SELECT page_id, {_scan} AS decoded FROM pages")
def url_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.decoded(F.col("url")).alias("decoded"))


_patterns = {k: p for k, p in T.PATTERNS.items() if k != "sql_keywords"}


def _lit(p: str) -> str:
    return "'" + p.replace("'", "''").replace("\\u2028", "\\x{2028}").replace("\\u2029", "\\x{2029}") + "'"


@query("SELECT page_id, " + ", ".join(f"CASE WHEN regexp_matches(html, {_lit(p)}) THEN 1 ELSE 0 END AS has_{k}, CAST(len(regexp_extract_all(html, {_lit(p)})) AS INTEGER) AS n_{k}" for k, p in _patterns.items()) + " FROM pages")
def attack_patterns(spark, sf_dir):
    counts = table(spark, sf_dir, "pages").select("page_id", *(T.occurrences(F.col("html"), p).cast("int").alias(f"n_{k}") for k, p in _patterns.items()))
    return counts.select("*", *((F.col(f"n_{k}") > 0).cast("int").alias(f"has_{k}") for k in _patterns))


@query(
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '%[0-9a-fA-F]{2}')) AS INTEGER) AS text_percent_encoded_count, CAST(len(regexp_extract_all(text, '%25[0-9a-fA-F]{2}')) AS INTEGER) AS text_double_encoded_count,
    CAST(len(regexp_extract_all(text, '[''";<>{}\\[\\]()$]')) AS INTEGER) AS text_special_char_count, CAST(len(regexp_extract_all(text, '[0-9]')) AS INTEGER) AS text_digit_count FROM documents"""
)
def character_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(c.cast("int").alias(k) for k, c in api.character_counts(F.col("text"), "text").items()))


@query(f"WITH {_U} SELECT page_id, CASE WHEN starts_with(lower(path), '/docs/') THEN 1 ELSE 0 END AS request_context_is_docs, CASE WHEN contains(lower(path), '/search') OR contains(lower(query), 'q=') THEN 1 ELSE 0 END AS request_context_is_search, CASE WHEN starts_with(lower(path), '/static/') THEN 1 ELSE 0 END AS request_context_is_static, CASE WHEN contains(lower(path), '/login') OR contains(lower(path), 'auth') OR contains(lower(path), 'profile') THEN 1 ELSE 0 END AS request_context_is_auth, CASE WHEN starts_with(lower(path), '/api/') THEN 1 ELSE 0 END AS request_context_is_api FROM u")
def url_contexts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(k) for k, c in api.contexts(T.url_path(u), T.url_query(u)).items()))


@query(
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents)
    SELECT doc_id, CAST(len(t) AS INTEGER) AS text_token_count, CAST(len(list_distinct(t)) AS INTEGER) AS text_unique_token_count, round(CASE WHEN len(t) = 0 THEN 0 ELSE list_sum(list_transform(t, lambda x: len(x))) / CAST(len(t) AS DOUBLE) END, 6) AS text_avg_token_length FROM t"""
)
def token_stats(spark, sf_dir):
    stats = api.token_stats(F.col("text"), "text")
    df = table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k) for k, c in stats.items()))
    return df.select("doc_id", "text_token_count", "text_unique_token_count", r6("text_avg_token_length"))


@query("""SELECT conv_id, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 1 ELSE 0 END AS same_role FROM conversations""")
def session_prev_role(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    return df.select("conv_id", "turn", N.flag(F.col("role") == F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))).alias("same_role"))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score from the documents' length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "toxic", "quality", (F.pmod("n_chars", F.lit(100)) / 100.0).alias("score"))


_S = "s AS (SELECT doc_id, toxic, quality, (n_chars % 100) / 100.0::DOUBLE AS score, least(greatest((n_chars % 100) / 100.0::DOUBLE, 1e-8), 1 - 1e-8) AS p FROM labels JOIN documents USING (doc_id))"
_rates = "round((tp + tn) / CAST(greatest(tp + tn + fp + fn, 1) AS DOUBLE), 6) AS accuracy, round(tp / CAST(greatest(tp + fp, 1) AS DOUBLE), 6) AS precision, round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS recall"
_cells = "CAST(count(*) FILTER (WHERE toxic = 1 AND p >= t) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE toxic = 0 AND p < t) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE toxic = 0 AND p >= t) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE toxic = 1 AND p < t) AS BIGINT) AS fn"


@query(f"WITH {_S}, c AS (SELECT {_cells}, round(avg(-(toxic * ln(p) + (1 - toxic) * ln(1 - p))), 6) AS log_loss, round(avg((p - toxic) * (p - toxic)), 6) AS brier FROM s, (SELECT 0.5 AS t)) SELECT *, {_rates} FROM c")
def confusion_metrics(spark, sf_dir):
    df = metrics.confusion(scored_labels(spark, sf_dir), "toxic", "score")
    return df.select("tp", "tn", "fp", "fn", *(r6(c) for c in ("log_loss", "brier", "accuracy", "precision", "recall")))


@query(f"WITH {_S}, c AS (SELECT t AS threshold, {_cells} FROM s, (SELECT CAST(round(i * 0.05, 2) AS DOUBLE) AS t FROM range(1, 20) r(i)) GROUP BY t) SELECT *, {_rates} FROM c")
def threshold_sweep(spark, sf_dir):
    df = metrics.sweep(scored_labels(spark, sf_dir), "toxic", "score")
    return df.select("threshold", *(F.col(c).cast("long").alias(c) for c in ("tp", "tn", "fp", "fn")), *(r6(c) for c in ("accuracy", "precision", "recall")))


@query(
    f"""WITH {_S}, c AS (SELECT t AS threshold, {_cells} FROM s, (SELECT CAST(round(i * 0.05, 2) AS DOUBLE) AS t FROM range(1, 20) r(i)) GROUP BY t),
    f AS (SELECT threshold, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS p, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS r FROM c), g AS (SELECT threshold, 2 * p * r / greatest(p + r, 1e-8) AS f1 FROM f)
    SELECT threshold, round(f1, 6) AS f1 FROM g ORDER BY g.f1 DESC, abs(threshold - 0.5), threshold LIMIT 1"""
)
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(metrics.sweep(scored_labels(spark, sf_dir), "toxic", "score")).select("threshold", r6("f1"))


@query(
    """WITH x AS (SELECT source AS truth, lang AS predicted, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS flagged FROM documents), c AS (SELECT truth, predicted, count(*) AS n FROM x GROUP BY ALL),
    m AS (SELECT truth, predicted, row_number() OVER (PARTITION BY truth ORDER BY n DESC, predicted) AS r FROM c)
    SELECT truth, CAST(count(*) AS BIGINT) AS rows, CAST(sum(flagged) AS BIGINT) AS flagged, round(CASE WHEN truth <> 'src0' THEN sum(flagged) / CAST(count(*) AS DOUBLE) END, 6) AS recall, any_value(m.predicted) AS commonest FROM x JOIN m USING (truth) WHERE m.r = 1 GROUP BY truth"""
)
def type_report(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("source").alias("truth"), F.col("lang").alias("predicted"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("flagged"))
    return metrics.by_type(df, "truth", "flagged", "predicted", "src0").select("truth", "rows", "flagged", r6("recall"), "commonest")


@query(
    """WITH g AS (SELECT count(DISTINCT label) AS n FROM embeddings), r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
    SELECT vec_id, label FROM r, g ORDER BY CASE WHEN rn > greatest(100 // n, 1) THEN 1 ELSE 0 END, vec_id LIMIT 100"""
)
def balanced_sample(spark, sf_dir):
    return split.balanced_sample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 100, "vec_id")


def _nearest_score(rows: DataFrame, refs: DataFrame, others: bool = False) -> DataFrame:
    x = retrieval.dense(rows, "vec_id", "embedding")
    best = retrieval.nearest(x, retrieval.dense(refs, "vec_id", "embedding"), 1, others).select("id", F.col("similarity").alias("s"))
    return retrieval.scores(x.select("id"), best).select("id", r6("nearest_benign_similarity"), r6("y_score"))


def _vote(rows: DataFrame, refs: DataFrame, others: bool = False) -> DataFrame:
    pairs = retrieval.nearest(retrieval.dense(rows, "vec_id", "embedding"), retrieval.dense(refs, "vec_id", "embedding"), 15, others)
    return retrieval.votes(pairs, refs.select(F.col("vec_id").alias("ref"), F.col("label").cast("string").alias("attack_type"))).select("id", "predicted_attack_type", r6("attack_similarity"))


_V = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT * FROM v WHERE label = 9), b AS (SELECT * FROM v WHERE label < 5),
p AS (SELECT q.id, b.id AS ref, b.label, list_cosine_similarity(q.e, b.e) AS s FROM q, b)"""


@query(f"WITH {_V} SELECT id, round(max(s), 6) AS nearest_benign_similarity, round(least(1, greatest(0, 1 - max(s))), 6) AS y_score FROM p GROUP BY id")
def nearest_reference_score(spark, sf_dir):
    """Rows of one label against references of five others; nearest_reference_score_all takes the whole table."""
    df = table(spark, sf_dir, "embeddings")
    return _nearest_score(df.where("label = 9"), df.where("label < 5"))


@query(
    f"""WITH {_V}, k AS (SELECT id, label, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, ref) AS r FROM p), t AS (SELECT id, CAST(label AS VARCHAR) AS type, sum(greatest(s, 0)) AS score FROM k WHERE r <= 15 GROUP BY ALL)
    SELECT id, type AS predicted_attack_type, round(score, 6) AS attack_similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, type) AS n FROM t) WHERE n = 1"""
)
def knn_vote(spark, sf_dir):
    """Rows of one label against references of five others; knn_vote_all takes the whole table."""
    df = table(spark, sf_dir, "embeddings")
    return _vote(df.where("label = 9"), df.where("label < 5"))


_ALL = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.id, b.id AS ref, b.label, list_cosine_similarity(q.e, b.e) AS s FROM v q JOIN v b ON q.id % 100 = 0 AND q.id <> b.id)"""


@query(f"WITH {_ALL} SELECT id, round(max(s), 6) AS nearest_benign_similarity, round(least(1, greatest(0, 1 - max(s))), 6) AS y_score FROM p GROUP BY id")
def nearest_reference_score_all(spark, sf_dir):
    """The query set (vec_id divisible by 100) against all other rows."""
    df = table(spark, sf_dir, "embeddings")
    return _nearest_score(df.where("vec_id % 100 = 0"), df, others=True)


@query(
    f"""WITH {_ALL}, k AS (SELECT id, label, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, ref) AS r FROM p), t AS (SELECT id, CAST(label AS VARCHAR) AS type, sum(greatest(s, 0)) AS score FROM k WHERE r <= 15 GROUP BY ALL)
    SELECT id, type AS predicted_attack_type, round(score, 6) AS attack_similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, type) AS n FROM t) WHERE n = 1"""
)
def knn_vote_all(spark, sf_dir):
    """The query set (vec_id divisible by 100) against all other rows."""
    df = table(spark, sf_dir, "embeddings")
    return _vote(df.where("vec_id % 100 = 0"), df, others=True)


@query()
def hashed_vectors(spark, sf_dir):
    """Buckets and norm of each whole document's vector."""
    docs = table(spark, sf_dir, "documents").select("doc_id", retrieval.weighted(T.lexical_tokens(F.col("text"), None), 1).alias("bag"))
    return retrieval.hashed(docs, "doc_id", "bag").groupBy("id").agg(F.count(F.lit(1)).alias("buckets"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))


@query(
    """SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY ALL"""
)
def hourly_counts(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return df.groupBy("hour", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT toxic AS label, CAST(count(*) AS BIGINT) AS n, round(sum(count(*)) OVER () / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY toxic")
def class_weights(spark, sf_dir):
    return metrics.class_weights(table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label"), "label").select("label", "n", r6("weight"))


@query(
    """SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, CAST(count(*) AS BIGINT) AS rows, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY ROLLUP (lang, source)"""
)
def report_rollup(spark, sf_dir):
    df = table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    return df.select(F.when(F.col("gl") == 1, "all").otherwise(F.col("lang")).alias("lang"), F.when(F.col("gs") == 1, "all").otherwise(F.col("source")).alias("source"), "rows", "mean_chars")


ATTACKS = ("q=1' OR 1=1--", "file=../../etc/passwd", "q=%3Cscript%3Ealert(1)", "x=${jndi:ldap://a}", "t=;id", "n=a%0ab", "q=union select", "q=plain", "role=admin")


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as access-log events; every third one carries an attack in its query."""
    u, n = F.col("url"), F.col("page_id") % 9
    query = F.when(F.col("page_id") % 3 == 0, F.element_at(F.array(*map(F.lit, ATTACKS)), (n + 1).cast("int"))).otherwise(T.url_query(u))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(":00Z")).alias("event_timestamp"), F.lit("GET").alias("method"), T.url_path(u).alias("path"), T.url_path(u).alias("path_template"), query.alias("query"),
        F.concat(F.lit("10.0.0."), (F.col("page_id") % 7).cast("string")).alias("client_ip"), F.lit("agent").alias("user_agent"), F.lit("text/html").alias("content_type"), F.when(F.col("page_id") % 2 == 0, 200).otherwise(403).alias("status_code"), F.lit(True).alias("request_has_cookie"),
    )


@query()
def alert_build(spark, sf_dir):
    """Alerts from rules; tests hold the rules against cases."""
    return alerts.alerts(page_events(spark, sf_dir))


_URL_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_unquoted = lambda x: f"trim(url_decode(url_decode(replace({x}, '+', ' '))))"


@query(
    f"""WITH p AS (SELECT page_id, unnest(list_filter(string_split({_URL_QUERY}, '&'), lambda x: x <> '')) AS s FROM pages),
    q AS (SELECT page_id, lower({_unquoted("regexp_extract(s, '^([^=]*)', 1)")}) AS k, {_unquoted("regexp_extract(s, '^[^=]*=?(.*)$', 1)")} AS v FROM p),
    j AS (SELECT page_id, '[' || string_agg('{{"k":"' || k || '","v":"' || v || '"}}', ',' ORDER BY k, v) || ']' AS pairs FROM q GROUP BY page_id)
    SELECT page_id, coalesce(j.pairs, '[]') AS pairs FROM pages LEFT JOIN j USING (page_id)"""
)
def url_query_pairs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.to_json(T.query_pairs(T.url_query(F.col("url")))).alias("pairs"))


@query()
def canonical_pattern_flags(spark, sf_dir):
    """Pattern flags on decoded and deobfuscated text."""
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(k) for k, c in api.pattern_flags(F.concat_ws(" ", "url", "html"), "page").items()))


def _shapes_sql() -> str:
    attacks = ", ".join("'" + x.replace("'", "''") + "'" for x in ATTACKS)
    plain = {T.SQL: T.SQL.replace(r"(?<!\*)/\*", r"(?:^|[^*])/\*")}  # SQL's patterns don't look behind
    cases = " ".join(f"WHEN regexp_matches(lower(v), {_lit(plain.get(p, p))}) THEN '{name}'" for name, p in T.SHAPES)
    return f"""WITH q AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ([{attacks}])[CAST(page_id % 9 AS INTEGER) + 1] ELSE {_URL_QUERY} END AS query FROM pages),
    v AS (SELECT page_id, regexp_extract(query, '=(.*)$', 1) AS v FROM q)
    SELECT page_id, CASE WHEN v = '' THEN 'empty' {cases} WHEN len(v) >= 32 THEN 'long' WHEN regexp_matches(v, '^[0-9]+$') THEN 'number' WHEN regexp_matches(v, '^[0-9a-fA-F-]{{16,}}$') THEN 'hex' ELSE 'plain' END AS shape FROM v"""


@query(_shapes_sql())
def value_shapes(spark, sf_dir):
    return page_events(spark, sf_dir).select("page_id", T.value_shape(F.regexp_extract("query", "=(.*)$", 1)).alias("shape"))


@query(
    """SELECT doc_id, array_to_string(list_transform(list_slice(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]{1,40}|[0-9]+|[./\\\\$\\{}:;|&`<>()=''\"-]+'), 1, 32), lambda x: left(x, 48)), ' ') AS tokens FROM documents"""
)
def lexical_tokens(spark, sf_dir):
    """Operator F33 as it is applied to one value of a request: the first 32 tokens, of at most 48 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.lexical_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'android|iphone|ios|mobile|phone') THEN 'mobile' WHEN regexp_matches(lower(text), 'ipad|tablet') THEN 'tablet' WHEN regexp_matches(lower(text), 'windows|mac|linux|desktop|laptop|pc') THEN 'desktop' WHEN regexp_matches(lower(text), 'server|vm|container|bot|crawler') THEN 'server' ELSE 'other_device' END AS device FROM documents")
def device_family(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.device_family(F.lower("text")).alias("device"))


@query()
def logistic_baseline(spark, sf_dir):
    """Rates of a logistic model of the toxic label on the documents' length and quality."""
    df = scored_labels(spark, sf_dir).withColumn("quality", F.col("quality").cast("double"))
    model = tabular.fit(df, ["quality", "score"], "toxic")
    return metrics.confusion(tabular.score(model, df, ["quality", "score"]), "toxic", "y_score")


@query()
def logistic_early_stopping(spark, sf_dir):
    """Scores of all labelled documents by the mini-batch model of the same columns, stopped on a fourth of them, and the pass that was kept."""
    df = scored_labels(spark, sf_dir).withColumn("quality", F.col("quality").cast("double"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = descent.fit(df.where(fold != 3), df.where(fold == 3), ["quality", "score"], "toxic", most_passes=20)
    scored = model.score(df.withColumn("split", F.when(fold == 3, "val").otherwise("train")))
    return scored.select("doc_id", "split", F.col("toxic").cast("int").alias("toxic"), r6("y_score"), F.lit(model.best_pass).alias("best_pass"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
