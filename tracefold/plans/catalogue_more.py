"""Further queries on the test tables, each beside the same in SQL: profiles and classes of columns, splits, models of risk, cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.operators import across, columns, detection, flows, metrics, profiling, quantiles, retrieval, risk, sketches, split
from tracefold.plans.catalogue import _split_sql, query, r6, table
from tracefold.storage import written
from tracefold.streaming import incidents


@query(f"SELECT event_id, props, event_type, {_split_sql} FROM (SELECT event_id, props, event_type, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)")
def time_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall split of whole rows."""
    return split.by_time(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "props", "event_type", "split")


@query(
    f"""WITH s AS (SELECT o_orderdate AS t, {_split_sql} FROM (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)),
    e AS (SELECT max(t) FILTER (WHERE split = 'train') AS train_end, max(t) FILTER (WHERE split IN ('train', 'val')) AS val_end FROM s)
    SELECT any_value(train_end) AS train_end, any_value(val_end) AS val_end, any_value(val_end) AS test_start, max(t) AS test_end, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train_records,
    CAST(count(*) FILTER (WHERE split = 'val') AS BIGINT) AS val_records, CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS test_records FROM s, e"""
)
def split_info(spark, sf_dir):
    return split.split_info(split.by_time(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey"), "o_orderdate")


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def first_in_time(spark, sf_dir):
    return split.first_in_time(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 100, "ts", "event_id")


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS BIGINT) AS place, CAST(count(*) OVER () AS BIGINT) AS rows FROM lineitem")
def place_in_order(spark, sf_dir):
    """The place of each row in an order of all."""
    df = split.numbered_in_order(table(spark, sf_dir, "lineitem"), [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber")])
    return df.select("l_orderkey", "l_linenumber", (F.col("_rn") - 1).alias("place"), F.col("_n").alias("rows"))


_numeric = {"lineitem": ("l_quantity", "l_extendedprice", "l_discount"), "orders": ("o_totalprice",)}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS p{round(100 * q)}" for q in profiling.SHARES) + f" FROM {t}" for t, cs in _numeric.items() for c in cs
    )
)
def column_quantiles(spark, sf_dir):
    """Exact quantiles from sorted ranges."""
    parts = [quantiles.long_form(table(spark, sf_dir, t), cs) for t, cs in _numeric.items()]
    found = quantiles.of_counts(quantiles.distinct_counts(parts[0].union(parts[1])), profiling.SHARES)
    return found.select("column_name", "n", *(F.round(F.col("p")[i], 6).alias(f"p{round(100 * q)}") for i, q in enumerate(profiling.SHARES)))


# order lines under raw names of flow columns
_raw = {
    "Protocol": "CAST(l_linenumber AS DOUBLE)", "Flow Duration": "l_extendedprice * l_extendedprice", "Tot Fwd Pkts": "l_quantity", "Down/Up Ratio": "l_discount", "Pkt Size Avg": "l_tax * 1000",
    "SYN Flag Cnt": "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END", "Init Fwd Win Byts": "l_quantity - 10", "Flow Byts/s": "l_extendedprice / l_quantity", "Idle Std": "0.0 * l_tax", "Other": "l_extendedprice",
}
MOST_DISTINCT = 50_000
_stats = " UNION ALL ".join(
    f"""SELECT '{n}' AS column_name, count(x) AS non_null_count, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS zero_ratio, avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END) AS negative_ratio, count(DISTINCT x) AS u, min(x) AS mn, max(x) AS mx,
    quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM (SELECT CAST({e} AS DOUBLE) AS x FROM lineitem)"""
    for n, e in _raw.items()
)
_group = """CASE column_name WHEN 'Protocol' THEN 'transport_context' WHEN 'SYN Flag Cnt' THEN 'flag_features' WHEN 'Flow Duration' THEN 'timing' WHEN 'Idle Std' THEN 'timing' WHEN 'Flow Byts/s' THEN 'rate' WHEN 'Down/Up Ratio' THEN 'directionality_ratio'
    WHEN 'Init Fwd Win Byts' THEN 'signed_or_sentinel_window' WHEN 'Tot Fwd Pkts' THEN 'flow_volume' WHEN 'Pkt Size Avg' THEN 'packet_shape' ELSE 'other_numeric' END"""
_reference = "greatest(abs(mn), abs(p99), abs(mx))"
_magnitude = "CASE " + " ".join(f"WHEN {_reference} <= {h} THEN '{n}'" for h, n in (("1", "10^0_or_less"), ("10", "10^1"), ("100", "10^2"), ("1000", "10^3"), ("10000", "10^4"), ("100000", "10^5"), ("1000000", "10^6"))) + " ELSE 'gt_10^6' END"
_transform = """CASE WHEN (NOT approx AND uc <= 1) OR mn = mx THEN 'drop_constant_feature' WHEN uc <= 2 AND mn >= 0 AND mx <= 1 THEN 'keep_binary_indicator' WHEN g = 'transport_context' THEN 'bucketize_transport_context'
    WHEN mn < 0 THEN 'treat_negative_as_sentinel_then_scale' WHEN g = 'flag_features' THEN CASE WHEN zero_ratio >= 0.95 OR uc <= 3 THEN 'keep_indicator_and_drop_raw_count_if_sparse' ELSE 'clip_then_log1p_flag_count' END
    WHEN g = 'directionality_ratio' THEN 'clip_ratio_then_standardize' WHEN g IN ('timing', 'rate', 'flow_volume') AND (p99 > 100 OR (p99 + 1) / (greatest(p95, 0) + 1) > 1.5 OR (mx + 1) / (greatest(p99, 0) + 1) > 5)
    THEN 'clip_high_percentile_then_log1p_then_standardize' WHEN g = 'packet_shape' OR mx > 100 THEN 'standardize_after_basic_cleaning' ELSE 'keep_raw_or_standardize' END"""
_fine = """CASE WHEN g = 'transport_context' THEN 'transport_protocol_category' WHEN (NOT approx AND uc = 1) OR mn = mx THEN 'constant_zero_or_constant_value' WHEN g = 'signed_or_sentinel_window' OR negative_ratio > 0 THEN 'signed_sentinel_tcp_window'
    WHEN g = 'flag_features' THEN CASE WHEN uc <= 2 AND mn >= 0 AND mx <= 1 THEN CASE WHEN zero_ratio >= 0.95 THEN 'rare_binary_transport_flag' ELSE 'binary_transport_flag' END ELSE 'small_count_flag' END
    WHEN g = 'directionality_ratio' THEN CASE WHEN p99 <= 1 AND mx > 10 THEN 'denominator_sensitive_ratio_spike' ELSE 'bounded_or_mild_ratio' END
    WHEN g = 'packet_shape' THEN CASE WHEN zero_ratio >= 0.75 AND p95 <= 125 THEN 'packet_floor_zero_inflated' WHEN p95 >= 1200 AND p99 >= 1400 THEN 'packet_ceiling_mtu_like' WHEN (mx + 1) / (p99 + 1) > 100 AND p99 < 5000 THEN 'packet_shape_with_rare_header_outlier'
      WHEN p99 <= 1000 THEN 'moderate_packet_shape_continuous' ELSE 'broad_packet_shape_continuous' END
    WHEN g = 'rate' THEN 'extreme_positive_rate'
    WHEN g = 'timing' THEN CASE WHEN zero_ratio >= 0.85 AND (p95 + 1) / (p50 + 1) > 1000 THEN 'zero_inflated_extreme_timing' WHEN (p95 + 1) / (p50 + 1) > 10000 AND p99 >= 1e7 THEN 'saturated_timeout_like_timing'
      WHEN (p99 + 1) / (p95 + 1) > 2 OR (mx + 1) / (p99 + 1) > 5 THEN 'burst_gap_heavy_tail_timing' ELSE 'moderate_timing_continuous' END
    WHEN g = 'flow_volume' THEN CASE WHEN zero_ratio = 0 AND p50 <= 3 AND (mx + 1) / (p99 + 1) > 100 THEN 'always_positive_count_with_rare_huge_tail' WHEN zero_ratio >= 0.25 AND (mx + 1) / (p99 + 1) > 100 THEN 'zero_moderate_with_extreme_volume_tail'
      WHEN p99 <= 50 AND mx >= 1000 THEN 'small_count_with_rare_large_flow' ELSE 'general_positive_volume' END
    ELSE 'other_numeric_needs_manual_review' END"""


def raw_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*(F.expr(e).cast("double").alias(n) for n, e in _raw.items()))


@query(
    f"""WITH s AS ({_stats}), a AS (SELECT *, {_group} AS g, u > {MOST_DISTINCT} AS approx, CASE WHEN u > {MOST_DISTINCT} THEN 0 ELSE u END AS uc FROM s)
    SELECT column_name, g AS semantic_group, CAST(uc AS BIGINT) AS unique_count, approx AS unique_count_is_approximate, {_magnitude} AS magnitude_group, {_transform} AS transform_recommendation, {_fine} AS fine_grained_group,
    round(p25, 4) AS p25, round(p75, 4) AS p75 FROM a"""
)
def fine_groups(spark, sf_dir):
    """Columns under raw names: group, capped number of values, magnitude, recommendation and finer class."""
    df = columns.fine_groups(columns.recommended(profiling.profile(raw_columns(spark, sf_dir), list(_raw), most_distinct=MOST_DISTINCT)))
    return df.select("column_name", "semantic_group", "unique_count", "unique_count_is_approximate", "magnitude_group", "transform_recommendation", "fine_grained_group", F.round("p25", 4).alias("p25"), F.round("p75", 4).alias("p75"))


@query(
    """WITH x AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS f FROM documents WHERE source <> 'src0')
    SELECT CAST(count(*) AS BIGINT) AS attack_rows, round(avg(CASE WHEN lang = CASE source WHEN 'src1' THEN 'en' ELSE 'de' END THEN 1.0 ELSE 0.0 END), 6) AS attack_type_accuracy,
    round(avg(CASE WHEN f = 1 AND lang = CASE source WHEN 'src1' THEN 'en' ELSE 'de' END THEN 1.0 ELSE 0.0 END), 6) AS strict_attack_accuracy FROM x"""
)
def attack_type_accuracy(spark, sf_dir):
    """Sources in the place of types."""
    truth = F.when(F.col("source") == "src0", "Benign").when(F.col("source") == "src1", "en").otherwise("de")
    df = table(spark, sf_dir, "documents").select(truth.alias("truth"), F.col("lang").alias("predicted"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("y_pred"))
    return metrics.attack_type_accuracy(df, "truth", "predicted").select("attack_rows", r6("attack_type_accuracy"), r6("strict_attack_accuracy"))


@query("SELECT round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS alert_precision, CAST(count(*) AS BIGINT) AS alerts FROM events WHERE value >= 50")
def alert_precision(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("value", (F.col("event_type") == "error").cast("int").alias("error"))
    return metrics.alert_precision(df, "error", F.coalesce(F.col("value") >= 50, F.lit(False))).select(r6("alert_precision"), "alerts")


@query(
    """WITH q AS (SELECT """
    + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))
    + """ FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, 1 - exp(-(least(abs(l_quantity - m_l_quantity) / s_l_quantity, 5) + least(abs(l_extendedprice - m_l_extendedprice) / s_l_extendedprice, 5)) / 2) AS volume_score,
    1 - exp(-least(abs(l_discount - m_l_discount) / s_l_discount, 5)) AS price_score FROM lineitem, q), r AS (SELECT *, least(greatest(volume_score / 2 + price_score / 2, 0), 1) AS risk FROM b),
    t AS (SELECT quantile_cont(risk, 0.95) AS t FROM r) SELECT l_orderkey, l_linenumber, round(volume_score, 6) AS volume_score, round(price_score, 6) AS price_score, round(risk, 6) AS risk_score, CASE WHEN risk >= t + 1e-9 THEN 1 ELSE 0 END AS alert FROM r, t"""
)
def block_risk_model(spark, sf_dir):
    """Two blocks, fused, with a threshold that a twentieth of the rows lies above; rows at the threshold itself are no alerts here."""
    df = table(spark, sf_dir, "lineitem")
    model = risk.BlockRiskModel.fit(df, {"volume": ["l_quantity", "l_extendedprice"], "price": ["l_discount"]}).calibrated(df, 0.05)
    scored = model.predict(df).withColumn("alert", (F.col("risk_score") >= model.threshold + 1e-9).cast("int"))
    return scored.select("l_orderkey", "l_linenumber", r6("volume_score"), r6("price_score"), r6("risk_score"), "alert")


@query(
    """WITH p AS (SELECT doc_id, source AS goal, CASE WHEN toxic = 1 THEN 'attack' ELSE 'benign' END AS expected, quality AS y, CASE WHEN lang = 'en' THEN 'XSS' ELSE 'RCE' END AS kind FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT *, CASE WHEN (y = 1) = (expected = 'attack') THEN 1 ELSE 0 END AS b, CASE WHEN expected = 'benign' OR kind = 'XSS' THEN 1 ELSE 0 END AS k FROM p)
    SELECT goal AS probe_goal, CASE WHEN b = 1 AND k = 1 THEN '' WHEN b = 0 AND expected = 'attack' THEN 'false_negative_binary' WHEN b = 0 THEN 'false_positive_binary' ELSE 'wrong_attack_type' END AS failure_type,
    CAST(count(*) AS BIGINT) AS rows, CAST(sum(b) AS BIGINT) AS binary_pass, CAST(sum(k) AS BIGINT) AS type_pass, CAST(sum(b * k) AS BIGINT) AS strict_pass FROM s GROUP BY ALL"""
)
def probe_failures(spark, sf_dir):
    """Labels in the place of probes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    kind = F.when(F.col("lang") == "en", "XSS").otherwise("RCE")
    probes = table(spark, sf_dir, "labels").where("toxic is not null and quality is not null").join(docs, "doc_id").select(
        F.col("source").alias("probe_goal"), F.when(F.col("toxic") == 1, "attack").otherwise("benign").alias("label_expected"), F.lit("XSS").alias("attack_type_expected"), F.col("quality").alias("y_pred"), kind.alias("predicted_attack_type")
    )
    scored = detection.scored_probes(probes)
    return scored.groupBy("probe_goal", "failure_type").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(f"{k}_pass").alias(f"{k}_pass") for k in ("binary", "type", "strict")))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 6 WHEN 'A' THEN 17 END AS p, l_suppkey * 700 - 5000 AS port FROM lineitem), m AS (SELECT *, coalesce(p, 0) AS pr FROM l)
    SELECT l_orderkey, l_linenumber, CAST(pr = 6 AS TINYINT) AS is_tcp, CAST(pr = 17 AS TINYINT) AS is_udp, CAST(pr = 1 AS TINYINT) AS is_icmp, CAST(pr NOT IN (1, 6, 17) AS TINYINT) AS is_other_protocol, CAST(port BETWEEN 0 AND 1023 AS TINYINT) AS is_system_port,
    CAST(port BETWEEN 1024 AND 49151 AS TINYINT) AS is_registered_port, CAST(port >= 49152 AS TINYINT) AS is_dynamic_port, CAST(port < 0 AS TINYINT) AS is_invalid_port FROM m"""
)
def transport_context(spark, sf_dir):
    protocol = F.when(F.col("l_returnflag") == "R", 6).when(F.col("l_returnflag") == "A", 17)
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", protocol.alias("protocol"), (F.col("l_suppkey") * 700 - 5000).alias("dst_port"))
    return flows.transport_context(df).drop("protocol", "dst_port")


def _rolling_sql(hours: float, name: str) -> str:
    w = f"OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {round(hours * 3_600_000_000)} PRECEDING AND 1 PRECEDING)"
    n = f"count(*) {w}"
    share = lambda i: f"coalesce(count(*) FILTER (WHERE k = {i}) {w} / nullif(CAST({n} AS DOUBLE), 0), 0)"
    entropy = " + ".join(f"CASE WHEN {share(i)} > 0 THEN -{share(i)} * log2({share(i)}) ELSE 0 END" for i in range(4))
    rate = f"coalesce(count(*) FILTER (WHERE event_type = 'error') {w} / nullif(CAST({n} AS DOUBLE), 0), 0)"
    return f"CAST({n} AS BIGINT) AS flow_count_{name}, round({rate}, 6) AS attack_rate_{name}, round({entropy}, 6) + 0.0 AS protocol_entropy_{name}"


_kinds = {"click": 6, "view": 17, "purchase": 1}


@query(
    "WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS k FROM events) SELECT event_id, "
    + ", ".join(_rolling_sql(h, n) for h, n in ((1.0, "1h"), (24.0, "24h")))
    + " FROM e"
)
def flow_rolling(spark, sf_dir):
    """Events in the place of flows, users in that of sources."""
    protocol = F.element_at(F.create_map(*(F.lit(x) for kv in _kinds.items() for x in kv)), F.col("event_type"))
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", protocol.alias("protocol"), (F.col("event_type") == "error").cast("int").alias("label_binary"))
    out = flows.rolling(df, "user_id", "ts", (1.0, 24.0))
    return out.select("event_id", *(c for n in ("1h", "24h") for c in (f"flow_count_{n}", r6(f"attack_rate_{n}"), (F.round(F.col(f"protocol_entropy_{n}"), 6) + 0.0).alias(f"protocol_entropy_{n}"))))


# the same without looking behind, which SQL's patterns can't
_SQL_PLAIN = T.SQL.replace(r"(?<!\*)/\*", r"(?:^|[^*])/\*").replace("'", "''")


@query(f"SELECT page_id, CASE WHEN regexp_matches(url, '{_SQL_PLAIN}') THEN 1 ELSE 0 END AS url_sql, CASE WHEN regexp_matches(html, '{_SQL_PLAIN}') THEN 1 ELSE 0 END AS html_sql FROM pages")
def sql_pattern(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *(T.contains(F.col(c), T.SQL).alias(f"{c}_sql") for c in ("url", "html")))


MOST_REFERENCES = 2000
_BUCKET = "CAST(('0x' || left(md5(w), 8)) AS BIGINT) % 2048"


@query(
    f"""WITH d AS (SELECT doc_id AS id, lang || '/' || source AS endpoint, source, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents),
    b AS (SELECT id, {_BUCKET} AS b, CAST(count(*) AS DOUBLE) AS w FROM (SELECT id, unnest(t) AS w FROM d) GROUP BY ALL),
    v AS MATERIALIZED (SELECT id, b, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM b),
    l AS (SELECT d.id, endpoint, source, toxic, md5(CAST(d.id AS VARCHAR)) AS o FROM d JOIN labels ON labels.doc_id = d.id WHERE toxic IS NOT NULL),
    a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o) AS rn FROM l WHERE toxic = 1),
    r AS (SELECT id, endpoint, source, toxic FROM (SELECT * FROM l WHERE toxic = 0 ORDER BY o LIMIT {MOST_REFERENCES})
      UNION ALL SELECT id, endpoint, source, toxic FROM (SELECT * FROM a ORDER BY CASE WHEN rn > greatest({MOST_REFERENCES} // (SELECT count(DISTINCT source) FROM a), 1) THEN 1 ELSE 0 END, o LIMIT {MOST_REFERENCES})),
    s AS MATERIALIZED (SELECT x.id, y.id AS ref, sum(x.w * y.w) AS s FROM v x JOIN v y ON x.b = y.b JOIN r ON r.id = y.id GROUP BY x.id, y.id),
    known AS (SELECT DISTINCT endpoint FROM r WHERE toxic = 0),
    n AS (SELECT s.id, max(s.s) AS s FROM s JOIN d ON d.id = s.id JOIN r ON r.id = s.ref LEFT JOIN known k ON k.endpoint = d.endpoint WHERE r.toxic = 0 AND (k.endpoint IS NULL OR r.endpoint = d.endpoint) GROUP BY s.id),
    y AS (SELECT d.id, coalesce(n.s, 0) AS near, least(1, greatest(0, 1 - coalesce(n.s, 0))) AS y FROM d LEFT JOIN n ON n.id = d.id),
    top AS (SELECT s.id, r.source, s.s FROM s JOIN r ON r.id = s.ref JOIN y ON y.id = s.id WHERE r.toxic = 1 AND y.y >= 0.3 QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY round(s.s, 12) DESC, s.ref) <= 15),
    c AS (SELECT id, source, sum(s) AS s FROM top GROUP BY ALL),
    f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, source) = 1)
    SELECT y.id, round(near, 6) + 0.0 AS nearest_benign_similarity, round(y, 6) + 0.0 AS y_score, CAST(y >= 0.3 AS INTEGER) AS y_pred,
    CASE WHEN y < 0.3 THEN 'Benign' ELSE coalesce(f.source, 'Unknown') END AS predicted_attack_type, round(CASE WHEN y < 0.3 THEN 0 ELSE coalesce(f.s, 0) END, 6) + 0.0 AS attack_similarity
    FROM y LEFT JOIN f ON f.id = y.id"""
)
def retrieval_scores(spark, sf_dir):
    """Every document against labelled ones, at most MOST_REFERENCES of a kind: toxic ones as attacks of a type, their language and source as endpoint."""
    words = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), lambda x: x != "")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("endpoint_key"), "source", "text")
    with_bags = lambda df: df.withColumn("bag", retrieval.weighted(words, 1))
    labels = table(spark, sf_dir, "labels").where("toxic is not null").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label_binary"))
    known = texts.drop("text").join(labels, "id").withColumn("attack_type", F.col("source"))
    bags = lambda ids: with_bags(texts.join(ids, "id", "left_semi")).select("id", "bag")
    scored = retrieval.RetrievalModel.fit(known, most=MOST_REFERENCES, threshold=0.3, by="md5", bags=bags).predict(with_bags(texts), keep=["id"])
    return scored.select("id", *((F.round(c, 6) + 0.0).alias(c) for c in ("nearest_benign_similarity", "y_score")), "y_pred", "predicted_attack_type", (F.round("attack_similarity", 6) + 0.0).alias("attack_similarity"))


_ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_totalprice, TIMESTAMP '2024-01-01' + to_seconds(CAST((o_orderkey * 7919) % 2592000 AS INTEGER)) AS t FROM orders)"


def _orders_of_the_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the month of the events: a second of it for each key."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("o_orderkey") * 7919) % 2_592_000)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", at.alias("t"))


@query(
    f"""WITH {_ORDERS}, u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, t ORDER BY o_orderkey DESC) = 1)
    SELECT e.event_id, u.o_orderkey, u.o_totalprice, CAST(epoch_us(e.ts) - epoch_us(u.t) AS BIGINT) AS us_since FROM events e ASOF LEFT JOIN u ON e.user_id = u.o_custkey AND e.ts >= u.t"""
)
def order_before_event(spark, sf_dir):
    """Of every event the last order of its user at or before it."""
    found = across.as_of(table(spark, sf_dir, "events"), _orders_of_the_month(spark, sf_dir), ["user_id"], "ts", ["o_custkey"], "t", ["o_orderkey"], cut=3 * 86_400_000_000)
    return found.select("event_id", "o_orderkey", "o_totalprice", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros("t")).alias("us_since"))


@query(
    f"""WITH {_ORDERS} SELECT e.event_id, CAST(count(o.o_orderkey) AS BIGINT) AS orders_near, round(sum(o.o_totalprice), 2) AS spent_near, CAST(count(o.o_orderkey) FILTER (WHERE o.t > e.ts) AS BIGINT) AS orders_after
    FROM events e JOIN o ON e.user_id = o.o_custkey AND o.t BETWEEN e.ts - INTERVAL 2 DAY AND e.ts + INTERVAL 1 DAY GROUP BY e.event_id"""
)
def orders_near_event(spark, sf_dir):
    """Of every event that has any, the orders of its user from two days before it to one day after."""
    day = 86_400_000_000
    pairs = across.near(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), _orders_of_the_month(spark, sf_dir), ["user_id"], "ts", 2 * day, day, ["o_custkey"], "t")
    after = F.count_if(F.col("t") > F.col("ts").cast("timestamp"))
    return pairs.groupBy("event_id").agg(F.count("o_orderkey").alias("orders_near"), F.round(F.sum("o_totalprice"), 2).alias("spent_near"), after.alias("orders_after"))


_RUNS = """e AS (SELECT CAST(user_id AS VARCHAR) AS client_ip, epoch_us(ts) AS us, event_type FROM events {where}),
    n AS (SELECT *, CASE WHEN us - lag(us) OVER w < {gap} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY client_ip ORDER BY us)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY client_ip ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM n)"""
_HALF_DAY = 43_200_000_000


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of a source; an error is one with an attack in its query."""
    query_text = F.when(F.col("event_type") == "error", "id=1' or 1=1").otherwise("q=books")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("client_ip"), F.col("ts").cast("timestamp").alias("event_timestamp"), F.col("event_type").alias("path"), query_text.alias("query"))


@query(
    f"""WITH {_RUNS.format(where="", gap=_HALF_DAY)} SELECT client_ip, CAST(min(us) AS BIGINT) AS start_us, CAST(max(us) + {_HALF_DAY} AS BIGINT) AS end_us, CAST(count(*) AS BIGINT) AS events,
    CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS signals, CAST(count(DISTINCT event_type) AS BIGINT) AS paths FROM r GROUP BY client_ip, run"""
)
def source_sessions(spark, sf_dir):
    found = incidents.sessions(_requests(spark, sf_dir), "12 hours")
    return found.select("client_ip", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", "signals", "paths")


@query(
    f"""WITH {_RUNS.format(where="WHERE event_type = 'error'", gap=_HALF_DAY)}, c AS (SELECT client_ip, min(us) AS first_us, max(us) AS last_us, count(*) AS events FROM r GROUP BY client_ip, run)
    SELECT client_ip, k AS kind, CAST(first_us AS BIGINT) AS first_us, CAST(last_us AS BIGINT) AS last_us, CAST(events AS BIGINT) AS events FROM c, (VALUES ('closed', 1), ('escalated', 2)) v(k, least) WHERE events >= least"""
)
def source_incidents(spark, sf_dir):
    found = incidents.incidents(_requests(spark, sf_dir), "12 hours", most=2)
    return found.select("client_ip", "kind", F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"), "events")


_SKETCHED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS total_rows, CAST(count({c}) AS BIGINT) AS non_null_count, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, 5 AS quantiles_in_bounds, true AS distinct_in_bounds FROM lineitem"
        for c in _SKETCHED
    )
)
def sketch_profile(spark, sf_dir):
    """Sketches of each month of shipments, merged; their quantiles' ranks and distinct counts held against the exact ones."""
    df = table(spark, sf_dir, "lineitem")
    got = written(sketches.merged(sketches.of_parts(df, _SKETCHED, F.date_trunc("month", "l_shipdate"), "month")), "sketches")
    values = quantiles.distinct_counts(quantiles.long_form(df, _SKETCHED))
    shares = {f"p{round(100 * q)}": q for q in sketches.SHARES}
    met = values.join(F.broadcast(got.select("column_name", "non_null_count", "unique_count", *shares)), "column_name")  # a row per column
    ranks = met.groupBy("column_name").agg(
        F.first("non_null_count").alias("n"), F.abs(F.first("unique_count") - F.count(F.lit(1))).alias("off"), F.count(F.lit(1)).alias("exact"),
        *(F.sum(F.when(F.col("x") < F.col(p), F.col("c")).otherwise(0)).alias(f"{p}_low") for p in shares), *(F.sum(F.when(F.col("x") <= F.col(p), F.col("c")).otherwise(0)).alias(f"{p}_high") for p in shares),
    )
    e = sketches.rank_error()
    inside = sum(((F.col(f"{p}_low") / F.col("n") <= q + e) & (F.col(f"{p}_high") / F.col("n") >= q - e)).cast("int") for p, q in shares.items())
    ranks = ranks.select("column_name", inside.alias("quantiles_in_bounds"), (F.col("off") <= 0.024 * F.col("exact") + 1).alias("distinct_in_bounds"))
    return got.select("column_name", "total_rows", "non_null_count", "min", "max", r6("mean"), r6("std")).join(ranks, "column_name")
