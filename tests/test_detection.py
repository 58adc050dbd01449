"""Rules and model on cases, models of risk, loops of training, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tracefold.operators import alerts, api, api_views, columns, detection, experiments, flows, metrics, profiling, retrieval, risk, split
from tracefold.sources import readers, sinks

BASE = {"event_timestamp": "2026-04-30T00:00:00Z", "method": "GET", "host": "127.0.0.1", "client_ip": "127.0.0.1", "content_type": "", "user_agent": "curl/8.0", "status_code": 200, "response_body_size": 20, "query": "", "request_has_cookie": False, "request_has_authorization": False}
MATRIX = {
    "SQL Injection": (
        [{"path": "/orders/get/country", "query": "country=US"}, {"path": "/orders/get/country", "query": "country=FR"}],
        [{"path": "/orders/get/country", "query": "country=US' OR 1=1--"}, {"path": "/api/search", "query": "q=' OR 1=1--", "status_code": 403}],
    ),
    "Directory Traversal": (
        [{"path": "/static/download_txt/readme.txt"}, {"path": "/static/download_txt/report.txt"}],
        [{"path": "/static/download_txt/../../etc/passwd.txt"}, {"path": "/static/download_txt/%2e%2e/%2e%2e/windows.ini.txt", "status_code": 403}],
    ),
    "XSS": (
        [{"path": "/greet/alice", "query": "name=alice"}, {"path": "/forum", "query": "message=hello"}],
        [{"path": "/greet/bob", "query": "name=<script>alert(1)</script>"}, {"path": "/forum", "query": "message=<img src=x onerror=alert(1)>", "status_code": 403}],
    ),
    "LOG4J": (
        [{"path": "/forgot-password"}, {"path": "/forgot-password", "query": "email=user@example.com"}],
        [{"path": "/forgot-password", "user_agent": "${jndi:ldap://demo.local/a}"}, {"path": "/forgot-password", "query": "next=${jndi:dns://demo.local/a}", "status_code": 403}],
    ),
    "RCE": (
        [{"path": "/api/render", "query": "template=invoice"}, {"path": "/api/tools", "query": "action=status"}],
        [{"path": "/api/render", "query": 'template={{__import__("os").system("id")}}'}, {"path": "/api/tools", "query": "cmd=/bin/sh", "status_code": 403}],
    ),
    "Log Forging": (
        [{"path": "/api/comment", "query": "message=hello"}, {"path": "/api/comment", "query": "message=normal-status"}],
        [{"path": "/api/comment", "query": "message=ok%0aCRITICAL forged=true"}, {"path": "/api/comment", "query": "message=ok%0dadmin=true", "status_code": 403}],
    ),
    "Cookie Injection": (
        [{"path": "/cookielogin"}, {"path": "/api/profile", "request_has_authorization": True}],
        [{"path": "/cookielogin", "request_has_cookie": True}, {"path": "/cookielogin", "request_has_cookie": True, "status_code": 403}],
    ),
}


@pytest.fixture(scope="module")
def cases(spark):
    rows = []
    for kind, (benign, attacks) in MATRIX.items():
        rows += [BASE | {"path_template": x["path"], "attack_type_expected": kind, "label_expected": label, "event_id": f"{kind}-{label}-{i}", "difficulty": "plain"} | x for label, xs in (("benign", benign), ("attack", attacks)) for i, x in enumerate(xs)]
    schema = alerts.EVENT_SCHEMA + ", event_id string, attack_type_expected string, label_expected string, difficulty string"
    return spark.createDataFrame([json.dumps(x) for x in rows], "string").select(F.from_json("value", schema).alias("e")).select("e.*").cache()


def test_the_matrix_of_cases(spark, cases):
    scored = detection.scored_cases(cases)
    assert scored.where("passed = 0").count() == 0 and scored.where("label_expected = 'attack' and signal <> attack_type_expected").count() == 0
    summary = {r.attack_type_expected: r for r in detection.case_summary(scored).collect()}
    assert len(summary) == 7 and all((r.rows, r.passed, r.attacks_passed, r.benign_passed, r.failures) == (4, 4, 2, 2, []) for r in summary.values())
    assert detection.improvement_hints(scored).count() == 0


def test_failed_cases_by_hand(spark, cases):
    odd = cases.withColumns({"y_pred": F.lit(0), "predicted_attack_type": F.lit("Benign")})
    scored = detection.scored_cases(odd)  # the model agrees to nothing
    assert {r.failure_type for r in scored.where("label_expected = 'attack'").collect()} == {"missed_attack"}
    hints = [r.hint for r in detection.improvement_hints(scored).orderBy("number").collect()]
    assert len(hints) == 4 and hints[0].startswith("Generalize cookie")
    wrong = detection.scored_cases(cases.withColumns({"y_pred": F.lit(1), "predicted_attack_type": F.lit("XSS")})).where("label_expected = 'attack' and attack_type_expected = 'RCE'")
    assert {r.failure_type for r in wrong.collect()} == {"wrong_attack_type"}


def test_a_model_and_the_rules_agree(spark, cases):
    train = detection.model_rows(cases).withColumns({"label_binary": (F.col("label_expected") == "attack").cast("long"), "attack_type": F.when(F.col("label_expected") == "attack", F.col("attack_type_expected")).otherwise("Benign")})
    row = train.where("event_id = 'RCE-attack-1'").collect()[0]
    tokens = {t.token for t in row.bag}
    assert row.endpoint_key == "GET 127.0.0.1:5000 /api/tools" and {"attack_rce", "flag:request_contains_rce", "flag:suspicious_request_got_4xx", "outcome:blocked"} <= tokens
    assert train.where("path = '/forgot-password'").first().path_template == "/forgot-password/bookstore/api/swagger.json/{num}"
    model = retrieval.RetrievalModel.fit(train, threshold=0.05)
    got = {r.event_id: r for r in detection.verdicts(cases, model).collect()}
    assert all((got[k].verdict is not None) == ("attack" in k) for k in got)
    made = detection.model_alerts(cases, model).collect()
    assert len(made) == 14 and all(json.loads(r.model)["y_pred"] == 1 and r.zero_trust_action == alerts.ACTION for r in made)
    assert {json.loads(r.model)["mode"] for r in detection.model_alerts(cases).collect()} == {"fallback_rules"}


def test_probes(spark, tmp_path):
    rows = [("a", "x", "attack", "XSS", 1, "XSS"), ("b", "x", "attack", "XSS", 0, "Benign"), ("c", "y", "benign", "Benign", 1, "RCE"), ("d", "y", "attack", "XSS", 1, "RCE"), ("e", "y", "benign", "Benign", 0, "Benign")]
    scored = detection.scored_probes(spark.createDataFrame(rows, "event_id string, probe_goal string, label_expected string, attack_type_expected string, y_pred int, predicted_attack_type string"))
    assert {r.event_id: r.failure_type for r in scored.collect()} == {"a": "", "b": "false_negative_binary", "c": "false_positive_binary", "d": "wrong_attack_type", "e": ""}
    assert [r.event_id for r in detection.failed_probes(scored).collect()] == ["b", "c", "d"]
    report = detection.probe_report(scored)
    assert report["overall"]["strict_pass"] == 2 and report["failure_counts"]["passed"] == 2 and report["by_probe_goal"]["x"]["binary_rate"] == 0.5
    sinks.checks(scored, report, str(tmp_path / "checks"))
    assert readers.manifest(spark, str(tmp_path / "checks" / "summary"))["overall"]["rows"] == 5


def test_block_risk_model(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10), float(i), int(i > 190), i % 2) for i in range(200)] + [(900, None, float("inf"), 0, 0)], "id int, a double, b double, y int, odd int")
    model, reports = risk.train(df, df, {"x": ["a"], "z": ["a", "b"]}, 0.1, "y")
    model.save(spark, str(tmp_path / "m"))
    again = risk.BlockRiskModel.load(spark, str(tmp_path / "m"))
    assert again == model and abs(reports["val"]["risk_summary"]["alert_rate"] - 0.1) < 0.05 and 0 < reports["val"]["reference_metrics"]["recall"] <= 1
    got = again.predict(df).where("id = 7").collect()[0]
    mid, scale = model.blocks["x"]["a"]
    assert abs(got.x_score - (1 - 2.718281828459045 ** -min(5, abs(7 - mid) / scale))) < 1e-9
    assert metrics.reference_metrics(again.score(df), "id", "risk_score") == {} == metrics.reference_metrics(df, "none", "a")
    said = risk.diagnose({"val": 50, "test": 500}, {"risk_summary": {"alert_rate": 0.3}, "reference_metrics": {"f1": 0.9}}, {"reference_metrics": {"f1": 0.5}}, 0.1)
    assert len(said["findings"]) == 3 and said["primary_focus"] == "training" and (said["training_priority"], said["process_priority"]) == (2, 2)
    assert risk.diagnose({"val": 500, "test": 500}, {}, {}, None)["recommendations"] == ["Next step: run slice analysis on high-novelty and failure-heavy events."]


def test_training_loop(spark, cases, tmp_path):
    truth = {"label_binary": (F.col("label_expected") == "attack").cast("long"), "attack_type": F.when(F.col("label_expected") == "attack", F.col("attack_type_expected")).otherwise("Benign")}
    rows = detection.model_rows(cases).withColumns(truth).cache()
    model, reports = experiments.train(spark, rows, rows, str(tmp_path))
    assert reports["val"]["f1"] > 0.9 and reports["val"]["attack_type_metrics"]["attack_rows"] == 14 and reports["val"]["warnings"] == []
    assert experiments.load_threshold(spark, str(tmp_path / "threshold"), 0.5) == model.threshold and experiments.load_threshold(spark, str(tmp_path / "none"), 0.5) == 0.5
    saved = spark.read.parquet(str(tmp_path / "predictions" / "val.parquet"))
    assert {"security_finding", "explanation", "y_true", "attack_type_true", "endpoint_key"} <= set(saved.columns) and saved.count() == 28
    assert spark.read.option("header", True).csv(str(tmp_path / "predictions" / "val.csv")).count() == 28
    assert experiments.evaluate(spark, model, rows.drop("label_binary"), "bare", str(tmp_path))["labeled"] is False
    plain = spark.createDataFrame([(i % 2, float(i % 2) + 0.1 * (i % 3), 1.0) for i in range(60)], "y int, a double, b double")
    assert experiments.fit_and_score(plain, plain, ["a", "b"], "y")["val"]["f1"] > 0.9


def test_splits_of_wide_rows_lose_none(spark):
    names = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "262144", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(30_000).select("id", F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("t"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
        got = split.by_time(df, "t", "id").select("id", "t", "split", "wide").toPandas().sort_values(["t", "id"])
        assert got["split"].tolist() == ["train"] * 22_500 + ["val"] * 2_400 + ["test"] * 5_100
        info = split.split_info(split.by_time(df, "t", "id"), "t").collect()[0]
        assert info.train_records == 22_500 and info.test_start == info.val_end == got["t"].iloc[24_899] and info.test_end == got["t"].iloc[-1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert split.split_info(split.by_time(df.limit(0), "t", "id"), "t").collect()[0].train_end is None
    assert [r.id for r in split.sample(df, 5, "id", 3).collect()] == [r.id for r in split.sample(df.repartition(7), 5, "id", 3).collect()]


def test_row_numbers_of_files(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.csv").write_text("x,y\n" + "".join(f"{i},{'z' * 40}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # files in several splits
    try:
        rows = readers.network_csv(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.event_id for r in rows} == {f"{n}:{i}" for n in "ab" for i in range(3000)} and all(r.event_id.split(":")[1] == r.x for r in rows)
    (tmp_path / "log.jsonl").write_text('{"v": 1}\n\n{"v": 2, "event_id": "own"}\n{"v": 3}\n')
    assert {r.event_id: r.v for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), "v int, event_id string").collect()} == {"log.jsonl:1": 1, "own": 2, "log.jsonl:4": 3}


def test_api_events_have_ids_and_are_kept_once(spark, tmp_path):
    event = lambda u: {"request": {"headers": {"Host": "first", "host": "last"}, "method": "get", "url": u, "body": ""}, "response": {"status": "x", "headers": {}, "status_code": "200", "body": ""}}
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "dataset_1_train.json").write_text(json.dumps([event(f"/{folder}/{i}") for i in range(3)]))
    raw = readers.api_json(spark, str(tmp_path / "*"))
    assert raw.count() == 6
    got = api.normalize(raw).collect()
    assert {r.event_id for r in got} == {f"dataset_1_train:{i}" for i in range(3)} and len(got) == 3 and {r.request_headers["host"] for r in got} == {"last"}
    (tmp_path / "one" / "odd.json").write_text('{"request": {}}')
    with pytest.raises(ValueError, match="expected a list"):
        readers.api_json(spark, str(tmp_path / "one"))
    for n, content in enumerate(["", "  \n", "\ufeff {}", "null", ", [1]"]):
        (tmp_path / f"bad{n}").mkdir()
        (tmp_path / f"bad{n}" / "a.json").write_text(json.dumps([event("/x")]))
        (tmp_path / f"bad{n}" / "b.json").write_text(content)
        with pytest.raises(ValueError, match="every file, but 1" if not content else "expected a list in b.json"):
            readers.api_json(spark, [str(tmp_path / "two"), str(tmp_path / f"bad{n}")])
    (tmp_path / "marked").mkdir()
    (tmp_path / "marked" / "a.json").write_text("\ufeff\n \t" + json.dumps([event("/x")]))
    (tmp_path / "marked" / "_hidden").write_text("{}")
    assert [r["request"]["url"] for r in readers.api_json(spark, str(tmp_path / "marked")).collect()] == ["/x"]
    df = api_views.combined_features(api.features(api.normalize(raw)))
    lists = api_views.feature_list()
    nested = {"path_percent_decoded", "body_percent_decoded", "body_multiline", "parse_status_ok"}
    assert set(lists) - nested <= set(df.columns) and len(lists) == len(set(lists)) == 85
    assert set(api_views.static_view(df, "request_only").columns) & {*api_views.RESPONSE_STATIC, "status_code"} == set()
    assert len(api_views.static_features("request_only")) == 48 and len(api_views.static_features()) == 69 and all(api_views.blocks().values())
    assert df.select(api_views.model_text("request_only").alias("t")).first().t == df.first().request_text


def test_more_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, "train" if i < 6 else "test", i % 2, "u") for i in range(9)], "id int, shard_id int, split string, label_known int, url string")
    sinks.splits(df, str(tmp_path / "s"), within="shard_id")
    assert readers.split(spark, str(tmp_path / "s"), "train").count() == 6
    assert spark.read.option("header", True).csv(str(tmp_path / "s_stats")).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.split(spark, str(tmp_path / "s"), "val")
    sinks.labelled(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l" / "features_static")).columns == ["url", "label_known"] and spark.read.parquet(str(tmp_path / "l" / "unlabeled_validation")).count() == 5
    raw = spark.createDataFrame([(float(i), float(-i), 1.0, float(i % 2), None) for i in range(50)], "`Tot Fwd Pkts` double, `Init Bwd Win Byts` double, `Idle Max` double, `SYN Flag Cnt` double, Label double")
    profile = columns.recommended(profiling.profile(raw, raw.columns, most_distinct=40)).cache()
    by = {r.column_name: r for r in profile.collect()}
    assert by["Tot Fwd Pkts"].unique_count == 0 and by["Tot Fwd Pkts"].unique_count_is_approximate and by["Idle Max"].transform_recommendation == "drop_constant_feature"
    assert by["Init Bwd Win Byts"].transform_recommendation == "treat_negative_as_sentinel_then_scale" and by["Label"].transform_recommendation == "drop_or_investigate" and by["Label"].range_bucket == "all_missing"
    fine = columns.fine_groups(profile)
    sinks.profile(profile, str(tmp_path / "profile"))
    sinks.fine_groups(fine, str(tmp_path / "fine"))
    back = {r.column_name: r for r in readers.profile_csv(spark, str(tmp_path / "profile" / "stats")).collect()}
    assert back["SYN Flag Cnt"].p95 == 1.0 and back["Idle Max"].unique_count == 1
    assert readers.manifest(spark, str(tmp_path / "fine" / "groups"))["binary_transport_flag"]["columns"] == ["SYN Flag Cnt"]
    assert readers.manifest(spark, str(tmp_path / "profile" / "processing_recommendations"))["keep_binary_indicator"]["steps"][0] == "Keep as 0/1 indicator"
    assert "## small_count" not in columns.markdown(fine) and columns.largest(profile, 2).count() == 2
    assert {r.dataset_column: r.column_name for r in columns.joined(profile, ["tot_fwd_pkts", "syn_flag_cnt", "none"]).collect()} == {"tot_fwd_pkts": "Tot Fwd Pkts", "syn_flag_cnt": "SYN Flag Cnt"}


def test_https_order_and_context(spark):
    rows = [("a", "b", "1", "6", f"2024-01-0{1 + i % 3} 00:00:00", "2024-01-05 00:00:00", "1", "1", "1", "1", "backbone_capture", "0") for i in range(6)]
    names = ["SRC_IP", "DST_IP", "DST_PORT", "PROTOCOL", "TIME_FIRST", "TIME_LAST", "BYTES", "BYTES_REV", "PACKETS", "PACKETS_REV", "SCENARIO", "CLASS"]
    got = flows.annotated_https(flows.normalize_https(spark.createDataFrame(rows, names)), "x/flows.csv")
    assert got.columns[:4] == ["event_id", "source_file", "input_view", "event_timestamp"]
    ordered = [r.event_timestamp for r in sorted(got.collect(), key=lambda r: int(r.event_id.split(":")[1]))]
    assert ordered == sorted(ordered) and {r.event_id for r in got.collect()} == {f"flows:{i}" for i in range(6)}
    context = flows.transport_context(spark.createDataFrame([(6, 80), (None, None), (99, 50000)], "protocol int, dst_port int")).collect()
    assert [(r.is_tcp, r.is_other_protocol, r.is_system_port, r.is_dynamic_port, r.is_invalid_port) for r in context] == [(1, 0, 1, 0, 0), (0, 1, 0, 0, 1), (0, 1, 0, 1, 0)]
    assert set(flows.HTTPS_FEATURES) <= set(flows.https_features(flows.normalize_https(spark.createDataFrame(rows, names))).columns)
