"""Live detection: access-log events as rows of the retrieval model, its verdict beside the rules', and scored cases.

The same projections serve batches and streams; a model's references are tables, so scoring a batch is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import numbers as N
from tracefold.functions import text as T
from tracefold.operators import api, findings
from tracefold.operators.alerts import EVIDENCE, LOG4J, alerts, with_signal
from tracefold.operators.retrieval import RetrievalModel

# Templates of demonstration paths, tokens of attack types, hints for failures.
TEMPLATES = (
    ("/static/download_txt/", "/static/download_txt/{num}"),
    ("/forgot-password", "/forgot-password/bookstore/api/swagger.json/{num}"),
    ("/orders/get/country", "/orders/get/country/{num}"),
)
TOKENS = {"SQL Injection": "attack_sql", "Directory Traversal": "attack_traversal", "XSS": "attack_xss", "LOG4J": "attack_log4j", "RCE": "attack_rce", "Log Forging": "attack_log_forging"}
HINTS = (
    ("difficulty", "encoded", "Add recursive URL decoding features and keep decoded-depth indicators before regex/model vectorization."),
    ("difficulty", "split|fragmented|mixed_case", "Add canonicalized payload tokens that remove comments, normalize case, and join fragmented keywords."),
    ("failure_type", "^false_positive_alert$", "Add hard benign negatives during training: documentation pages, security tutorials, and safe encoded filenames."),
    ("attack_type_expected", "^Cookie Injection$", "Generalize cookie/session features beyond /cookielogin; model signed-cookie, auth-cookie, and endpoint context separately."),
    ("attack_type_expected", "^RCE$", "Expand RCE features for shell metacharacters, ${IFS}, backticks, Jinja MRO/subclasses, and command separators."),
    ("attack_type_expected", "^LOG4J$", "Add Log4J deobfuscation for nested ${::-x} fragments and encoded JNDI payloads."),
    ("attack_type_expected", "^Log Forging$", "Detect double-encoded CR/LF and Unicode line separators in query, header, and user-agent fields."),
)
HOST = "127.0.0.1:5000"


def path_template(path: Column) -> Column:
    out = F.when(path.startswith(TEMPLATES[0][0]), F.lit(TEMPLATES[0][1]))
    for prefix, template in TEMPLATES[1:]:
        out = out.when(path.startswith(prefix), F.lit(template))
    return out.otherwise(path)


def hint_token(attack_type: Column) -> Column:
    """The semantic token of an attack type, or an empty text."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TOKENS.items() for x in kv)), attack_type), F.lit(""))


def query_keys(query: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: x != "")
    return F.array_sort(F.transform(parts, lambda x: F.regexp_extract(x, "^([^=]*)", 1)))


def model_rows(events: DataFrame, hint: str | None = None) -> DataFrame:
    """Events as rows with a bag for a RetrievalModel: id, endpoint_key, flags of the rules' signal, answer and impacts.

    hint: a column with an attack type that takes the place of the rules' one in the semantic token.
    """
    c = F.col
    text = lambda x: F.coalesce(c(x), F.lit("")) if x in events.columns else F.lit("")
    bit = lambda x: N.flag(c(x)) if x in events.columns else F.lit(0)
    df = with_signal(events, "signal")
    made = {
        "id": F.coalesce(c("event_id"), F.concat(F.lit("demo:"), text("event_timestamp"))) if "event_id" in events.columns else F.concat(F.lit("demo:"), text("event_timestamp")),
        "method": F.upper(text("method")), "path": text("path"), "host": F.lit(HOST), "query_string": text("query"), "user_agent": text("user_agent"), "content_type": text("content_type"),
        "status_code": F.coalesce(c("status_code").cast("int"), F.lit(0)), "request_has_cookie": bit("request_has_cookie"), "request_has_authorization": bit("request_has_authorization"),
    }
    df = df.withColumns(made)
    df = df.withColumn("path_template", path_template(c("path")))
    names = F.array_compact(F.array(F.when(c("request_has_authorization") == 1, "authorization"), F.when(c("content_type") != "", "content-type")))
    token = hint_token(F.coalesce(c(hint), c("signal")) if hint else c("signal"))
    df = df.withColumns(
        {
            "endpoint_key": F.concat_ws(" ", "method", "host", "path_template"), "url": F.concat(F.lit("http://"), c("host"), c("path"), F.when(c("query_string") != "", F.concat(F.lit("?"), "query_string")).otherwise("")),
            "path_normalized": c("path"), "body_normalized": F.lit(""), "request_body": F.lit(""), "request_header_values": c("user_agent"), "query_key_set": query_keys(c("query_string")),
            "headers_filtered": F.map_from_arrays(names, F.transform(names, lambda x: F.lit("present"))), "request_headers": F.map_from_arrays(F.filter(names, lambda x: x == "authorization"), F.array_repeat(F.lit("present"), c("request_has_authorization"))),
            "semantic_tokens": F.filter(F.array(token), lambda x: x != ""),
            "normalization_flags": F.struct(c("path").contains("%").cast("int").alias("path_percent_decoded"), F.lit(0).alias("body_percent_decoded"), F.lit(0).alias("body_multiline")),
            "response_headers": F.create_map(F.lit("content-type"), F.lit("application/json")),
        }
    )
    seen = {f"request_contains_{v}": N.flag(c("signal") == k) for k, v in EVIDENCE.items()}
    seen["request_header_contains_log4j"] = N.flag((c("signal") == "LOG4J") & c("user_agent").rlike(T.java(LOG4J)))
    status = {f"response_status_is_{k}xx": N.flag(c("status_code").between(100 * k, 100 * k + 99)) for k in (2, 3, 4, 5)}
    methods = {f"request_method_is_{m.lower()}": N.flag(c("method") == m) for m in api.METHODS} | {"request_method_is_uncommon": N.flag(~c("method").isin(*api.METHODS, "HEAD"))}
    df = df.withColumns(seen | status | methods | {f"request_path_has_template_{k}": c("path_template").contains(f"{{{k}}}").cast("int") for k in ("num", "hex", "token")})
    size = c("response_body_size") if "response_body_size" in events.columns else F.lit(0)
    df = df.withColumns(
        {
            "request_host_is_ip": F.lit(1), "request_has_forwarded_for": F.lit(0), "request_has_content_type": N.flag(c("content_type") != ""), "request_has_json_content_type": N.flag(F.lower("content_type").contains("json")),
            "response_has_error_keyword": N.flag(c("status_code").between(400, 599)), "response_is_json_like": F.lit(1), "response_has_body": N.flag(size > 0), "response_contains_log4j": F.lit(0), "response_header_contains_log4j": F.lit(0),
            "response_body_contains_log4j": F.lit(0), "request_signal_score": sum((c(x) for x in api.SIGNALS[1:]), c(api.SIGNALS[0])),
        }
    )
    return api.bag(api.impact_features(df), response_context=True)


def scored(rows: DataFrame, model: RetrievalModel) -> DataFrame:
    """Rows with scores, type, finding and explanation."""
    return findings.with_explanation(findings.with_finding(model.predict(rows)))


def verdicts(events: DataFrame, model: RetrievalModel | None = None) -> DataFrame:
    """events with an id, the rules' `signal` and `verdict`, the type for an alert: that of the rules if the model agrees that the row is
    an attack; the rules' alone without a model. Events need ids of their own."""
    if model is None:
        return with_signal(events, "signal").withColumn("verdict", F.col("signal"))
    kept = scored(model_rows(events), model)
    agreed = (F.col("y_pred") == 1) & (F.col("predicted_attack_type") != "Benign")
    return kept.withColumn("verdict", F.when(agreed, F.col("signal")))


def model_alerts(events: DataFrame, model: RetrievalModel | None = None) -> DataFrame:
    """Alerts that the rules and the model agree on, or the rules' alone."""
    if model is None:
        return alerts(events)
    found = verdicts(events, model).withColumnRenamed("predicted_attack_type", "_predicted")
    keep = ["y_score", "nearest_benign_similarity", "y_pred", "attack_similarity", "security_finding", "explanation"]
    model_of = F.to_json(F.struct(*keep, F.col("_predicted").alias("predicted_attack_type")))
    rows = found.withColumn("model_prediction", model_of).drop("security_finding", "signal", "verdict", "explanation").withColumn("query", F.col("query_string"))
    flagged = rows.withColumn("_agreed", F.when(F.col("y_pred") == 1, F.col("_predicted")))
    return alerts(flagged, "_agreed")


def scored_cases(cases: DataFrame) -> DataFrame:
    """Cases with label_expected and attack_type_expected, and of a model y_pred and predicted_attack_type if they have them: what the rules,
    with the model's consent, found, whether that is right (passed), and how it failed (empty if it did not)."""
    c = F.col
    df = with_signal(cases, "signal")
    with_model = {"y_pred", "predicted_attack_type"} <= set(cases.columns)
    consent = (c("y_pred") == 1) & (c("predicted_attack_type") != "Benign") if with_model else F.lit(True)
    alert = c("signal").isNotNull() & F.coalesce(consent, F.lit(False))
    attack = F.coalesce(c("label_expected"), F.lit("attack")) == "attack"
    passed = attack == alert
    failure = F.when(passed, "").when(attack, "missed_attack").otherwise("false_positive_alert")
    if with_model:
        odd = attack & (c("y_pred") == 1) & F.coalesce(~c("predicted_attack_type").isin("Unknown") & (c("predicted_attack_type") != c("attack_type_expected")), F.lit(False))
        failure = F.when(odd, F.when(passed, "wrong_attack_type").otherwise("missed_alert_wrong_model_type")).otherwise(failure)
    return df.withColumns({"alert": alert, "passed": passed.cast("int"), "failure_type": failure})


def case_summary(scored: DataFrame) -> DataFrame:
    """For each expected type: rows, passed, attacks, attacks found, benign rows without an alert, and how the others failed."""
    attack = F.col("label_expected") == "attack"
    return scored.groupBy("attack_type_expected").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("passed").alias("passed"), F.count_if(attack).alias("attacks"), F.count_if(attack & (F.col("passed") == 1)).alias("attacks_passed"),
        F.count_if(~attack & (F.col("passed") == 1)).alias("benign_passed"), F.sort_array(F.collect_list(F.when(F.col("failure_type") != "", F.col("failure_type")))).alias("failures"),
    )


def improvement_hints(scored: DataFrame) -> DataFrame:
    """The hints that the failed cases call for, in order."""
    failed = scored.where("passed = 0")
    named = [F.max(F.col(column).rlike(pattern).cast("int")).alias(f"h{i}") for i, (column, pattern, _) in enumerate(HINTS)]
    texts = F.array_compact(F.array(*(F.when(F.col(f"h{i}") == 1, F.lit(text)) for i, (_, _, text) in enumerate(HINTS))))
    return failed.agg(*named).select(F.posexplode(texts).alias("number", "hint"))


def scored_probes(probes: DataFrame) -> DataFrame:
    """Probes with a model's y_pred and predicted_attack_type: binary_pass, type_pass, strict_pass and failure_type (empty if strict)."""
    attack = F.col("label_expected") == "attack"
    binary = (F.col("y_pred") == 1) == attack
    kind = ~attack | (F.col("predicted_attack_type") == F.coalesce("attack_type_expected", F.lit("Benign")))
    failure = F.when(binary & kind, "").when(~binary & attack, "false_negative_binary").when(~binary, "false_positive_binary").otherwise("wrong_attack_type")
    return probes.withColumns({"binary_pass": binary.cast("int"), "type_pass": kind.cast("int"), "strict_pass": (binary & kind).cast("int"), "failure_type": failure})


def failed_probes(scored: DataFrame) -> DataFrame:
    """The probes that failed, in order of their ids."""
    return scored.where("strict_pass = 0").orderBy("event_id")


def probe_report(scored: DataFrame) -> dict:
    """Pass counts and rates overall, by goal and by type, and counts of failures."""
    rates = [F.count(F.lit(1)).alias("rows"), *(x for k in ("strict", "binary", "type") for x in (F.sum(f"{k}_pass").alias(f"{k}_pass"), F.avg(F.col(f"{k}_pass").cast("double")).alias(f"{k}_rate")))]
    per = lambda by: {r[by]: {k: v for k, v in r.asDict().items() if k != by} for r in scored.groupBy(by).agg(*rates).collect()}  # noqa: E731  a row per goal or type
    failures = scored.groupBy(F.when(F.col("failure_type") == "", "passed").otherwise(F.col("failure_type")).alias("failure")).count()
    return {"overall": scored.agg(*rates).collect()[0].asDict(), "failure_counts": {r["failure"]: r["count"] for r in failures.collect()}, "by_probe_goal": per("probe_goal"), "by_attack_type": per("attack_type_expected")}
