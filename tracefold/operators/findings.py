"""What a scored request means: a finding by the first rule that holds, and the signals behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Findings of attack types, and signals with their names in explanations.
FINDINGS = {
    "SQL Injection": "possible_sql_injection_exposure",
    "Directory Traversal": "possible_path_traversal_exposure",
    "LOG4J": "possible_log4j_lookup_exposure",
    "Log Forging": "possible_log_integrity_issue",
    "RCE": "possible_remote_code_execution_exposure",
    "XSS": "possible_xss_exposure",
    "Cookie Injection": "possible_session_cookie_integrity_issue",
}
REASONS = {
    "request_contains_sql_keywords": "SQL keywords",
    "request_contains_traversal": "path traversal marker",
    "request_contains_xss": "XSS marker",
    "request_contains_log4j": "Log4J/JNDI marker",
    "request_header_contains_log4j": "Log4J/JNDI marker in request header",
    "request_contains_rce": "RCE marker",
    "request_contains_log_forging": "log forging newline marker",
    "request_has_authorization": "authorization header present",
    "request_has_cookie": "cookie/session context present",
    "path_percent_decoded": "encoded path normalized",
    "body_percent_decoded": "encoded body normalized",
    "request_method_is_uncommon": "uncommon HTTP method",
    "response_status_is_2xx": "response accepted with 2xx",
    "response_status_is_4xx": "response rejected with 4xx",
    "response_status_is_5xx": "response caused 5xx",
    "response_has_error_keyword": "response contains error keyword",
    "response_contains_log4j": "Log4J/JNDI marker in response",
    "response_header_contains_log4j": "Log4J/JNDI marker in response header",
    "response_body_contains_log4j": "Log4J/JNDI marker in response body",
    "suspicious_request_got_2xx": "suspicious request accepted",
    "suspicious_request_got_4xx": "suspicious request blocked/rejected",
    "suspicious_request_got_5xx": "suspicious request caused server error",
}


def _is(df: DataFrame, name: str) -> Column:
    """A flag of the table; false where it has none."""
    return F.coalesce(F.col(name).cast("int") == 1, F.lit(False)) if name in df.columns else F.lit(False)


def with_finding(df: DataFrame) -> DataFrame:
    """df, with y_pred and predicted_attack_type, and its security_finding."""
    of = lambda n: _is(df, n)
    names = F.create_map(*(F.lit(x) for kv in FINDINGS.items() for x in kv))
    df = df.withColumn("_finding", F.element_at(names, F.col("predicted_attack_type")))
    method = F.col("method") if "method" in df.columns else F.lit("")
    rules = (
        F.when(F.col("y_pred") != 1, "no_static_security_anomaly")
        .when(of("suspicious_request_got_4xx"), "attack_attempt_blocked_by_client_error")
        .when(of("suspicious_request_got_5xx"), "attack_attempt_caused_server_error")
        .when(of("suspicious_request_got_2xx") & F.col("_finding").isNotNull(), F.col("_finding"))
        .when(F.col("_finding").isNotNull(), F.replace("_finding", F.lit("possible_"), F.lit("attempted_")))
        .when(~of("request_has_authorization"), "authorization_context_absent")
        .when(~of("request_has_content_type") & method.isin("POST", "PUT", "PATCH"), "body_content_type_absent")
        .when(of("request_method_is_uncommon"), "uncommon_method_exposure")
        .when(of("path_percent_decoded") | of("body_percent_decoded"), "encoded_payload_requires_validation")
        .otherwise("endpoint_behavior_anomaly")
    )
    return df.withColumn("security_finding", rules).drop("_finding")


def with_explanation(df: DataFrame) -> DataFrame:
    """df, scored and with findings, and a sentence that names scores, signals, type and finding."""
    three = lambda c: F.format_string("%.3f", F.col(c))
    active = F.array_join(F.filter(F.array(*(F.when(_is(df, k), F.lit(v)) for k, v in REASONS.items())), lambda x: x.isNotNull()), ", ")
    flagged = F.concat_ws(
        "; ",
        F.concat(F.lit("anomaly_score="), three("y_score")),
        F.concat(F.lit("nearest_benign_similarity="), three("nearest_benign_similarity")),
        F.when(active != "", F.concat(F.lit("signals="), active)),
        F.concat(F.lit("predicted_attack_type="), F.col("predicted_attack_type")),
        F.concat(F.lit("finding="), F.col("security_finding")),
    )
    calm = F.concat(F.lit("nearest benign similarity="), three("nearest_benign_similarity"), F.lit("; treated as normal endpoint behavior"))
    return df.withColumn("explanation", F.when(F.col("y_pred") == 1, flagged).otherwise(calm))


def finding_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("security_finding").agg(F.count(F.lit(1)).alias("rows"))


def probe_summary(df: DataFrame, by: str) -> DataFrame:
    """Rows of probes with label_expected, attack_type_expected, y_pred and predicted_attack_type: pass rates for each value of a column."""
    attack = F.col("label_expected") == "attack"
    binary = F.col("y_pred") == attack.cast("int")
    kind = ~attack | (F.col("predicted_attack_type") == F.col("attack_type_expected"))
    rate = lambda c, n: F.avg(c.cast("double")).alias(n)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), rate(binary, "binary_pass_rate"), rate(kind, "type_pass_rate"), rate(binary & kind, "strict_pass_rate"))
