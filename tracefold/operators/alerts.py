"""Rules on access-log events, and alerts from them. The same columns serve batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import text as T

# Rules, and titles, causes and fixes of alerts.
SQL, LOG4J = T.SQL, T.LOG4J
TRAVERSAL = r"(?i)(\.\./|%2e%2e%2f|%2e%2e/|\.\.[/\\])"
XSS = r"(?i)(<script|<svg|java\s*script\s*:|javascript\s*:|onerror\s*=|onload\s*=|alert\s*\(|confirm\s*\()"
RCE = r"(?i)(__import__|__mro__|__subclasses__|\$\{ifs\}|/bin/sh|/etc/passwd|cmd=|exec\s*\(|system\s*\(|[`;&|]\s*(id|cat|uname|whoami)\b)"
DOCS_EXCEPTION = r"(?i)('|--|/\*|\bor\s+\d+\s*=\s*\d+\b)"
TEXTS = {
    "SQL Injection": ("Input validation misconfiguration", "SQL-shaped input reached an API parameter.", "Use parameterized queries and allowlisted input types."),
    "Directory Traversal": ("File path validation misconfiguration", "A path breakout sequence reached a file-serving endpoint.", "Canonicalize paths and enforce an allowlisted base directory."),
    "LOG4J": ("Dependency/logging misconfiguration risk", "JNDI lookup syntax reached a logged request surface.", "Patch Log4J, disable lookup expansion, and restrict egress."),
    "Cookie Injection": ("Authentication/session misconfiguration", "Abnormal client-controlled cookie context was accepted.", "Use signed server-side sessions and strict cookie flags."),
    "XSS": ("Output encoding misconfiguration", "Script-capable input reached a rendered or redirecting flow.", "Apply output encoding, template escaping, and CSP."),
    "RCE": ("Unsafe execution design", "Execution-shaped input reached an interpreter-facing surface.", "Remove shell/template execution from untrusted input paths."),
    "Log Forging": ("Log integrity misconfiguration", "Log-control characters reached request handling.", "Use structured logging and sanitize newline/control characters."),
}
EVIDENCE = {"LOG4J": "log4j", "Directory Traversal": "traversal", "XSS": "xss", "RCE": "rce", "Log Forging": "log_forging", "SQL Injection": "sql_keywords"}
ACTION = "Block or step-up matching requests, alert the API owner, and open a root-cause fix ticket."
EVENT_SCHEMA = (
    "event_timestamp string, method string, host string, path string, path_template string, query string, client_ip string, user_agent string, content_type string, status_code int, response_body_size int, "
    "request_has_authorization boolean, request_has_cookie boolean"
)


def _once(value: Column, made) -> Column:
    """made(value), with the value computed once however often it is used: a lambda's argument isn't copied into its body."""
    return F.element_at(F.transform(F.array(value), made), 1)


def with_signal(events: DataFrame, name: str = "security_finding") -> DataFrame:
    """events with the attack type of the first rule that holds, or null.

    Rules look at the request's text as it is, decoded, deobfuscated and compact; each stage is computed once.
    """
    have = lambda c: F.coalesce(F.col(c), F.lit("")) if c in events.columns else F.lit("")
    path = have("path")
    has_cookie = F.coalesce(F.col("request_has_cookie").cast("boolean"), F.lit(False)) if "request_has_cookie" in events.columns else F.lit(False)

    def rules(text: Column) -> Column:
        hit = lambda pattern: text.rlike(T.java(pattern))
        return _once(T.decoded(have("query")), lambda query: first_rule(hit, query))

    def first_rule(hit, query: Column) -> Column:
        docs = path.startswith("/docs/") & ~query.rlike(T.java(DOCS_EXCEPTION))
        low = F.lower(query)
        cookie = has_cookie & ((path == "/cookielogin") | path.startswith("/login/") | low.contains("role=admin") | low.contains("next=/admin"))
        return (
            F.when(hit(LOG4J), "LOG4J")
            .when(hit(TRAVERSAL), "Directory Traversal")
            .when(hit(XSS), "XSS")
            .when(hit(RCE), "RCE")
            .when(hit(T.LOG_FORGING), "Log Forging")
            .when(hit(SQL), F.when(~docs, "SQL Injection"))
            .when(cookie, "Cookie Injection")
        )

    def with_compact(raw: Column, plain: Column, clear: Column) -> Column:
        compact = F.regexp_replace(F.regexp_replace(clear, r"(?d)/\*.*?\*/", ""), r"(?U)\s+", "")
        return _once(F.concat_ws(" ", raw, plain, clear, compact), rules)

    raw = F.concat_ws(" ", *(have(c) for c in ("path", "path_template", "query", "user_agent", "content_type")))
    found = _once(raw, lambda r: _once(T.decoded(r), lambda plain: _once(T.deobfuscate(plain), lambda clear: with_compact(r, plain, clear))))
    return events.withColumn(name, found)


def outcome(status: Column) -> Column:
    return F.when(status.between(200, 299), "accepted").when(status.between(400, 499), "blocked").when(status.between(500, 599), "errored").otherwise("observed")


def alerts(events: DataFrame, predictions: str | None = None) -> DataFrame:
    """An alert for each event with a signal. predictions: a column with a model's type; an alert then needs its agreement."""
    df = with_signal(events).withColumn("outcome", outcome(F.col("status_code"))).where("security_finding is not null")
    if predictions:
        df = df.where(F.coalesce(F.col(predictions), F.lit("Benign")) != "Benign")
    kind, result = F.col("security_finding"), F.col("outcome")
    accepted, blocked = result == "accepted", result == "blocked"
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in TEXTS.items() for x in (k, v[i]))), kind)
    severity = F.when(accepted & kind.isin("SQL Injection", "LOG4J", "RCE"), "critical").when(accepted, "high").when(blocked, "medium").otherwise("high")
    title = F.when(accepted, of(0)).when(blocked, F.concat(F.lit("Blocked suspicious request: "), kind)).otherwise(F.concat(F.lit("Unsafe handling: "), kind))
    cause = (
        F.when(accepted, F.concat(of(1), F.lit(" The endpoint returned 2xx, so this is likely a misconfiguration.")))
        .when(blocked, "Control rejected the suspicious request; keep as abuse telemetry.")
        .otherwise("Suspicious input produced an unsafe or unexpected response.")
    )
    fix = F.when(blocked, "Aggregate by source and tune controls if volume increases.").otherwise(of(2))
    names = F.element_at(F.create_map(*(F.lit(x) for k, v in EVIDENCE.items() for x in (k, f"request_contains_{v}"))), kind)
    header = F.when((kind == "LOG4J") & F.coalesce("user_agent", F.lit("")).rlike(T.java(LOG4J)), "request_header_contains_log4j")
    seen = F.when(kind == "Cookie Injection", "request_has_cookie").otherwise(names)
    model = F.col("model_prediction") if "model_prediction" in events.columns else F.lit('{"mode":"fallback_rules"}')
    status = F.concat(F.lit("response_status_is_"), F.floor(F.col("status_code") / 100).cast("string"), F.lit("xx"))
    got = F.concat(F.lit("suspicious_request_got_"), F.when(accepted, "2xx").when(blocked, "4xx").when(result == "errored", "5xx").otherwise("other"))
    return df.select(
        F.col("event_timestamp").alias("timestamp"), severity.alias("severity"), title.alias("title"), F.col("client_ip").alias("source_ip"), F.concat_ws(" ", "method", "path").alias("endpoint"), "status_code", "security_finding",
        F.concat(F.col("path"), F.lit(" "), result, F.lit(" suspicious "), kind, F.lit(" shaped input with HTTP "), F.col("status_code").cast("string"), F.lit(".")).alias("summary"),
        cause.alias("root_cause"), F.filter(F.array(seen, header, status, got), lambda x: x.isNotNull()).alias("evidence"), fix.alias("recommended_fix"), model.alias("model"), F.lit(ACTION).alias("zero_trust_action"),
    )
