"""API traffic: flattened requests and responses, lexical and impact features, token bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import numbers as N
from tracefold.functions import text as T
from tracefold.operators.retrieval import weighted
from tracefold.operators.split import keep_first

# Kept headers, attack labels, methods.
HEADERS = ("accept", "authorization", "content-encoding", "content-length", "content-type", "cookie", "host", "user-agent", "x-forwarded-for", "x-requested-with")
ATTACKS = {"benign": "Benign", "cookie injection": "Cookie Injection", "directory traversal": "Directory Traversal", "log4j": "LOG4J", "log forging": "Log Forging", "rce": "RCE", "sql injection": "SQL Injection", "xss": "XSS"}
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS")
RESPONSE_WORDS = "error|not found|access denied|unauthorized|failed|forbidden"
SIGNALS = [f"request_contains_{k}" for k in T.PATTERNS] + ["request_header_contains_log4j"]


def _headers(c: Column) -> Column:
    """Names in lower case; of names that differ in case only the last one stays."""
    pairs = F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(T.strip(e["key"])).alias("key"), F.coalesce(e["value"], F.lit("")).alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def normalize(raw: DataFrame, validation: tuple[str, ...] = ("_val", "validation")) -> DataFrame:
    """One row per event of (request, response, source_file). With a record_index, as `readers.api_json` gives it, events get an
    event_id of file and index, and the first row of each stays."""
    if "record_index" in raw.columns:
        raw = keep_first(raw.withColumn("event_id", F.concat_ws(":", F.regexp_replace("source_file", r"\.[^.]*$", ""), F.col("record_index").cast("string"))), ["event_id"], ["source_file", "record_index"])
    r, s = "request", "response"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    df = raw.withColumns({"request_headers": _headers(F.col(f"{r}.headers")), "response_headers": _headers(F.col(f"{s}.headers")), "method": F.upper(text(f"{r}.method")), "url": text(f"{r}.url"), "request_body": text(f"{r}.body"), "response_body": text(f"{s}.body")})
    df = df.withColumns({"host": F.coalesce(F.nullif(T.url_host(F.col("url")), F.lit("")), F.col("request_headers")["host"], F.lit("")), "path": T.url_path(F.col("url")), "query_string": T.url_query(F.col("url")), "headers_filtered": F.map_filter("request_headers", lambda k, _: k.isin(*HEADERS))})
    path = F.regexp_replace(T.strip(T.unquote(F.when(F.col("path") == "", "/").otherwise(F.col("path")), plus=False)), "/{2,}", "/")
    body = T.strip(F.regexp_replace(T.unquote(F.col("request_body"), plus=False), "\r\n?", "\n"))
    df = df.withColumns({"path_normalized": F.when(path == "", "/").otherwise(path), "body_normalized": body, "query_pairs": T.query_pairs(F.col("query_string")), "content_type": F.coalesce(F.col("request_headers")["content-type"], F.lit("")), "cookie": F.coalesce(F.col("request_headers")["cookie"], F.lit("")), "user_agent": F.coalesce(F.col("request_headers")["user-agent"], F.lit(""))})
    has = lambda k: F.map_contains_key("headers_filtered", k).cast("int")
    flags = F.struct(N.flag(F.col("path") != F.col("path_normalized")).alias("path_percent_decoded"), N.flag(F.col("request_body") != F.col("body_normalized")).alias("body_percent_decoded"), F.col("body_normalized").contains("\n").cast("int").alias("body_multiline"), has("cookie").alias("has_cookie"), has("authorization").alias("has_authorization"), has("x-forwarded-for").alias("has_forwarded_for"))
    tag = F.lower(T.strip(F.coalesce(F.col(f"{r}.Attack_Tag"), F.lit("Benign"))))
    names = F.create_map(*(F.lit(x) for kv in ATTACKS.items() for x in kv))
    unlabelled = F.lower("source_file").rlike("|".join(validation))
    dataset = F.regexp_extract(F.lower("source_file"), r"dataset[_-]?(\d+)", 1)
    df = df.withColumns({
        "path_template": T.path_template(F.col("path_normalized")), "query_key_set": F.array_sort(F.array_distinct(F.transform("query_pairs", lambda p: p["k"]))), "normalization_flags": flags,
        "status_code": F.coalesce(F.col(f"{s}.status_code").try_cast("int"), F.lit(0)), "attack_type": F.when(~unlabelled, F.coalesce(names[tag], F.lit("Unknown"))), "label_known": (~unlabelled).cast("int"),
        "dataset_id": F.when(dataset != "", F.concat(F.lit("dataset_"), dataset)).otherwise(F.regexp_replace("source_file", r"\.[^.]*$", "")),
        "request_header_values": F.array_join(F.map_values("request_headers"), " "), "response_header_values": F.array_join(F.map_values("response_headers"), " "),
    })
    df = df.withColumns({"label_binary": F.when(F.col("label_known") == 1, (F.col("attack_type") != "Benign").cast("long")), "endpoint_key": F.concat_ws(" ", "method", "host", "path_template"), "semantic_tokens": semantic_tokens(), "request_text": F.concat_ws(" ", "method", "url", "request_header_values", "request_body"), "response_text": F.concat_ws(" ", F.col("status_code").cast("string"), "response_header_values", "response_body")})
    return df.withColumns({"combined_text": F.concat_ws(" ", "request_text", "response_text"), "event_timestamp": F.try_to_timestamp(F.regexp_replace(F.col("response_headers")["date"], r"^\s*[A-Za-z]{3},\s*|\s*GMT\s*$", ""), F.lit("d MMM yyyy HH:mm:ss"))}).drop(r, s)


def semantic_tokens() -> Column:
    """Tokens of method, path, parameters, headers, content type and attack patterns."""
    c = F.col
    low = F.lower("content_type")
    kind = F.when(low.contains("json"), "content_type:json").when(low.contains("xml"), "content_type:xml").when(low.contains("form"), "content_type:form").when(low != "", "content_type:other")
    text = F.lower(F.concat_ws(" ", "path_template", F.array_join(F.transform("query_pairs", lambda p: F.concat(p["k"], F.lit("="), p["v"])), " "), "body_normalized"))
    patterns = {"attack_sql": T.SQL} | {f"attack_{new}": dict(T.SHAPES)[old] for new, old in (("traversal", "traversal"), ("xss", "script"), ("log4j", "lookup"), ("rce", "command"), ("log_forging", "newline"))}
    patterns["attack_traversal"] = r"\.\./|\.\.\\"  # no encoded dots here: the body is decoded already
    prefixed = lambda p, a: F.transform(a, lambda x: F.concat(F.lit(p), x))
    single = F.array(
        F.concat(F.lit("method:"), F.lower("method")), F.concat(F.lit("host_is_ip:"), T.host_is_ip(c("host")).cast("string")), F.concat(F.lit("path_depth:"), T.path_depth(c("path_template")).cast("string")), kind,
        *(F.when(text.rlike(T.java(p)), k) for k, p in patterns.items()),
    )
    lists = F.concat(prefixed("path:", F.filter(F.split("path_template", "/"), lambda x: x != "")), prefixed("query_key:", c("query_key_set")), F.transform("query_pairs", lambda p: F.concat(F.lit("query_value_shape:"), p["k"], F.lit(":"), T.value_shape(p["v"]))), prefixed("header:", F.array_sort(F.map_keys("headers_filtered"))))
    return F.filter(F.concat(single, lists), lambda x: x.isNotNull())


def pattern_flags(text: Column, prefix: str) -> dict[str, Column]:
    scan = T.canonical(text)
    return {f"{prefix}_contains_{k}": T.contains(scan, p) for k, p in T.PATTERNS.items()}


# Names of the counts of patterns.
COUNT_NAMES = {"sql_keywords": "sql_keyword", "traversal": "traversal_token", "xss": "xss_token", "log4j": "log4j_token", "rce": "rce_token", "log_forging": "newline_token"}


def pattern_counts(text: Column, prefix: str) -> dict[str, Column]:
    scan = T.canonical(text)
    return {f"{prefix}_{COUNT_NAMES[k]}_count": T.occurrences(scan, p) for k, p in T.PATTERNS.items()}


def contexts(path: Column, query: Column) -> dict[str, Column]:
    path, query = F.lower(path), F.lower(query)
    return {
        "request_context_is_docs": path.startswith("/docs/").cast("int"),
        "request_context_is_search": (path.contains("/search") | query.contains("q=")).cast("int"),
        "request_context_is_static": path.startswith("/static/").cast("int"),
        "request_context_is_auth": (path.contains("/login") | path.contains("auth") | path.contains("profile")).cast("int"),
        "request_context_is_api": path.startswith("/api/").cast("int"),
    }


def character_counts(text: Column, prefix: str) -> dict[str, Column]:
    return {
        f"{prefix}_percent_encoded_count": T.occurrences(text, "%[0-9a-fA-F]{2}"),
        f"{prefix}_double_encoded_count": T.occurrences(text, "%25[0-9a-fA-F]{2}"),
        f"{prefix}_special_char_count": T.occurrences(text, T.SPECIAL_CHARACTERS),
        f"{prefix}_digit_count": T.occurrences(text, "[0-9]"),
    }


def token_stats(text: Column, prefix: str) -> dict[str, Column]:
    t = T.tokens(text)
    total = F.aggregate(t, F.lit(0), lambda a, x: a + F.length(x))
    return {f"{prefix}_token_count": F.size(t), f"{prefix}_unique_token_count": F.size(F.array_distinct(t)), f"{prefix}_avg_token_length": F.coalesce(N.ratio(total.cast("double"), F.size(t)), F.lit(0.0))}


def request_features(df: DataFrame) -> DataFrame:
    c = F.col
    methods = {f"request_method_is_{m.lower()}": N.flag(c("method") == m) for m in METHODS} | {"request_method_is_uncommon": N.flag(~c("method").isin(*METHODS, "HEAD"))}
    lengths = {f"request_{k}_length": F.length(v) for k, v in (("url", "url"), ("path", "path"), ("path_template", "path_template"), ("query", "query_string"), ("body", "request_body"), ("body_normalized", "body_normalized"), ("cookie", "cookie"), ("user_agent", "user_agent"))}
    has = {f"request_has_{k.replace('-', '_').replace('x_', '')}": F.map_contains_key("headers_filtered", k).cast("int") for k in ("authorization", "x-forwarded-for", "content-type")}
    scan = F.concat_ws(" ", "url", "request_body", "request_header_values")
    out = df.withColumns(methods | lengths | has | contexts(c("path"), c("query_string")) | character_counts(c("request_text"), "request"))
    out = out.withColumns({"request_host_is_ip": T.host_is_ip(c("host")), "request_path_depth": T.path_depth(c("path")), "request_query_param_count": F.size("query_pairs"), "request_query_key_count": F.size("query_key_set"), "request_has_cookie": N.flag(F.length("cookie") > 0), "request_has_json_content_type": F.lower("content_type").contains("json").cast("int"), "request_header_count_filtered": F.size("headers_filtered"), **{f"request_path_has_template_{k}": c("path_template").contains(f"{{{k}}}").cast("int") for k in ("num", "hex", "token")}, "request_header_contains_log4j": T.contains(c("request_header_values"), T.LOG4J)})
    out = out.withColumns(pattern_flags(scan, "request")).withColumns(pattern_counts(scan, "request"))
    return out.withColumn("request_signal_score", sum((c(x) for x in SIGNALS[1:]), c(SIGNALS[0])))


def response_features(df: DataFrame) -> DataFrame:
    c = F.col
    scan = F.concat_ws(" ", "response_body", "response_header_values")
    status = {f"response_status_is_{k}xx": N.flag(c("status_code").between(100 * k, 100 * k + 99)) for k in (2, 3, 4, 5)}
    kind = F.lower(F.coalesce(c("response_headers")["content-type"], c("content_type")))
    status |= {"response_content_type_is_json": F.coalesce(kind.contains("json"), F.lit(False)).cast("int")}
    out = df.withColumns(status | {"response_body_length": F.length("response_body"), "response_has_error_keyword": F.lower("response_body").rlike(RESPONSE_WORDS).cast("int"), "response_is_json_like": c("response_body").rlike(r"^[{\[]").cast("int"), "response_has_body": N.flag(F.length("response_body") > 0), "response_header_contains_log4j": T.contains(c("response_header_values"), T.LOG4J), "response_body_contains_log4j": T.contains(c("response_body"), T.LOG4J)})
    flags = pattern_flags(scan, "response") | {"response_contains_log_forging": T.contains(c("response_text"), T.LOG_FORGING)}
    out = out.withColumns(flags)
    names = [*flags, "response_has_error_keyword", "response_header_contains_log4j", "response_body_contains_log4j"]
    return out.withColumn("response_signal_score", sum((c(x) for x in names[1:]), c(names[0])))


def impact_features(df: DataFrame) -> DataFrame:
    """Suspicious requests by what the endpoint answered."""
    c = F.col
    suspicious, accepted = c("request_signal_score") > 0, c("response_status_is_2xx") == 1
    out = {f"suspicious_request_got_{k}xx": N.flag(suspicious & (c(f"response_status_is_{k}xx") == 1)) for k in (2, 4, 5)}
    out |= {f"{k.removesuffix('_keywords')}_request_got_2xx": N.flag((c(f"request_contains_{k}") == 1) & accepted) for k in T.PATTERNS if k != "log4j"}
    out["log4j_request_got_2xx"] = N.flag(((c("request_contains_log4j") == 1) | (c("request_header_contains_log4j") == 1)) & accepted)
    out["auth_or_cookie_request_got_2xx"] = N.flag(((c("request_has_authorization") == 1) | (c("request_has_cookie") == 1)) & accepted)
    return df.withColumns(out)


def features(df: DataFrame, mode: str = "request_response") -> DataFrame:
    """Row-level features; no shuffle. mode: request_only, response_only or request_response."""
    if mode != "response_only":
        df = request_features(df).withColumns(token_stats(F.col("request_text"), "request"))
    if mode != "request_only":
        df = response_features(df).withColumns(token_stats(F.col("response_text"), "response"))
    if mode == "request_response":
        df = impact_features(df).withColumns(token_stats(F.col("combined_text"), "combined"))
    return df


def without_hints(df: DataFrame) -> DataFrame:
    """Semantic tokens emptied and signals zeroed, to see what a model knows without them."""
    hints = [c for c in df.columns if "_contains_" in c or c.endswith(("_signal_score", "_got_2xx", "_got_4xx", "_got_5xx"))]
    return df.withColumns({"semantic_tokens": F.array().cast("array<string>")} | {c: F.lit(0) for c in hints})


# Families of payloads and weights of tokens; everything else counts once.
FAMILIES = {
    "payload_sql": r"(?i)(?:\bunion\b\s+\bselect\b|\bselect\b.+\bfrom\b|\bor\b\s+['\"]?\w+['\"]?\s*=\s*['\"]?\w+['\"]?|\bor\b\s+1\s*=\s*1|--|/\*)",
    "payload_traversal": r"(?i)(?:\.\./|\.\.\\|%2e%2e|/etc/passwd|windows\\win\.ini)",
    "payload_xss": r"(?i)(?:<script|<svg|java\s*script\s*:|javascript\s*:|onerror\s*=|onload\s*=|alert\s*\(|confirm\s*\()",
    "payload_log4j": T.LOG4J,
    "payload_rce": T.RCE,
    "payload_log_forging": T.LOG_FORGING,
}
FAMILY_WEIGHT, IMPACT_WEIGHT = 8, 4
SEMANTIC_WEIGHTS = {"attack_sql": 10, "attack_log_forging": 10, "attack_traversal": 8, "attack_xss": 8, "attack_log4j": 8, "attack_rce": 8}
IMPACTS = [f"suspicious_request_got_{k}xx" for k in (2, 4, 5)] + [f"{k}_request_got_2xx" for k in ("sql", "traversal", "xss", "log4j", "rce", "log_forging", "auth_or_cookie")]
REQUEST_FLAGS = [
    *(f"request_method_is_{m.lower()}" for m in METHODS), "request_method_is_uncommon", "request_host_is_ip", *(f"request_path_has_template_{k}" for k in ("num", "hex", "token")),
    *(f"request_has_{k}" for k in ("cookie", "authorization", "forwarded_for", "content_type", "json_content_type")), "parse_status_ok", "path_percent_decoded", "body_percent_decoded", "body_multiline", *SIGNALS,
]
RESPONSE_FLAGS = [
    *(f"response_status_is_{k}xx" for k in (2, 3, 4, 5)), "response_has_error_keyword", "response_is_json_like", "response_has_body", "response_content_type_is_json",
    "response_contains_log4j", "response_header_contains_log4j", "response_body_contains_log4j", *IMPACTS,
]
FLAG_WEIGHTS = {k: 6 for k in SIGNALS} | {"request_contains_log_forging": 8} | {k: 3 for k in IMPACTS if not k.startswith(("suspicious", "auth"))}
# Names of the fields in tokens, and the columns that hold them here.
PAYLOAD_FIELDS = {"path": "path_normalized", "request_body": "body_normalized", "body_raw": "request_body", "body_normalized": "body_normalized", "request_header_values": "request_header_values", "user_agent": "user_agent"}
MOST_PAYLOAD_TOKENS = 256


def context_tokens() -> Column:
    path, template, query = (F.lower(F.coalesce(c, F.lit(""))) for c in ("path_normalized", "path_template", "query_string"))
    rules = {
        "docs": path.startswith("/docs/") | template.contains("/docs/"), "search": path.contains("/search") | query.contains("q="), "static": path.startswith("/static/"),
        "auth": path.contains("/login") | path.contains("auth") | path.contains("profile"), "api": path.startswith("/api/"),
    }
    return F.filter(F.array(*(F.when(rule, F.lit(f"context:{k}")) for k, rule in rules.items())), lambda x: x.isNotNull())


def payload_tokens(most: int = MOST_PAYLOAD_TOKENS) -> Column:
    """Families of the whole payload, then the words of each query value and field, 32 a value; `most` of all of these in order."""
    headers = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers_filtered"))))
    parts = [F.col(c) for c in ("path_normalized", "url", "query_string", "body_normalized", "request_body", "body_normalized", "request_header_values")] + [headers, F.col("user_agent")]
    payload = T.canonical_text(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " "))
    families = F.flatten(F.array(*(F.array_repeat(F.lit(f"family:{k}"), F.when(payload.rlike(T.java(p)), FAMILY_WEIGHT).otherwise(0)) for k, p in FAMILIES.items())))

    def words(prefix: Column, value: Column) -> Column:
        found = T.lexical_tokens(F.lower(T.canonical_text(value)))
        return F.flatten(F.transform(found, lambda t: F.array(F.concat(prefix, t), F.concat(F.lit("payload_token:"), t))))

    def of_pair(pair: Column) -> Column:
        key = F.lower(T.unquote(F.regexp_extract(pair, "^([^=]*)", 1)))
        return words(F.concat(F.lit("query_value:"), key, F.lit(":")), T.unquote(F.regexp_extract(pair, "^[^=]*=?([\\s\\S]*)$", 1)))

    values = F.flatten(F.transform(F.filter(F.split(F.coalesce("query_string", F.lit("")), "&"), lambda x: x != ""), of_pair))
    fields = [words(F.lit(f"{name}:"), F.col(c)) for name, c in PAYLOAD_FIELDS.items()]
    return F.slice(F.concat(families, values, *fields), 1, most)


def response_tokens() -> Column:
    """What came of the request: class of the status, outcome, impacts; needs impact_features."""
    status = F.col("status_code")
    outcome = F.when(status.between(200, 299), "outcome:accepted").when(status.between(400, 499), "outcome:blocked").when(status.between(500, 599), "outcome:errored")
    family = F.when(status.between(200, 599), F.concat(F.lit("response_status_family:"), F.floor(status / 100).cast("string"), F.lit("xx")))
    impacts = (F.when(F.col(c) == 1, F.array_repeat(F.lit(f"impact:{c}"), IMPACT_WEIGHT)) for c in IMPACTS)
    return F.flatten(F.filter(F.array(F.array(family), F.array(outcome), *impacts), lambda x: x.isNotNull()))


def bag(df: DataFrame, response_context: bool = False) -> DataFrame:
    """df with `bag`: weighted tokens of fields, contexts, payloads, meaning and flags; with the answer's too if `response_context`.

    df: normalized rows with request_features; with features() for the answer's. Flags whose columns are missing count as not set.
    """
    c = F.col
    single = [F.when(T.strip(c(k)) != "", F.concat(F.lit(f"{k}:"), F.lower(T.strip(c(k))))) for k in ("method", "host", "path_template", "content_type")]
    names = {"query_key_set": c("query_key_set"), "request_header_names": F.array_sort(F.map_keys("request_headers"))}
    prefixed = lambda k, a: F.transform(a, lambda x: F.concat(F.lit(f"{k}:"), x))
    lists = [prefixed(k, T.tokens(F.lower(F.array_join(v, " ")))) for k, v in names.items()]
    plain = [F.array(*single), *lists, context_tokens(), payload_tokens()]
    derived = {"parse_status_ok": N.flag(~c("method").isin("", "UNKNOWN"))} | {k: c(f"normalization_flags.{k}") for k in ("path_percent_decoded", "body_percent_decoded", "body_multiline")}
    flags = REQUEST_FLAGS
    if response_context:
        plain.append(response_tokens())
        flags = flags + RESPONSE_FLAGS
        answer = F.coalesce(c("response_headers")["content-type"], c("content_type"))
        derived["response_content_type_is_json"] = F.lower(answer).contains("json").cast("int")
    value = {k: c(k) if k in df.columns else derived[k] for k in flags if k in df.columns or k in derived}
    token = lambda t, w: F.struct(t.alias("token"), w.cast("double").alias("weight"))
    known = F.create_map(*(F.lit(x) for kv in SEMANTIC_WEIGHTS.items() for x in kv))
    semantic = F.transform("semantic_tokens", lambda t: token(t, F.coalesce(known[t], F.lit(1))))
    flagged = F.filter(F.array(*(F.when(v == 1, token(F.lit(f"flag:{k}"), F.lit(FLAG_WEIGHTS.get(k, 1)))) for k, v in value.items())), lambda x: x.isNotNull())
    words = F.filter(F.concat(*plain), lambda x: x.isNotNull())
    return df.withColumn("bag", F.concat(weighted(words, 1), semantic, flagged))


def leaks(df: DataFrame, allowed: tuple[str, ...] = ("response_status_is_2xx", "response_status_is_4xx", "response_status_is_5xx")) -> list[str]:
    """Columns that a request-only view must not have."""
    return [c for c in df.columns if c.startswith(("response_", "combined_")) and c not in allowed or c.endswith(("_got_2xx", "_got_4xx", "_got_5xx"))]
