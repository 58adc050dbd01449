"""Feature lists of API traffic by mode, blocks of them, and views for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of features and metadata, in the order of the views.
METHOD_FLAGS = [f"request_method_is_{m}" for m in ("get", "post", "put", "delete", "patch", "options", "uncommon")]
TEMPLATE_FLAGS = [f"request_path_has_template_{k}" for k in ("num", "hex", "token")]
HEADER_FLAGS = [f"request_has_{k}" for k in ("cookie", "authorization", "forwarded_for", "content_type", "json_content_type")]
NORMALIZATION = ["parse_status_ok", "path_percent_decoded", "body_percent_decoded", "body_multiline"]
REQUEST_PATTERNS = ["request_contains_sql_keywords", "request_contains_traversal", "request_contains_xss", "request_contains_log4j", "request_header_contains_log4j", "request_contains_rce", "request_contains_log_forging"]
PATTERN_COUNTS = ["request_sql_keyword_count", "request_traversal_token_count", "request_xss_token_count", "request_log4j_token_count", "request_rce_token_count", "request_newline_token_count"]
CHARACTERS = ["request_percent_encoded_count", "request_double_encoded_count", "request_special_char_count", "request_digit_count"]
CONTEXTS = [f"request_context_is_{k}" for k in ("docs", "search", "static", "auth", "api")]
STATUS = [f"response_status_is_{k}xx" for k in (2, 3, 4, 5)]
ANSWER = ["response_has_error_keyword", "response_is_json_like", "response_has_body", "response_content_type_is_json"]
IMPACTS = ["suspicious_request_got_2xx", "suspicious_request_got_4xx", "suspicious_request_got_5xx", *(f"{k}_request_got_2xx" for k in ("sql", "traversal", "xss", "log4j", "rce", "log_forging", "auth_or_cookie"))]
REQUEST_LEXICAL = [
    *METHOD_FLAGS, "request_host_is_ip", "request_url_length", "request_path_length", "request_path_template_length", "request_path_depth", *TEMPLATE_FLAGS, "request_query_length", "request_query_param_count",
    "request_query_key_count", "request_body_length", "request_body_normalized_length", "request_cookie_length", "request_user_agent_length", *HEADER_FLAGS, "request_header_count_filtered", *NORMALIZATION, *REQUEST_PATTERNS,
    *PATTERN_COUNTS, *CHARACTERS, *CONTEXTS, "request_signal_score",
]
RESPONSE_LEXICAL = [
    "response_body_length", *STATUS, *ANSWER, "response_contains_sql_keywords", "response_contains_traversal", "response_contains_xss", "response_contains_log4j", "response_header_contains_log4j",
    "response_body_contains_log4j", "response_contains_rce", "response_contains_log_forging", "response_signal_score",
]
TOKEN_STATS = [f"{side}_{k}" for side in ("request", "response", "combined") for k in ("token_count", "unique_token_count", "avg_token_length")]
COMBINED_ONLY = ["request_response_length_ratio", "request_response_signal_gap", "model_text_length"]
REQUEST_STATIC = [x for x in REQUEST_LEXICAL if x not in PATTERN_COUNTS and x != "request_signal_score"]
RESPONSE_STATIC = [*STATUS, *ANSWER, "response_contains_log4j", "response_header_contains_log4j", "response_body_contains_log4j", *IMPACTS]
METADATA = [
    "event_id", "dataset_id", "data_split", "source_file", "record_index", "event_timestamp", "method", "host", "path", "url", "path_template", "query_string", "query_key_set", "request_text", "request_body", "body_raw",
    "body_normalized", "cookie", "user_agent", "headers_filtered", "request_header_names", "request_header_values", "content_type", "endpoint_key", "semantic_tokens", "parse_status", "label_known", "is_benign_reference",
    "label_binary", "attack_type",
]
RESPONSE_METADATA = ["status", "status_code", "response_text"]
VIEWS = ("request_only", "request_response")


def static_features(view: str = "request_response") -> list[str]:
    """Features of a view without per-request counts of patterns."""
    if view not in VIEWS:
        raise ValueError(f"no view {view}")
    return REQUEST_STATIC + (RESPONSE_STATIC if view == "request_response" else [])


def feature_list(feature_mode: str = "combined", text_mode: str = "hybrid") -> list[str]:
    """Names by mode: request_only, response_only or combined; token statistics with the text modes tokenized and hybrid."""
    parts = {"request_only": [REQUEST_LEXICAL], "response_only": [RESPONSE_LEXICAL], "combined": [REQUEST_LEXICAL, RESPONSE_LEXICAL]}[feature_mode]
    tail = (TOKEN_STATS if text_mode in ("tokenized", "hybrid") else []) + (COMBINED_ONLY if feature_mode == "combined" else [])
    return [x for p in parts for x in p] + tail


def _focus(kinds: list[str], *more: str) -> list[str]:
    return [*kinds, *more]


def blocks(view: str = "request_response") -> dict[str, list[str]]:
    """Named blocks of features, for models on parts of them."""
    encoded = ["request_percent_encoded_count", "request_double_encoded_count"]
    docs, search, static, auth, api = CONTEXTS
    return {
        "static": static_features(view),
        "request_static": REQUEST_STATIC,
        "response_impact_static": RESPONSE_STATIC,
        "endpoint": [*METHOD_FLAGS, "request_host_is_ip", "request_path_length", "request_path_template_length", "request_path_depth", *TEMPLATE_FLAGS, "request_query_length", "request_query_param_count", "request_query_key_count"],
        "headers": ["request_cookie_length", "request_user_agent_length", *HEADER_FLAGS, "request_header_count", "request_header_count_filtered"],
        "body": ["request_body_length", "request_body_normalized_length", "path_percent_decoded", "body_percent_decoded", "body_multiline", "parse_status_ok"],
        "semantic_signals": [*REQUEST_PATTERNS, *PATTERN_COUNTS, *CHARACTERS, *CONTEXTS, "request_signal_score"],
        "sql_injection_focus": _focus(["request_contains_sql_keywords", "request_sql_keyword_count"], *encoded, "request_special_char_count", "request_query_length", "request_query_param_count", docs, search, api),
        "directory_traversal_focus": _focus(["request_contains_traversal", "request_traversal_token_count"], "path_percent_decoded", *encoded, "request_path_depth", static, docs, api),
        "xss_focus": _focus(["request_contains_xss", "request_xss_token_count"], "request_special_char_count", *encoded, docs, search, api),
        "log4j_focus": _focus(["request_contains_log4j", "request_header_contains_log4j", "request_log4j_token_count"], *encoded, "request_user_agent_length", docs, api),
        "rce_focus": _focus(["request_contains_rce", "request_rce_token_count"], "request_special_char_count", *encoded, "request_has_json_content_type", docs, api),
        "log_forging_focus": _focus(["request_contains_log_forging", "request_newline_token_count"], *encoded, "request_user_agent_length", docs, api),
        "cookie_injection_focus": ["request_has_cookie", "request_has_authorization", "request_cookie_length", auth, static, api],
        "response": RESPONSE_LEXICAL,
        "impact": IMPACTS,
        "token_stats": TOKEN_STATS,
        "combined": COMBINED_ONLY,
    }


def static_view(df: DataFrame, view: str = "request_response") -> DataFrame:
    """Metadata and static features of a view, those that the table has; request_only leaves out all that the answer tells."""
    wanted = [*METADATA, *(RESPONSE_METADATA if view == "request_response" else []), *static_features(view)]
    return df.select(*(F.col(f"`{x}`") for x in wanted if x in df.columns))


def model_text(feature_mode: str = "combined") -> Column:
    """The text that a model reads."""
    column = {"request_only": "request_text", "response_only": "response_text"}.get(feature_mode, "combined_text")
    return F.coalesce(F.col(column), F.lit(""))


def combined_features(df: DataFrame, feature_mode: str = "combined") -> DataFrame:
    """What request and answer tell together; needs api.features()."""
    text = lambda x: F.length(F.coalesce(F.col(x), F.lit("")))
    return df.withColumns(
        {
            "request_response_length_ratio": text("response_text") / F.greatest(text("request_text"), F.lit(1)),
            "request_response_signal_gap": F.col("request_signal_score") - F.col("response_signal_score"),
            "model_text_length": F.length(model_text(feature_mode)),
        }
    )
