"""Schemas of the curated tables."""

USAGE_LOGS = (
    "id long, created_at long, type int, request_id string, user_id long, username string, token_id long, "
    "token_name string, model_name string, prompt_tokens long, completion_tokens long, quota long, use_time long, "
    "is_stream boolean, channel_id long, channel_name string, ip string, content string, other string"
)
TOKENS = "id long, user_id long, name string, key string"
OPTIONS = "key string, value string"
MESSAGES = "array<struct<role:string,content:string>>"
AUDIT_ENTRIES = (
    "id long, source_id string, source_path string, source_line long, byte_offset long, created_at long, "
    "has_timestamp boolean, ingested_at long, method string, path string, model string, token_id long, "
    "key_tail string, key_hash string, user_agent string, client_name string, client_version string, "
    "client_variant string, request_id string, body string, messages " + MESSAGES
)
MATCHES = "log_id long, audit_entry_id long, matched_by string, matched_note string, matched_at long"
REVIEW_PLAN = (
    "audit_entry_id long, token_id long, created_at long, request_model string, parent_entry_id long, "
    "delta_start int, delta_message_count int, content string, content_hash string, content_chars int"
)
REVIEW_RESULTS = (
    "content_hash string, config_hash string, decision string, risk_score int, categories array<string>, "
    "reason string, confidence double, prompt_tokens long, completion_tokens long, created_at long"
)
RAW_LINES = (
    "path string, source_id string, split long, split_line long, line_no long, byte_offset long, "
    "byte_length long, value string"
)
QUOTA_WINDOWS = (
    "channel string, account_id string, account_name string, window_name string, source string, "
    "limit_value double, used_value double, remaining_value double, used_percent double, "
    "remaining_percent double, resets_at string, window_seconds long, requests long, tokens long, cost double, "
    "error string"
)
