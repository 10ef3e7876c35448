"""Oracles of the rollup queries: the summaries of the logs themselves."""

from .usage import ORACLE as USAGE_ORACLE

TIMED = "type IN (2, 5) AND created_at BETWEEN 1704500000 AND 1706000000"

ORACLE = {
    "rollup_summary": USAGE_ORACLE["usage_summary"],
    "rollup_summary_range": USAGE_ORACLE["usage_summary"].replace("type IN (2, 5)", TIMED),
    "rollup_summary_sketch": f"""SELECT * EXCLUDE (token_count, user_count, model_count), true AS token_count, true AS user_count,
        true AS model_count FROM ({USAGE_ORACLE['usage_summary']})""",
    "rollup_key_usage": USAGE_ORACLE["key_usage"],
    "rollup_model_usage_by_key": USAGE_ORACLE["model_usage_by_key"],
}
