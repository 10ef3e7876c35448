"""Registered usage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlens import bindings as b
from meterlens.functions import loose_json as lj
from meterlens.functions.billing import with_billing_meta
from meterlens.operators import filters, usage as u
from meterlens.operators.usage import LogFilter

from .common import rounded


def _page(**filter_args):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        page = LogFilter(**filter_args)
        return rounded(u.logs_page(b.usage_logs(spark, sf), b.tokens(spark, sf), b.options(spark, sf), page))

    return run


def _over_logs(operator, **args):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(operator(b.usage_logs(spark, sf), options=b.options(spark, sf), **args))

    return run


def _keys(**args):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(u.key_usage(b.usage_logs(spark, sf), b.tokens(spark, sf), b.options(spark, sf), **args))

    return run


def _json_coerce(spark: SparkSession, sf: str) -> DataFrame:
    """Loose readers over one oddly typed field built from every log row."""
    case, quota = F.col("id") % 7, F.col("quota").cast("string")
    text = (
        F.when(case == 0, F.concat(F.lit('{"x":'), quota, F.lit(".5}")))
        .when(case == 1, F.concat(F.lit('{"x":" -'), quota, F.lit('.25 "}')))
        .when(case == 2, F.lit('{"x":true}'))
        .when(case == 3, F.lit('{"x":"1.5d"}'))
        .when(case == 4, F.lit('{"x":null}'))
        .when(case == 5, F.lit('{"x":{"y":1}}'))
        .otherwise(F.lit('{"x":"1e2"} tail'))
    )
    doc = F.col("doc")
    return lj.with_object(b.usage_logs(spark, sf), text, "doc").select(
        "id",
        lj.loose_number(doc, "x").alias("number"),
        lj.loose_long(doc, "x").alias("whole"),
        lj.strict_text(doc, "x").alias("text"),
        lj.strict_bool(doc, "x").alias("flag"),
        lj.is_object(doc).alias("valid"),
    )


QUERIES = {
    "scan_usage_logs": b.usage_logs,
    "scan_tokens": b.tokens,
    "billing_settings": lambda spark, sf: u.billing_settings(b.options(spark, sf)),
    "filter_time_range": lambda spark, sf: filters.usage_rows(
        b.usage_logs(spark, sf), 1704500000, 1706000000
    ).select("id", "created_at", "type"),
    "usage_summary": _over_logs(u.usage_summary),
    "token_summary": _over_logs(u.token_summary, token_id=1),
    "key_usage": _keys(limit=500, show_full_keys=True),
    "key_usage_search": _keys(query=" R#0000_00", sort="calls"),
    "model_usage": _over_logs(u.model_usage, token_id=1),
    "model_usage_by_key": _over_logs(u.model_usage_by_key),
    "model_share": _over_logs(u.model_share),
    "logs_page": _page(start=1704500000, page=2, page_size=500),
    "logs_key_search": _page(key_name="Customer#%1", log_type="success", page_size=500),
    "logs_text_search": _page(query="claude_3", page_size=500),
    "logs_total": lambda spark, sf: u.logs_total(
        b.usage_logs(spark, sf), b.tokens(spark, sf), LogFilter(log_type="error")
    ),
    "self_logs": lambda spark, sf: rounded(
        u.self_logs(
            b.usage_logs(spark, sf),
            b.tokens(spark, sf),
            b.options(spark, sf),
            LogFilter(token_id=1, page_size=100),
        )
    ),
    "logs_after": lambda spark, sf: u.logs_after(b.usage_logs(spark, sf), 1705000000, 5),
    "log_by_id": lambda spark, sf: rounded(
        u.log_by_id(b.usage_logs(spark, sf), b.tokens(spark, sf), b.options(spark, sf), 77)
    ),
    "token_options": lambda spark, sf: u.token_options(b.tokens(spark, sf), limit=2000),
    "token_options_search": lambda spark, sf: u.token_options(b.tokens(spark, sf), query="7B"),
    "quota_cny": _over_logs(u.quota_amounts),
    "billing_meta": lambda spark, sf: with_billing_meta(b.usage_logs(spark, sf)).select("id", "meta.*"),
    "log_billing": _over_logs(u.log_billing),
    "json_coerce": _json_coerce,
}
