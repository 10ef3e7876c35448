"""Registered queries over provider quota snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlens import bindings as b
from meterlens.functions import quota as qf
from meterlens.operators import quota as q

from .common import rounded


def _sub2api_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return q.sub2api_accounts(b.sub2api_documents(spark, sf))


def _opencode(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.opencode_documents(spark, sf)
    return q.opencode_windows(q.opencode_accounts(docs["accounts"]), docs["prices"], docs["usage"])


def _opencode_live(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.opencode_documents(spark, sf)
    return q.opencode_live_windows(docs["refreshed"], docs["prices"])


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    docs = b.pool_documents(spark, sf)
    return q.pool_accounts(q.pool_files(docs["files"], "codex"), docs["probes"])


def _status(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts of all providers with identity, state and whether a refresh is possible."""
    sub2api = _sub2api_accounts(spark, sf).select(
        F.lit(q.SUB2API).alias("channel"),
        F.col("account_id").cast("string").alias("account_id"),
        "account_name",
        "email",
        "status",
        F.concat_ws("|", F.array_join("groups", ","), "proxy_name", F.col("concurrency").cast("string")).alias("detail"),
        "can_refresh_usage",
        F.col("error_message").alias("error"),
    )
    opencode = q.opencode_accounts(b.opencode_documents(spark, sf)["accounts"]).select(
        F.lit(q.OPENCODE).alias("channel"),
        "account_id",
        "account_name",
        F.lit("").alias("email"),
        F.when(F.col("enabled"), "enabled").otherwise("disabled").alias("status"),
        F.col("setup_step").alias("detail"),
        "can_refresh_usage",
        "error",
    )
    pool = _pool(spark, sf).select(
        F.lit(q.CPA).alias("channel"),
        "account_id",
        "account_name",
        "email",
        F.when(F.col("error") == "", "ok").otherwise("error").alias("status"),
        F.col("auth_index").alias("detail"),
        F.lit(False).alias("can_refresh_usage"),
        "error",
    )
    xfyun = q.xfyun_accounts(b.xfyun_documents(spark, sf)).select(
        F.lit(q.XFYUN).alias("channel"),
        F.col("account_id").cast("string").alias("account_id"),
        "account_name",
        F.lit("").alias("email"),
        "status",
        F.lit("").alias("detail"),
        F.lit(False).alias("can_refresh_usage"),
        "error",
    )
    return sub2api.unionByName(opencode).unionByName(pool).unionByName(xfyun)


def _percent(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("s_acctbal") / 4000
    used = qf.used_percent(value)
    return rounded(
        b.table(spark, sf, "supplier").select(
            "s_suppkey", used.alias("used"), qf.remaining_percent(used).alias("remaining")
        )
    )


def _attached(spark: SparkSession, sf: str) -> DataFrame:
    quotas = q.external_quota(b.external_quota_documents(spark, sf))
    attached = q.attach_quota(_sub2api_accounts(spark, sf), quotas, base_url="https://api.EXAMPLE/v1")
    return rounded(
        attached.select(
            "account_id", "quota_username", "quota", "balance_cny", "used_cny", "request_count", "quota_error"
        )
    )


QUERIES = {
    "quota_sub2api": lambda spark, sf: rounded(q.sub2api_estimated_windows(_sub2api_accounts(spark, sf))),
    "quota_sub2api_state": lambda spark, sf: q.sub2api_snapshots(b.sub2api_documents(spark, sf)),
    "quota_sub2api_live": lambda spark, sf: rounded(q.sub2api_live_windows(b.sub2api_usage_documents(spark, sf))),
    "quota_opencode": lambda spark, sf: rounded(_opencode(spark, sf)),
    "quota_opencode_live": lambda spark, sf: rounded(_opencode_live(spark, sf)),
    "quota_cpa": lambda spark, sf: rounded(q.pool_windows(_pool(spark, sf))),
    "quota_xfyun": lambda spark, sf: rounded(q.xfyun_windows(q.xfyun_accounts(b.xfyun_documents(spark, sf)))),
    "balance_currency": lambda spark, sf: q.currency_balances(b.balance_documents(spark, sf)),
    "quota_accounts": _status,
    "quota_totals": lambda spark, sf: q.account_totals(_status(spark, sf)),
    "quota_attach": _attached,
    "quota_percent": _percent,
    "quota_last_good": lambda spark, sf: q.last_good(b.snapshot_history(spark, sf)),
}
