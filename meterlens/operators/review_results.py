"""Review results as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlens.functions.decisions import DECISIONS, FAILED_REASON, FAILED_SCORE, OTHER_RISK, PASS, REVIEW
from meterlens.functions.text import first_nonempty
from meterlens.session import cut_lineage

from .filters import limit_or
from .ranking import only_for, page_of

# Labels of where a result comes from.
INHERITED, NEW, CACHED, CALLED, FAILED = "继承", "新增", "缓存", "模型", "错误"
SEPARATOR = " · "


def filter_results(final: DataFrame, decision: str = "", token_id: int = 0) -> DataFrame:
    """Finished requests, of one key or one effective decision if given; other decision words are ignored."""
    rows = final.filter(F.col("status").isin("done", "error"))
    if token_id > 0:
        rows = rows.filter(F.col("token_id") == token_id)
    if decision in DECISIONS:
        rows = rows.filter(F.col("effective_decision") == decision)
    return rows


def _result_of(cache: DataFrame, config: str, prefix: str, hash_name: str) -> DataFrame:
    fields = ["decision", "risk_score", "categories", "reason", "confidence"]
    return cache.filter(F.col("config_hash") == config).select(
        F.col("content_hash").alias(hash_name), *[F.col(f).alias(f"{prefix}_{f}") for f in fields]
    )


def results_page(
    final: DataFrame,
    cache: DataFrame,
    matches: DataFrame,
    tokens: DataFrame,
    config: str,
    *,
    decision: str = "",
    token_id: int = 0,
    page: int = 1,
    page_size: int = 50,
) -> DataFrame:
    """One page of results, riskiest first, with own and effective result, first log, key name and labels.

    Only the requests of the page are joined; the page is written once, since four joins read it.
    """
    order = [F.desc("effective_risk_score"), F.desc("created_at"), F.desc("audit_entry_id")]
    shown = cut_lineage(page_of(filter_results(final, decision, token_id), order, page, limit_or(page_size, 200, 50)))
    logs = only_for(matches, "audit_entry_id", shown, "audit_entry_id")
    logs = F.broadcast(logs.groupBy("audit_entry_id").agg(F.min("log_id").alias("log_id")))
    keys = tokens.select(F.col("id").alias("token_id"), F.col("name").alias("_name"))
    own = _result_of(cache, config, "own", "result_hash")
    top = _result_of(cache, config, "top", "effective_result_hash")
    joined = (
        shown.join(only_for(own, "result_hash", shown, "result_hash"), "result_hash", "left")
        .join(only_for(top, "effective_result_hash", shown, "effective_result_hash"), "effective_result_hash", "left")
        .join(logs, "audit_entry_id", "left")
        .join(only_for(keys, "token_id", shown, "token_id"), "token_id", "left")
    )
    failed = F.col("status") == "error"
    no_names = F.expr("cast(array() as array<string>)")
    bare = F.coalesce(F.size("top_categories"), F.lit(0)) == 0
    fallback = failed & bare & (F.coalesce("top_reason", F.lit("")) == "")

    def own_field(name: str, failed_value: Column, default: Column) -> Column:
        return F.when(failed, failed_value).otherwise(F.coalesce(f"own_{name}", default))

    def top_field(name: str, failed_value: Column, default: Column) -> Column:
        return F.when(fallback, failed_value).otherwise(F.coalesce(f"top_{name}", default))

    other = F.array(F.lit(OTHER_RISK))
    zero = F.lit(0.0)
    result = joined.withColumns(
        {
            "log_id": F.coalesce("log_id", F.lit(0).cast("long")),
            "key_name": first_nonempty(F.col("_name"), F.concat(F.lit("Token #"), F.col("token_id").cast("string"))),
            "delta_decision": own_field("decision", F.lit(REVIEW), F.lit(PASS)),
            "delta_risk_score": own_field("risk_score", F.lit(FAILED_SCORE), F.lit(0)),
            "delta_categories": own_field("categories", other, no_names),
            "delta_reason": own_field("reason", F.lit(FAILED_REASON), F.lit("")),
            "delta_confidence": own_field("confidence", zero, zero),
            "result_decision": top_field("decision", F.lit(REVIEW), F.col("effective_decision")),
            "result_risk_score": top_field("risk_score", F.lit(FAILED_SCORE), F.col("effective_risk_score")),
            "result_categories": top_field("categories", other, no_names),
            "result_reason": top_field("reason", F.lit(FAILED_REASON), F.lit("")),
            "result_confidence": top_field("confidence", zero, zero),
        }
    )
    origin = F.concat_ws(
        SEPARATOR,
        F.when(F.col("inherited"), INHERITED).otherwise(NEW),
        F.when(F.col("cache_hit"), CACHED).otherwise(CALLED),
        F.when(failed, FAILED),
    )
    columns = [
        "audit_entry_id",
        "log_id",
        "token_id",
        "key_name",
        "created_at",
        "request_model",
        "delta_message_count",
        "delta_decision",
        "delta_risk_score",
        "delta_categories",
        "delta_reason",
        "delta_confidence",
        "result_decision",
        "result_risk_score",
        "result_categories",
        "result_reason",
        "result_confidence",
        "effective_decision",
        "effective_risk_score",
        "inherited",
        "cache_hit",
        "status",
        "error",
    ]
    reason = first_nonempty(F.col("error"), F.col("result_reason"), F.col("delta_reason"), F.lit("-"))
    return result.select(*columns, origin.alias("origin"), reason.alias("shown_reason")).orderBy(*order)


def recent_runs(runs: DataFrame, limit: int = 30) -> DataFrame:
    """The newest review runs of a history table."""
    return runs.orderBy(F.desc("id")).limit(limit_or(limit, 100, 30))
