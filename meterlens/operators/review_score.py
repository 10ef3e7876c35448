"""Scoring unseen content once and carrying risk down the conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from meterlens import schemas
from meterlens.functions.decisions import (
    FAILED_SCORE,
    PASS,
    REVIEW,
    decision_rank,
    with_decision,
)
from meterlens.session import cut_lineage

# A scorer adds `reply`, `prompt_tokens`, `completion_tokens` and `error` to rows of (content_hash, content).
Scorer = Callable[[DataFrame], DataFrame]
REPLY_COLUMNS = ["content_hash", "reply", "prompt_tokens", "completion_tokens", "error"]
REPLY_SCHEMA = "content_hash string, reply string, prompt_tokens long, completion_tokens long, error string"
# Errors of a review.
CHANGED = "request content changed during review"
INVALID = "review model did not return a valid decision"

# Version tags of the settings hash, and the reasoning efforts that are kept as given.
CONFIG_VERSION, LEGACY_VERSION = "schema-v2", "schema-v1"
EFFORTS = ["omit", "no_think", "low", "high"]


def config_hash(base_url: str, model: str, policy: str, effort: str = "auto") -> str:
    """Identity of the reviewer settings; results are reused only under the same settings."""
    effort = effort.strip() if effort.strip() in EFFORTS else "auto"
    return hashlib.sha256("\x00".join([base_url, model, policy, effort, CONFIG_VERSION]).encode()).hexdigest()


def legacy_config_hash(base_url: str, model: str, policy: str) -> str:
    """The settings hash before the reasoning effort was part of it."""
    return hashlib.sha256("\x00".join([base_url, model, policy, LEGACY_VERSION]).encode()).hexdigest()


def with_legacy(cache: DataFrame, config: str, legacy: str) -> DataFrame:
    """The result cache where results under the `legacy` settings hash also count under `config`, if that has none."""
    own = cache.filter(F.col("config_hash") == config).select("content_hash")
    older = cache.filter(F.col("config_hash") == legacy).join(own, "content_hash", "left_anti")
    return cache.unionByName(older.withColumn("config_hash", F.lit(config)))


def pandas_scorer(function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Scorer:
    """A scorer that runs user code over batches of rows, such as calls to a review model."""
    return lambda rows: rows.select("content_hash", "content").mapInPandas(function, REPLY_SCHEMA)


def content_units(plan: DataFrame) -> DataFrame:
    """Every distinct content once, with the first request that asks for it."""
    order = F.struct("token_id", "created_at", "audit_entry_id")
    return (
        plan.filter(F.col("content_hash") != "")
        .groupBy("content_hash")
        .agg(F.first("content").alias("content"), F.min(order).alias("first"))
        .select("content_hash", "content", F.col("first.audit_entry_id").alias("first_entry_id"))
    )


def unscored(plan: DataFrame, cache: DataFrame, config: str) -> DataFrame:
    known = cache.filter(F.col("config_hash") == config).select("content_hash")
    return content_units(plan).join(known, "content_hash", "left_anti")


# Contents that one task sends to the review model.
UNITS_PER_TASK = 200


def score_new(plan: DataFrame, cache: DataFrame, scorer: Scorer, config: str, calls: int = 10) -> DataFrame:
    """Results of the contents the cache does not know; `error` is set where there is no result.

    Tasks are small, so a lost one asks the model again for few contents. `calls` is how many of them are wanted at
    least; how many talk to the model at a time is the cluster's number of cores, or a limit in the scorer. The
    replies are written before they are used, so a second use of the result never asks the model again.
    """
    units = cut_lineage(unscored(plan, cache, config))
    calls = max(calls, -(-units.count() // UNITS_PER_TASK))
    intact = F.sha2("content", 256) == F.col("content_hash")
    asked = units.filter(intact).select("content_hash", "content").repartition(calls, "content_hash")
    replies = cut_lineage(scorer(asked).select(*REPLY_COLUMNS))
    changed = units.filter(~intact).select("content_hash", F.lit(CHANGED).alias("error"))
    decided = with_decision(replies, "reply", "result").unionByName(changed, allowMissingColumns=True)
    failed = F.nullif(F.coalesce("error", F.lit("")), F.lit(""))
    error = F.coalesce(failed, F.when(F.col("result").isNull(), F.lit(INVALID)), F.lit(""))
    zero = F.lit(0).cast("long")
    return decided.select(
        "content_hash",
        F.lit(config).alias("config_hash"),
        "result.*",
        F.coalesce("prompt_tokens", zero).alias("prompt_tokens"),
        F.coalesce("completion_tokens", zero).alias("completion_tokens"),
        error.alias("error"),
    )


def new_results(scored: DataFrame, cache: DataFrame, created_at: Column) -> DataFrame:
    """Rows to append to the result cache: no failures, nothing that is stored already."""
    names = [name.split(":")[0].split()[0] for name in schemas.REVIEW_RESULTS.split(", ")]
    fresh = (
        scored.filter(F.col("error") == "")
        .withColumn("created_at", created_at.cast("long"))
        .dropDuplicates(["content_hash", "config_hash"])
        .join(cache.select("content_hash", "config_hash"), ["content_hash", "config_hash"], "left_anti")
    )
    return fresh.select(*names)


def cache_hits(plan: DataFrame, cache: DataFrame, config: str) -> DataFrame:
    """Which requests need no call: their content is cached, or an earlier request has the same content."""
    known = cache.filter(F.col("config_hash") == config).select("content_hash", F.lit(True).alias("known"))
    units = content_units(plan).drop("content").join(known, "content_hash", "left")
    rows = plan.filter(F.col("content_hash") != "").select("audit_entry_id", "content_hash")
    return rows.join(units, "content_hash").select(
        "audit_entry_id",
        "content_hash",
        F.coalesce("known", F.lit(False)).alias("cached_before"),
        (F.coalesce("known", F.lit(False)) | (F.col("audit_entry_id") != F.col("first_entry_id"))).alias("cache_hit"),
    )


def outcomes(plan: DataFrame, cache: DataFrame, scored: DataFrame, config: str) -> DataFrame:
    """Every planned request with the decision on its own new content.

    Requests without new content pass. A failed review counts as a review decision and is never a cache hit.
    """
    cached = cache.filter(F.col("config_hash") == config).select(
        "content_hash", "decision", "risk_score", F.lit("").alias("error"), F.lit(True).alias("known")
    )
    fresh = scored.select(
        "content_hash",
        "decision",
        "risk_score",
        "error",
        F.lit(False).alias("known"),
        "prompt_tokens",
        "completion_tokens",
    )
    results = cached.unionByName(fresh, allowMissingColumns=True).join(
        content_units(plan).select("content_hash", "first_entry_id"), "content_hash"
    )
    # Requests without new content may be most of the rows and match nothing: they stay out of the join.
    has_content = F.col("content_hash") != ""
    rows = plan.drop("content")
    rows = (
        rows.filter(has_content)
        .join(results, "content_hash", "left")
        .unionByName(rows.filter(~has_content), allowMissingColumns=True)
    )
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    is_first = F.col("audit_entry_id") == F.col("first_entry_id")
    has_result = F.col("decision").isNotNull() & ~failed
    called = F.coalesce(has_result & ~F.col("known") & is_first, F.lit(False))
    zero = F.lit(0).cast("long")

    def spent(name: str) -> Column:
        return F.when(called, F.coalesce(name, zero)).otherwise(zero)

    return rows.select(
        *[name for name in plan.columns if name != "content"],
        F.when(failed, REVIEW).otherwise(F.coalesce("decision", F.lit(PASS))).alias("delta_decision"),
        F.when(failed, FAILED_SCORE).otherwise(F.coalesce("risk_score", F.lit(0))).alias("delta_risk_score"),
        F.when(has_result, F.col("content_hash")).otherwise("").alias("result_hash"),
        F.coalesce(has_result & (F.col("known") | ~is_first), F.lit(False)).alias("cache_hit"),
        called.alias("called"),
        F.when(failed, "error").otherwise("done").alias("status"),
        F.when(failed, F.col("error")).otherwise("").alias("error"),
        spent("prompt_tokens").alias("prompt_tokens"),
        spent("completion_tokens").alias("completion_tokens"),
    )


def inherit_risk(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Add the effective decision of every request: the worst on its chain of parents, the latest among equals.

    `before` holds finished requests of earlier runs, where chains may begin; a request of both counts as it is in
    `rows`. Pointer doubling: each round every request joins the one its pointer names, takes over the worse decision
    and that one's pointer, so a chain of a million links takes twenty rounds. Requests whose chain has ended are
    written once; a round writes only those that still climb.
    """
    best = F.struct(
        decision_rank(F.col("delta_decision")).alias("rank"),
        F.col("delta_risk_score").alias("score"),
        F.col("created_at").alias("created_at"),
        F.col("audit_entry_id").alias("entry"),
        F.col("result_hash").alias("result_hash"),
        F.col("delta_decision").alias("decision"),
    )
    nodes = rows.select(
        F.col("audit_entry_id").alias("node"),
        F.when(F.col("parent_entry_id") > 0, F.col("parent_entry_id")).alias("up"),
        best.alias("worst"),
    )
    if before is not None:
        known = before.join(rows.select("audit_entry_id"), "audit_entry_id", "left_anti")
        # Of an earlier request only its standing counts: it is older than all that follow it, so ties go to these.
        standing = F.struct(
            decision_rank(F.col("effective_decision")).alias("rank"),
            F.col("effective_risk_score").alias("score"),
            F.col("created_at").alias("created_at"),
            F.col("audit_entry_id").alias("entry"),
            F.col("effective_result_hash").alias("result_hash"),
            F.col("effective_decision").alias("decision"),
        )
        ended = known.select(F.col("audit_entry_id").alias("node"), F.lit(None).cast("long").alias("up"), standing.alias("worst"))
        nodes = nodes.unionByName(ended)
    nodes = cut_lineage(nodes)
    done = nodes.filter(F.col("up").isNull())
    climbing = nodes.filter(F.col("up").isNotNull())
    while not climbing.isEmpty():
        above = done.unionByName(climbing).select(
            F.col("node").alias("up"), F.col("up").alias("next_up"), F.col("worst").alias("above")
        )
        moved = cut_lineage(
            climbing.join(above, "up", "left").select(
                "node",
                F.col("next_up").alias("up"),
                F.greatest(F.col("worst"), F.coalesce("above", "worst")).alias("worst"),
            )
        )
        done = done.unionByName(moved.filter(F.col("up").isNull()))
        climbing = moved.filter(F.col("up").isNotNull())
    nodes = done
    own = F.struct(
        decision_rank(F.col("delta_decision")).alias("rank"), F.col("delta_risk_score").alias("score")
    )
    above_own = F.struct(F.col("worst.rank").alias("rank"), F.col("worst.score").alias("score")) > own
    inherited = above_own & (F.col("worst.rank") > 0)
    return (
        rows.join(nodes.select(F.col("node").alias("audit_entry_id"), "worst"), "audit_entry_id")
        .withColumns(
            {
                "effective_decision": F.col("worst.decision"),
                "effective_risk_score": F.col("worst.score"),
                "inherited": inherited,
                "effective_result_hash": F.when(inherited, F.col("worst.result_hash")).otherwise(
                    F.col("result_hash")
                ),
            }
        )
        .select(*rows.columns, "effective_decision", "effective_risk_score", "inherited", "effective_result_hash")
    )


def counters(final: DataFrame) -> DataFrame:
    """Progress of a run: processed, reviewed, reused, flagged and failed requests, and tokens spent."""
    finished = F.col("status").isin("done", "error")
    processed = F.count_if(finished)
    return final.agg(
        F.count("*").alias("total_entries"),
        processed.alias("processed_entries"),
        F.count_if(F.col("called")).alias("reviewed_units"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(finished & (F.col("effective_decision") != PASS)).alias("flagged_entries"),
        F.count_if(F.col("status") == "error").alias("error_entries"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0).cast("long")).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0).cast("long")).alias("completion_tokens"),
        F.when(F.count("*") == 0, F.lit(100.0))
        .otherwise(F.least(F.lit(100.0), processed / F.count("*") * 100))
        .alias("progress"),
    )


def ready(rows: DataFrame) -> DataFrame:
    """Pending requests whose parent is absent from the run or finished, in work order."""
    pending = rows.filter(F.col("status") == "pending")
    unfinished = pending.select(F.col("audit_entry_id").alias("parent_entry_id"))
    return pending.join(unfinished, "parent_entry_id", "left_anti").select(
        "audit_entry_id", "token_id", "created_at", "parent_entry_id"
    )


def pending_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "pending").alias("pending"))
