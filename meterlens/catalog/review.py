"""Registered review queries over the generated conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterlens import bindings as b, schemas
from meterlens.functions.decisions import BLOCK, PASS, REVIEW, reply_text, with_decision
from meterlens.operators import review_plan as rp, review_results as rr, review_score as rs
from meterlens.operators.review_plan import ReviewScope
from meterlens.plans.review_run import run_review, write_plan
from meterlens.session import cut_lineage

from .common import new_folder, rounded

ALL_KEYS, ALL_MODELS = [5, 4, 3, 2, 1, 0, -1], [" gpt-test", "other-model", ""]
END = 2_000_000_000
SCOPE = ReviewScope(ALL_KEYS, ALL_MODELS, 1, END)
# Begins in the middle of the generated conversations, so that older requests serve as anchors.
LATER_SCOPE = ReviewScope(ALL_KEYS, ALL_MODELS, b.REVIEW_START + 400, END, "all")
CONFIG = rs.config_hash("https://review.example/v1", "review-model", "policy", "auto")


def hash_byte(content_hash: Column) -> Column:
    return F.conv(F.substring(content_hash, 1, 2), 16, 10).cast("int")


def scorer(rows: DataFrame) -> DataFrame:
    """A reviewer whose reply depends on the content hash only; two in 256 contents fail."""
    v = hash_byte(F.col("content_hash"))
    decision = F.when(v < 16, BLOCK).when(v < 48, REVIEW).otherwise(PASS)
    score = F.when(v < 16, 90).when(v < 48, 60).otherwise(3)
    reply = F.format_string(
        '```json\n{"decision":"%s","risk_score":%d,"categories":["网络攻击","odd","odd"],"reason":" r%d ","confidence":0.9}\n```',
        decision,
        score,
        v,
    )
    return rows.select(
        "content_hash",
        F.when(v == 255, "sorry").otherwise(reply).alias("reply"),
        (10 + v).cast("long").alias("prompt_tokens"),
        F.lit(5).cast("long").alias("completion_tokens"),
        F.when(v == 254, "timeout").alias("error"),
    )


def stored_results(plan: DataFrame) -> DataFrame:
    """Results of an earlier run under the same settings: the contents whose hash byte is a multiple of three."""
    v = hash_byte(F.col("content_hash"))
    return (
        plan.filter((F.col("content_hash") != "") & (v % 3 == 0) & (v < 254))
        .select("content_hash")
        .distinct()
        .select(
            "content_hash",
            F.lit(CONFIG).alias("config_hash"),
            F.when(v < 16, BLOCK).when(v < 48, REVIEW).otherwise(PASS).alias("decision"),
            F.when(v < 16, 90).when(v < 48, 60).otherwise(3).alias("risk_score"),
            F.when(v < 48, F.array(F.lit("网络攻击"), F.lit("其他风险")))
            .otherwise(F.expr("cast(array() as array<string>)"))
            .alias("categories"),
            F.concat(F.lit("r"), v.cast("string")).alias("reason"),
            F.lit(0.9).alias("confidence"),
            (10 + v).cast("long").alias("prompt_tokens"),
            F.lit(5).cast("long").alias("completion_tokens"),
            F.lit(1_700_000_000).cast("long").alias("created_at"),
        )
    )


def _plan(spark: SparkSession, sf: str, scope: ReviewScope = SCOPE) -> DataFrame:
    return rp.review_plan(b.review_requests(spark, sf), scope)


def _run(spark: SparkSession, sf: str):
    cache = cut_lineage(stored_results(_plan(spark, sf)))
    return cache, run_review(
        b.review_requests(spark, sf), SCOPE, cache, scorer, CONFIG, F.lit(1_700_000_500)
    )


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    final = _run(spark, sf)[1].final
    return final.select(
        "audit_entry_id", "delta_decision", "delta_risk_score", "cache_hit", "called", "status", "error", "prompt_tokens"
    )


def _inherited(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf)[1].final.select(
        "audit_entry_id", "effective_decision", "effective_risk_score", "inherited", "effective_result_hash"
    )


def _results_page(spark: SparkSession, sf: str) -> DataFrame:
    cache, run = _run(spark, sf)
    stored = cache.unionByName(run.results)
    matches = b.review_requests(spark, sf).select(
        (F.col("id") + 7).alias("log_id"), F.col("id").alias("audit_entry_id")
    )
    page = rr.results_page(run.final, stored, matches, b.tokens(spark, sf), CONFIG, page_size=200)
    return rounded(
        page.withColumns(
            {name: F.array_join(name, "、") for name in ("delta_categories", "result_categories")}
        )
    )


def _half_done(spark: SparkSession, sf: str) -> DataFrame:
    """A run in progress: requests with an even creation second are finished."""
    plan = _plan(spark, sf)
    return plan.withColumn("status", F.when(F.col("created_at") % 2 == 0, "done").otherwise("pending"))


def _hashes(spark: SparkSession, sf: str) -> DataFrame:
    turns = b.table(spark, sf, "conversations")
    messages = F.array(F.struct(F.concat(F.lit(" "), F.upper("role")).alias("role"), F.col("text").alias("content")))
    return turns.select("conv_id", "turn", rp.message_hashes(messages)[0].alias("hash"))


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Replies in eight forms, one per document: fenced, wordy, clamped, mistyped, unknown, cut short."""
    shape = F.col("doc_id") % 8
    long_reason = F.concat(F.lit(" "), F.repeat(F.lit("长"), 600))
    replies = [
        F.lit('```json\n{"decision":"复核","risk_score":70,"categories":["提示词注入","unknown"],"reason":"可疑","confidence":0.8}\n```'),
        F.concat(F.lit('Result: {"decision":"阻断","risk_score":'), F.col("n_chars"), F.lit(',"confidence":7} done')),
        F.lit('{"decision":"通过","risk_score":-4,"categories":["欺诈"]}'),
        F.lit('{"decision":"阻断","risk_score":"70"}'),
        F.lit('{"decision":"maybe"}'),
        F.concat(F.lit('{"decision":"复核","reason":"'), long_reason, F.lit('"}')),
        F.lit('{"decision":"阻断","risk_score":70.5}'),
        F.lit("no reply"),
    ]
    reply = F.lit(None).cast("string")
    for number, text in enumerate(replies):
        reply = F.when(shape == number, text).otherwise(reply)
    rows = with_decision(b.table(spark, sf, "documents").withColumn("reply", reply), "reply", "d")
    return rounded(
        rows.select(
            "doc_id",
            "d.decision",
            "d.risk_score",
            F.array_join("d.categories", ",").alias("categories"),
            "d.reason",
            "d.confidence",
        )
    )


def _reply_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as the content of a reply: a string, a list of parts, or neither."""
    text = F.col("text")
    part = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    parts = F.to_json(F.array(part(text), part(F.lit("!")), part(F.lit(None).cast("string"))))
    shape = F.col("doc_id") % 3
    as_string = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    as_string = F.concat(F.lit('"'), F.replace(F.replace(as_string, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))
    content = F.try_parse_json(F.when(shape == 0, as_string).when(shape == 1, parts).otherwise(F.lit("7")))
    rows = b.table(spark, sf, "documents").withColumn("content", content)
    return rows.select("doc_id", F.sha2(reply_text(F.col("content")), 256).alias("digest"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """A history with one run per customer."""
    runs = b.table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1).alias("id"), F.lit("completed").alias("status"), F.col("c_name").alias("models")
    )
    return rr.recent_runs(runs, 100)


def _plan_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two jobs' plans are stored, then that of one is replaced by a smaller one; the other stays."""
    plan, path = rp.review_plan(b.review_requests(spark, sf), SCOPE), new_folder(spark, "plans")
    write_plan(plan, path)
    write_plan(plan.withColumn("job_id", F.lit(2).cast("long")), path)
    write_plan(plan.filter("content_hash <> ''"), path)
    stored = spark.read.schema(f"{schemas.REVIEW_PLAN}, job_id long").parquet(path)
    return stored.select("job_id", "audit_entry_id", "parent_entry_id", "delta_start", "content_hash")


QUERIES = {
    "message_hashes": _hashes,
    "model_options": lambda spark, sf: rp.model_options(b.review_requests(spark, sf), ALL_KEYS, 1, END),
    "review_scope": lambda spark, sf: rp.scope_counts(b.review_requests(spark, sf), SCOPE),
    "review_anchors": lambda spark, sf: rp.anchors(b.review_requests(spark, sf), LATER_SCOPE).select(
        "id", "token_id", "created_at", "anchor_rank"
    ),
    "review_plan": _plan,
    "review_plan_anchored": lambda spark, sf: _plan(spark, sf, LATER_SCOPE).drop("content"),
    "review_plan_sink": _plan_sink,
    "review_plan_totals": lambda spark, sf: rp.plan_totals(_plan(spark, sf)),
    "review_cache_hits": lambda spark, sf: rs.cache_hits(
        _plan(spark, sf), stored_results(_plan(spark, sf)), CONFIG
    ),
    "review_cache_write": lambda spark, sf: rounded(
        _run(spark, sf)[1].results.withColumn("categories", F.array_join("categories", "、"))
    ),
    "review_outcomes": _outcomes,
    "risk_inherit": _inherited,
    "review_counters": lambda spark, sf: rounded(rs.counters(_run(spark, sf)[1].final)),
    "review_results_page": _results_page,
    "review_ready": lambda spark, sf: rs.ready(_half_done(spark, sf)),
    "review_pending": lambda spark, sf: rs.pending_count(_half_done(spark, sf)),
    "review_runs": _runs,
    "parse_decision": _decisions,
    "reply_text": _reply_texts,
}
