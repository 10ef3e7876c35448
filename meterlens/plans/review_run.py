"""A whole review run: plan, score what is new, carry risk down the conversations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from meterlens.operators import review_score as rs
from meterlens.operators.review_plan import ReviewScope, review_plan
from meterlens.session import cut_lineage


@dataclass(frozen=True)
class ReviewRun:
    """Tables of one run; `results` are the rows to append to the result cache."""

    plan: DataFrame
    final: DataFrame
    results: DataFrame


def run_review(
    entries: DataFrame,
    scope: ReviewScope,
    cache: DataFrame,
    scorer: rs.Scorer,
    config: str,
    created_at: Column | None = None,
    calls: int = 10,
    since: DataFrame | None = None,
    finished: Callable[[DataFrame], DataFrame] | None = None,
) -> ReviewRun:
    """Review the requests of a scope. The plan is written once, since scoring and the results both read it.

    With `since` (see `parents`) only the later requests of some keys are reviewed; `finished` then gives, for rows
    with `audit_entry_id`, those requests as they were decided before, where the chains of parents go on.
    """
    before = None
    plan = cut_lineage(review_plan(entries, scope, since))
    if finished is not None:
        asked = plan.filter("parent_entry_id > 0").select(F.col("parent_entry_id").alias("audit_entry_id")).distinct()
        before = finished(asked.join(plan.select("audit_entry_id"), "audit_entry_id", "left_anti"))
    return run_plan(plan, cache, scorer, config, created_at, calls, before)


def run_plan(
    plan: DataFrame,
    cache: DataFrame,
    scorer: rs.Scorer,
    config: str,
    created_at: Column | None = None,
    calls: int = 10,
    before: DataFrame | None = None,
) -> ReviewRun:
    """Score what a written plan asks for and carry risk down; `before` has finished requests of earlier runs."""
    scored = cut_lineage(rs.score_new(plan, cache, scorer, config, calls))
    final = rs.inherit_risk(rs.outcomes(plan, cache, scored, config), before)
    stamp = F.unix_timestamp() if created_at is None else created_at
    return ReviewRun(plan, final, rs.new_results(scored, cache, stamp))


def write_plan(plan: DataFrame, path: str) -> None:
    """Replace the stored plan of the run's job and leave other jobs alone."""
    (
        plan.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("job_id")
        .parquet(path)
    )
