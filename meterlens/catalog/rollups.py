"""Registered queries over daily rollups."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlens import bindings as b
from meterlens.operators import rollup as r, usage as u
from meterlens.sources.usage import read_usage_logs, write_usage_logs

from .common import new_folder, rounded

# A range that begins and ends inside days.
RANGE = {"start": 1_704_500_000, "end": 1_706_000_000}


def _written(spark: SparkSession, sf: str) -> r.Rollup:
    """The logs in day folders, and a rollup of the first two thirds of their days."""
    logs_path, path = new_folder(spark, "logs"), new_folder(spark, "rollup")
    write_usage_logs(b.usage_logs(spark, sf), logs_path)
    logs = read_usage_logs(spark, logs_path)
    low, high = (date(1970, 1, 1) + timedelta(seconds=s) for s in logs.agg(F.min("created_at"), F.max("created_at")).first())
    through = low + (high - low) * 2 // 3
    r.write_rollup(logs, path, low, through)
    return r.Rollup.read(spark, logs, path, through)


def _over_rollup(operator, **args):
    return lambda spark, sf: rounded(operator(_written(spark, sf), options=b.options(spark, sf), **args))


def _sketched(spark: SparkSession, sf: str) -> DataFrame:
    """The sums from the days' rows, and whether the sketches' counts are within 2 per cent of the exact ones."""
    rollup, options = _written(spark, sf), b.options(spark, sf)
    few = rounded(r.rollup_summary(rollup, options, exact=False))
    exact = u.usage_summary(rollup.logs, options).select("request_count", *[F.col(c).alias(f"_{c}") for c in r.COUNTED])
    near = [(F.abs(F.col(c) - F.col(f"_{c}")) <= 0.02 * F.col(f"_{c}")).alias(c) for c in r.COUNTED]
    return few.join(exact, "request_count").select(*[c for c in few.columns if c not in r.COUNTED], *near)


QUERIES = {
    "rollup_summary": _over_rollup(r.rollup_summary),
    "rollup_summary_range": _over_rollup(r.rollup_summary, **RANGE),
    "rollup_summary_sketch": _sketched,
    "rollup_key_usage": lambda spark, sf: rounded(
        r.rollup_key_usage(_written(spark, sf), b.tokens(spark, sf), b.options(spark, sf), limit=500, show_full_keys=True)
    ),
    "rollup_model_usage_by_key": _over_rollup(r.rollup_model_usage_by_key),
}
