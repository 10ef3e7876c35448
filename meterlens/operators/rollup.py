"""Daily usage rollups: summaries of any time range from whole days that are summed up already and the logs of its edges.

The rollup has one row for each day, key, user, model and the names in the logs, with sums that can be summed again; costs are
kept in quota units, so billing settings apply when it is read. It is written by day, so a day that is made again replaces
itself. A second table has one row a day, with sketches of its keys, users and models, for counts without their rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterlens.functions import text as tx
from meterlens.functions.billing import COST_COLUMNS, Rates, quota_to_cny, with_billing_meta, with_cost_breakdown

from .filters import DAY, in_time_range, limit_or, usage_rows
from .usage import finished_summary, input_adjustment, model_order, rates_from, summed_keys, summed_totals, token_sums

KEYS = ["token_id", "user_id", "username", "token_name", "model_name"]
#: Sums over billed rows, where NULL amounts are zero.
BILLED = ["cache_read_billed", "cache_write_billed", *COST_COLUMNS]
ADDED = ["requests", "successes", "errors", "prompt", "completion", "both", "quota_sum", "cache_read_tokens", "input_adjustment", *BILLED]
COUNTED = {"token_count": "token_id", "user_count": "user_id", "model_count": "model_name"}
#: Buckets of a sketch as a power of two: its counts are within 2 per cent in all but one of a hundred cases.
SKETCH_BITS = 14


def day_column() -> Column:
    """The day of a log; a row without a time has none and is never rolled up."""
    return F.date_from_unix_date(F.floor(F.col("created_at") / DAY).cast("int"))


def daily_rollup(logs: DataFrame) -> DataFrame:
    """Partial sums of the successes and errors of each day."""
    zero = F.lit(0).cast("long")
    amounts = {f"_{name}": F.coalesce(F.col(name), zero) for name in ("prompt_tokens", "completion_tokens", "quota")}
    cached = F.coalesce(F.col("other").contains('"cache_tokens"'), F.lit(False))
    rows = with_billing_meta(usage_rows(logs).withColumns(amounts))
    rows = rows.withColumns(
        {
            "_read": F.when(cached, F.col("meta.cache_read_tokens")).otherwise(zero),
            "_adjustment": F.when(cached, input_adjustment()).otherwise(zero),
        }
    )
    unit = Rates(F.lit(1.0), F.lit(1.0))
    rows = with_cost_breakdown(rows, F.col("_prompt_tokens"), F.col("_completion_tokens"), F.col("_quota"), unit)
    created = F.col("created_at")
    return rows.groupBy(day_column().alias("event_date"), *KEYS).agg(
        *token_sums(),
        F.min(F.when(created > 0, created)).alias("first_positive"),
        F.sum("cache_read_tokens").alias("cache_read_billed"),
        F.sum("cache_write_tokens").alias("cache_write_billed"),
        *[F.sum(name).alias(name) for name in COST_COLUMNS],
        F.sum("_read").alias("cache_read_tokens"),
        F.sum("_adjustment").alias("input_adjustment"),
    )


def day_totals(rollup: DataFrame) -> DataFrame:
    """One row for each day of a rollup: its sums, and sketches of its keys, users and models."""
    named = F.nullif(F.col("model_name"), F.lit(""))
    sketched = {"token_count": F.col("token_id"), "user_count": F.col("user_id"), "model_count": named}
    return rollup.groupBy("event_date").agg(
        *[F.sum(name).alias(name) for name in ADDED],
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        *[F.hll_sketch_agg(column, SKETCH_BITS).alias(name) for name, column in sketched.items()],
    )


def write_rollup(logs: DataFrame, path: str, first: date, last: date) -> None:
    """Make the rollup of whole days from the logs; days that are there already are replaced, other days stay."""
    low, high = _seconds(first), _seconds(last + timedelta(days=1))
    _by_day(daily_rollup(in_time_range(logs, low, high - 1)).repartition("event_date"), f"{path}/keys")
    written = logs.sparkSession.read.parquet(f"{path}/keys").filter(F.col("event_date").between(first, last))
    _by_day(day_totals(written).coalesce(1), f"{path}/days")


def _seconds(day: date) -> int:
    return (day - date(1970, 1, 1)).days * DAY


def _by_day(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


@dataclass(frozen=True)
class Rollup:
    """A written rollup of all days up to `through`, beside the logs that it was made of."""

    logs: DataFrame
    keys: DataFrame
    days: DataFrame
    through: date

    @classmethod
    def read(cls, spark: SparkSession, logs: DataFrame, path: str, through: date) -> "Rollup":
        return cls(logs, spark.read.parquet(f"{path}/keys"), spark.read.parquet(f"{path}/days"), through)

    def whole_days(self, start: int, end: int) -> tuple[date, date] | None:
        """The days that lie in an inclusive time range as a whole and are rolled up; bounds of zero or less are off."""
        first = date(1970, 1, 1) + timedelta(days=-(-start // DAY) if start > 0 else 0)
        last = self.through if end <= 0 else min(self.through, date(1970, 1, 1) + timedelta(days=(end + 1) // DAY - 1))
        return (first, last) if first <= last else None

    def edge_logs(self, start: int, end: int) -> DataFrame:
        """The logs of a time range that lie in no whole day of it."""
        days = self.whole_days(start, end)
        if days is None:
            return in_time_range(self.logs, start, end)
        low, high = _seconds(days[0]), _seconds(days[1] + timedelta(days=1))
        after = in_time_range(self.logs, high, end) if end <= 0 or high <= end else self.logs.limit(0)
        if start <= 0 and end <= 0:
            # Rows without a time count where no bound is set.
            untimed = F.col("created_at").isNull()
            if "event_date" in self.logs.columns:
                untimed = untimed & F.col("event_date").isNull()
            after = after.unionByName(self.logs.filter(untimed))
        if start <= 0 or start == low:
            return after
        return in_time_range(self.logs, start, low - 1).unionByName(after)

    def partials(self, start: int, end: int) -> DataFrame:
        """Partial sums of a time range: whole days as they are written, the edges from the logs."""
        edges, days = daily_rollup(self.edge_logs(start, end)), self.whole_days(start, end)
        if days is None:
            return edges
        return self.keys.filter(F.col("event_date").between(*days)).unionByName(edges)


def rollup_summary(rollup: Rollup, options: DataFrame | None = None, start: int = 0, end: int = 0, exact: bool = True) -> DataFrame:
    """`usage_summary` of a time range. Without `exact` the distinct counts come from the days' sketches, and of whole days only
    one row each is read."""
    extra = ["cache_read_tokens", "input_adjustment"]
    if exact:
        return finished_summary(summed_totals(rollup.partials(start, end), extra), options)
    rows, days = day_totals(daily_rollup(rollup.edge_logs(start, end))), rollup.whole_days(start, end)
    if days is not None:
        rows = rollup.days.filter(F.col("event_date").between(*days)).unionByName(rows)
    sums = summed_totals(rows.withColumns({c: F.lit(None).cast("long") for c in COUNTED.values()}), extra)
    counts = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("long").alias(c) for c in COUNTED]
    # Two rows of one table each, so that they can be joined by a number.
    one = F.lit(1).alias("_one")
    totals = sums.drop(*COUNTED).select("*", one).join(rows.agg(*counts).select("*", one), "_one").drop("_one")
    return finished_summary(totals, options)


def rollup_key_usage(
    rollup: Rollup,
    tokens: DataFrame,
    options: DataFrame | None = None,
    *,
    start: int = 0,
    end: int = 0,
    query: str = "",
    sort: str = "tokens",
    limit: int = 100,
    show_full_keys: bool = False,
) -> DataFrame:
    """`key_usage` of a time range."""
    rows = rollup.partials(start, end)
    if query.strip():
        names = tokens.select(F.col("id").alias("token_id"), F.col("name").alias("_name"))
        found = tx.matches_any(query, F.col("_name"), F.col("token_name"), F.col("username"), F.col("model_name"))
        rows = rows.join(names, "token_id", "left").filter(found)
    return summed_keys(rows, tokens, options, sort, limit, show_full_keys)


def rollup_model_usage_by_key(rollup: Rollup, options: DataFrame | None = None, *, start: int = 0, end: int = 0) -> DataFrame:
    """`model_usage_by_key` of a time range; cost parts are the same up to the order in which doubles are added."""
    return _models(rollup.partials(start, end), ["token_id", "model_name"], options)


def rollup_model_usage(
    rollup: Rollup, token_id: int, options: DataFrame | None = None, *, start: int = 0, end: int = 0, limit: int = 100
) -> DataFrame:
    """`model_usage` of a time range."""
    rows = _models(rollup.partials(start, end).filter(F.col("token_id") == token_id), ["model_name"], options)
    return rows.orderBy(*model_order()).limit(limit_or(limit, 500, 100))


def _models(partials: DataFrame, keys: list[str], options: DataFrame | None) -> DataFrame:
    rates, zero = rates_from(options), F.lit(0).cast("long")

    def added(name: str) -> Column:
        return F.coalesce(F.sum(name), zero)

    def priced(name: str) -> Column:
        return quota_to_cny(F.coalesce(F.sum(name), F.lit(0)), rates)

    rows = partials.withColumn("model_name", tx.first_nonempty(F.col("model_name"), F.lit("unknown")))
    return rows.groupBy(*keys).agg(
        added("requests").alias("request_count"),
        added("prompt").alias("input_tokens"),
        added("completion").alias("output_tokens"),
        (added("prompt") + added("completion")).alias("total_tokens"),
        added("quota_sum").alias("quota"),
        priced("quota_sum").alias("quota_cny"),
        added("cache_read_billed").alias("cache_read_tokens"),
        added("cache_write_billed").alias("cache_write_tokens"),
        *[priced(name).alias(name) for name in COST_COLUMNS],
        added("successes").alias("success_count"),
        added("errors").alias("error_count"),
        F.coalesce(F.min("first_positive"), zero).alias("first_used_at"),
        F.greatest(F.coalesce(F.max("last_at"), zero), zero).alias("last_used_at"),
    )
