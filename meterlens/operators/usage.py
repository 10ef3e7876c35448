"""Usage summaries, per-key and per-model usage, and log pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens.functions import text as tx
from meterlens.functions.billing import (
    COST_COLUMNS,
    DEFAULT_QUOTA_PER_UNIT,
    DEFAULT_USD_TO_CNY,
    Rates,
    display_amount,
    quota_to_cny,
    with_billing_meta,
    with_cost_breakdown,
)
from meterlens.functions.loose_json import NUMERIC_TEXT

from meterlens.session import cut_lineage

from .filters import ERROR, ID_BLOCK, SUCCESS, limit_or, usage_rows
from .ranking import only_for, page_of


def billing_settings(options: DataFrame) -> DataFrame:
    """One row with the two billing settings; an option counts only if it is a number above zero."""

    def setting(key: str, default: float) -> Column:
        value = F.trim(F.max(F.when(F.col("key") == key, F.col("value"))))
        number = F.when(value.rlike(NUMERIC_TEXT), value.try_cast("double"))
        return F.coalesce(F.when(number > 0, number), F.lit(default))

    return options.agg(
        setting("QuotaPerUnit", DEFAULT_QUOTA_PER_UNIT).alias("quota_per_unit"),
        setting("USDExchangeRate", DEFAULT_USD_TO_CNY).alias("usd_to_cny"),
    )


def rates_from(options: DataFrame | None) -> Rates:
    """Billing settings as scalar subqueries, so that they never travel with the fact rows."""
    if options is None:
        return Rates.default()
    settings = billing_settings(options)
    return Rates(settings.select("quota_per_unit").scalar(), settings.select("usd_to_cny").scalar())


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def token_sums() -> list[Column]:
    """Partial sums that can be summed again; a row with one side NULL adds nothing to the total."""
    return [
        F.count("*").alias("requests"),
        _count(F.col("type") == SUCCESS).alias("successes"),
        _count(F.col("type") == ERROR).alias("errors"),
        F.sum("prompt_tokens").alias("prompt"),
        F.sum("completion_tokens").alias("completion"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("both"),
        F.sum("quota").alias("quota_sum"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    ]


def summed_again() -> dict[str, Column]:
    return {
        "request_count": _zero(F.sum("requests")),
        "success_count": _zero(F.sum("successes")),
        "error_count": _zero(F.sum("errors")),
        "input_tokens": _zero(F.sum("prompt")),
        "output_tokens": _zero(F.sum("completion")),
        "total_tokens": _zero(F.sum("both")),
        "quota": _zero(F.sum("quota_sum")),
        "first_used_at": _zero(F.min("first_at")),
        "last_used_at": _zero(F.max("last_at")),
    }


SUMMARY_COLUMNS = [
    "request_count",
    "success_count",
    "error_count",
    "token_count",
    "user_count",
    "model_count",
    "input_tokens",
    "cache_read_tokens",
    "cache_rate",
    "output_tokens",
    "total_tokens",
    "quota",
    "quota_cny",
    "first_used_at",
    "last_used_at",
]


def _summary(rows: DataFrame, extra_sums: list[str]) -> DataFrame:
    """Counts, distinct counts and sums over `rows` as one row.

    The rows are first grouped by the three counted columns, which map-side combine reduces to a small table; the
    exact distinct counts then run on that table instead of on three copies of every fact row.
    """
    grouped = rows.groupBy("token_id", "user_id", "model_name").agg(
        *token_sums(), *[F.sum(name).alias(name) for name in extra_sums]
    )
    return summed_totals(grouped, extra_sums)


def summed_totals(grouped: DataFrame, extra_sums: list[str]) -> DataFrame:
    """One row over partial sums by key, user and model."""
    return grouped.agg(
        F.countDistinct("token_id").alias("token_count"),
        F.countDistinct("user_id").alias("user_count"),
        F.countDistinct(F.nullif(F.col("model_name"), F.lit(""))).alias("model_count"),
        *[column.alias(name) for name, column in summed_again().items()],
        *[_zero(F.sum(name)).alias(name) for name in extra_sums],
    )


def usage_summary(logs: DataFrame, options: DataFrame | None = None, start: int = 0, end: int = 0) -> DataFrame:
    """One row over all keys; input tokens are adjusted by the cache fields of `other`.

    Only rows whose `other` mentions cache_tokens are parsed: the text test is part of the meaning.
    """
    rows = usage_rows(logs, start, end).select(
        "type",
        "token_id",
        "user_id",
        "model_name",
        "prompt_tokens",
        "completion_tokens",
        "quota",
        "created_at",
        F.when(F.col("other").contains('"cache_tokens"'), F.col("other")).alias("other"),
    )
    rows = with_billing_meta(rows).withColumns(
        {"cache_read_tokens": F.col("meta.cache_read_tokens"), "input_adjustment": input_adjustment()}
    )
    return finished_summary(_summary(rows, ["cache_read_tokens", "input_adjustment"]), options)


def input_adjustment() -> Column:
    """What the cache fields in `meta` add to a row's input tokens."""
    meta, prompt = F.col("meta"), _zero(F.col("prompt_tokens"))
    return (
        F.when(meta["input_tokens_total"] > prompt, meta["input_tokens_total"] - prompt)
        .when(meta["anthropic_semantic"], meta["cache_read_tokens"] + meta["cache_write_tokens"])
        .otherwise(F.lit(0).cast("long"))
    )


def finished_summary(totals: DataFrame, options: DataFrame | None) -> DataFrame:
    """The summary's columns from its totals."""
    input_tokens = F.col("input_tokens") + F.col("input_adjustment")
    rate = F.least(F.greatest(F.col("cache_read_tokens") / F.col("input_tokens") * 100, F.lit(0.0)), F.lit(100.0))
    return (
        totals.withColumn("input_tokens", input_tokens)
        .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
        .withColumn("cache_rate", F.when(F.col("input_tokens") > 0, rate).otherwise(F.lit(0.0)))
        .withColumn("quota_cny", quota_to_cny(F.col("quota"), rates_from(options)))
        .select(*SUMMARY_COLUMNS)
    )


def token_summary(
    logs: DataFrame, token_id: int, options: DataFrame | None = None, start: int = 0, end: int = 0
) -> DataFrame:
    """One row for one key, with raw input tokens and no cache metrics."""
    if token_id <= 0:
        raise ValueError("invalid token id")
    totals = _summary(usage_rows(logs.filter(F.col("token_id") == token_id), start, end), [])
    return totals.select(
        *[
            F.lit(0).cast("long").alias(name)
            if name == "cache_read_tokens"
            else F.lit(0.0).alias(name)
            if name == "cache_rate"
            else quota_to_cny(F.col("quota"), rates_from(options)).alias(name)
            if name == "quota_cny"
            else F.col(name)
            for name in SUMMARY_COLUMNS
        ]
    )


def _key_order(sort: str) -> list[Column]:
    by = {
        "tokens": ["total_tokens", "request_count"],
        "requests": ["request_count", "total_tokens"],
        "cost": ["quota", "request_count"],
    }
    aliases = {"request_count": "requests", "calls": "requests", "quota": "cost", "money": "cost"}
    word = sort.strip().lower()
    return [F.col(c).desc() for c in by.get(aliases.get(word, word), by["tokens"])] + [F.col("token_id").asc()]


def key_usage(
    logs: DataFrame,
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
    """Usage by key. Logs are aggregated before the key table is joined, so the join sees one row per key.

    The names are grouping columns of the first step and not its maxima: a maximum of text would make Spark sort the
    fact rows instead of hashing them, and a key has few names.
    """
    rows = usage_rows(logs, start, end)
    names = tokens.select(F.col("id").alias("token_id"), F.col("name").alias("_name"))
    if query.strip():
        rows = rows.join(names, "token_id", "left").filter(
            tx.matches_any(query, F.col("_name"), F.col("token_name"), F.col("username"), F.col("model_name"))
        )
    per_name = rows.groupBy("token_id", "model_name", "token_name", "user_id", "username").agg(*token_sums())
    return summed_keys(per_name, tokens, options, sort, limit, show_full_keys)


def summed_keys(
    per_name: DataFrame, tokens: DataFrame, options: DataFrame | None, sort: str, limit: int, show_full_keys: bool
) -> DataFrame:
    """Usage by key from partial sums by key, model and the names in the logs."""
    per_key = per_name.groupBy("token_id").agg(
        F.max("token_name").alias("token_name"),
        _zero(F.max("user_id")).alias("user_id"),
        F.coalesce(F.max("username"), F.lit("")).alias("username"),
        F.countDistinct(F.nullif(F.col("model_name"), F.lit(""))).alias("model_count"),
        *[column.alias(name) for name, column in summed_again().items()],
    )
    keys = tokens.select(F.col("id").alias("token_id"), "name", "key")
    full_key = F.coalesce(F.col("key"), F.lit("")) if show_full_keys else F.lit("")
    return (
        per_key.join(keys, "token_id", "left")
        .select(
            _zero(F.col("token_id")).alias("token_id"),
            tx.first_nonempty(F.col("name"), F.col("token_name")).alias("key_name"),
            tx.key_tail(F.col("key")).alias("key_tail"),
            full_key.alias("key_value"),
            "user_id",
            "username",
            "request_count",
            "success_count",
            "error_count",
            "model_count",
            "input_tokens",
            "output_tokens",
            "total_tokens",
            "quota",
            quota_to_cny(F.col("quota"), rates_from(options)).alias("quota_cny"),
            "first_used_at",
            "last_used_at",
        )
        .orderBy(*_key_order(sort))
        .limit(limit_or(limit, 500, 100))
    )


def _billed(logs: DataFrame, options: DataFrame | None) -> DataFrame:
    """Log rows with NULL amounts as zero, cache tokens, CNY and the cost parts."""
    rows = logs.withColumns({name: _zero(F.col(name)) for name in ("prompt_tokens", "completion_tokens", "quota")})
    return with_cost_breakdown(
        with_billing_meta(rows),
        F.col("prompt_tokens"),
        F.col("completion_tokens"),
        F.col("quota"),
        rates_from(options),
    )


def _model_totals(billed: DataFrame, keys: list[str]) -> DataFrame:
    created = _zero(F.col("created_at"))
    return billed.groupBy(*keys).agg(
        F.count("*").alias("request_count"),
        F.sum("prompt_tokens").alias("input_tokens"),
        F.sum("completion_tokens").alias("output_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.sum("quota").alias("quota"),
        F.sum("quota_cny").alias("quota_cny"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"),
        F.sum("cache_write_tokens").alias("cache_write_tokens"),
        *[F.sum(name).alias(name) for name in COST_COLUMNS],
        _count(F.col("type") == SUCCESS).alias("success_count"),
        _count(F.col("type") == ERROR).alias("error_count"),
        _zero(F.min(F.when(created > 0, created))).alias("first_used_at"),
        F.greatest(F.max(created), F.lit(0).cast("long")).alias("last_used_at"),
    )


def _model_name() -> Column:
    return tx.first_nonempty(F.col("model_name"), F.lit("unknown"))


def model_order() -> list[Column]:
    return [F.desc("total_tokens"), F.desc("request_count"), F.asc("model_name")]


def model_usage(
    logs: DataFrame, token_id: int, options: DataFrame | None = None, *, start: int = 0, end: int = 0, limit: int = 100
) -> DataFrame:
    """Usage and cost by model for one key, largest first."""
    rows = usage_rows(logs.filter(F.col("token_id") == token_id), start, end)
    billed = _billed(rows, options).withColumn("model_name", _model_name())
    return _model_totals(billed, ["model_name"]).orderBy(*model_order()).limit(limit_or(limit, 500, 100))


def model_usage_by_key(logs: DataFrame, options: DataFrame | None = None, *, start: int = 0, end: int = 0) -> DataFrame:
    """The same totals for every key at once."""
    billed = _billed(usage_rows(logs, start, end), options).withColumn("model_name", _model_name())
    return _model_totals(billed, ["token_id", "model_name"])


def model_share(logs: DataFrame, options: DataFrame | None = None, *, start: int = 0, end: int = 0) -> DataFrame:
    """Bar width of every model of a key: its tokens against the key's largest model, at least 2 percent."""
    totals = model_usage_by_key(logs, options, start=start, end=end)
    largest = F.greatest(F.max("total_tokens").over(Window.partitionBy("token_id")), F.lit(1).cast("long"))
    return totals.select(
        "token_id",
        "model_name",
        "total_tokens",
        F.greatest(F.lit(2.0), F.col("total_tokens") / largest * 100).alias("share"),
    )


@dataclass(frozen=True)
class LogFilter:
    """What a log page shows; zero and blank values are off."""

    start: int = 0
    end: int = 0
    token_id: int = 0
    model: str = ""
    query: str = ""
    key_name: str = ""
    log_type: str = ""
    page: int = 1
    page_size: int = 100


def filter_logs(logs: DataFrame, tokens: DataFrame, f: LogFilter) -> DataFrame:
    """Log rows that satisfy `f`. The key table is only joined when its names are searched."""
    rows = usage_rows(logs, f.start, f.end, f.log_type)
    if f.token_id > 0:
        rows = rows.filter(F.col("token_id") == f.token_id)
    if f.model.strip():
        rows = rows.filter(F.col("model_name") == f.model.strip())
    if f.query.strip():
        rows = rows.filter(
            tx.matches_any(f.query, *[F.col(c) for c in ("username", "token_name", "model_name", "request_id")])
        )
    if f.key_name.strip():
        names = tokens.select(F.col("id").alias("token_id"), F.col("name").alias("_name"))
        rows = (
            rows.join(names, "token_id", "left")
            .filter(tx.matches_any(f.key_name, F.col("_name"), F.col("token_name")))
            .drop("_name")
        )
    return rows


LOG_COLUMNS = [
    "id",
    "created_at",
    "type",
    "request_id",
    "user_id",
    "username",
    "token_id",
    "token_name",
    "key_name",
    "key_tail",
    "model_name",
    "input_tokens",
    "output_tokens",
    "total_tokens",
    "quota",
    "quota_cny",
    "cache_read_tokens",
    "cache_write_tokens",
    "use_time",
    "is_stream",
    "channel_id",
    "channel_name",
    "ip",
    "content",
    "other",
]


def log_view(rows: DataFrame, tokens: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """Log rows with the key's name and tail, defaults for missing values, CNY and cache tokens."""
    keys = tokens.select(F.col("id").alias("token_id"), F.col("name").alias("_name"), F.col("key").alias("_key"))
    joined = rows.join(keys, "token_id", "left").withColumns(
        {
            "total_tokens": _zero(F.col("prompt_tokens") + F.col("completion_tokens")),
            "key_name": tx.first_nonempty(F.col("_name"), F.col("token_name")),
            "key_tail": tx.key_tail(F.col("_key")),
            "is_stream": F.coalesce("is_stream", F.lit(False)),
            "type": F.coalesce(F.col("type").cast("long"), F.lit(0).cast("long")),
            **{c: _zero(F.col(c)) for c in ("created_at", "user_id", "token_id", "use_time", "channel_id")},
            **{
                c: F.coalesce(F.col(c), F.lit(""))
                for c in (
                    "request_id", "username", "token_name", "model_name", "channel_name", "ip", "content", "other",
                )
            },
        }
    )
    return (
        _billed(joined, options)
        .withColumnsRenamed({"prompt_tokens": "input_tokens", "completion_tokens": "output_tokens"})
        .select(*LOG_COLUMNS)
    )


def logs_page(logs: DataFrame, tokens: DataFrame, options: DataFrame | None, f: LogFilter) -> DataFrame:
    """One page of logs, newest id first. Only the rows of the page are joined and billed."""
    size = limit_or(f.page_size, 500, 100)
    rows = cut_lineage(page_of(filter_logs(logs, tokens, f), [F.desc("id")], f.page, size))
    return page_view(rows, tokens, options).orderBy(F.desc("id"))


def page_view(rows: DataFrame, tokens: DataFrame, options: DataFrame | None) -> DataFrame:
    """`log_view` of the rows of one page, with the page's own keys only."""
    keys = tokens.withColumnRenamed("id", "token_id")
    own = only_for(keys, "token_id", rows, "token_id")
    return log_view(rows, own.withColumnRenamed("token_id", "id"), options)


def logs_total(logs: DataFrame, tokens: DataFrame, f: LogFilter) -> DataFrame:
    """Number of rows and pages of the same filter."""
    size = limit_or(f.page_size, 500, 100)
    pages = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / size))
    return filter_logs(logs, tokens, f).agg(F.count("*").alias("total")).withColumn("pages", pages)


SELF_COLUMNS = [
    "id",
    "created_at",
    "type",
    "model_name",
    "input_tokens",
    "output_tokens",
    "total_tokens",
    "cache_read_tokens",
    "cache_write_tokens",
    "quota_cny",
    "use_time",
    "is_stream",
    "channel_name",
]


def self_logs(logs: DataFrame, tokens: DataFrame, options: DataFrame | None, f: LogFilter) -> DataFrame:
    """The self-service page of one key: no ip, content, request or key identity."""
    if f.token_id <= 0:
        raise ValueError("a self-service page needs a key")
    own = LogFilter(
        f.start, f.end, f.token_id, f.model, "", "", f.log_type, f.page, limit_or(f.page_size, 100, 50)
    )
    return logs_page(logs, tokens, options, own).select(*SELF_COLUMNS)


def logs_after(logs: DataFrame, created_at: int, log_id: int, limit: int = 200) -> DataFrame:
    """The next rows in (created_at, id) order: pages that stay cheap however deep they are."""
    later = (F.col("created_at") > created_at) | ((F.col("created_at") == created_at) & (F.col("id") > log_id))
    return (
        usage_rows(logs)
        .filter((F.col("created_at") >= created_at) & later)
        .orderBy("created_at", "id")
        .limit(limit)
    )


def log_by_id(logs: DataFrame, tokens: DataFrame, options: DataFrame | None, log_id: int) -> DataFrame:
    """One log row of any type; of a table in blocks of ids only one block is read."""
    rows = logs.filter(F.col("id") == log_id)
    if "id_block" in logs.columns:
        rows = rows.filter(F.col("id_block") == log_id // ID_BLOCK)
    return log_view(rows, tokens, options).limit(1)


def token_options(tokens: DataFrame, query: str = "", limit: int = 500) -> DataFrame:
    """Keys to choose from, named ones first, found by a substring of name and tail."""
    name = F.coalesce("name", F.lit(""))
    shown = tokens.select(
        F.col("id").alias("token_id"), name.alias("key_name"), tx.key_tail(F.col("key")).alias("key_tail")
    )
    if query.strip():
        shown = shown.filter(F.lower(F.concat_ws(" ", "key_name", "key_tail")).contains(query.strip().lower()))
    unnamed_last = F.when(F.col("key_name") == "", 1).otherwise(0)
    return shown.orderBy(unnamed_last, "key_name", "token_id").limit(limit_or(limit, 2000, 500))


def quota_amounts(logs: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """Every usage row's quota as CNY and as shown text."""
    cny = quota_to_cny(_zero(F.col("quota")), rates_from(options))
    return usage_rows(logs).select("id", cny.alias("quota_cny")).withColumn("shown", display_amount(F.col("quota_cny")))


def log_billing(logs: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """Cost parts of every usage row."""
    return _billed(usage_rows(logs), options).select(
        "id", "quota_cny", "cache_read_tokens", "cache_write_tokens", *COST_COLUMNS
    )
