"""Money and cache-token expressions over usage-log columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import loose_json as lj
from .stage import pinned

# Settings used when the options table has no usable override.
DEFAULT_QUOTA_PER_UNIT = 500000.0
DEFAULT_USD_TO_CNY = 7.3


@dataclass(frozen=True)
class Rates:
    """Quota units per US dollar and CNY per US dollar, as columns."""

    quota_per_unit: Column
    usd_to_cny: Column

    @classmethod
    def default(cls) -> "Rates":
        return cls(F.lit(DEFAULT_QUOTA_PER_UNIT), F.lit(DEFAULT_USD_TO_CNY))


def quota_to_cny(quota: Column, rates: Rates) -> Column:
    usable = (rates.quota_per_unit > 0) & (rates.usd_to_cny > 0)
    return F.when(usable, quota.cast("double") / rates.quota_per_unit * rates.usd_to_cny).otherwise(F.lit(0.0))


def display_amount(amount: Column) -> Column:
    """Two decimals from one cent upwards, six below."""
    return F.concat(
        F.lit("¥"),
        F.when(F.abs(amount) >= 0.01, F.format_string("%.2f", amount)).otherwise(F.format_string("%.6f", amount)),
    )


def cache_write_from_split(total: Column, five_minutes: Column, one_hour: Column) -> Column:
    """Total cache-creation tokens, or the 5m + 1h split when it says more than the total."""
    split = five_minutes + one_hour
    return F.when((split > 0) & (total < split), split).otherwise(total)


# Members of `other` that bear on billing. The first three and `claude` are read as variants, because
# their presence or type counts; of the others only the text does.
REQUIRED_RATIOS = ["model_ratio", "group_ratio", "completion_ratio"]
RATIOS = [
    "cache_ratio",
    "cache_creation_ratio",
    "cache_creation_ratio_5m",
    "cache_creation_ratio_1h",
    "model_price",
]
TOKEN_COUNTS = [
    "cache_tokens",
    "cache_write_tokens",
    "cache_creation_tokens",
    "cache_creation_tokens_5m",
    "cache_creation_tokens_1h",
    "input_tokens_total",
]
FLAGS = ["usage_semantic", "billing_mode"]
OTHER_DOCUMENT = ",".join(
    [f"{name}:variant" for name in [*REQUIRED_RATIOS, "claude"]]
    + [f"{name}:string" for name in [*RATIOS, *TOKEN_COUNTS, *FLAGS]]
)


def with_billing_meta(df: DataFrame, other: str = "other", out: str = "meta") -> DataFrame:
    """Add the struct `out` with the billing fields of the JSON text in `other`; no object means all zero.

    The text is read in one pass with a fixed schema. It is read as the only item of a list, so that text after the
    object makes it invalid. The numbers are read by one expression over a list, which keeps the generated code of
    the row loop small enough to be compiled.
    """
    doc, ratios, counts = "_other_document", "_ratios", "_token_counts"
    listed = F.from_json(F.concat(F.lit("["), F.col(other), F.lit("]")), f"array<struct<{OTHER_DOCUMENT}>>")
    parsed = df.withColumn(doc, listed).withColumn(doc, F.when(F.size(doc) == 1, F.col(doc)[0]))

    def member(name: str) -> Column:
        return F.col(f"{doc}.{name}")

    ratio_texts = [F.try_variant_get(member(name), "$", "string") for name in REQUIRED_RATIOS]
    ratio_texts += [member(name) for name in RATIOS]
    read = parsed.withColumns(
        {
            ratios: pinned(F.transform(F.array(*ratio_texts), lj.number_from_text)),
            counts: pinned(F.transform(F.array(*[member(name) for name in TOKEN_COUNTS]), lj.long_from_text)),
        }
    )
    ratio = dict(zip([*REQUIRED_RATIOS, *RATIOS], [F.col(ratios)[i] for i in range(len(REQUIRED_RATIOS + RATIOS))]))
    count = dict(zip(TOKEN_COUNTS, [F.col(counts)[i] for i in range(len(TOKEN_COUNTS))]))
    says_claude = F.when(
        F.schema_of_variant(member("claude")) == "BOOLEAN", F.try_variant_get(member("claude"), "$", "boolean")
    )
    has_ratios = F.lit(True)
    for name in REQUIRED_RATIOS:
        has_ratios = has_ratios & member(name).isNotNull()
    split_5m, split_1h = count["cache_creation_tokens_5m"], count["cache_creation_tokens_1h"]
    written = F.when(count["cache_write_tokens"] != 0, count["cache_write_tokens"]).otherwise(
        cache_write_from_split(count["cache_creation_tokens"], split_5m, split_1h)
    )
    meta = F.struct(
        *[column.alias(name) for name, column in ratio.items()],
        count["cache_tokens"].alias("cache_read_tokens"),
        written.alias("cache_write_tokens"),
        split_5m.alias("cache_creation_tokens_5m"),
        split_1h.alias("cache_creation_tokens_1h"),
        count["input_tokens_total"].alias("input_tokens_total"),
        (
            F.coalesce(member("usage_semantic") == "anthropic", F.lit(False)) | F.coalesce(says_claude, F.lit(False))
        ).alias("anthropic_semantic"),
        F.coalesce(member("billing_mode") == "tiered_expr", F.lit(False)).alias("tiered"),
        has_ratios.alias("has_ratios"),
    )
    return read.withColumn(out, meta).drop(doc, ratios, counts)


def cache_write_quota(meta: Column) -> Column:
    """Price of cache writes before scaling: the 5m and 1h parts have their own ratios."""
    tokens = meta["cache_write_tokens"]
    split_5m, split_1h = meta["cache_creation_tokens_5m"], meta["cache_creation_tokens_1h"]
    regular = F.greatest(tokens - split_5m - split_1h, F.lit(0).cast("long"))
    return (
        F.when(tokens == 0, F.lit(0.0))
        .when((split_5m == 0) & (split_1h == 0), tokens * meta["cache_creation_ratio"])
        .otherwise(
            regular * meta["cache_creation_ratio"]
            + split_5m * meta["cache_creation_ratio_5m"]
            + split_1h * meta["cache_creation_ratio_1h"]
        )
    )


COST_COLUMNS = ["input_cost_cny", "output_cost_cny", "cache_read_cost_cny", "cache_write_cost_cny", "other_cost_cny"]


def with_cost_breakdown(df: DataFrame, prompt: Column, completion: Column, quota: Column, rates: Rates) -> DataFrame:
    """Add `quota_cny`, the cache token counts and the five cost parts; needs the column `meta`."""
    meta = F.col("meta")
    read, write = meta["cache_read_tokens"], meta["cache_write_tokens"]
    scale = meta["model_ratio"] * meta["group_ratio"]
    uncached = F.greatest(prompt - (read + write), F.lit(0).cast("long"))
    base_input = F.when(meta["anthropic_semantic"], prompt).otherwise(uncached)
    by_ratio = (quota != 0) & meta["has_ratios"] & ~meta["tiered"] & (meta["model_price"] == 0)
    parts = F.struct(
        (base_input * scale).alias("input"),
        (completion * meta["completion_ratio"] * scale).alias("output"),
        (read * meta["cache_ratio"] * scale).alias("read"),
        (cache_write_quota(meta) * scale).alias("write"),
    )
    staged = df.withColumn("_parts", F.when(by_ratio, parts))
    part = F.col("_parts")
    rest = quota - (part["input"] + part["output"] + part["read"] + part["write"])
    zero = F.lit(0.0)

    def cost(name: str) -> Column:
        return F.when(part.isNotNull(), quota_to_cny(part[name], rates)).otherwise(zero)

    other = (
        F.when(quota == 0, zero)
        .when(part.isNull(), quota_to_cny(quota, rates))
        .when(F.abs(rest) < 1, zero)
        .otherwise(quota_to_cny(rest, rates))
    )
    return staged.withColumns(
        {
            "quota_cny": quota_to_cny(quota, rates),
            "cache_read_tokens": read,
            "cache_write_tokens": write,
            "input_cost_cny": cost("input"),
            "output_cost_cny": cost("output"),
            "cache_read_cost_cny": cost("read"),
            "cache_write_cost_cny": cost("write"),
            "other_cost_cny": other,
        }
    ).drop("_parts")
