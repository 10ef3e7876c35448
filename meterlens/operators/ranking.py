"""Global ordering without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens.session import cut_lineage


def _sliced(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition by keys and order and number the slices; written, so that the numbers are stable."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))


def running_total(
    df: DataFrame, keys: list[str], order: list[Column], amount: Column, out: str
) -> DataFrame:
    """Add `out`: the sum of `amount` over the rows of the same keys that come strictly before in `order`.

    A window over the keys alone would sort a hot key in one task. Here the rows are range-partitioned by keys and
    order, so a hot key spreads over many slices; each slice is summed on its own and shifted by the total of the
    slices before it. `order` must be unique within the keys.
    """
    sliced = _sliced(df.withColumn("_amount", amount), keys, order)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_amount").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    shifts = totals.select(*keys, "_slice", F.coalesce(F.sum("_total").over(earlier), zero).alias("_shift"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_amount").over(within), zero)
    return (
        sliced.join(shifts, [*keys, "_slice"])
        .withColumn(out, F.col("_shift") + local)
        .drop("_slice", "_amount", "_shift")
    )


def running_last(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Add `out`: the last non-NULL `value` of the same keys up to and including each row, cut into slices as above."""
    sliced = _sliced(df.withColumn("_value", value), keys, order)
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    newest = sliced.groupBy(*keys, "_slice").agg(F.max_by("_value", place).alias("_newest"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*keys, "_slice", F.last("_newest", ignorenulls=True).over(earlier).alias("_carried"))
    within = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = F.last("_value", ignorenulls=True).over(within)
    return (
        sliced.join(carried, [*keys, "_slice"])
        .withColumn(out, F.coalesce(local, F.col("_carried")))
        .drop("_slice", "_value", "_carried")
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows of every group; Spark cuts each group to `n` rows before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def page_of(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page in a total order, as a top-k of the rows up to its end. `logs_after` reads on at any depth."""
    return df.orderBy(*order).offset((max(page, 1) - 1) * page_size).limit(page_size)


def only_for(df: DataFrame, column: str, page: DataFrame, page_column: str) -> DataFrame:
    """The rows of `df` that a page asks for, at most one for each row of the page: small enough to be broadcast.

    A page that meets them is not shuffled, so it keeps its order.
    """
    asked = page.select(F.col(page_column).alias(column)).distinct()
    return F.broadcast(df.join(F.broadcast(asked), column, "left_semi"))
