"""Tables written batch by batch, so that a repeated batch replaces its own rows."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterlens.operators.filters import DAY
from meterlens.session import cut_lineage

# Rows of a batch in folders that one file of a folder is for.
FILE_ROWS = 1_000_000
# Days up to which the folders are named; of more days all folders are listed.
NAMED_DAYS = 1000


def day_of(seconds: Column) -> Column:
    """The UTC day of Unix seconds; rows without a time, whose seconds are 0, are of the first day."""
    return F.date_from_unix_date(F.floor(F.coalesce(seconds, F.lit(0).cast("long")) / DAY).cast("int"))


def days_in(df: DataFrame, seconds: Column, around: int = 0) -> list[date]:
    """The days of the rows of one batch, which has no more days than rows, and `around` days on either side."""
    found = [row[0] for row in df.select(day_of(seconds).alias("d")).distinct().collect()]
    return widened(found, around)


def widened(days: Iterable[date], around: int) -> list[date]:
    return sorted({d + timedelta(days=n) for d in days for n in range(-around, around + 1)})


def on_days(df: DataFrame, days: list[date], seconds: str = "created_at") -> DataFrame:
    """Rows of the given days; a table in day folders reads only these."""
    day = F.col("event_date") if "event_date" in df.columns else day_of(F.col(seconds))
    return df.filter(day.isin(days))


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of one batch into the batch's own folder, replacing an earlier attempt."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_days(df: DataFrame, path: str, batch_id: int, seconds: str = "created_at") -> None:
    """Write the rows of one batch into folders by day, then batch. An attempt that is repeated has the same days."""
    placed = df.withColumns({"event_date": day_of(F.col(seconds)), "batch_id": F.lit(batch_id).cast("long")})
    writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("event_date", "batch_id").parquet(path)


def write_folders(df: DataFrame, path: str, batch_id: int, folder: str) -> None:
    """Write the rows of one batch into folders by the column `folder`, then batch; a repeated attempt names the same ones.

    The rows of a folder meet in one task, which writes one file, since every reader opens all files of a folder. Only a batch
    of more than `FILE_ROWS` rows is dealt into shares, each with a file of its own, so that no folder's rows are too many for
    a task. The number of tasks is fixed: Spark would join small ones, and one task would write all folders in turn.
    """
    rows = cut_lineage(df)
    shares = max(1, -(-rows.count() // FILE_ROWS))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(shares))
    placed = rows.repartition(tasks, F.col(folder), share)
    writer = placed.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(folder, "batch_id").parquet(path)


def read_table(
    spark: SparkSession,
    path: str,
    schema: str,
    except_batch: int | None = None,
    days: list[date] | None = None,
    keep: str = "",
) -> DataFrame:
    """All rows written so far, without those of the batch that is being repeated; empty before the first batch.

    Of a table in day folders only the folders of `days` are listed and read, if given. `keep` names the folder column that
    stays.
    """
    folders = "batch_id long, event_date date" if keep == "event_date" or days is not None else "batch_id long"
    named = f"{path}/event_date={{{','.join(map(str, days))}}}" if days and len(days) <= NAMED_DAYS else path
    try:
        rows = spark.read.schema(f"{schema}, {folders}").option("basePath", path).parquet(named)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = spark.createDataFrame([], f"{schema}, {folders}")
        return empty.drop(*[c for c in ("batch_id", "event_date") if c != keep])
    if days is not None:
        rows = on_days(rows, days)
    if except_batch is not None:
        rows = rows.filter(F.coalesce("batch_id", F.lit(-1).cast("long")) != except_batch)
    return rows.drop(*[c for c in ("batch_id", "event_date") if c != keep])
