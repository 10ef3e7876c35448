"""Keeping expensive columns from being computed twice."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pinned(column: Column) -> Column:
    """The same value, computed where it stands.

    Spark copies a column's expression into every filter it pushes below the column. For a parsed line that means
    parsing again for each filter, and chains of such columns grow without bound. A partition number is never
    negative, but it is no constant either, so filters stay above.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def pinned_all(columns: dict[str, Column]) -> dict[str, Column]:
    return {name: pinned(column) for name, column in columns.items()}
