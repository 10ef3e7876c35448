"""Helpers of the registered queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from meterlens.session import ensure_checkpoint_dir


# Moves amounts that end exactly on half a unit off the tie, which engines round differently.
NUDGE = 1.23456789e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, since sums of doubles depend on their order."""
    return df.select(
        *[
            F.round(F.col(f.name) + NUDGE, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the session's checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file:")
