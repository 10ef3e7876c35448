"""Usage, audit and review analytics for LLM API gateways, written on Spark DataFrames."""

from .session import configure, cut_lineage

__all__ = ["configure", "cut_lineage"]
