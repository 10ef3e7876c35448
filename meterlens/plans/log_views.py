"""Log pages joined with what the audit entries say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterlens.functions.messages import with_messages
from meterlens.operators import matching, usage
from meterlens.operators.filters import limit_or
from meterlens.operators.ranking import page_of
from meterlens.operators.usage import LogFilter
from meterlens.session import cut_lineage


def logs_with_client(
    logs: DataFrame,
    tokens: DataFrame,
    options: DataFrame | None,
    entries: DataFrame,
    matches: DataFrame,
    f: LogFilter,
    window: int = matching.DEFAULT_WINDOW,
) -> DataFrame:
    """One page of logs with the client that sent each request. Only the logs of the page are matched."""
    size = limit_or(f.page_size, 500, 100)
    # The page is used many times below; written once, the log table is scanned once.
    rows = cut_lineage(page_of(usage.filter_logs(logs, tokens, f), [F.desc("id")], f.page, size))
    clients = matching.best_client(rows, tokens, entries, matches, window).withColumnRenamed("log_id", "id")
    # One row for each log of the page: broadcast, so that the page is not shuffled and stays in order.
    clients = F.broadcast(clients)
    shown = {name: F.coalesce(name, F.lit("")) for name in matching.CLIENT_FIELDS}
    return (
        usage.page_view(rows, tokens, options).join(clients, "id", "left").withColumns(shown).orderBy(F.desc("id"))
    )


def log_audit(
    logs: DataFrame,
    tokens: DataFrame,
    entries: DataFrame,
    matches: DataFrame,
    log_id: int,
    window: int = matching.DEFAULT_WINDOW,
    limit: int = matching.DEFAULT_HITS,
) -> DataFrame:
    """The audit entries of one log with their match labels, best first."""
    one = cut_lineage(logs.filter(F.col("id") == log_id))
    found = matching.match_tiered(one, tokens, entries, matches, window, limit, page=True).select(
        "log_id", "rank", "matched_by", "matched_note", F.col("entry_id").alias("id")
    )
    return found.join(entries, "id").orderBy("rank")


def audit_messages(found: DataFrame) -> DataFrame:
    """Role and content of each message in the bodies of `log_audit`'s entries; an entry without messages gives no row."""
    rows = with_messages(found).select("log_id", "rank", "id", F.posexplode("messages").alias("position", "message"))
    return rows.select("log_id", "rank", "id", "position", "message.role", "message.content")
