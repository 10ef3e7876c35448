"""What each request adds to a conversation that was seen before."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens.functions.stage import pinned
from meterlens.functions.text import trim
from meterlens.session import cut_lineage

from .filters import check_range, clean_ids, clean_models, limit_or
from .ranking import running_total, top_per_group

# The defaults of a scope's history.
BRANCH_HISTORY = 100
ANCHOR_ENTRIES = 50
USER_ROLES, TOOL_ROLES = ["user", "human", "input"], ["tool", "function"]
ROLE_MODES = ["user", "user_tool", "all"]

# Requests of one key per slice of its history; a slice also sees the branches just before it.
HISTORY_SLICE = 20_000


@dataclass(frozen=True)
class ReviewScope:
    """Which requests are reviewed: keys, models, an inclusive time range, and which roles count."""

    token_ids: list[int]
    models: list[str]
    start: int
    end: int
    role_mode: str = "user"
    max_entry_id: int | None = None
    job_id: int = field(default=1)
    # How many non-empty requests of a key can be parents, and how many older ones are looked at.
    branch_history: int = BRANCH_HISTORY
    anchor_entries: int = ANCHOR_ENTRIES

    def checked(self) -> "ReviewScope":
        ids, models = clean_ids(self.token_ids), clean_models(self.models)
        if not ids:
            raise ValueError("at least one key is required")
        if not models:
            raise ValueError("at least one request model is required")
        check_range(self.start, self.end)
        mode = self.role_mode if self.role_mode in ROLE_MODES else "user"
        return replace(self, token_ids=ids, models=models, role_mode=mode)


def eligible(entries: DataFrame, scope: ReviewScope) -> DataFrame:
    """Requests of the scope's keys and models, at any time."""
    rows = entries.filter(F.col("token_id").isin(scope.token_ids) & F.col("model").isin(scope.models))
    return rows if scope.max_entry_id is None else rows.filter(F.col("id") <= scope.max_entry_id)


def in_scope(entries: DataFrame, scope: ReviewScope) -> DataFrame:
    scope = scope.checked()
    return eligible(entries, scope).filter(F.col("created_at").between(scope.start, scope.end))


def scope_counts(entries: DataFrame, scope: ReviewScope) -> DataFrame:
    """Highest entry id and number of requests in scope; the id freezes the scope of a run."""
    return in_scope(entries, scope).agg(
        F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("max_entry_id"), F.count("*").alias("total_entries")
    )


def model_options(entries: DataFrame, token_ids: list[int], start: int, end: int, limit: int = 500) -> DataFrame:
    """Models that the keys used in a time range, most used first."""
    check_range(start, end)
    rows = entries.filter(
        F.col("token_id").isin(clean_ids(token_ids)) & F.col("created_at").between(start, end) & (F.col("model") != "")
    )
    counted = rows.groupBy("model").agg(F.count("*").alias("request_count"))
    return counted.orderBy(F.desc("request_count"), "model").limit(limit_or(limit, 500, 500))


def anchors(entries: DataFrame, scope: ReviewScope) -> DataFrame:
    """The newest requests of every key before the scope begins; they can be parents but are not reviewed."""
    scope = scope.checked()
    earlier = eligible(entries, scope).filter(F.col("created_at") < scope.start)
    newest = [F.desc("created_at"), F.desc("id")]
    return top_per_group(earlier, ["token_id"], newest, scope.anchor_entries, "anchor_rank")


def role_name(role: Column) -> Column:
    return F.lower(trim(role))


def normal_content(content: Column) -> Column:
    return trim(F.replace(content, F.lit("\r\n"), F.lit("\n")))


def role_allowed(role: Column, mode: str) -> Column:
    if mode == "all":
        return F.lit(True)
    return role_name(role).isin(USER_ROLES + TOOL_ROLES if mode == "user_tool" else USER_ROLES)


def message_hashes(messages: Column) -> Column:
    """SHA-256 of every message: its role and its content, normalised."""
    return F.transform(
        messages,
        lambda m: F.sha2(F.concat(role_name(m["role"]), F.lit("\x00"), normal_content(m["content"])), 256),
    )


def prefix_digests(messages: Column) -> Column:
    """A digest of every message prefix; two conversations share a prefix when the digests are equal."""
    return F.aggregate(
        message_hashes(messages),
        F.expr("cast(array() as array<binary>)"),
        lambda seen, one: F.array_append(
            seen,
            F.unhex(F.sha2(F.concat(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(b"")), F.unhex(one)), 256)),
        ),
    )


def reviewed_since(entries: DataFrame, scope: ReviewScope, since: DataFrame | None) -> DataFrame:
    """The requests in scope; with `since`, which has one row per key, only those of its keys from `first` on."""
    rows = in_scope(entries, scope)
    if since is None:
        return rows
    return rows.join(since, "token_id").filter(F.struct("created_at", "id") >= F.col("first")).drop("first")


def _history(entries: DataFrame, scope: ReviewScope, since: DataFrame | None) -> DataFrame:
    """Requests that can be parents of reviewed ones without being reviewed themselves."""
    older = anchors(entries, scope)
    if since is None:
        return older
    before = in_scope(entries, scope).filter(F.size("messages") > 0).join(since, "token_id")
    before = before.filter(F.struct("created_at", "id") < F.col("first")).drop("first")
    newest = [F.desc("created_at"), F.desc("id")]
    last = top_per_group(before, ["token_id"], newest, scope.branch_history, "anchor_rank")
    return older.join(since.select("token_id"), "token_id", "left_semi").unionByName(last)


def parents(entries: DataFrame, scope: ReviewScope, since: DataFrame | None = None) -> DataFrame:
    """(audit_entry_id, parent_entry_id, parent_length) of every request in scope that continues an earlier one.

    The parent is the longest of the key's last 100 non-empty requests that is a prefix of this one, the earliest
    among equals. With `since` (token_id, first) only requests of these keys from (created_at, id) on are asked about;
    the ones before are history. Every request is spread into its prefixes; requests sharing a prefix meet in one group, and a
    window over their sequence numbers finds the earliest full request among the last 100. A group, for instance a
    system prompt that a third of all requests begin with, is cut into slices of the key's history, so no task sees
    more than a slice, and no pairs are formed.
    """
    checked = scope.checked()
    older = _history(entries, checked, since).select(
        "id", "token_id", "created_at", "messages", F.lit(False).alias("reviewed")
    )
    asked = reviewed_since(entries, checked, since).select(
        "id", "token_id", "created_at", "messages", F.lit(True).alias("reviewed")
    )
    # Hashing all text is the costly part: the digests are written once, and the order is found on ids alone.
    requests = cut_lineage(
        older.unionByName(asked)
        .withColumn("prefixes", pinned(prefix_digests(F.col("messages"))))
        .drop("messages")
        .filter(F.size("prefixes") > 0)
    )
    places = running_total(
        requests.select("id", "token_id", "created_at"),
        ["token_id"],
        [F.col("created_at"), F.col("id")],
        F.lit(1).cast("long"),
        "seq",
    ).select("id", "seq")
    ordered = requests.join(places, "id").withColumn("length", F.size("prefixes"))
    # Anchors are never asked about: of their prefixes only the whole request matters.
    whole = F.when(F.col("reviewed"), F.col("prefixes")).otherwise(F.slice("prefixes", -1, 1))
    return longest_prefix(ordered.withColumn("prefixes", whole), checked.branch_history)


def longest_prefix(ordered: DataFrame, branch_history: int) -> DataFrame:
    """The parents of the `reviewed` ones among (id, token_id, seq, reviewed, length, prefixes).

    `prefixes` holds the digests of all prefixes of a reviewed request, and of another one only that of the whole request;
    `seq` is the place among the key's requests.
    """
    spread = ordered.select("id", "token_id", "seq", "reviewed", "length", F.posexplode("prefixes"))
    prefix_length = F.when(F.col("reviewed"), F.col("pos") + 1).otherwise(F.col("length"))
    slice_of = F.floor(F.col("seq") / HISTORY_SLICE)
    last_slice = F.floor((F.col("seq") + branch_history) / HISTORY_SLICE)
    placed = spread.select(
        "id",
        "token_id",
        "seq",
        "reviewed",
        prefix_length.alias("length"),
        F.col("col").alias("digest"),
        (prefix_length == F.col("length")).alias("whole"),
        slice_of.alias("own_slice"),
        F.explode(
            F.when(prefix_length == F.col("length"), F.array_distinct(F.array(slice_of, last_slice))).otherwise(
                F.array(slice_of)
            )
        ).alias("slice"),
    )
    history = Window.partitionBy("token_id", "length", "digest", "slice").orderBy("seq").rangeBetween(-branch_history, -1)
    branch = F.when(F.col("whole"), F.struct("seq", "id"))
    matched = placed.withColumn("branch", F.min(branch).over(history)).filter(
        F.col("reviewed") & (F.col("slice") == F.col("own_slice")) & F.col("branch").isNotNull()
    )
    return (
        matched.groupBy(F.col("id").alias("audit_entry_id"))
        .agg(F.max(F.struct("length", F.col("branch.id").alias("parent"))).alias("best"))
        .select(
            "audit_entry_id",
            F.col("best.parent").alias("parent_entry_id"),
            F.col("best.length").alias("parent_length"),
        )
    )


def review_plan(entries: DataFrame, scope: ReviewScope, since: DataFrame | None = None) -> DataFrame:
    """One row per request in scope (see `parents` for `since`): its parent, and the content no earlier request had.

    Without a parent only the last reviewable message counts, not the history before it.
    """
    scope = scope.checked()
    return planned(reviewed_since(entries, scope, since), parents(entries, scope, since), scope)


def planned(requests: DataFrame, found: DataFrame, scope: ReviewScope) -> DataFrame:
    """The plan of `requests` whose parents were `found`."""
    requests = requests.select(
        F.col("id").alias("audit_entry_id"), "token_id", "created_at", F.col("model").alias("request_model"), "messages"
    )
    messages = F.col("messages")

    def reviewable(m: Column) -> Column:
        return role_allowed(m["role"], scope.role_mode) & (normal_content(m["content"]) != "")

    last = F.array_max(F.transform(messages, lambda m, i: F.when(reviewable(m), i)))
    start = F.coalesce("parent_length", last, F.size(messages))
    delta = F.filter(F.slice(messages, F.col("delta_start") + 1, F.size(messages)), reviewable)
    text = F.transform(
        "_delta",
        lambda m: F.concat(F.lit("[角色:"), role_name(m["role"]), F.lit("]\n"), normal_content(m["content"])),
    )
    return (
        requests.join(found, "audit_entry_id", "left")
        .withColumn("delta_start", start)
        .withColumn("_delta", delta)
        .withColumn("content", pinned(F.array_join(text, "\n\n---\n\n")))
        .select(
            F.lit(scope.job_id).cast("long").alias("job_id"),
            "audit_entry_id",
            "token_id",
            "created_at",
            "request_model",
            F.coalesce("parent_entry_id", F.lit(0).cast("long")).alias("parent_entry_id"),
            "delta_start",
            F.size("_delta").alias("delta_message_count"),
            "content",
            pinned(F.when(F.col("content") == "", F.lit("")).otherwise(F.sha2("content", 256))).alias("content_hash"),
            F.length("content").alias("content_chars"),
        )
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    """Requests, review units and characters to review."""
    unit = F.col("content_hash") != ""
    return plan.agg(
        F.count("*").alias("total_entries"),
        F.count_if(unit).alias("review_units"),
        F.coalesce(F.sum(F.when(unit, F.col("content_chars"))), F.lit(0)).cast("long").alias("estimated_chars"),
    )
