"""Matching usage logs to audit entries.

A key may own a third of all rows, so no operator here joins a key's logs to a key's entries. Logs are first reduced
to the distinct questions they ask, entries to the few that can be an answer; each question gets a short list of
hits, and the lists go back to the logs by an equi join whose right side is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlens.functions import text as tx
from meterlens.session import cut_lineage

from .ranking import top_per_group

DEFAULT_WINDOW = 120
ONE_DAY = 86400
# Width in windows of the time chunks in which neighbours are searched: what a task sorts at once for the hottest key.
CHUNK_WINDOWS = 6
# Logs and entries for each task that searches neighbours.
ROWS_PER_TASK = 50_000
MAX_HITS, DEFAULT_HITS = 50, 10
# Logs of one page; only pages are small enough to be broadcast.
MAX_PAGE = 500

# What a hit carries: enough to rank it, to show the client, and to fetch the entry by id.
HIT_FIELDS = ["entry_id", "entry_created_at", "client_name", "client_version", "client_variant", "user_agent"]
# Notes of a match.
LATEST_NOTE = (
    "audit log has no usable timestamp match; newest same-token candidates are shown with model match ranked first"
)


def hit_limit(limit: int) -> int:
    """Hits per log: the default for zero or less; more than `MAX_HITS` is refused."""
    if limit > MAX_HITS:
        raise ValueError(f"at most {MAX_HITS} hits per log")
    return limit if limit > 0 else DEFAULT_HITS


def request_start(created_at: Column, use_time: Column) -> Column:
    """Estimated start of a request: its log is written when it ends."""
    known = (use_time > 0) & (use_time < ONE_DAY)
    return F.when(created_at > 0, F.when(known, created_at - use_time).otherwise(created_at)).otherwise(
        F.lit(0).cast("long")
    )


def lookups(logs: DataFrame, tokens: DataFrame) -> DataFrame:
    """What each log asks for: key, key tail, model, times and request id, with missing values filled."""
    keys = tokens.select(F.col("id").alias("token_id"), F.col("key").alias("_key"))
    zero = F.lit(0).cast("long")
    created, used = F.coalesce("created_at", zero), F.coalesce("use_time", zero)
    centre = request_start(created, used)
    return logs.join(keys, "token_id", "left").select(
        F.col("id").alias("log_id"),
        F.coalesce("token_id", zero).alias("token_id"),
        tx.trim(tx.key_tail(F.col("_key"))).alias("key_tail"),
        tx.trim(F.coalesce("model_name", F.lit(""))).alias("model"),
        created.alias("created_at"),
        centre.alias("centre"),
        (centre != created).alias("shifted"),
        F.coalesce("request_id", F.lit("")).alias("request_id"),
    )


def _as_hits(entries: DataFrame) -> DataFrame:
    """Entries reduced to the hit fields, with the identity under which logs can find them."""
    by_token = F.concat(F.lit("t"), F.col("token_id").cast("string"))
    by_tail = F.when(F.col("key_tail") != "", F.concat(F.lit("k"), F.col("key_tail")))
    return entries.select(
        F.when(F.col("token_id") > 0, by_token).when(F.col("token_id") == 0, by_tail).alias("identity"),
        F.col("model").alias("entry_model"),
        F.col("id").alias("entry_id"),
        F.col("created_at").alias("entry_created_at"),
        *HIT_FIELDS[2:],
        "has_timestamp",
        "request_id",
    )


def _identities(token_id: Column, key_tail: Column) -> Column:
    """The identities a log accepts: its key, and unresolved entries with the same key tail."""
    return F.array_compact(
        F.array(
            F.concat(F.lit("t"), token_id.cast("string")),
            F.when(key_tail != "", F.concat(F.lit("k"), key_tail)),
        )
    )


def _hit_struct(*extra: Column) -> Column:
    return F.struct(*extra, *[F.col(name) for name in HIT_FIELDS])


def _hit_lists(ranked: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """The hits of every question as one short array in rank order."""
    hit = _hit_struct(F.col(rank).alias("rank"))
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def search_tasks(rows: int, least: int) -> int:
    """Tasks of a search over so many rows: more rows take more tasks, not larger ones."""
    return max(least, -(-rows // ROWS_PER_TASK))


PROBE = ["token_id", "key_tail", "model", "centre", "shifted"]
# Streams in which neighbours are searched: all entries of an identity, and those of one model.
ANY_MODEL = "*"


def _streams(model: Column) -> Column:
    return F.array_distinct(F.array(F.lit(ANY_MODEL), F.concat(F.lit("="), model)))


def _model_mismatch() -> Column:
    return F.when((F.col("model") == "") | (F.col("entry_model") == F.col("model")), 0).otherwise(1)


def _seen_once() -> Column:
    """False for the second sight of an entry: one of the asked model also comes in the stream of all models."""
    return (F.col("stream") != ANY_MODEL) | (_model_mismatch() == 1) | (F.col("model") == "")


def _neighbours(probes: DataFrame, hits: DataFrame, window: int, n: int, tasks: int) -> DataFrame:
    """For every probe the `n` hits at or before its centre and the `n` after it, per identity and stream.

    Both sides are cut into time chunks; a hit near a chunk border is also put into the neighbouring chunk. Within a
    stream and second only `n` hits can matter, so a chunk holds a bounded number of rows however hot the key is. The
    chunks are dealt to `tasks` tasks, since each sorts all that it gets.
    """
    width = window * CHUNK_WINDOWS
    group = ["identity", "stream", "chunk"]
    at = F.col("entry_created_at")
    streamed = hits.filter(F.col("has_timestamp") & F.col("identity").isNotNull()).withColumn(
        "stream", F.explode(_streams(F.col("entry_model")))
    )
    second = ["identity", "stream", "entry_created_at"]
    kept = top_per_group(
        streamed.repartition(tasks, *second), second, [F.desc("entry_id")], n, "_second_rank"
    ).drop("_second_rank")
    chunked = kept.withColumn(
        "chunk",
        F.explode(
            F.array_distinct(F.array(*[F.floor((at + shift) / width) for shift in (-window, 0, window)]))
        ),
    ).withColumn("t", at)
    hit_columns = [*HIT_FIELDS, "entry_model"]
    asked = (
        probes.withColumn("identity", F.explode(_identities(F.col("token_id"), F.col("key_tail"))))
        .withColumn(
            "stream",
            F.explode(
                F.when(F.col("model") == "", F.array(F.lit(ANY_MODEL))).otherwise(_streams(F.col("model")))
            ),
        )
        .withColumn("chunk", F.floor(F.col("centre") / width))
        .withColumn("t", F.col("centre"))
    )
    hit = F.struct(*[F.col(c) for c in hit_columns])
    both = chunked.select(
        *group, "t", F.lit(0).alias("is_probe"), F.col("entry_id").alias("tie"), hit.alias("hit")
    ).unionByName(
        asked.select(*group, "t", F.lit(1).alias("is_probe"), F.struct(*PROBE).alias("probe")),
        allowMissingColumns=True,
    ).repartition(tasks, *group)
    rows_so_far = (Window.unboundedPreceding, Window.currentRow)
    rising = Window.partitionBy(*group).orderBy("t", "is_probe", "tie").rowsBetween(*rows_so_far)
    falling_ties = Window.partitionBy(*group).orderBy("t", "is_probe", F.desc("tie")).rowsBetween(*rows_so_far)
    seen = F.count("hit")
    placed = both.withColumn("rising", seen.over(rising)).withColumn("falling", seen.over(falling_ties))
    # A probe has seen k hits: the last n of them are counted k - n + 1 to k with rising ties, the next n are counted
    # k + 1 to k + n with falling ones.
    last = Window.partitionBy(*group).orderBy("rising").rangeBetween(-(n - 1), 0)
    following = Window.partitionBy(*group).orderBy("falling").rangeBetween(1, n)
    found = (
        placed.withColumn("earlier", F.collect_list("hit").over(last))
        .withColumn("later", F.collect_list("hit").over(following))
        .filter(F.col("is_probe") == 1)
    )
    return found.select("probe.*", "stream", F.explode(F.concat("earlier", "later")).alias("hit")).select(
        *PROBE, "stream", "hit.*"
    )


def nearest_lists(asked: DataFrame, entries: DataFrame, window: int, n: int) -> DataFrame:
    """The `n` best entries within `window` seconds of every distinct probe, as a list per probe.

    Ranked by model mismatch, distance to the estimated start, distance to the end, then newest id. Only the sign of
    the shift between start and end can decide the third step, so logs that share it share a probe.
    """
    usable = asked.filter((F.col("token_id") > 0) & (F.col("created_at") > 0) & (F.col("centre") > 0))
    probes = usable.select(*PROBE).distinct()
    least = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = search_tasks(usable.count() + entries.filter("has_timestamp").count(), least)
    near = _neighbours(probes, _as_hits(entries), window, n, tasks).filter(
        (F.abs(F.col("entry_created_at") - F.col("centre")) <= window) & _seen_once()
    )
    mismatch = _model_mismatch()
    later_first = F.when(F.col("shifted") & (F.col("entry_created_at") > F.col("centre")), 0).otherwise(1)
    order = [mismatch, F.abs(F.col("entry_created_at") - F.col("centre")), later_first, F.desc("entry_id")]
    return _hit_lists(top_per_group(near.repartition(tasks, *PROBE), PROBE, order, n), PROBE)


def request_id_lists(entries: DataFrame, n: int) -> DataFrame:
    """The newest `n` entries of every request id, as a list per id."""
    named = _as_hits(entries).filter(tx.trim(F.col("request_id")) != "")
    return _hit_lists(top_per_group(named, ["request_id"], [F.desc("entry_id")], n), ["request_id"])


SCOPE = ["token_id", "key_tail", "model"]


def latest_lists(asked: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """The newest `n` entries of every (key, key tail, model) that is asked for, matching models first."""
    hits = _as_hits(entries).filter(F.col("identity").isNotNull())
    streamed = hits.withColumn("stream", F.explode(_streams(F.col("entry_model"))))
    newest = top_per_group(streamed, ["identity", "stream"], [F.desc("entry_id")], n, "_newest").drop("_newest")
    scopes = asked.filter(F.col("token_id") > 0).select(*SCOPE).distinct()
    wished = scopes.withColumn("identity", F.explode(_identities(F.col("token_id"), F.col("key_tail")))).withColumn(
        "stream",
        F.explode(F.when(F.col("model") == "", F.array(F.lit(ANY_MODEL))).otherwise(_streams(F.col("model")))),
    )
    found = wished.join(newest, ["identity", "stream"]).filter(_seen_once())
    return _hit_lists(top_per_group(found, SCOPE, [_model_mismatch(), F.desc("entry_id")], n), SCOPE)


def _only_relevant(
    asked: DataFrame, entries: DataFrame, matches: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries by identity, entries by request id, and matches that a page of logs can need.

    For a page, which holds at most 500 logs: that is checked, so what is broadcast has a fixed bound. The entry table
    is cut down while it is scanned instead of being ranked as a whole.
    """
    if asked.limit(MAX_PAGE + 1).count() > MAX_PAGE:
        raise ValueError(f"a page holds at most {MAX_PAGE} logs")

    def some(rows: DataFrame, column: str, of: DataFrame, name: str) -> DataFrame:
        wanted = F.broadcast(of.select(F.col(name).alias(column)).distinct())
        return rows.join(wanted, column, "left_semi")

    own = some(entries.filter(F.col("token_id") > 0), "token_id", asked, "token_id")
    unresolved = some(entries.filter(F.col("token_id") == 0), "key_tail", asked, "key_tail")
    named = some(entries, "request_id", asked.filter(F.col("request_id") != ""), "request_id")
    return own.unionByName(unresolved), named, some(matches, "log_id", asked, "log_id")


def _around(asked: DataFrame, entries: DataFrame, window: int) -> DataFrame:
    """Entries in the time that the asked logs span, for partition pruning."""
    timed = asked.filter(F.col("centre") > 0)
    low = timed.select((F.min("centre") - window).alias("low")).scalar()
    high = timed.select((F.max("centre") + window).alias("high")).scalar()
    return entries.filter((F.col("created_at") >= low) & (F.col("created_at") <= high))


def time_note(centre: Column, window: int) -> Column:
    return F.concat(
        F.lit(f"same token within +/- {window}s around estimated request start "),
        centre.cast("string"),
        F.lit("; model match is ranked first"),
    )


def _exploded(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.explode("hits").alias("hit")).select(
        *keep, F.col("hit.rank").alias("rank"), *[F.col(f"hit.{name}").alias(name) for name in HIT_FIELDS]
    )


def match_token_time(
    logs: DataFrame, tokens: DataFrame, entries: DataFrame, window: int = DEFAULT_WINDOW, limit: int = 1
) -> DataFrame:
    """The best `limit` entries of every log by key and estimated start time."""
    window = window if window > 0 else DEFAULT_WINDOW
    asked = lookups(logs, tokens)
    lists = nearest_lists(asked, entries, window, hit_limit(limit))
    found = asked.filter(F.col("token_id") > 0).join(lists, PROBE).withColumns(
        {"matched_by": F.lit("token_time"), "matched_note": time_note(F.col("centre"), window)}
    )
    return _exploded(found, ["log_id", "matched_by", "matched_note"])


def match_request_id(logs: DataFrame, tokens: DataFrame, entries: DataFrame, limit: int = DEFAULT_HITS) -> DataFrame:
    """The newest entries with the log's request id."""
    asked = lookups(logs, tokens).filter(tx.trim(F.col("request_id")) != "").select("log_id", "request_id")
    return _exploded(asked.join(request_id_lists(entries, hit_limit(limit)), "request_id"), ["log_id"])


def match_latest(logs: DataFrame, tokens: DataFrame, entries: DataFrame, limit: int = DEFAULT_HITS) -> DataFrame:
    """The newest entries of the log's key, whatever their time."""
    asked = lookups(logs, tokens).filter(F.col("token_id") > 0)
    return _exploded(asked.join(latest_lists(asked, entries, hit_limit(limit)), SCOPE), ["log_id"])


def stored_lists(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Remembered matches with their entry, as a list of one per log; the note says that it was remembered."""
    note = F.coalesce("matched_note", F.lit(""))
    noted = F.when(note == "", F.lit("cached match")).otherwise(F.concat(F.lit("cached match; "), note))
    found = matches.join(_as_hits(entries), matches["audit_entry_id"] == F.col("entry_id"))
    return found.select(
        "log_id",
        F.col("matched_by").alias("stored_by"),
        noted.alias("stored_note"),
        F.array(_hit_struct(F.lit(1).alias("rank"))).alias("stored_hits"),
    )


def match_stored(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Remembered matches with their entry."""
    found = stored_lists(matches, entries).select(
        "log_id",
        F.col("stored_by").alias("matched_by"),
        F.col("stored_note").alias("matched_note"),
        F.col("stored_hits").alias("hits"),
    )
    return _exploded(found, ["log_id", "matched_by", "matched_note"])


def _left_join(rows: DataFrame, lists: DataFrame, keys: list[str], usable: Column) -> DataFrame:
    """Left join on unique `lists`. Rows that cannot match, say a third of all logs with a blank request id, would
    meet in one task; they are given a key of their own instead and so spread over all tasks."""
    own = F.when(~usable, F.col("log_id"))
    spread = rows.withColumn("_own", F.coalesce(own, F.lit(-1).cast("long")))
    return spread.join(lists.withColumn("_own", F.lit(-1).cast("long")), [*keys, "_own"], "left").drop("_own")


def match_tiered(
    logs: DataFrame,
    tokens: DataFrame,
    entries: DataFrame,
    matches: DataFrame,
    window: int = DEFAULT_WINDOW,
    limit: int = DEFAULT_HITS,
    page: bool = False,
) -> DataFrame:
    """The first tier that knows the log: remembered match, key and time, request id, newest of the key.

    `page` says that `logs` is one page of at most 500 logs.
    """
    window = window if window > 0 else DEFAULT_WINDOW
    n = hit_limit(limit)
    # Narrow rows that four tiers read: written once, the logs are scanned and joined to their keys once.
    asked = cut_lineage(lookups(logs, tokens))
    known, named, remembered = (
        _only_relevant(asked, entries, matches) if page else (entries, entries, matches)
    )
    timed_entries = _around(asked, known, window) if page else known

    # Tier by tier: a log goes on only if no tier before has found it.
    has_key, has_request = F.col("token_id") > 0, tx.trim(F.col("request_id")) != ""
    stored = cut_lineage(asked.join(stored_lists(remembered, entries), "log_id", "left"))
    found = [
        stored.filter(F.col("stored_hits").isNotNull()).select(
            "log_id", F.col("stored_by").alias("matched_by"), F.col("stored_note").alias("matched_note"), F.col("stored_hits").alias("hits")
        )
    ]
    open_logs = stored.filter(F.col("stored_hits").isNull()).select(*asked.columns)
    tiers = [
        ("token_time", time_note(F.col("centre"), window), PROBE, has_key, lambda rows: nearest_lists(rows, timed_entries, window, n)),
        ("request_id", F.lit("exact request_id match"), ["request_id"], has_request, lambda rows: request_id_lists(_named(rows, named), n)),
        ("token_latest", F.lit(LATEST_NOTE), SCOPE, has_key, lambda rows: latest_lists(rows, known, n)),
    ]
    for name, note, keys, usable, lists in tiers:
        tried = cut_lineage(_left_join(open_logs, lists(open_logs), keys, usable))
        hit = tried.filter(F.col("hits").isNotNull())
        found.append(hit.select("log_id", F.lit(name).alias("matched_by"), note.alias("matched_note"), "hits"))
        open_logs = tried.filter(F.col("hits").isNull()).select(*asked.columns)
    labelled = found[0]
    for part in found[1:]:
        labelled = labelled.unionByName(part)
    return _exploded(labelled, ["log_id", "matched_by", "matched_note"])


def _named(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries with a request id that is asked for."""
    return entries.join(asked.select("request_id").distinct(), "request_id", "left_semi")


REMEMBERED_TIERS = ["token_time", "request_id"]


def new_matches(found: DataFrame, matches: DataFrame, matched_at: Column, rematch: bool = False) -> DataFrame:
    """First hits worth remembering for logs that have no remembered match; the first one stays for good.

    With `rematch` the hits are given for logs that have a match as well, for a caller that replaces the table.
    """
    first = found.filter((F.col("rank") == 1) & F.col("matched_by").isin(REMEMBERED_TIERS)).dropDuplicates(["log_id"])
    if not rematch:
        first = first.join(matches.select("log_id"), "log_id", "left_anti")
    return first.select(
        "log_id",
        F.col("entry_id").alias("audit_entry_id"),
        "matched_by",
        "matched_note",
        matched_at.cast("long").alias("matched_at"),
    )


CLIENT_FIELDS = ["client_name", "client_version", "client_variant", "user_agent"]


def best_client(
    logs: DataFrame, tokens: DataFrame, entries: DataFrame, matches: DataFrame, window: int = DEFAULT_WINDOW
) -> DataFrame:
    """The client of every log of a page: from its remembered match, else from the nearest entry."""
    asked = cut_lineage(lookups(logs, tokens))
    known, _, remembered = _only_relevant(asked, entries, matches)
    joined = asked.join(stored_lists(remembered, entries), "log_id", "left").join(
        nearest_lists(asked, _around(asked, known, window), window, 1), PROBE, "left"
    )
    hit = F.coalesce("stored_hits", "hits")[0]
    return joined.filter(hit.isNotNull()).select("log_id", *[hit[name].alias(name) for name in CLIENT_FIELDS])
