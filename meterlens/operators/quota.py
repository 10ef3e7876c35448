"""Provider quota snapshots as comparable accounts and windows.

A snapshot table has one row per fetched document: `snapshot` (which poll), `fetched_at` (Unix seconds), and `body`
(JSON text). "Now" is always the time of the snapshot, so a result does not depend on when it is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlens.functions import quota as q
from meterlens.functions.stage import pinned
from meterlens.functions.text import trim
from meterlens.functions.timestamps import rfc3339_text
from meterlens.schemas import QUOTA_WINDOWS

from .ranking import running_last, top_per_group

# Channel ids, window names and sources of the providers.
SUB2API, OPENCODE, CPA, XFYUN, DEEPSEEK, IKUN = "sub2api", "opencode", "cpa", "xfyun", "deepseek", "ikun"
ESTIMATED, LIVE = "estimated", "live"
FIVE_HOURS_ESTIMATED, SEVEN_DAYS_ESTIMATED = "5h 预估", "7d 预估"
FIVE_HOURS_LIVE, SEVEN_DAYS_LIVE = "5h 实时", "7d 实时"
NOT_LOGGED_IN, NOT_LOGGED_IN_CODE = "未登录", 4001

WINDOW_COLUMNS = [part.split()[0] for part in QUOTA_WINDOWS.split(", ")]
WINDOW_TYPES = dict(part.split() for part in QUOTA_WINDOWS.split(", "))


def _decoded(snapshots: DataFrame, schema: str) -> DataFrame:
    """Add `doc`, the typed document, NULL where the body does not fit the schema."""
    parsed = F.from_json("body", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    staged = snapshots.withColumn("doc", pinned(parsed))
    return staged.withColumn("doc", F.when(F.col("doc._bad").isNull(), F.col("doc")))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _long(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("long")


def _double(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0)).cast("double")


def _flag(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def _window(**columns: Column) -> Column:
    """One window struct in the common layout; what a provider does not tell is NULL."""
    return F.struct(
        *[
            columns.get(name, F.lit(None)).cast(WINDOW_TYPES[name]).alias(name)
            for name in WINDOW_COLUMNS
            if name not in ("channel", "account_id", "account_name", "error")
        ]
    )


def _windows(accounts: DataFrame, channel: str, windows: Column) -> DataFrame:
    """Explode the non-NULL windows of each account."""
    flat = accounts.select("snapshot", "account_id", "account_name", F.explode(F.array_compact(windows)).alias("w"))
    named = {
        "channel": F.lit(channel),
        "account_id": F.col("account_id").cast("string"),
        "account_name": F.col("account_name"),
        "error": F.lit(""),
    }
    return flat.select("snapshot", *[named.get(n, F.col(f"w.{n}")).alias(n) for n in WINDOW_COLUMNS])


SUB2API_ACCOUNTS = (
    "code long, message string, data struct<total:long,items:array<struct<id:long,name:string,platform:string,"
    "type:string,status:string,error_message:string,schedulable:boolean,current_concurrency:int,concurrency:int,"
    "last_used_at:string,updated_at:string,session_window_start:string,session_window_end:string,"
    "session_window_status:string,extra:variant,credentials:variant,groups:array<struct<name:string>>,"
    "proxy:struct<name:string>>>>"
)


def sub2api_snapshots(snapshots: DataFrame) -> DataFrame:
    """State and account total of every account-list document."""
    code = _long("doc.code")
    error = (
        F.when(F.col("doc").isNull(), "decode accounts")
        .when(code != 0, F.concat(F.lit("accounts code "), code.cast("string"), F.lit(": "), _text("doc.message")))
        .otherwise("")
    )
    listed = F.coalesce(F.size("doc.data.items"), F.lit(0)).cast("long")
    total = F.when(_long("doc.data.total") == 0, listed).otherwise(_long("doc.data.total"))
    return _decoded(snapshots, SUB2API_ACCOUNTS).select(
        "snapshot",
        "fetched_at",
        F.lit(SUB2API).alias("channel"),
        (error == "").alias("ok"),
        error.alias("error"),
        F.when(error == "", total).otherwise(F.lit(0).cast("long")).alias("total"),
    )


def sub2api_accounts(snapshots: DataFrame) -> DataFrame:
    """One row per account of the documents without error."""
    good = _decoded(snapshots, SUB2API_ACCOUNTS).filter(F.col("doc").isNotNull() & (_long("doc.code") == 0))
    items = good.select("snapshot", "fetched_at", F.explode("doc.data.items").alias("a"))
    extra, credentials = F.col("a.extra"), F.col("a.credentials")
    mail_names = ("email_address", "email", "account")
    mails = [q.member_text(source, name) for source in (credentials, extra) for name in mail_names]
    named_groups = F.filter(F.transform("a.groups", lambda g: g["name"]), lambda n: trim(n) != "")
    return items.select(
        "snapshot",
        "fetched_at",
        _long("a.id").alias("account_id"),
        _text("a.name").alias("account_name"),
        q.first_with_at(*mails).alias("email"),
        *[_text(f"a.{name}").alias(name) for name in ("platform", "type", "status", "error_message")],
        _flag("a.schedulable").alias("schedulable"),
        _long("a.current_concurrency").alias("current_concurrency"),
        _long("a.concurrency").alias("concurrency"),
        F.coalesce(named_groups, F.expr("cast(array() as array<string>)")).alias("groups"),
        _text("a.proxy.name").alias("proxy_name"),
        *[
            _text(f"a.{name}").alias(name)
            for name in (
                "last_used_at", "updated_at", "session_window_status", "session_window_start", "session_window_end",
            )
        ],
        (F.lower(_text("a.type")) == "oauth").alias("can_refresh_usage"),
        q.member_text(credentials, "base_url").alias("base_url"),
        F.try_variant_get(extra, "$.session_window_utilization", "variant").alias("session_utilization"),
        F.try_variant_get(extra, "$.passive_usage_7d_utilization", "variant").alias("weekly_utilization"),
        F.try_variant_get(extra, "$.passive_usage_7d_reset", "variant").alias("weekly_reset"),
    )


def sub2api_estimated_windows(accounts: DataFrame) -> DataFrame:
    """Five-hour and seven-day windows estimated from the account list, where the list has them."""

    def window(name: str, utilization: str, resets_at: Column) -> Column:
        used = q.used_percent(q.loose_number(F.col(utilization)))
        return F.when(
            F.col(utilization).isNotNull(),
            _window(
                window_name=F.lit(name),
                source=F.lit(ESTIMATED),
                used_percent=used,
                remaining_percent=q.remaining_percent(used),
                resets_at=resets_at,
            ),
        )

    reset = rfc3339_text(q.loose_number(F.col("weekly_reset")).cast("long"))
    return _windows(
        accounts,
        SUB2API,
        F.array(
            window(FIVE_HOURS_ESTIMATED, "session_utilization", F.col("session_window_end")),
            window(SEVEN_DAYS_ESTIMATED, "weekly_utilization", reset),
        ),
    )


_LIVE_WINDOW = (
    "struct<utilization:variant,resets_at:string,remaining_seconds:long,"
    "window_stats:struct<requests:long,tokens:long,cost:double>>"
)
SUB2API_USAGE = (
    f"code long, message string, data struct<updated_at:string,five_hour:{_LIVE_WINDOW},seven_day:{_LIVE_WINDOW}>"
)


def sub2api_live_windows(snapshots: DataFrame) -> DataFrame:
    """Live windows of each account's usage document; a window that says nothing is left out."""
    good = _decoded(snapshots, SUB2API_USAGE).filter(F.col("doc").isNotNull() & (_long("doc.code") == 0))
    accounts = good.select("snapshot", "account_id", F.lit("").alias("account_name"), "doc")

    def window(name: str, part: str) -> Column:
        used = q.used_percent(q.loose_number(F.col(f"doc.data.{part}.utilization")))
        seconds = _long(f"doc.data.{part}.remaining_seconds")
        requests, tokens = (_long(f"doc.data.{part}.window_stats.{n}") for n in ("requests", "tokens"))
        resets_at = _text(f"doc.data.{part}.resets_at")
        silent = (used == 0) & (resets_at == "") & (seconds == 0) & (requests == 0) & (tokens == 0)
        return F.when(
            ~silent,
            _window(
                window_name=F.lit(name),
                source=F.lit(LIVE),
                used_percent=used,
                remaining_percent=q.remaining_percent(used),
                resets_at=resets_at,
                window_seconds=seconds,
                requests=requests,
                tokens=tokens,
                cost=_double(f"doc.data.{part}.window_stats.cost"),
            ),
        )

    return _windows(
        accounts, SUB2API, F.array(window(FIVE_HOURS_LIVE, "five_hour"), window(SEVEN_DAYS_LIVE, "seven_day"))
    )


OPENCODE_ACCOUNTS = (
    "accounts array<struct<id:string,name:string,username:string,enabled:boolean,account_type:string,"
    "setup_step:string,purchase_date:string,expires_on:string,last_error:string,auth_error:string>>"
)
OPENCODE_PRICING = "limits struct<window_5h:double,window_week:double,window_month:double>"
_OPENCODE_USAGE_FIELDS = (
    "window_5h:double,window_week:double,window_month:double,"
    "resets_in_5h:string,resets_in_week:string,resets_in_month:string"
)
OPENCODE_USAGE = _OPENCODE_USAGE_FIELDS.replace(":", " ").replace(",", ", ")
OPENCODE_REFRESH = f"source string, usage struct<{_OPENCODE_USAGE_FIELDS}>"


def opencode_accounts(snapshots: DataFrame) -> DataFrame:
    """One row per account; the account list is a bare JSON array."""
    wrapped = snapshots.withColumn("body", F.concat(F.lit('{"accounts":'), F.col("body"), F.lit("}")))
    items = _decoded(wrapped, OPENCODE_ACCOUNTS).select("snapshot", "fetched_at", F.explode("doc.accounts").alias("a"))
    managed = (F.lower(_text("a.account_type")) == "managed") & (F.lower(_text("a.setup_step")) == "ready")
    error = F.coalesce(F.nullif("a.auth_error", F.lit("")), F.nullif("a.last_error", F.lit("")), F.lit(""))
    return items.select(
        "snapshot",
        "fetched_at",
        _text("a.id").alias("account_id"),
        _text("a.name").alias("account_name"),
        _text("a.username").alias("username"),
        _flag("a.enabled").alias("enabled"),
        *[_text(f"a.{n}").alias(n) for n in ("account_type", "setup_step", "purchase_date", "expires_on")],
        (_flag("a.enabled") & managed).alias("can_refresh_usage"),
        error.alias("error"),
    )


def _usd_windows(source: Column) -> Column:
    def window(name: str, used_column: str, limit_column: str, reset_column: str) -> Column:
        used, limit = F.greatest(_double(used_column), F.lit(0.0)), _double(limit_column)
        percent = F.least(F.when(limit > 0, used / limit * 100).otherwise(0.0), F.lit(100.0))
        return _window(
            window_name=F.lit(name),
            source=source,
            limit_value=limit,
            used_value=used,
            remaining_value=F.greatest(limit - used, F.lit(0.0)),
            used_percent=percent,
            remaining_percent=100 - percent,
            resets_at=_text(reset_column),
        )

    return F.array(
        window("5h", "u.window_5h", "limits.window_5h", "u.resets_in_5h"),
        window("周", "u.window_week", "limits.window_week", "u.resets_in_week"),
        window("月", "u.window_month", "limits.window_month", "u.resets_in_month"),
    )


def opencode_windows(accounts: DataFrame, pricing: DataFrame, usage: DataFrame) -> DataFrame:
    """USD windows of every account whose usage document could be read, against the limits of the same poll."""
    limits = _decoded(pricing, OPENCODE_PRICING).select("snapshot", F.col("doc.limits").alias("limits"))
    used = _decoded(usage, OPENCODE_USAGE).filter("doc is not null").select("snapshot", "account_id", F.col("doc").alias("u"))
    joined = accounts.join(used, ["snapshot", "account_id"]).join(limits, "snapshot")
    return _opencode_exploded(joined, F.lit(ESTIMATED))


def _opencode_exploded(joined: DataFrame, source: Column) -> DataFrame:
    staged = joined.withColumn("_windows", _usd_windows(source))
    return _windows(staged, OPENCODE, F.col("_windows"))


def opencode_live_windows(refreshed: DataFrame, pricing: DataFrame) -> DataFrame:
    """USD windows of refreshed accounts; the document names its source, the windows are live."""
    limits = _decoded(pricing, OPENCODE_PRICING).select("snapshot", F.col("doc.limits").alias("limits"))
    used = _decoded(refreshed, OPENCODE_REFRESH).filter("doc is not null").select(
        "snapshot", "account_id", F.lit("").alias("account_name"), F.col("doc.usage").alias("u")
    )
    return _opencode_exploded(used.join(limits, "snapshot"), F.lit(LIVE))


def pool_files(snapshots: DataFrame, target_type: str, max_accounts: int = 0) -> DataFrame:
    """Auth files of one type with name, mail and account id, in document order; at most `max_accounts` if set."""
    files = _decoded(snapshots, "files array<variant>").select(
        "snapshot", "fetched_at", F.posexplode("doc.files").alias("position", "file")
    )
    file = F.col("file")

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(q.member_text(file, n), F.lit("")) for n in names], F.lit(""))

    extra = F.try_variant_get(file, "$.extra", "variant")
    name = first("name", "id")
    mail = [F.lower(q.member_text(source, n)) for source in (file, extra) for n in ("email", "account")]
    auth = F.try_variant_get(file, "$.auth_index", "variant")
    typed = files.filter(F.lower(first("type", "typo")) == target_type.lower()).select(
        "snapshot",
        "fetched_at",
        "position",
        name.alias("account_name"),
        q.first_with_at(*mail, F.regexp_replace(F.lower(name), r"\.json$", "")).alias("email"),
        first("chatgpt_account_id", "chatgptAccountId", "account_id", "accountId").alias("account_id"),
        q.field_text(auth).alias("auth_index"),
    )
    if max_accounts <= 0:
        return typed
    return top_per_group(typed, ["snapshot"], [F.col("position")], max_accounts, "_rank").drop("_rank")


_POOL_WINDOW = "struct<used_percent:double,limit_window_seconds:long,reset_at:variant,reset_after_seconds:long>"
POOL_USAGE = f"rate_limit struct<primary_window:{_POOL_WINDOW},secondary_window:{_POOL_WINDOW}>"


def pool_accounts(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Every auth file with its probe: an error, or the usage document.

    A probe row has `http_status` and the envelope `{status_code, body}` whose body is JSON text again.
    """
    envelopes = _decoded(probes, "status_code long, body string").select(
        "snapshot", "auth_index", "http_status", F.col("body").alias("raw"), F.col("doc").alias("envelope")
    )
    inner = _decoded(
        envelopes.withColumn("body", F.col("envelope.body")).drop("doc"), POOL_USAGE
    ).select("snapshot", "auth_index", "http_status", "raw", "envelope", F.col("doc").alias("usage"))
    status = F.coalesce(F.col("envelope.status_code"), F.lit(0))
    error = (
        F.when(F.col("auth_index") == "", "missing auth_index")
        .when(
            F.col("http_status") >= 400,
            F.concat(F.lit("api-call http "), F.col("http_status").cast("string"), F.lit(": "), q.snippet(F.col("raw"))),
        )
        .when(F.col("envelope").isNull(), "decode api-call")
        .when(status == 401, "401")
        .when(status != 200, F.concat(F.lit("usage status "), status.cast("string")))
        .when(F.col("usage").isNull(), "decode usage body")
        .otherwise("")
    )
    return files.join(inner, ["snapshot", "auth_index"], "left").withColumn("error", error).drop("raw", "envelope")


def pool_windows(accounts: DataFrame) -> DataFrame:
    """Primary and secondary windows of the accounts without error."""

    def window(name: str) -> Column:
        part = f"usage.rate_limit.{name}"
        used = F.col(f"{part}.used_percent")
        after = _long(f"{part}.reset_after_seconds")
        absolute = q.loose_epoch(F.col(f"{part}.reset_at"))
        reset = (
            F.when(absolute > 0, absolute)
            .when(after > 0, F.col("fetched_at") + after)
            .otherwise(F.lit(0).cast("long"))
        )
        return F.when(
            used.isNotNull(),
            _window(
                window_name=F.lit(name),
                source=F.lit(LIVE),
                used_percent=used,
                remaining_percent=100 - used,
                resets_at=rfc3339_text(reset),
                window_seconds=F.greatest(_long(f"{part}.limit_window_seconds"), F.lit(0).cast("long")),
            ),
        )

    good = accounts.filter(F.col("error") == "").withColumn(
        "_windows", F.array(window("primary_window"), window("secondary_window"))
    )
    return _windows(good, CPA, F.col("_windows"))


_PLAN_USAGE = (
    "struct<channel:string,dailyLimit:double,dailyUsage:double,packageLeft:double,packageLimit:double,"
    "packageUsage:double,rp5hLimit:double,rp5hUsage:double,rpwLimit:double,rpwUsage:double>"
)
XFYUN_PLANS = (
    "code long, succeed boolean, message string, data struct<rows:array<struct<appId:string,name:string,"
    f"validFrom:string,expiresAt:string,codingPlanUsageDTO:{_PLAN_USAGE}>>>"
)


def xfyun_accounts(snapshots: DataFrame) -> DataFrame:
    """Status and plans of every account; a row has `account_id`, `account_name`, `has_session` and `http_status`."""
    message = trim(_text("doc.message"))
    code = _long("doc.code")
    refused = ~_flag("doc.succeed") | (code != 0)
    reason = F.when(message != "", message).otherwise(F.concat(F.lit("code "), code.cast("string")))
    error = (
        F.when(~F.col("has_session"), "missing ssoSessionId")
        .when(
            F.col("http_status") >= 400,
            F.concat(F.lit("http "), F.col("http_status").cast("string"), F.lit(": "), q.snippet(F.col("body"))),
        )
        .when(F.col("doc").isNull(), "decode response")
        .when(refused, reason)
        .otherwise("")
    )
    answered = (F.col("http_status") < 400) & F.col("doc").isNotNull()
    logged_out = answered & refused & ((code == NOT_LOGGED_IN_CODE) | reason.contains(NOT_LOGGED_IN))
    return (
        _decoded(snapshots, XFYUN_PLANS)
        .withColumn("error", error)
        .withColumn(
            "status",
            F.when(F.col("error") == "", "ok")
            .when(~F.col("has_session") | logged_out, "expired")
            .otherwise("error"),
        )
        .select(
            "snapshot",
            "fetched_at",
            "account_id",
            "account_name",
            "status",
            "error",
            F.when(F.col("error") == "", F.col("doc.data.rows")).alias("plans"),
        )
    )


def xfyun_windows(accounts: DataFrame) -> DataFrame:
    """Package, five-hour, weekly and daily windows of every plan that has a limit."""
    plans = accounts.select(
        "snapshot", "account_id", F.explode("plans").alias("p"), F.lit(None).cast("double").alias("unknown")
    ).withColumn("account_name", _text("p.name"))

    def window(name: str, limit_field: str, usage_field: str, left_field: str | None) -> Column:
        limit = F.col(f"p.codingPlanUsageDTO.{limit_field}")
        used = _double(f"p.codingPlanUsageDTO.{usage_field}")
        left = F.col(f"p.codingPlanUsageDTO.{left_field}") if left_field else F.col("unknown")
        remaining = F.least(F.greatest(F.coalesce(left, limit - used), F.lit(0.0)), limit)
        percent = q.clamp_percent(remaining / limit * 100)
        return F.when(
            limit > 0,
            _window(
                window_name=F.lit(name),
                source=F.lit(LIVE),
                limit_value=limit,
                used_value=used,
                remaining_value=remaining,
                used_percent=100 - percent,
                remaining_percent=percent,
            ),
        )

    staged = plans.withColumn(
        "_windows",
        F.array(
            window("package", "packageLimit", "packageUsage", "packageLeft"),
            window("rp5h", "rp5hLimit", "rp5hUsage", None),
            window("rpw", "rpwLimit", "rpwUsage", None),
            window("daily", "dailyLimit", "dailyUsage", None),
        ),
    )
    return _windows(staged, XFYUN, F.col("_windows"))


BALANCES = (
    "is_available boolean, balance_infos array<struct<currency:string,total_balance:string,granted_balance:string,"
    "topped_up_balance:string>>"
)


def currency_balances(snapshots: DataFrame) -> DataFrame:
    """One row per currency; amounts stay text, so no digit is lost."""
    good = _decoded(snapshots, BALANCES).filter("doc is not null")
    infos = good.select(
        "snapshot", "fetched_at", _flag("doc.is_available").alias("is_available"), F.explode("doc.balance_infos").alias("i")
    )
    amounts = ("currency", "total_balance", "granted_balance", "topped_up_balance")
    return infos.select("snapshot", "fetched_at", "is_available", *[_text(f"i.{n}").alias(n) for n in amounts])


EXTERNAL_QUOTA = (
    "success boolean, message string, "
    "data struct<id:long,username:string,quota:long,used_quota:long,request_count:long>"
)


def external_quota(snapshots: DataFrame) -> DataFrame:
    """The quota of an external account per snapshot, or the error of its document."""
    ok = _flag("doc.success")
    message = trim(_text("doc.message"))
    failure = F.concat(F.lit(f"{IKUN}: "), F.when(message != "", message).otherwise("request failed"))
    error = F.when(F.col("doc").isNull(), f"decode {IKUN} self").when(~ok, failure).otherwise("")

    def if_ok(value: Column, empty: Column) -> Column:
        return F.when(error == "", value).otherwise(empty)

    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    return _decoded(snapshots, EXTERNAL_QUOTA).select(
        "snapshot",
        "fetched_at",
        F.lit(IKUN).alias("quota_source"),
        if_ok(_long("doc.data.id"), zero).alias("quota_user_id"),
        if_ok(_text("doc.data.username"), F.lit("")).alias("quota_username"),
        if_ok(_long("doc.data.quota"), zero).alias("quota"),
        if_ok(_long("doc.data.used_quota"), zero).alias("used_quota"),
        if_ok(q.quota_cny(_long("doc.data.quota")), none).alias("balance_cny"),
        if_ok(q.quota_cny(_long("doc.data.used_quota")), none).alias("used_cny"),
        if_ok(_long("doc.data.request_count"), zero).alias("request_count"),
        error.alias("quota_error"),
    )


def attach_quota(
    accounts: DataFrame, quotas: DataFrame, *, account_id: int = 0, name_key: str = IKUN, base_url: str = ""
) -> DataFrame:
    """Give the external quota of the same poll to the accounts that use it, found by id, else by name or address.

    Which accounts match depends on the account row alone, so the join itself is on the poll only.
    """

    def address(value: Column) -> Column:
        return F.rtrim(F.lower(value), F.lit("/"))

    key = name_key.strip().lower()
    own_address = address(F.col("base_url"))
    by_address = (own_address != "") & (own_address == base_url.strip().lower().rstrip("/"))
    by_name = F.lower(trim(F.col("account_name"))).contains(key) if key else F.lit(False)
    matches = F.col("account_id") == account_id if account_id > 0 else by_name | by_address
    keyed = quotas.drop("fetched_at")
    used = F.coalesce(matches, F.lit(False))
    # Accounts that use no external quota stay out of the join.
    found = accounts.filter(used).join(keyed, "snapshot", "left").select(*accounts.columns, *[c for c in keyed.columns if c != "snapshot"])
    return found.unionByName(accounts.filter(~used), allowMissingColumns=True)


def account_totals(accounts: DataFrame) -> DataFrame:
    """Accounts and accounts with an error per channel."""
    return accounts.groupBy("channel").agg(
        F.count("*").alias("accounts"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors")
    )


def last_good(history: DataFrame) -> DataFrame:
    """Every snapshot as it should be shown: a failed one shows the last good payload, marked as stale.

    `history` has channel, fetched_at, ok, error and payload; a channel's history may be long, so it is cut in slices.
    """
    good = F.when(F.col("ok"), F.struct(F.col("fetched_at").alias("at"), F.col("payload").alias("payload")))
    held = running_last(history, ["channel"], [F.col("fetched_at")], good, "_good")
    stale = ~F.col("ok") & F.col("_good").isNotNull()
    return held.select(
        "channel",
        "fetched_at",
        (F.col("ok") | stale).alias("ok"),
        F.when(stale, F.concat(F.lit("stale: "), F.col("error")))
        .when(F.col("ok"), F.lit(""))
        .otherwise(F.col("error"))
        .alias("error"),
        F.coalesce("_good.at", "fetched_at").alias("updated_at"),
        F.col("_good.payload").alias("payload"),
    )
