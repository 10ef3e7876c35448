"""Fields of one audit line: aliases, headers, keys and clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import loose_json as lj
from .stage import pinned
from .text import blank_to_null, trim
from .timestamps import parse_timestamp

# Accepted names of every field, in order of preference.
ALIASES = {
    "timestamp": ["created_at", "createdAt", "timestamp", "time", "ts", "@timestamp"],
    "method": ["method", "request_method", "requestMethod"],
    "path": ["path", "uri", "request_uri", "requestUri"],
    "body": ["body", "request_body", "requestBody", "request", "data"],
    "headers": ["headers", "request_headers", "requestHeaders"],
    "user_agent": ["user_agent", "userAgent", "ua"],
    "request_id": ["request_id", "requestId", "trace_id", "traceId"],
}
REQUEST_ID_HEADERS = ["x-oneapi-request-id", "x-request-id", "request-id"]
KEY_HEADERS = ["x-api-key", "x-goog-api-key", "api-key"]
MASKED_KEYS = ["", "[redacted]", "redacted", "***", "-"]

VARIANT_MAP = "map<string,variant>"


def with_members(df: DataFrame, document: str, out: str) -> DataFrame:
    """Add `out`, the members of a document by name, and `<out>_lower`, the same by lower-case name.

    Where names differ only by case, the lower-case map keeps the alphabetically first one. Names without a capital, by far
    the most, are their own lower-case names.
    """
    names = f"_{out}_names"
    members = F.try_variant_get(document, "$[0]", VARIANT_MAP)
    first_spelling = F.transform(
        F.array_distinct(F.transform(names, F.lower)),
        lambda low: F.struct(low, F.try_element_at(F.filter(names, lambda n: F.lower(n) == low), F.lit(1))),
    )
    joined = F.array_join(names, "\n")
    return (
        df.withColumn(out, members)
        .withColumn(names, F.array_sort(F.map_keys(out)))
        .withColumn(
            f"{out}_lower",
            F.when(F.lower(joined) == joined, F.map_from_arrays(names, names)).otherwise(F.map_from_entries(first_spelling)),
        )
        .drop(names)
    )


def members_by_alias(members: str, field: str, read) -> Column:
    """`read` applied to the members that a field's aliases name, in order of preference; missing ones are left out.

    A member with exactly the alias as its name comes before one whose name differs by case only. The result is NULL for a
    line that has none of them, so that nothing is looked up there.
    """

    lower, names = f"{members}_lower", {alias.lower(): alias for alias in ALIASES[field]}
    aliases = F.create_map(*[F.lit(text) for pair in names.items() for text in pair])
    lows = F.array(*[F.lit(low) for low in names])

    def one(low: Column) -> Column:
        exact = F.try_element_at(F.col(members), F.try_element_at(aliases, low))
        return F.coalesce(exact, F.try_element_at(F.col(members), F.try_element_at(F.col(lower), low)))

    named = F.transform(F.array_intersect(lows, F.map_keys(lower)), one)
    return F.when(F.arrays_overlap(F.map_keys(lower), lows), F.transform(named, read))


def _first(values: Column) -> Column:
    return F.try_element_at(F.array_compact(values), F.lit(1))


def text_of(value: Column) -> Column:
    """The value if it is a JSON string, else NULL."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def first_text(members: str, field: str) -> Column:
    """The first alias that holds a non-blank string, trimmed; else ''."""
    return F.coalesce(_first(members_by_alias(members, field, lambda v: blank_to_null(text_of(v)))), F.lit(""))


def first_timestamp(members: str, zone: str) -> Column:
    """The first alias that reads as a time after the epoch; 0 if there is none."""
    stamps = members_by_alias(members, "timestamp", lambda v: parse_timestamp(v, zone))
    return F.coalesce(_first(F.filter(stamps, lambda t: t > 0)), F.lit(0).cast("long"))


def _header_value(value: Column) -> Column:
    kind = lj.json_kind(value)
    parts = F.filter(
        F.transform(F.try_variant_get(value, "$", "array<variant>"), text_of), lambda t: F.coalesce(t != "", F.lit(False))
    )
    return (
        F.when(kind == '"', trim(F.try_variant_get(value, "$", "string")))
        .when(kind == "[", F.when(F.size(parts) > 0, F.array_join(parts, ",")))
        .when(kind != "n", trim(F.to_json(value)))
    )


def _header_entries(value: Column) -> Column:
    """(lower-case name, text) pairs of one header object; pairs without text are left out."""
    pairs = F.transform(
        F.map_entries(F.try_variant_get(value, "$", VARIANT_MAP)),
        lambda e: F.struct(F.lower(e["key"]).alias("name"), _header_value(e["value"]).alias("text")),
    )
    return F.coalesce(
        F.filter(pairs, lambda p: p["text"].isNotNull()),
        F.array().cast("array<struct<name:string,text:string>>"),
    )


def with_headers(df: DataFrame, members: str, out: str = "headers") -> DataFrame:
    """Add the header map: all header objects merged, names in lower case, the last one wins.

    The map is pinned: exploding it filters by its size, which would merge all headers again for each line.
    """
    none = F.array().cast("array<struct<name:string,text:string>>")
    entries = F.coalesce(F.flatten(members_by_alias(members, "headers", _header_entries)), none)
    names = F.array_distinct(F.transform("_header_entries", lambda e: e["name"]))
    last = F.transform(
        names,
        lambda n: F.struct(
            n, F.try_element_at(F.filter("_header_entries", lambda e: e["name"] == n), F.lit(-1))["text"]
        ),
    )
    return (
        df.withColumn("_header_entries", pinned(entries))
        .withColumn(
            out,
            pinned(F.when(F.size("_header_entries") > 0, F.map_from_entries(last)).otherwise(F.map_from_entries(none))),
        )
        .drop("_header_entries")
    )


def first_header(headers: Column, names: list[str]) -> Column:
    texts = F.transform(
        F.array(*[F.lit(name) for name in names]), lambda n: blank_to_null(F.try_element_at(headers, n))
    )
    return F.coalesce(F.when(F.size(headers) > 0, _first(texts)), F.lit(""))


def without_bearer(key: Column) -> Column:
    return F.when(F.lower(F.left(key, F.lit(7))) == "bearer ", trim(F.substring(key, 8, 2**31 - 1))).otherwise(key)


def _query_key(path: Column) -> Column:
    """The decoded `key` parameter of a path or URL."""
    raw = F.regexp_extract(path, r"^[^?#]*\?(?:[^#]*&)?key=([^&#]*)", 1)
    return F.try_url_decode(F.nullif(raw, F.lit("")))


def api_key(headers: Column, path: Column) -> Column:
    """The caller's key: Authorization, then the key headers, then the query string; '' if none is usable."""
    candidates = [
        without_bearer(first_header(headers, ["authorization"])),
        *[first_header(headers, [name]) for name in KEY_HEADERS],
        _query_key(path),
    ]
    masked = [F.lit(mask) for mask in MASKED_KEYS]
    usable = F.filter(
        F.array(*candidates), lambda key: key.isNotNull() & ~F.array_contains(F.array(*masked), F.lower(trim(key)))
    )
    given = (F.size(headers) > 0) | path.contains("key=")
    return F.coalesce(F.when(given, F.try_element_at(usable, F.lit(1))), F.lit(""))


def key_hash(key: Column) -> Column:
    return F.when(key == "", F.lit("")).otherwise(F.sha2(key, 256))


# User-agent product marker, client name and variant; the claude variant has its own table.
CLIENTS = [
    ("codex desktop/", "codex", "desktop"),
    ("codex-tui/", "codex", "tui"),
    ("claude-cli/", "claude", None),
    ("cherrystudio/", "cherrystudio", "desktop"),
]
CLAUDE_VARIANTS = [
    ("claude-vscode", "vscode"),
    ("claude-desktop", "desktop"),
    ("sdk-cli", "sdk-cli"),
    ("sdk-ts", "sdk-ts"),
    ("agent-sdk/", "cli-agent"),
    ("cli", "cli"),
]


def _by_marker(lower_agent: Column, rules: list[tuple[str, Column]], default: str) -> Column:
    """The value of the first marker that occurs in the user agent."""
    found = [F.when(lower_agent.contains(marker), value) for marker, value in rules]
    return F.coalesce(*found, F.lit(default))


def client_columns(user_agent: Column) -> dict[str, Column]:
    """Client name, version and variant of a user agent."""
    agent = trim(user_agent)
    low = F.lower(agent)
    claude = _by_marker(low, [(marker, F.lit(name)) for marker, name in CLAUDE_VARIANTS], "")

    def version(marker: str) -> Column:
        return F.regexp_extract(agent, f"(?i){marker}([A-Za-z0-9._-]*)", 1)

    return {
        "client_name": _by_marker(low, [(m, F.lit(name)) for m, name, _ in CLIENTS], "unknown"),
        "client_version": _by_marker(low, [(m, version(m)) for m, _, _ in CLIENTS], ""),
        "client_variant": _by_marker(low, [(m, claude if v is None else F.lit(v)) for m, _, v in CLIENTS], ""),
    }


def canonical_json(text: Column) -> Column:
    """JSON text re-written with sorted names and no spaces; other text is kept, trimmed."""
    plain = trim(text)
    whole = F.json_array_length(F.concat(F.lit("["), plain, F.lit("]"))) == 1
    return F.coalesce(F.when(whole, canonical_variant(F.try_parse_json(plain))), plain)


def canonical_variant(value: Column) -> Column:
    """Compact JSON with the characters escaped that are unsafe inside HTML."""
    escaped = F.to_json(value)
    # Characters that the gateway's JSON writer escapes.
    for character in ("<", ">", "&", "\u2028", "\u2029"):
        escaped = F.replace(escaped, F.lit(character), F.lit(f"\\u{ord(character):04x}"))
    return escaped


def first_body(members: str) -> Column:
    """The first body alias with content as canonical JSON text; '' if there is none."""

    def read(value: Column) -> Column:
        kind = lj.json_kind(value)
        text = blank_to_null(F.try_variant_get(value, "$", "string"))
        return F.when(kind == '"', canonical_json(text)).when(kind != "n", canonical_variant(value))

    return F.coalesce(_first(members_by_alias(members, "body", read)), F.lit(""))
