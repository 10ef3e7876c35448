"""Registered queries over audit lines, entries and their matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlens import bindings as b
from meterlens.operators import ingest, matching as m
from meterlens.functions import audit_fields as af
from meterlens.plans import log_views

# The generated events of one key lie minutes apart, so matching looks an hour around.
WINDOW = 3600


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.parse_lines(b.raw_lines(spark, sf), b.LINE_ZONE)


def _fields(*names: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _parsed(spark, sf).filter(F.col("line_state") == "entry").select("line_no", *names)

    return run


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    staged = af.lj.with_object(b.raw_lines(spark, sf), "value", "doc")
    staged = af.with_headers(af.with_members(staged, "doc", "members"), "members")
    return staged.select("line_no", F.explode("headers").alias("name", "text"))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.audit_entries(b.raw_lines(spark, sf), b.tokens(spark, sf), F.lit(1_700_100_000), b.LINE_ZONE)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select(
        F.col("source_line").alias("line_no"), F.posexplode("messages").alias("position", "message")
    ).select("line_no", "position", "message.role", "message.content")


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _parsed(spark, sf).filter(F.col("line_state") == "entry")
    return ingest.resolve_keys(parsed, b.tokens(spark, sf)).select("line_no", "token_id", "token_name", "key_tail")


def _new_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A replayed batch against a table that holds the first of the three files already."""
    entries = b.audit_entries(spark, sf)
    replayed = entries.unionByName(entries)
    stored = entries.filter(F.col("source_id") == "src-0")
    return ingest.new_entries(replayed, stored).select("source_id", "source_line", "created_at")


def _over_matches(operator, **args):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return operator(b.usage_logs(spark, sf), b.tokens(spark, sf), b.audit_entries(spark, sf), **args)

    return run


def _tiered(spark: SparkSession, sf: str, limit: int = 3) -> DataFrame:
    return m.match_tiered(
        b.usage_logs(spark, sf),
        b.tokens(spark, sf),
        b.audit_entries(spark, sf),
        b.stored_matches(spark, sf),
        WINDOW,
        limit,
    )


def _sticky(spark: SparkSession, sf: str) -> DataFrame:
    return m.new_matches(_tiered(spark, sf), b.stored_matches(spark, sf), F.lit(1_800_000_000))


def _narrow(df: DataFrame) -> DataFrame:
    return df.drop(*[name for name in m.HIT_FIELDS if name not in ("entry_id", "entry_created_at", "client_name")])


def _narrowed(query):
    return lambda spark, sf: _narrow(query(spark, sf))


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies stored plain or packed come back as the same text."""
    import gzip

    @F.pandas_udf("binary")
    def pack(values):
        return values.map(lambda v: gzip.compress(v.encode(), mtime=0))

    packed = F.col("doc_id") % 2 == 0
    stored = b.table(spark, sf, "documents").select(
        "doc_id",
        "text",
        F.when(packed, F.lit("")).otherwise(F.col("text")).alias("body"),
        pack("text").alias("body_gzip"),
        F.when(packed, F.lit("gzip")).otherwise(F.lit("")).alias("body_encoding"),
    )
    body = ingest.stored_body(F.col("body"), F.col("body_gzip"), F.col("body_encoding"))
    return stored.select("doc_id", F.sha2(body, 256).alias("digest"))


def _content_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a content part behind four or five levels of lists."""
    from meterlens.functions.messages import with_messages

    part = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    deep = F.col("doc_id") % 2 == 0
    content = F.when(deep, F.concat(F.lit("[[[[["), part, F.lit("]]]]]"))).otherwise(
        F.concat(F.lit('["first",['), part, F.lit(',{"image_url":{"url":"u"}},null,3]]'))
    )
    body = F.concat(F.lit('{"messages":[{"content":'), content, F.lit("}]}"))
    rows = with_messages(b.table(spark, sf, "documents").withColumn("body", body))
    return rows.select("doc_id", F.explode("messages").alias("m")).select(
        "doc_id", "m.role", F.sha2("m.content", 256).alias("digest")
    )


def _log_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of the entries that belong to one log."""
    asked = F.concat(F.lit('{"messages":[{"role":"system","content":" be brief "},{"content":"ask '), F.col("source_line"), F.lit('"}]}'))
    entries = b.audit_entries(spark, sf).withColumn("body", asked)
    found = log_views.log_audit(b.usage_logs(spark, sf), b.tokens(spark, sf), entries, b.stored_matches(spark, sf), 2, WINDOW)
    return log_views.audit_messages(found)


QUERIES = {
    "parse_audit": _fields(
        "created_at", "has_timestamp", "method", "request_path", "model", "request_id", "user_agent"
    ),
    "parse_timestamp": _fields("created_at", "has_timestamp"),
    "parse_api_key": _fields("api_key"),
    "parse_client": _fields("client_name", "client_version", "client_variant"),
    "parse_headers": _headers,
    "canonical_json": _fields("body"),
    "normalize_messages": _messages,
    "content_text": _content_text,
    "decode_body": _decoded,
    "resolve_key": _resolved,
    "ingest_stats": lambda spark, sf: ingest.line_statistics(_parsed(spark, sf), "path").drop("bytes_read"),
    "ingest_dedup": _new_entries,
    "entry_by_id": lambda spark, sf: ingest.entry_by_id(b.audit_entries(spark, sf), 71).select(
        "id", "source_id", "source_line", "model", "token_id", "key_tail", "request_id"
    ),
    "match_token_time": _narrowed(_over_matches(m.match_token_time, window=WINDOW)),
    "match_token_time_topn": _narrowed(_over_matches(m.match_token_time, window=WINDOW, limit=5)),
    "match_request_id": _narrowed(_over_matches(m.match_request_id, limit=3)),
    "match_latest": _narrowed(_over_matches(m.match_latest, limit=3)),
    "match_stored": _narrowed(
        lambda spark, sf: m.match_stored(b.stored_matches(spark, sf), b.audit_entries(spark, sf))
    ),
    "match_tiered": _narrowed(_tiered),
    "match_sticky": _sticky,
    "logs_with_client": lambda spark, sf: log_views.logs_with_client(
        b.usage_logs(spark, sf),
        b.tokens(spark, sf),
        b.options(spark, sf),
        b.audit_entries(spark, sf),
        b.stored_matches(spark, sf),
        log_views.LogFilter(page_size=500),
        WINDOW,
    ).select("id", "key_name", "client_name", "client_version", "client_variant", "user_agent"),
    "log_audit_messages": _log_messages,
    "log_audit": lambda spark, sf: log_views.log_audit(
        b.usage_logs(spark, sf),
        b.tokens(spark, sf),
        b.audit_entries(spark, sf),
        b.stored_matches(spark, sf),
        2,
        WINDOW,
    ).select("log_id", "rank", "matched_by", "matched_note", "id", "model", "source_path", "source_line"),
}
