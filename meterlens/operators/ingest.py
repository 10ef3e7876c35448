"""From raw audit lines to audit entries."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from meterlens import schemas
from meterlens.functions import audit_fields as af
from meterlens.functions import loose_json as lj
from meterlens.functions import text as tx
from meterlens.functions.messages import with_messages
from meterlens.functions.stage import pinned_all

from .ranking import running_total

PARSED_COLUMNS = [
    "created_at",
    "has_timestamp",
    "method",
    "request_path",
    "model",
    "request_id",
    "api_key",
    "user_agent",
    "client_name",
    "client_version",
    "client_variant",
    "body",
]


def parse_lines(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """Add the parsed fields of the JSON line in `value`; `line_state` is blank, invalid or entry."""
    staged = lj.with_object(lines, "value", "_doc")
    staged = af.with_headers(af.with_members(staged, "_doc", "_members"), "_members", "_headers")
    headers = F.col("_headers")
    state = (
        F.when(tx.trim(F.col("value")) == "", "blank")
        .when(F.col("_members").isNull(), "invalid")
        .otherwise("entry")
    )
    fields = pinned_all(
        {
            "line_state": state,
            "created_at": af.first_timestamp("_members", zone),
            "method": F.upper(af.first_text("_members", "method")),
            "request_path": af.first_text("_members", "path"),
            "body": af.first_body("_members"),
            "user_agent": tx.first_nonblank(
                af.first_text("_members", "user_agent"), af.first_header(headers, ["user-agent"])
            ),
            "request_id": tx.first_nonblank(
                af.first_text("_members", "request_id"), af.first_header(headers, af.REQUEST_ID_HEADERS)
            ),
        }
    )
    staged = lj.with_object(staged.withColumns(fields), "body", "_body")
    fields = pinned_all(
        {
            "has_timestamp": F.col("created_at") > 0,
            "api_key": af.api_key(headers, F.col("request_path")),
            "model": F.coalesce(tx.trim(lj.strict_text(F.col("_body"), "model")), F.lit("")),
            **af.client_columns(F.col("user_agent")),
        }
    )
    return staged.withColumns(fields).drop("_doc", "_members", "_members_lower", "_headers", "_body")


def line_figures() -> list[Column]:
    """Processed, entry, blank and invalid lines and the bytes read, as aggregates over parsed lines."""
    state = F.col("line_state")
    return [
        F.count("*").alias("processed_lines"),
        F.count_if(state == "entry").alias("entry_lines"),
        F.count_if(state == "blank").alias("blank_lines"),
        F.count_if(state == "invalid").alias("invalid_lines"),
        F.coalesce(F.sum("byte_length"), F.lit(0).cast("long")).alias("bytes_read"),
    ]


def line_statistics(parsed: DataFrame, *keys: str) -> DataFrame:
    """`line_figures` per file or in all."""
    return parsed.groupBy(*keys).agg(*line_figures())


def key_candidates(key: Column) -> list[Column]:
    """The key without Bearer as given, then without its sk- prefix."""
    given = tx.trim(af.without_bearer(tx.trim(key)))
    bare = F.when(F.lower(F.left(given, F.lit(3))) == "sk-", tx.trim(F.substring(given, 4, 2**31 - 1)))
    return [F.nullif(given, F.lit("")), F.nullif(bare, F.lit(""))]


#: Distinct keys, or sources, of a batch up to which a table of them is broadcast.
FEW = 10_000


def has_few(df: DataFrame) -> bool:
    return df.limit(FEW + 1).count() <= FEW


def resolve_keys(rows: DataFrame, tokens: DataFrame, key: str = "api_key", few_keys: bool = False) -> DataFrame:
    """Add `token_id`, `token_name` and `key_tail` of each row's key; an unknown key has token 0 and its own tail.

    The distinct keys are looked up first, so the key table meets a small table whatever the number of rows; the
    answers then come back by key. Rows without a key, which may be many, find no answer: they are spread by their
    place in the input instead of meeting in one task. With `few_keys` (`has_few`) neither the rows nor the key table
    are shuffled.
    """
    small = F.broadcast if few_keys else lambda df: df
    place = [name for name in ("path", "line_no") if name in rows.columns] or rows.columns[:1]
    own = F.when(F.col(key) == "", F.xxhash64(*place)).otherwise(F.lit(0).cast("long"))
    token = F.struct(F.col("id").alias("id"), F.coalesce("name", F.lit("")).alias("name")).alias("_token")
    known = tokens.select(F.col("key").alias("_known"), token)
    if not few_keys:
        known = known.groupBy("_known").agg(F.min("_token").alias("_token"))
    asked = rows.select(F.col(key).alias("_asked")).filter(F.col("_asked") != "").distinct()
    ranked = asked.select(
        "_asked",
        F.posexplode(F.array_compact(F.array(*key_candidates(F.col("_asked"))))).alias("_position", "_known"),
    )
    answers = (
        known.join(small(ranked), "_known")
        .groupBy("_asked")
        .agg(F.min(F.struct("_position", "_token", "_known")).alias("_best"))
        .select(
            F.col("_asked").alias(key),
            F.col("_best._token.id").alias("_id"),
            F.col("_best._token.name").alias("_name"),
            tx.key_tail(F.col("_best._known")).alias("_tail"),
            F.lit(0).cast("long").alias("_own"),
        )
    )
    return (
        rows.withColumn("_own", own)
        .join(small(answers), [key, "_own"], "left")
        .withColumns(
            {
                "token_id": F.coalesce("_id", F.lit(0).cast("long")),
                "token_name": F.coalesce("_name", F.lit("")),
                "key_tail": tx.first_nonempty(F.col("_tail"), tx.key_tail(tx.trim(F.col(key)))),
            }
        )
        .drop("_id", "_name", "_tail", "_own")
    )


def audit_entries(lines: DataFrame, tokens: DataFrame, ingested_at: Column, zone: str = "UTC") -> DataFrame:
    """Entries of raw lines with resolved keys and messages; `id` is left to `assign_ids`."""
    return entries_of(parse_lines(lines, zone), tokens, ingested_at)


def entries_of(parsed: DataFrame, tokens: DataFrame, ingested_at: Column, few_keys: bool = False) -> DataFrame:
    """Entries of parsed lines; `few_keys` as in `resolve_keys`."""
    resolved = resolve_keys(parsed.filter(F.col("line_state") == "entry"), tokens, few_keys=few_keys)
    shaped = resolved.withColumns(
        {
            "source_path": F.col("path"),
            "source_line": F.col("line_no"),
            "path": F.col("request_path"),
            "key_hash": af.key_hash(F.col("api_key")),
            "ingested_at": ingested_at.cast("long"),
        }
    )
    names = [f.name for f in T.StructType.fromDDL(schemas.AUDIT_ENTRIES).fields if f.name != "id"]
    return with_messages(shaped).select(*names)


def assign_ids(entries: DataFrame, after: int = 0, sources: DataFrame | None = None) -> DataFrame:
    """Number entries in (source_path, source_line) order, going on after the id `after`.

    Every source gets as many ids as its lines span, so only one row per source has to be ordered and the entries
    themselves are not sorted. Lines without an entry leave gaps. `sources` are rows with the same sources and lines that
    are read at less cost than `entries`; they are counted at once, and where sources are few nothing is shuffled.
    """
    spans = (entries if sources is None else sources).groupBy("source_path", "source_id").agg(
        F.min("source_line").alias("_first"), (F.max("source_line") - F.min("source_line") + 1).alias("_span")
    )
    few = [] if sources is None else spans.limit(FEW + 1).collect()
    if sources is not None and len(few) <= FEW:
        # Strings of Python and of Spark sort alike, nulls come first.
        few.sort(key=lambda r: [(text is not None, text or "") for text in (r["source_path"], r["source_id"])])
        before = accumulate((r["_span"] or 0 for r in few), initial=0)
        rows = [(r["source_path"], r["source_id"], r["_first"], b) for r, b in zip(few, before)]
        schema = "source_path string, source_id string, _first long, _before long"
        placed = F.broadcast(entries.sparkSession.createDataFrame(rows, schema))
    else:
        placed = running_total(
            spans.withColumn("_all", F.lit(0)),
            ["_all"],
            [F.col("source_path"), F.col("source_id")],
            F.col("_span"),
            "_before",
        ).select("source_path", "source_id", "_first", "_before")
    number = F.col("_before") + F.col("source_line") - F.col("_first") + 1 + after
    return entries.join(placed, ["source_path", "source_id"]).select(number.alias("id"), *entries.columns)


#: Lines of a source that stay together when new ones are looked for.
BLOCK_LINES = 4096


def new_lines(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """The parsed lines (source_id, line_no, step) without a stored entry, each once, as of its first step.

    Lines and stored entries meet in blocks of neighbouring lines, with one shuffle and one sort. Neighbours are of the same
    days, by and large, so a task has rows of few days to write.
    """
    known = stored.select("source_id", F.col("source_line").alias("line_no")).dropna()
    both = parsed.withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    # The number of tasks is fixed: Spark would join small ones, and what is worked out for the new lines takes long.
    tasks = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumn("_block", F.floor(F.col("line_no") / BLOCK_LINES)).repartition(tasks, "source_id", "_block")
    # A stored entry comes before the lines of its number, so a line is left out if the row before it has that number.
    order = Window.partitionBy("source_id", "_block").orderBy("line_no", "_new", "step")
    before = F.lag(F.struct("line_no")).over(order)
    marked = both.withColumn("_before", before)
    fresh = marked.filter(F.col("_new") & (F.col("_before").isNull() | ~F.col("_before.line_no").eqNullSafe(F.col("line_no"))))
    return fresh.select(*parsed.columns)


def new_entries(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Entries whose (source_id, source_line) is not stored yet, each once."""
    return batch.dropDuplicates(["source_id", "source_line"]).join(
        stored.select("source_id", "source_line"), ["source_id", "source_line"], "left_anti"
    )


def audit_status(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Tracked files, also those without an entry, indexed rows and the newest times; `files` has one row a file."""
    zero = F.lit(0).cast("long")
    newest = [F.coalesce(F.max(c), zero).alias(f"last_{c}") for c in ("created_at", "ingested_at")]
    rows = entries.agg(zero.alias("tracked_files"), F.count("*").alias("indexed_rows"), *newest)
    tracked = files.agg(F.count("*").alias("tracked_files"), *[zero.alias(c) for c in rows.columns[1:]])
    return rows.union(tracked).agg(*[F.max(c).alias(c) for c in rows.columns])


def entry_by_id(entries: DataFrame, entry_id: int) -> DataFrame:
    return entries.filter(F.col("id") == entry_id).limit(1)


def stored_body(plain: Column, packed: Column, encoding: Column) -> Column:
    """Body text of a stored row: unpacked when it is marked as gzip and not empty, else the plain column."""
    import gzip

    @F.pandas_udf("string")
    def unpack(values):
        return values.map(lambda v: None if v is None else gzip.decompress(bytes(v)).decode("utf-8", "replace"))

    is_packed = (encoding == "gzip") & (F.length(packed) > 0)
    return F.coalesce(F.when(is_packed, unpack(F.when(is_packed, packed))), plain)
