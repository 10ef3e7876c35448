"""Reviewing audit entries as they arrive.

What a batch needs of earlier ones it looks up by name. The index has one row for each reviewed request: the digest of its
messages, its place among the requests of its key, and how it was decided, in folders by a hash of the digest. A request can only
continue one whose digest is that of one of its own prefixes, so a batch reads the folders of its prefixes; parents bring their
decisions with them. Results lie in folders by a hash of the content. The states of the keys, one row a key, and the newest
requests before the scope, fifty a key, are rewritten by each batch. Entries are read only if one comes late: then those of its
key from its time on, by day.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlens import schemas
from meterlens.functions.stage import pinned
from meterlens.operators.ranking import running_total, top_per_group
from meterlens.operators.review_plan import ReviewScope, eligible, in_scope, longest_prefix, planned, prefix_digests
from meterlens.operators.review_score import Scorer
from meterlens.plans.review_run import run_plan
from meterlens.session import cut_lineage

from .store import day_of, read_table, write_batch, write_folders

# What `reviewed` gives before the first batch: the columns that chains of parents need.
FINAL = (
    "audit_entry_id long, created_at long, effective_decision string, effective_risk_score int, "
    "effective_result_hash string"
)
#: Folders of the index and of the results. They are named in the tables, so changing this takes a new table.
BUCKETS = 256
INDEX = (
    "token_id long, length int, digest binary, id long, created_at long, seq long, "
    "effective_decision string, effective_risk_score int, effective_result_hash string"
)
# How many non-empty requests a key has in scope, and its last request.
KEYS = "token_id long, requests long, last_at long, last_id long"
ANCHORS = "token_id long, length int, digest binary, id long, created_at long"


def reviewed(spark: SparkSession, final_path: str) -> DataFrame:
    """Every reviewed request once, as the last batch that reviewed it left it."""
    try:
        rows = spark.read.parquet(final_path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], FINAL)
    columns = [c for c in rows.columns if c not in ("audit_entry_id", "batch_id")]
    last = rows.groupBy("audit_entry_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("_last"))
    return last.select("audit_entry_id", *[F.col(f"_last.{c}").alias(c) for c in columns])


def bucket_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def write_results(results: DataFrame, path: str, batch_id: int) -> None:
    """Add results to the cache, in folders by their content."""
    write_folders(results.withColumn("bucket", bucket_of(F.col("content_hash"))), path, batch_id, "bucket")


def read_buckets(spark: SparkSession, path: str, schema: str, keys: DataFrame, column: str, batch_id: int) -> DataFrame:
    """The rows whose `column` is one of `keys`, without those of the batch; only folders that a key names are read."""
    named = [r[0] for r in keys.select(bucket_of(F.col(column))).distinct().collect()]  # at most BUCKETS numbers
    rows = read_table(spark, path, f"{schema}, bucket int", batch_id, keep="batch_id")
    return rows.filter(F.col("bucket").isin(named)).join(keys.select(column).distinct(), column, "left_semi").drop("bucket")


def _slot(path: str, batch_id: int) -> str:
    return f"{path}/slot={batch_id % 2}"


def read_state(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """The state as the batch before this one left it; it lies where this batch does not write."""
    return read_table(spark, _slot(path, batch_id - 1), schema)


def write_state(state: DataFrame, path: str, batch_id: int) -> None:
    cut_lineage(state).write.mode("overwrite").parquet(_slot(path, batch_id))


def _last() -> Column:
    return F.struct(F.col("last_at").alias("created_at"), F.col("last_id").alias("id"))


def digests(entries: DataFrame) -> DataFrame:
    """Requests with the digests of their prefixes; one without messages has none, and is known by its id."""
    rows = entries.withColumn("prefixes", pinned(prefix_digests(F.col("messages")))).withColumn("length", F.size("prefixes"))
    own = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    return rows.withColumn("digest", F.when(F.col("length") > 0, F.try_element_at("prefixes", F.lit(-1))).otherwise(own))


def _newest_anchors(spark: SparkSession, new: DataFrame, scope: ReviewScope, path: str, batch_id: int) -> DataFrame:
    """The newest requests of each key before the scope begins, with those of this batch."""
    names = [c.split()[0] for c in ANCHORS.split(", ")]
    stored = read_state(spark, path, ANCHORS, batch_id)
    earlier = digests(eligible(new, scope).filter(F.col("created_at") < scope.start)).select(*names)
    newest = [F.desc("created_at"), F.desc("id")]
    every = stored.unionByName(earlier).dropDuplicates(["id"])
    return cut_lineage(top_per_group(every, ["token_id"], newest, scope.anchor_entries, "anchor_rank"))


def review_batch(
    new: DataFrame,
    batch_id: int,
    scope: ReviewScope,
    scorer: Scorer,
    config: str,
    entries_path: str,
    results_path: str,
    final_path: str,
    index_path: str,
) -> None:
    """Review the new entries, and again what follows them in the history of their keys.

    An entry that was reviewed before is new to nobody. One that comes late can be the parent of requests that were
    reviewed without it, so the requests of its key from its time on are planned anew and replace their rows; requests
    before it stand, and chains of parents go on from their stored decisions. So the rows are those of one run over all
    entries, however these are cut into batches. Contents that were scored come from the result cache.
    """
    spark, scope = new.sparkSession, scope.checked()
    prefixes_path, keys_path, anchors_path = (f"{index_path}/{name}" for name in ("prefixes", "keys", "anchors"))
    anchors = _newest_anchors(spark, new, scope, anchors_path, batch_id)
    write_state(anchors.drop("anchor_rank"), anchors_path, batch_id)
    names = ["id", "token_id", "created_at", "model", "messages", "prefixes", "length", "digest"]
    arrived = cut_lineage(digests(in_scope(new, scope).dropDuplicates(["id"])).select(*names))
    known = read_buckets(spark, prefixes_path, INDEX, arrived, "digest", batch_id).select("id").distinct()
    fresh = arrived.join(known, "id", "left_anti")
    since = fresh.groupBy("token_id").agg(F.min(F.struct("created_at", "id")).alias("first"))
    keys = cut_lineage(read_state(spark, keys_path, KEYS, batch_id))
    since = since.join(keys, "token_id", "left").withColumn("late", _last() > F.col("first"))
    since = cut_lineage(since.withColumn("late", F.coalesce("late", F.lit(False))))
    if since.isEmpty():
        write_state(keys, keys_path, batch_id)
        return
    asked = fresh
    first_late = since.filter("late").agg(F.min("first")).first()[0]
    if first_late is not None:
        late = since.filter("late").select("token_id", "first")
        stored = read_table(spark, entries_path, schemas.AUDIT_ENTRIES, keep="event_date")
        stored = stored.filter(F.col("event_date") >= day_of(F.lit(first_late["created_at"])))
        again = in_scope(stored, scope).dropDuplicates(["id"]).join(late, "token_id")
        again = digests(again.filter(F.struct("created_at", "id") >= F.col("first"))).select(*names)
        # What was stored after this batch was formed comes with a batch of its own. Only the digests are written for the look-up.
        named = cut_lineage(again.select("digest").distinct())
        reviewed_ids = read_buckets(spark, prefixes_path, INDEX, named, "digest", batch_id).select("id").distinct()
        again = again.join(fresh.select("id"), "id", "left_anti").join(reviewed_ids, "id", "left_semi")
        asked = fresh.unionByName(again)
    asked = cut_lineage(asked)

    # Places go on from the number of requests of the key that stand before the first one of this batch.
    filled = asked.filter("length > 0")
    counts = filled.join(fresh.select("id", F.lit(True).alias("is_fresh")), "id", "left").groupBy("token_id")
    counts = counts.agg(F.count_if(F.col("is_fresh").isNull()).alias("old"), F.count("*").alias("all"))
    zero = F.lit(0).cast("long")
    before = F.coalesce("requests", zero) - F.coalesce("old", zero)
    bases = cut_lineage(since.join(counts, "token_id", "left").withColumn("base", before))
    order = [F.col("created_at"), F.col("id")]
    places = running_total(filled.select("id", "token_id", "created_at"), ["token_id"], order, F.lit(1).cast("long"), "place")
    places = places.join(bases.select("token_id", "base"), "token_id").select("id", (F.col("base") + F.col("place") + 1).alias("seq"))
    filled = cut_lineage(filled.join(places, "id").select("id", "token_id", "created_at", "seq", "length", "prefixes", "digest"))

    # Requests before the first one that equal a prefix of a planned one, and the anchors, whose places end at 0.
    wanted = filled.select("token_id", F.explode("prefixes").alias("digest")).distinct()
    earlier = read_buckets(spark, prefixes_path, INDEX, wanted, "digest", batch_id)
    earlier = earlier.join(wanted, ["token_id", "digest"], "left_semi")
    columns = [c for c in earlier.columns if c not in ("id", "batch_id")]
    earlier = earlier.groupBy("id").agg(F.max_by(F.struct(*columns), "batch_id").alias("r")).select("id", "r.*")
    earlier = earlier.join(bases.select("token_id", "base", "first"), "token_id")
    in_reach = (F.col("seq") > F.col("base") - scope.branch_history) & (F.struct("created_at", "id") < F.col("first"))
    earlier = cut_lineage(earlier.filter(in_reach & (F.col("length") > 0)).drop("base", "first"))
    newest = Window.partitionBy("token_id").orderBy(F.desc("created_at"), F.desc("id"))
    anchored = anchors.filter("length > 0").withColumn("seq", (1 - F.row_number().over(newest)).cast("long"))
    fields = ["id", "token_id", "seq", "length"]
    candidates = earlier.select(*fields, "digest").unionByName(anchored.select(*fields, "digest"))
    ordered = filled.select(*fields, "prefixes", F.lit(True).alias("reviewed")).unionByName(
        candidates.select(*fields, F.array("digest").alias("prefixes"), F.lit(False).alias("reviewed"))
    )
    plan = cut_lineage(planned(asked, longest_prefix(ordered, scope.branch_history), replace(scope, job_id=batch_id)))

    contents = plan.filter("content_hash <> ''").select("content_hash").distinct()
    cache = read_buckets(spark, results_path, schemas.REVIEW_RESULTS, contents, "content_hash", batch_id).drop("batch_id")
    standing = earlier.select(F.col("id").alias("audit_entry_id"), *[c.split()[0] for c in FINAL.split(", ")[1:]])
    run = run_plan(plan, cache, scorer, config, before=standing)
    write_results(run.results, results_path, batch_id)
    final = cut_lineage(run.final)
    write_batch(final, final_path, batch_id)
    decided = final.select(F.col("audit_entry_id").alias("id"), *[c for c in final.columns if c.startswith("effective_")])
    rows = asked.join(filled.select("id", "seq"), "id", "left").join(decided, "id")
    rows = rows.select(*[c.split()[0] for c in INDEX.split(", ")]).withColumn("bucket", bucket_of(F.col("digest")))
    write_folders(rows, prefixes_path, batch_id, "bucket")
    last = asked.groupBy("token_id").agg(F.max(F.struct("created_at", "id")).alias("newest"))
    touched = bases.join(last, "token_id").select(
        "token_id",
        (F.col("base") + F.coalesce("all", zero)).alias("requests"),
        F.greatest(F.col("newest"), _last()).alias("l"),
    )
    touched = touched.select("token_id", "requests", F.col("l.created_at").alias("last_at"), F.col("l.id").alias("last_id"))
    write_state(keys.join(touched, "token_id", "left_anti").unionByName(touched), keys_path, batch_id)


def start_review(
    spark: SparkSession,
    entries_path: str,
    scope: ReviewScope,
    scorer: Scorer,
    config: str,
    results_path: str,
    final_path: str,
    index_path: str,
    checkpoint: str,
    *,
    once: bool = False,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Follow the entry table and review every batch of new files; `reviewed` reads the results."""
    stream = spark.readStream.schema(schemas.AUDIT_ENTRIES + ", event_date date, batch_id long")
    entries = stream.option("maxFilesPerTrigger", files_per_batch).parquet(entries_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        review_batch(batch, batch_id, scope, scorer, config, entries_path, results_path, final_path, index_path)

    writer = entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": "10 seconds"})).start()
