"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts are sequences of words (letters and digits of any script, folded). A seed is the hash of six of up to ten words in a
row; its mask says which, and the words between are ignored. The three masks were chosen so that of any 15 words with up to
two substituted ones at least one seed is whole. Seeds of documents and of benchmark items are joined on the hash; hits of
one document and item with the same offset lie on one diagonal. There the words are compared one by one, and the stretch
with the best score (a match counts 1, a substitution -3) is reported if it is long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlens.llm.common import cut, prepare

#: Word places that a seed reads, from its first word on.
MASKS = ((0, 1, 4, 5, 8, 9), (0, 2, 4, 5, 7, 8), (0, 2, 3, 7, 8, 9))
SPAN = 1 + max(m[-1] for m in MASKS)
#: A stretch is reported if it has this many equal words, or if it covers `COVERAGE` of the item with at least `SPAN`.
MATCHED, COVERAGE = 13, 0.8
#: Items are sent to every task up to this many bytes of text; beyond it the join is shuffled.
BROADCAST_BYTES = 8 << 20
#: Diagonals (five numbers each) are sent to every task up to this many; beyond it the texts are shuffled to them.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """The words of a text; punctuation and white space part them."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seed_rows(rows: DataFrame, *ids: str) -> DataFrame:
    """(ids, place, seed) of rows (ids, words): a seed for each mask and word where the mask ends within the text."""
    hashed = rows.select(*ids, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    each = hashed.select(*ids, "h", F.posexplode("h").alias("place", "first"))

    def seed(number: int, mask: tuple[int, ...]) -> Column:
        parts = [F.get("h", F.col("place") + p) for p in mask]
        return F.when(F.col("place") + mask[-1] < F.size("h"), F.xxhash64(F.lit(number), *parts))

    seeds = F.array(*[seed(i, mask) for i, mask in enumerate(MASKS)])
    return each.select(*ids, "place", F.explode(seeds).alias("seed")).filter("seed is not null")


def best_stretch(equal: Column) -> Column:
    """(score, matched, start, end) of the best stretch of an array of booleans; of equal ones the first to end, the longest."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("score", "matched", "start", "end")])
    begin = F.struct(F.lit(0).alias("at"), zero.alias("run"), zero.alias("best"))

    def step(acc: Column, same: Column) -> Column:
        run, best, at = acc["run"], acc["best"], acc["at"]
        gain = F.when(same, 1).otherwise(-3)
        fresh = run["score"] < 0
        now = F.struct(
            (F.when(fresh, 0).otherwise(run["score"]) + gain).alias("score"),
            (F.when(fresh, 0).otherwise(run["matched"]) + F.when(same, 1).otherwise(0)).alias("matched"),
            F.when(fresh, at).otherwise(run["start"]).alias("start"),
            (at + 1).alias("end"),
        )
        better = now["score"] > best["score"]
        return F.struct((at + 1).alias("at"), now.alias("run"), F.when(better, now).otherwise(best).alias("best"))

    return F.aggregate(equal, begin, step, lambda acc: acc["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, length, item_words, word_start, word_end, item_start): the best stretch of each document
    and item, word places counted from 0, the end exclusive.

    Of stretches with equal scores the first in the document is reported. Null and empty texts, and documents or items of
    fewer than nine words, which no seed fits, overlap with nothing; nor do rows without an id. Rows that repeat a doc_id or
    an item_id count as one document or item with several texts. Empty tables give an empty result; other columns are not
    looked at.
    """
    prepare(docs.sparkSession)
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", words_of(F.col("text")).alias("item"))
    items = items.withColumn("item_words", F.size("item"))
    item_bytes = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    small = F.broadcast if item_bytes <= BROADCAST_BYTES else lambda df: df
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")

    item_seeds = seed_rows(items.withColumnRenamed("item", "words"), "item_id").withColumnRenamed("place", "item_place").distinct()
    doc_seeds = seed_rows(texts.select("doc_id", words_of(F.col("text")).alias("words")), "doc_id")
    hits = doc_seeds.join(small(item_seeds), "seed")
    diagonals = cut(hits.groupBy("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.count("*").alias("hits")))

    # Texts of the documents that were hit are read again: words never travel with the seeds.
    few = F.broadcast if diagonals.count() <= BROADCAST_ROWS else lambda df: df
    found = texts.join(few(diagonals), "doc_id").join(small(items), "item_id")
    found = found.withColumn("words", words_of(F.col("text"))).drop("text")
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.col("item_words"), F.size("words") - F.col("shift"))
    equal = F.when(
        high > low,
        F.transform(F.sequence(low, high - 1), lambda q: F.get(F.col("words"), q + F.col("shift")) == F.get(F.col("item"), q)),
    ).otherwise(F.array().cast("array<boolean>"))
    found = found.select("doc_id", "item_id", "shift", "item_words", low.alias("low"), best_stretch(equal).alias("b"))
    enough = (F.col("b.matched") >= MATCHED) | (
        (F.col("b.matched") >= SPAN) & (F.col("b.matched") >= COVERAGE * F.col("item_words"))
    )
    kept = found.filter(enough).select(
        "doc_id",
        "item_id",
        F.col("b.matched").cast("long").alias("matched"),
        (F.col("b.end") - F.col("b.start")).cast("long").alias("length"),
        F.col("item_words").cast("long").alias("item_words"),
        (F.col("low") + F.col("shift") + F.col("b.start")).cast("long").alias("word_start"),
        (F.col("low") + F.col("shift") + F.col("b.end")).cast("long").alias("word_end"),
        (F.col("low") + F.col("b.start")).cast("long").alias("item_start"),
        F.col("b.score").alias("score"),
    )
    fields = [c for c in kept.columns if c not in ("doc_id", "item_id")]
    order = F.struct(-F.col("score"), "word_start", "item_start", "word_end")
    best = kept.groupBy("doc_id", "item_id").agg(F.min_by(F.struct(*fields), order).alias("b"))
    return best.select("doc_id", "item_id", *[f"b.{c}" for c in fields if c != "score"])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose document overlaps with no benchmark item. Rows without doc_id stay."""
    hit = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
