"""Ranked lexical search over a length-stratified index.

A document's score for a term depends on its tf and on its normaliser m, a whole number that its length gives. The index is a
table of blocks; a block holds documents of one m, its stratum, or a part of them, and for each of its terms the postings by tf,
the largest tf first. So one impact holds for all postings of a term and a tf in a block: it is computed once, and the first
tf of a term gives the most that the term can add in the block. The sum of these over an item's terms bounds the block; an item
visits blocks from the highest bound on, and stops where the bound falls below its k-th best score so far.

Terms are known by 64-bit hashes of their bytes. Two of n terms share a hash with a probability of n^2 / 2^65 or so, and only
those of the items matter: for a billion terms in all and 10,000 asked for it is under 10^-6.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlens.llm.common import Words, byte_classes, longs, prepare, text_buffers
from meterlens.operators.ranking import top_per_group
from meterlens.session import ensure_checkpoint_dir

#: ASCII letters and digits and all other characters above ASCII make terms; A-Z count as a-z.
TERM_BYTES = byte_classes([b for b in range(128) if not chr(b).isalnum()])
K = 50
#: Most documents and postings of a block, and documents of a stratum that are sorted in one task.
BLOCK_DOCS, BLOCK_POSTINGS, SHARE_DOCS = 4096, 1 << 21, 4096
#: Bytes of blocks that a task holds to visit them in the order of their bounds.
HELD_BYTES = 64 << 20
#: Terms of items that are searched for at once; larger sets of items are searched in blocks of about as many.
QUERY_TERMS = 1 << 20
#: Salts of a search's tasks: their rows are cut to the best k by item and salt before they are by item.
SALTS = 256

STATISTICS = "n long, docs long"
FORWARD = "m long, doc_id long, terms binary, tfs binary"
#: Term t of a block has the runs term_runs[t] to term_runs[t + 1]; run r the postings run_posts[r] to run_posts[r + 1].
INDEX = (
    "m long, doc_ids array<long>, terms binary, dfs binary, term_runs binary, run_tfs binary, run_posts binary, posts binary"
)


def lengths(docs: DataFrame) -> DataFrame:
    """How many documents have how many terms; those without a term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(Words(*text_buffers(batch.column(0)), TERM_BYTES).first)
            n, docs_ = np.unique(counts[counts > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(docs_, pa.int64())], ["n", "docs"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, STATISTICS)
    return found.groupBy("n").agg(F.sum("docs").alias("docs"))


@dataclass(frozen=True)
class Corpus:
    """N, the documents with a term, and L, all their terms."""

    documents: int
    terms: int

    def normaliser(self, n):
        """m of a document of `n` terms; n is a number or an array."""
        return 50 + 50 * n * self.documents // self.terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def forward(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """The distinct terms of each document with their tf, and its m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*text_buffers(batch.column(1)), TERM_BYTES)
            rows, m, terms, tfs = [], [], [], []
            for i in np.flatnonzero(np.diff(words.first)).tolist():
                found, tf = np.unique(words.hash[words.first[i] : words.first[i + 1]], return_counts=True)
                rows.append(i)
                m.append(int(corpus.normaliser(int(words.first[i + 1] - words.first[i]))))
                terms.append(found.tobytes())
                tfs.append(tf.astype(np.uint32).tobytes())
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            columns = [pa.array(m, pa.int64()), ids, pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["m", "doc_id", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FORWARD)


def block(m: int, ids: list[int | None], terms: list[bytes], tfs: list[bytes]) -> dict:
    """The index row of documents of one m."""
    sizes = [len(x) // 8 for x in terms]
    term, tf = np.frombuffer(b"".join(terms), np.uint64), np.frombuffer(b"".join(tfs), np.uint32)
    doc = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
    order = np.lexsort((doc, ~tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    new_term = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    new_run = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])))
    return {
        "m": m,
        "doc_ids": ids,
        "terms": term[new_term].tobytes(),
        "dfs": np.diff(new_term, append=len(term)).astype(np.uint32).tobytes(),
        "term_runs": np.append(np.searchsorted(new_run, new_term), len(new_run)).astype(np.uint32).tobytes(),
        "run_tfs": tf[new_run].tobytes(),
        "run_posts": np.append(new_run, len(term)).astype(np.uint32).tobytes(),
        "posts": doc.tobytes(),
    }


def index_schema() -> pa.Schema:
    kinds = {"m": pa.int64(), "doc_ids": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.binary())) for c in INDEX.split(", ")])


def build(docs: DataFrame) -> tuple[DataFrame, Corpus] | None:
    """The blocks of all documents that have a term; None if there are none.

    Texts are read twice: for the lengths, which m needs, and for the terms. A stratum of many documents is dealt into shares
    by a hash of the document, so no task has more than its share of one, however many documents have one length.
    """
    prepare(docs.sparkSession)
    found = lengths(docs)
    total = found.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    if not total[0]:
        return None
    corpus = Corpus(*total)
    m = F.expr(f"50 + (50 * cast(n as decimal(20, 0)) * {corpus.documents}) div {corpus.terms}")
    strata = found.groupBy(m.alias("m")).agg(F.ceil(F.sum("docs") / SHARE_DOCS).alias("shares"))
    share = F.pmod(F.xxhash64("doc_id", "terms"), F.col("shares"))
    dealt = forward(docs, corpus).join(strata, "m").select("m", share.alias("share"), "doc_id", "terms", "tfs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = index_schema()
        at, ids, terms, tfs, postings = None, [], [], [], 0
        for batch in batches:
            for m, share, doc_id, term, tf in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and ((m, share) != at or len(ids) == BLOCK_DOCS or postings >= BLOCK_POSTINGS):
                    yield pa.RecordBatch.from_pylist([block(at[0], ids, terms, tfs)], schema)
                    ids, terms, tfs, postings = [], [], [], 0
                at = (m, share)
                ids.append(doc_id)
                terms.append(term)
                tfs.append(tf)
                postings += len(tf) // 4
        if ids:
            yield pa.RecordBatch.from_pylist([block(at[0], ids, terms, tfs)], schema)

    ranged = dealt.repartition("m", "share").sortWithinPartitions("m", "share", "doc_id")
    return ranged.mapInArrow(run, INDEX), corpus


def write_index(docs: DataFrame, path: str) -> Corpus | None:
    """Write the blocks as Parquet; None, and nothing written, if no document has a term."""
    found = build(docs)
    if found is None:
        return None
    found[0].write.mode("overwrite").parquet(path)
    return found[1]


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct terms of each row of `items` (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(*text_buffers(batch.column(1)), TERM_BYTES)
            terms = [longs(np.unique(words.hash[a:b])).tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, terms array<long>")
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def document_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many documents hold each of the sorted `terms`; only the index's terms and their counts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for there, dfs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known, place = places(np.frombuffer(there, np.uint64), terms)
                total[known] += np.frombuffer(dfs, np.uint32)[place]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "dfs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def places(there: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted `terms` are among the sorted `there`, and where."""
    at = np.searchsorted(there, terms)
    known = np.flatnonzero(there[np.minimum(at, len(there) - 1)] == terms)
    return known, at[known]


@dataclass
class Queries:
    """Items over sorted terms: item i asks for terms[asked[first[i] : first[i + 1]]]. Every item asks for a term at least."""

    ids: list
    terms: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    asked: np.ndarray


class Block:
    """One block as the queries see it: postings with their impacts, and what each term adds at most."""

    def __init__(self, row: dict, queries: Queries):
        m = row["m"]
        self.size = sum(len(x) for x in row.values() if isinstance(x, bytes)) + 8 * len(row["doc_ids"])
        self.ids = np.array([0 if i is None else i for i in row["doc_ids"]], np.int64)
        self.no_id = np.array([i is None for i in row["doc_ids"]])
        known, place = places(np.frombuffer(row["terms"], np.uint64), queries.terms)
        term_runs = np.frombuffer(row["term_runs"], np.uint32).astype(np.int64)
        run_tfs = np.frombuffer(row["run_tfs"], np.uint32).astype(np.int64)
        run_posts = np.frombuffer(row["run_posts"], np.uint32).astype(np.int64)
        self.posts = np.frombuffer(row["posts"], np.uint16)
        most = np.zeros(len(queries.terms), np.int64)
        most[known] = queries.weights[known] * impact(run_tfs[term_runs[place]], m)
        self.bounds = np.add.reduceat(most[queries.asked], queries.first[:-1])
        # One impact a term and tf, written to the postings of the terms asked for.
        self.start, self.end = np.zeros(len(queries.terms), np.int64), np.zeros(len(queries.terms), np.int64)
        self.start[known], self.end[known] = run_posts[term_runs[place]], run_posts[term_runs[place + 1]]
        self.impacts = np.zeros(len(self.posts))
        for weight, low, high in zip(queries.weights[known], term_runs[place], term_runs[place + 1], strict=True):
            values = weight * impact(run_tfs[low:high], m)
            self.impacts[run_posts[low] : run_posts[high]] = np.repeat(values, np.diff(run_posts[low : high + 1]))

    def scores(self, asked: np.ndarray) -> np.ndarray:
        """Every document's score. Sums of whole numbers below 2^53 are exact in doubles."""
        spans = [(a, b) for a, b in zip(self.start[asked].tolist(), self.end[asked].tolist(), strict=True) if b > a]
        docs = np.concatenate([self.posts[a:b] for a, b in spans])
        impacts = np.concatenate([self.impacts[a:b] for a, b in spans])
        return np.bincount(docs, weights=impacts, minlength=len(self.ids)).astype(np.int64)


class Best:
    """The best k documents of each item that a task has met: higher score, then smaller id, documents without one last."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        n = len(queries.ids)
        empty = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        self.found = [empty] * n
        self.least = np.ones(n, np.int64)
        self.visits = 0

    def meet(self, blocks: list[Block]) -> None:
        """Visit the blocks, for each item from the highest bound on while a block can hold one of its best."""
        bounds = np.array([b.bounds for b in blocks])
        order = np.argsort(-bounds, axis=0, kind="stable")
        for i in range(len(self.queries.ids)):
            asked = self.queries.asked[self.queries.first[i] : self.queries.first[i + 1]]
            for b in order[:, i].tolist():
                if bounds[b, i] < self.least[i]:
                    break
                self._visit(i, blocks[b], asked)

    def _visit(self, i: int, block_: Block, asked: np.ndarray) -> None:
        self.visits += 1
        scores = block_.scores(asked)
        some = np.flatnonzero(scores >= self.least[i])
        if not len(some):
            return
        ids, none, score = self.found[i]
        ids, none = np.append(ids, block_.ids[some]), np.append(none, block_.no_id[some])
        score = np.append(score, scores[some])
        order = np.lexsort((ids, none, -score))[: self.k]
        self.found[i] = ids[order], none[order], score[order]
        if len(order) == self.k:
            self.least[i] = score[order[-1]]


def search_blocks(index: DataFrame, queries: Queries, k: int, kind: str) -> DataFrame:
    """Each task's best k of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size, ids = Best(queries, k), [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                held.append(Block(row, queries))
                size += held[-1].size
                if size >= HELD_BYTES:
                    best.meet(held)
                    held, size = [], 0
        if held:
            best.meet(held)
        items = [i for i, found in enumerate(best.found) for _ in found[0]]
        ids, none, scores = (np.concatenate([f[c] for f in best.found]) for c in range(3))
        columns = [pa.array([queries.ids[i] for i in items], item_type), pa.array(ids, pa.int64(), mask=none), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])

    item_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    narrow = index.select("m", "doc_ids", "terms", "term_runs", "run_tfs", "run_posts", "posts")
    return narrow.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def queries_of(pairs: list[tuple], index: DataFrame, corpus: Corpus) -> Queries | None:
    """The items of (item, term) pairs over the index's terms. None if no term is in the index."""
    terms = np.unique(np.array([t for _, t in pairs], np.int64).view(np.uint64))
    dfs = document_frequencies(index, terms)
    weights = np.array([corpus.weight(int(df)) if df else 0 for df in dfs], np.int64)
    asked: dict[object, list[int]] = {}
    for item, term in pairs:
        place = int(np.searchsorted(terms, np.int64(term).view(np.uint64)))
        if weights[place]:
            asked.setdefault(item, []).append(place)
    if not asked:
        return None
    ids = sorted(asked, key=lambda i: (i is None, i))
    first = np.cumsum([0, *(len(asked[i]) for i in ids)])
    return Queries(ids, terms, weights, first, np.array([p for i in ids for p in sorted(asked[i])], np.int64))


def search(index: DataFrame, corpus: Corpus, items: DataFrame, k: int = K) -> DataFrame:
    """The `k` best documents of each item: item_id, rank (from 1), doc_id, score.

    Rows of one item_id make one item with the terms of all of them, also those without an id. Items that match nothing give
    no rows. The items are the stated query set; they are met in blocks of about `QUERY_TERMS` terms.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    pairs = item_terms(items)
    blocks = max(1, -(-pairs.count() // QUERY_TERMS))
    parts = []
    for b in range(blocks):
        some = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        queries = queries_of([(r["item_id"], r["term"]) for r in some], index, corpus) if some else None
        if queries is not None:
            parts.append(search_blocks(index, queries, k, kind))
    if not parts:
        return no_rows(items)
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("_salt", F.spark_partition_id() % SALTS)
    few = top_per_group(salted, ["item_id", "_salt"], order, k, "_rank").drop("_rank")
    return top_per_group(few, ["item_id"], order, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def no_rows(items: DataFrame) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()
    return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index all of `docs` (doc_id, text) in the session's shared folder and rank them for each of `items` (item_id, text).

    Texts that are null or have no term are in no count and no result. Rows that repeat a doc_id are documents of their own;
    documents without one take part and come last among equal scores. Empty tables give no rows; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/lexical-{uuid.uuid4().hex}"
    corpus = write_index(docs, path)
    return no_rows(items) if corpus is None else search(spark.read.parquet(path), corpus, items, k)
