"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles of `words` words. 150 hash functions give the minima; five minima make the
key of a band, and two documents that share a band are candidates. Two low bits of each minimum, packed into five longs,
give the similarity estimate: two unrelated minima agree by chance in a quarter of the cases, so the share of agreeing
pairs of bits is corrected by that. Candidates whose estimate is not far below the limit are confirmed on their full
sets, and confirmed links make groups.

No group is expanded into all its pairs. Documents with equal sets become one class, and only its smallest doc_id goes
on. In a band bucket every member is compared with the smallest member; the links found make components; only members
of different components that still share a bucket and are similar by their bits are then compared, and of these only the
pairs that share one of their rarest shingles, which linked sets always do, and that are similar by the bits of eight times as
many minima: in a group of copies of copies most pairs lie a little below the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterlens.llm.common import Words, byte_classes, cut, grams, longs, numbers, prepare, text_buffers

#: Minima in a band, and bands. A link at similarity 0.8 shares no band with probability (1 - 0.8^5)^30 < 7e-6.
ROWS, BANDS = 5, 30
BITS = 2
SEPARATORS = (0x20, *range(0x09, 0x0E))
#: Estimates that lie lower than the limit by this much are not confirmed: five standard deviations of 150 minima.
SLACK = 0.2
#: Minima of undecided sets only, and five standard deviations of these.
MORE, MORE_SLACK = 1200, 0.07
#: Edges of a task while groups are found, and up to which the smallest neighbours are sent to every task.
EDGES = 250_000
#: Ids of eight bytes that a broadcast may hold.
BROADCAST_IDS = 1_000_000
#: Rarest shingles that are kept beside each of a set's rare shingles.
HEAD = 16


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """Row by row the sorted distinct hashes of k words; of the whole sequence where a row has fewer."""
    whole = grams(words, k)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            few = words.hash[a:b] * (numbers(4, k)[: b - a] | np.uint64(1))
            yield np.array([few.sum(dtype=np.uint64) ^ numbers(5, k)[b - a - 1]], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def minima(hashes: np.ndarray, count: int = ROWS * BANDS, seed: int = 6) -> np.ndarray:
    """The minima of a set that is not empty, by `count` hash functions."""
    factors = (numbers(seed, count) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (numbers(seed + 1, count) >> np.uint64(32)).astype(np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (x[i : i + 256, None] * factors + shifts).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64) * (numbers(8, ROWS) | np.uint64(1))
    h = rows.sum(axis=1, dtype=np.uint64) + numbers(9, BANDS)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


def longs_of(count: int) -> int:
    """Longs that hold the packed bits of so many minima."""
    return -(-count * BITS // 64)


def low_bits(least: np.ndarray) -> np.ndarray:
    """The packed low bits; places without a minimum are 0 in every document."""
    wide = np.zeros(32 * longs_of(len(least)), np.uint64)
    wide[: len(least)] = least & np.uint32(3)
    places = np.arange(32, dtype=np.uint64) * np.uint64(BITS)
    return (wide.reshape(-1, 32) << places).sum(axis=1, dtype=np.uint64)


def sum_of(hashes: np.ndarray) -> int:
    """A number that stands for a set."""
    return int(longs(hashes.sum(dtype=np.uint64, keepdims=True))[0])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a number that stands for the set, band keys and packed bits of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = byte_classes(SEPARATORS)
        for batch in batches:
            data, ends = text_buffers(batch.column(1))
            n, one, bands, bits = [], [], [], []
            for s in shingles(Words(data, ends, kind), words):
                n.append(len(s))
                one.append(sum_of(s))
                least = minima(s) if len(s) else None
                bands.append(longs(band_keys(least)) if len(s) else [])
                bits.append(longs(low_bits(least)) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64())]
                + [pa.array(x, pa.list_(pa.int64())) for x in (bands, bits)],
                ["doc_id", "n_shingles", "node", "bands", "bits"],
            )

    schema = "doc_id long, n_shingles long, node long, bands array<long>, bits array<long>"
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def estimate(a: str, b: str, count: int = ROWS * BANDS):
    """Similarity of two documents by the packed bits of `count` minima, corrected for agreement by chance."""
    differ = F.lit(0)
    for i in range(longs_of(count)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(either)
    chance = 1.0 / (1 << BITS)
    return (1 - differ / F.lit(float(count)) - chance) / (1 - chance)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the given distinct doc_ids. Up to `BROADCAST_IDS` of them are sent to every task, so that other
    texts are left where they are read; more are joined by a shuffle."""
    ids = cut(ids)
    few = F.broadcast if ids.count() <= BROADCAST_IDS else lambda df: df
    return docs.select("doc_id", "text").join(few(ids), "doc_id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The links (a, b) of `pairs` (a, b, doc_a, doc_b) whose full sets have 100 * common >= percent * union.

    a and b stand for sets, doc_a and doc_b for documents that have them. Texts of another row with the same doc_id are
    recognised by their set and left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = byte_classes(SEPARATORS)
        for batch in batches:
            left, right = (list(shingles(Words(*text_buffers(batch.column(i)), kind), words)) for i in (2, 3))
            linked = []
            for x, y, a, b in zip(left, right, batch.column(0).to_numpy(), batch.column(1).to_numpy(), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                right_texts = sum_of(x) == a and sum_of(y) == b
                linked.append(right_texts and 100 * common >= percent * (len(x) + len(y) - common))
            links = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
            yield links.filter(pa.array(linked, pa.bool_()))

    pairs = cut(pairs)
    texts = texts_of(docs, pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct())
    both = pairs.join(texts.toDF("doc_a", "text_a"), "doc_a").join(texts.toDF("doc_b", "text_b"), "doc_b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def sharing_rare(nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b, doc_a, doc_b) of `nodes` in different components that can be linked, by their rarest shingles.

    Two sets of which one has n shingles share at least percent * n / 100 of them if they are linked. So if both are
    sorted from rare to common among `nodes`, each has one of the shared ones within the first n + 1 minus that number.
    A set that is only nearly similar to very many has more shingles of its own than that, and meets nobody here. Pairs that
    meet are held against the bits of `MORE` minima of their sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = byte_classes(SEPARATORS)
        for batch in batches:
            sets = list(shingles(Words(*text_buffers(batch.column(1)), kind), words))
            sets = [s if sum_of(s) == a else s[:0] for s, a in zip(sets, batch.column(0).to_numpy(), strict=True)]
            sizes = [len(s) for s in sets]
            columns = [np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(sizes, sizes), longs(np.concatenate([np.zeros(0, np.uint64), *sets]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "size", "shingle"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = byte_classes(SEPARATORS)
        for batch in batches:
            sets = shingles(Words(*text_buffers(batch.column(1)), kind), words)
            known = [(a, s) for a, s in zip(batch.column(0).to_pylist(), sets, strict=True) if len(s) and sum_of(s) == a]
            bits = [longs(low_bits(minima(s, MORE, 10))) for _, s in known]
            columns = [pa.array([a for a, _ in known], pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "bits"])

    texts = texts_of(docs, nodes.select("doc_id").distinct()).dropDuplicates(["doc_id", "text"])
    texts = cut(nodes.select("node", "doc_id").join(texts, "doc_id").select("node", "text"))
    spread = cut(texts.mapInArrow(run, "node long, size long, shingle long"))
    signed = cut(texts.mapInArrow(sign, "node long, bits array<long>").dropDuplicates(["node"]))
    common = spread.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    shared = spread.join(common, "shingle")
    own = Window.partitionBy("node")
    needed = F.floor((F.lit(percent) * F.col("size") + 99) / 100)
    # Shingles that no other node has come first and need not be looked at.
    first = F.col("size") - needed + 1 - (F.col("size") - F.count("*").over(own))
    rank = F.row_number().over(own.orderBy("df", "shingle"))
    place = F.col("size") - F.count("*").over(own) + rank
    prefix = shared.withColumns({"first": first, "rank": rank, "place": place}).filter("rank <= first")
    prefix = cut(prefix.select("node", "size", "shingle", "place", "rank"))
    # A pair is taken up at the first shingle that it shares, as far as the first `HEAD` of each tell which that is.
    ordered = F.array_sort(F.collect_list(F.struct("rank", "shingle")))
    heads = prefix.filter(F.col("rank") <= HEAD).groupBy("node").agg(F.transform(ordered, lambda s: s["shingle"]).alias("head"))
    prefix = prefix.drop("rank").join(heads, "node")
    prefix = cut(prefix.join(nodes.select("node", "component"), "node"))
    several = prefix.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    prefix = prefix.join(several.filter("low <> high").select("shingle"), "shingle").join(nodes.select("node", "doc_id").join(signed, "node"), "node")
    x, y = prefix.alias("x"), prefix.alias("y")
    near = (
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * percent)
        # Nothing before the first shared shingle is shared, so enough must be left from it on in both sets.
        & (
            (1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))) * (100 + percent)
            >= (F.col("x.size") + F.col("y.size")) * percent
        )
        & (estimate("x.bits", "y.bits", MORE) >= percent / 100 - MORE_SLACK)
        & (F.coalesce(F.get(F.array_intersect("x.head", "y.head"), F.lit(0)), F.col("x.shingle")) == F.col("x.shingle"))
    )
    ends = {"a": "x.node", "b": "y.node", "doc_a": "x.doc_id", "doc_b": "y.doc_id"}
    return x.join(y, near).select(*[F.col(c).alias(name) for name, c in ends.items()]).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the smallest node reachable, by alternating stars.

    Each round hangs the larger neighbours of a node, then the smaller ones, on its smallest neighbour, until nothing
    changes: a logarithmic number of rounds. Hubs are aggregated before they are shuffled and joined by equal keys.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    def star(df: DataFrame, few) -> DataFrame:
        """Every (a, b) with the smallest neighbour of a, or a itself if that is smaller."""
        least = df.groupBy("a").agg(F.min("b").alias("least"))
        return df.join(few(least), "a").withColumn("least", F.least("a", "least"))

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = state(edges)
    while before[0]:
        # Few edges need few tasks, and their smallest neighbours fit into every task; more are joined by a shuffle.
        few = F.broadcast if before[0] <= EDGES else lambda df: df
        edges = edges.coalesce(1 + before[0] // EDGES)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, few).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter("a <> b").distinct()
        small = star(large, few)
        small = small.select(F.col("b").alias("a"), F.col("least").alias("b")).union(small.select("a", "least"))
        edges = cut(small.filter("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id and kept (doc_id = component_id).

    Documents are linked if 100 * common >= percent * union of their shingle sets; component_id is the smallest doc_id
    of the group. Null or wordless texts have an empty set and are linked with nothing. Rows that repeat a doc_id are
    compared as documents of their own and meet again in the group of that id. Rows without doc_id keep null as their
    component_id and are kept; they are not compared. Other columns of `docs` are not looked at. An empty table gives an
    empty result.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(signatures(known, words))
    filled = base.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = cut(filled.join(classes, ["node", "doc_id"]).dropDuplicates(["node"]).select("node", "doc_id", "bands", "bits"))
    # A band's number is part of its key.
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last"))
    shared = shared.filter("center <> last").drop("last")
    members = cut(rows.join(shared, "key"))
    light = nodes.drop("bands")
    limit = percent / 100 - SLACK

    def with_documents(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(light.toDF(side, f"doc_{side}", f"bits_{side}"), side)
        return pairs

    stars = members.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    tested = with_documents(stars).filter(estimate("bits_a", "bits_b") >= limit).drop("bits_a", "bits_b")
    links = cut(confirm(tested, known, words, percent))

    # Members of one bucket that lie in different components after the stars: these are left to compare.
    placed = members.join(components(links), "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = mixed.filter("low <> high").select("key")
    left = cut(placed.join(mixed, "key").drop("center").join(light, "node"))
    x, y = left.alias("x"), left.alias("y")
    partner = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.component") != F.col("y.component"))
        & (estimate("x.bits", "y.bits") >= limit)
    )
    undecided = x.join(y, partner, "left_semi").select("node", "doc_id", "component").distinct()
    again = sharing_rare(cut(undecided), known, words, percent)
    links = links.union(confirm(again, known, words, percent))
    # A doc_id whose rows hold different sets ties them together.
    several = filled.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    ties = filled.join(several, "doc_id").select("a", F.col("node").alias("b"))
    groups = components(links.union(ties))
    ids = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = ids.join(least, "component").select("node", "component_id")
    found = base.join(placed, (base.node == placed.node) & (base.n_shingles > 0) & base.doc_id.isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
