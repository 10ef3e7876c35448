"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

A document is cut into pieces of `length` ids and a rest. All pieces are dealt into groups by a hash of document and place,
about `GROUP` pieces in each, and every group is packed by itself: pieces in falling order of size, each into the first
sequence that has room. The tree's leaves are the sequences' free places and every inner node is the larger of its two
children, so the first sequence with room is found by going down from the root. Only lengths are shuffled, never ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlens.llm.common import cut, prepare
from meterlens.llm.tokens import Encoder, grouped

LENGTH = 2048
#: Pieces that a group holds on average.
GROUP = 4096
PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """The pieces of each document: start (its ids before the piece), length, crc32 of its ids, ids of the document.

    ids are the tokenizer's without special tokens, then `end_id`. Null texts are empty and have that one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in grouped(batches):
            rows, start, size, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(batch.column(1))):
                ids = np.append(ids, np.array(end_id, ids.dtype)).astype("<u4")
                for a in range(0, len(ids), length):
                    part = ids[a : a + length]
                    rows.append(i)
                    start.append(a)
                    size.append(len(part))
                    crc.append(crc32(part))
                    total.append(len(ids))
            columns = [pa.array(c, pa.int64()) for c in (start, size, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names)

    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, PIECES.format(kind))


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each size; equal sizes keep their order. Sizes are at most `length`."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    free = [length] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, length - free[node]
        free[node] -= size
        node //= 2
        while node:
            largest = max(free[2 * node], free[2 * node + 1])
            if free[node] == largest:
                break
            free[node] = largest
            node //= 2
    return bins, offsets


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """`parts` with sequence_id and offset: gapless from 0 in each sequence, sequences of at most `length` ids.

    Repeated rows are pieces of their own. Sequence ids are unique, not dense. Every group is one task's work: about
    `group` rows of numbers, however large the table is. A document of any length is dealt over many groups.
    """
    parts = cut(parts)
    rows = parts.count()
    groups = max(1, round(rows / group))
    # `parts` is read from the checkpoint, so its rows and with them these numbers are the same in a repeated task.
    dealt = parts.withColumn("_group", F.floor(F.rand(11) * groups).cast("long"))
    names = parts.columns

    def run(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        order = [(name, "ascending") for name in ("doc_id", "start", "ids_crc32")]
        found = found.sort_by([("length", "descending"), *order])
        bins, offsets = first_fit_decreasing(found["length"].to_numpy(), length)
        # Groups have fewer rows than 2^32, so group and bin make one number.
        columns = [*(found[n] for n in names), pa.array((key[0].as_py() << 32) + bins), pa.array(offsets)]
        return pa.table(columns, [*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = PIECES.format(kinds["doc_id"]) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents with their places in sequences. An empty table gives an empty result.

    Null or empty texts are pieces of one id. doc_id keeps its type and may be null; other columns are not looked at.
    """
    return pack(pieces(docs, tokenizer_path, end_id, length), length)
