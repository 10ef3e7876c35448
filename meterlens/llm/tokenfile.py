"""Token ids of documents as files of range-coded blocks.

Documents are dealt into ranges of ascending doc_id; each range is one part, written as segments of whole documents. A
segment's bytes are

    magic "TKRC", version, bytes of an id, two zero bytes
    32-bit numbers: documents, blocks; 64-bit: ids
    for each document a 64-bit length
    for each block 32-bit numbers: ids, bytes, crc32 of its ids as little-endian 32-bit integers
    the blocks, each coded by itself (see `coder`)

all little-endian. A segment is a row of a Parquet table, with its part, its place there, the first id's place in the part and
the doc_ids beside it, so Spark commits and reads the files, on any store, and a lost task writes its part again.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meterlens.llm import coder
from meterlens.llm.common import prepare
from meterlens.llm.tokens import Encoder, grouped
from meterlens.session import ensure_checkpoint_dir

MAGIC, VERSION = b"TKRC", 2
HEAD = "<4sBBHIIQ"
HEAD_BYTES = struct.calcsize(HEAD)
#: Ids of a block, and of a segment; a document is never split, so a segment with a very long one is longer.
BLOCK, SEGMENT = 2048, 1 << 23
#: Words that a worker remembers: more than elsewhere, since the coder takes most of the time there is.
WORDS = 1_000_000


class Corrupt(ValueError):
    """A segment whose bytes are not what was written."""


def to_bytes(documents: list[np.ndarray]) -> bytes:
    """A segment's bytes from the ids of its documents."""
    ids = np.concatenate([np.zeros(0, np.uint32), *documents]).astype("<u4")
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    width = 4 if len(ids) and int(ids.max()) >= 1 << 16 else 2
    coded = coder.encode([b.astype(np.int64) for b in blocks], width // 2)
    lengths = np.array([len(d) for d in documents], "<u8").tobytes()
    table = np.array([(len(b), len(c), crc32(b.tobytes())) for b, c in zip(blocks, coded, strict=True)], "<u4").tobytes()
    head = struct.pack(HEAD, MAGIC, VERSION, width, 0, len(documents), len(blocks), len(ids))
    return b"".join([head, lengths, table, *coded])


def from_bytes(data: bytes) -> list[np.ndarray]:
    """The ids of a segment's documents; raises `Corrupt` if a checksum or a size is wrong."""
    if len(data) < HEAD_BYTES:
        raise Corrupt("too short")
    magic, version, width, _, documents, blocks, total = struct.unpack_from(HEAD, data)
    if (magic, version) != (MAGIC, VERSION):
        raise Corrupt("not a segment of this version")
    at = HEAD_BYTES + 8 * documents
    body = at + 12 * blocks
    if body > len(data):
        raise Corrupt("too short")
    lengths = np.frombuffer(data, "<u8", documents, HEAD_BYTES).astype(np.int64)
    table = np.frombuffer(data, "<u4", 3 * blocks, at).reshape(blocks, 3).astype(np.int64)
    ends = body + np.cumsum(table[:, 1])
    if len(data) != (ends[-1] if blocks else body) or table[:, 0].sum() != total or lengths.sum() != total:
        raise Corrupt("sizes do not add up")
    coded = [data[e - n : e] for e, n in zip(ends.tolist(), table[:, 1].tolist(), strict=True)]
    found = coder.decode(coded, table[:, 0].tolist(), width // 2)
    for ids, check in zip(found, table[:, 2].tolist(), strict=True):
        if crc32(ids.astype("<u4").tobytes()) != check:
            raise Corrupt("checksum differs")
    ids = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.uint32)
    return np.split(ids, np.cumsum(lengths)[:-1]) if documents else []


SEGMENTS = "part long, segment long, start long, tokens long, doc_ids array<{}>, payload binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Write the ids of all documents, each followed by `end_id`, in ascending doc_id order; null texts are empty.

    Rows without doc_id come first; rows that repeat a doc_id follow one another in the order of their texts.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(parts, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = Encoder(tokenizer_path, WORDS)
        waiting: list[np.ndarray] = []
        names: list[pa.Array] = []
        size = start = segment = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, start, segment
            doc_ids = pa.concat_arrays(names)
            lists = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            numbers = [pa.array([n], pa.int64()) for n in (part, segment, start, size)]
            row = [*numbers, lists, pa.array([to_bytes(waiting)], pa.binary())]
            start, segment, size = start + size, segment + 1, 0
            waiting.clear()
            names.clear()
            return pa.RecordBatch.from_arrays(row, ["part", "segment", "start", "tokens", "doc_ids", "payload"])

        for batch in grouped(batches):
            first = 0
            for i, ids in enumerate(encoder.encode(batch.column(1))):
                waiting.append(np.append(ids, np.array(end_id, ids.dtype)))
                size += len(ids) + 1
                if size >= SEGMENT:
                    names.append(batch.column(0).slice(first, i + 1 - first))
                    first = i + 1
                    yield flush()
            names.append(batch.column(0).slice(first))
        if waiting:
            yield flush()

    rows = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENTS.format(kind))
    rows.write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, in no order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                documents = from_bytes(batch.column(4)[i].as_py())
                lengths = np.array([len(d) for d in documents], np.int64)
                starts = batch.column(2)[i].as_py() + np.cumsum(lengths) - lengths
                part = np.full(len(documents), batch.column(0)[i].as_py(), np.int64)
                checks = [crc32(d.astype("<u4").tobytes()) for d in documents]
                doc_ids = batch.column(3).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, *(pa.array(c, pa.int64()) for c in (part, starts, lengths, checks))],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                )

    chosen = segments.select("part", "segment", "start", "doc_ids", "payload")
    found = chosen.mapInArrow(run, f"doc_id {kind}, part long, start long, n_tokens long, ids_crc32 long")
    # One row for each part, and there are no more parts than tasks wrote: small, whatever the parts hold.
    totals = segments.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shift"))
    placed = found.join(F.broadcast(shifts), "part")
    return placed.select("doc_id", (F.col("start") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids to a new folder of the shared checkpoint folder and read them back.

    An empty table gives an empty result. Other columns than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path, end_id, path)
    return read_tokens(spark, path)
