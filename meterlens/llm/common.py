"""Helpers shared by the operators: sessions, Arrow text batches, word hashes and lineage cuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlens.session import configure, ensure_checkpoint_dir

#: Rows of an Arrow batch. Texts can be long, so batches are short; results do not depend on it.
BATCH_ROWS = 256
#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 1 << 21


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for Python tasks over long texts; everything else is the cluster's."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder, so that later steps read it instead of making it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc32_mod(column, divisor: int):
    """crc32 of the decimal text of an id, modulo `divisor`."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column, pa.array([], pa.large_string())])
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """`n` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Word boundaries and 64-bit word hashes of a batch of texts, on the UTF-8 bytes.

    `kind` is an array of 256 byte classes: the byte that stands for it in a hash, or 0 for a separator. Rows never
    share a word. `first[i]` is the index of the first word of row i, so `first` has one entry more than rows.
    """

    POSITIONS = 1 << 16

    def __init__(self, data: np.ndarray, ends: np.ndarray, kind: np.ndarray):
        inside = kind[data] != 0
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        filled = ends[1:] > ends[:-1]
        heads, tails = ends[:-1][filled], ends[1:][filled] - 1
        begin[heads] = inside[heads]
        stop[tails] = inside[tails]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, ends)
        self.hash = self._hashes(data, kind)

    def _hashes(self, data: np.ndarray, kind: np.ndarray) -> np.ndarray:
        by_byte = numbers(1, 256)[kind]
        by_byte[kind == 0] = 0
        by_place = numbers(2, self.POSITIONS) | np.uint64(1)
        out = np.empty(len(self.start), np.uint64)
        low = 0
        while low < len(self.start):
            high = max(low + 1, int(np.searchsorted(self.end, self.start[low] + SLICE_BYTES)))
            a, b = self.start[low], self.end[high - 1]
            starts = self.start[low:high] - a
            place = np.arange(b - a, dtype=np.int64)
            place -= np.repeat(starts, np.diff(starts, append=b - a))
            place &= self.POSITIONS - 1
            out[low:high] = np.add.reduceat(by_byte[data[a:b]] * by_place[place], starts)
            low = high
        return mix(out + (self.end - self.start).astype(np.uint64))


def byte_classes(separators, fold: bool = True) -> np.ndarray:
    """Every byte stands for itself, A-Z for a-z if `fold`, and the separators for nothing."""
    kind = np.arange(256, dtype=np.uint8)
    if fold:
        kind[65:91] += 32
    kind[list(separators)] = 0
    return kind


def grams(words: Words, k: int) -> np.ndarray:
    """The hash of the k words from each word on; the last k - 1 of a row run into the next row and mean nothing."""
    factors = numbers(3, k) | np.uint64(1)
    out = np.zeros(len(words.hash), np.uint64)
    for i in range(k):
        out[: len(out) - i] += words.hash[i:] * factors[i] if i else words.hash * factors[0]
    return mix(out)


def longs(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
