"""Exact top-k inner products by columnar branch and bound.

Vectors are packed into blocks that are stored by dimension: one row of a block's matrix is one dimension of all its
vectors. For a query the products are added up dimension block by dimension block, for all vectors of a candidate block at
once. After each block a vector can still gain at most the product of its remaining norm and the query's (Cauchy-Schwarz);
vectors that cannot reach the query's k-th best score so far are dropped, and the survivors are compacted, so that later
dimensions are read for few vectors. The stated query set meets all candidates block by block: a task has one block of
queries and a share of the candidate blocks, keeps k rows for each query, and the shares' rows are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from meterlens.llm.common import cut, prepare

#: Components of a block, so that a batch of blocks stays small; dimensions that are added up between two bounds.
COMPONENTS, DIMENSIONS = 1 << 16, 16
#: Candidates that one task works through for a block of queries, about.
SHARE = 8192
#: Components up to this size keep all sums and bounds exact in 64-bit floats; larger ones are never dropped by a bound.
EXACT = 1 << 20

BLOCK = "share long, dims int, size int, ids binary, matrix binary"


def integer_vectors(rows: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * component) as longs. Rows without an id, without a vector or with a null or
    non-finite component are left out; so is the empty vector."""
    as_double = F.col(vector).cast("array<double>")
    finite = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return kept.select(
        F.col(id_column).cast("long").alias("id"), F.transform(as_double, lambda x: F.floor(scale * x)).alias("v")
    )


def narrow(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest integers that hold them."""
    most = int(max(matrix.max(initial=0), -(matrix.min(initial=0) + 1)))
    return matrix.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def opened(data: bytes, dims: int, size: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (dims * size)]).reshape(dims, size).astype(np.int64)


def blocks(vectors: DataFrame, shares: int, column: str) -> DataFrame:
    """Blocks of vectors of equal length, stored by dimension; a block's share is drawn from its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        made = 0

        def block(dims: int) -> pa.RecordBatch:
            nonlocal made
            parts = waiting.pop(dims)
            ids = np.concatenate([p[0] for p in parts])
            matrix = np.ascontiguousarray(np.concatenate([p[1] for p in parts]).T)
            made += 1
            share = (int(ids[0]) * 31 + made) % shares
            values = [[share], [dims], [len(ids)], [ids.tobytes()], [narrow(matrix).tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [column, "dims", "size", "ids", "matrix"]
            )

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat = lists.flatten().to_numpy()
            lengths = lists.value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                rows = flat[starts[at][:, None] + np.arange(dims)]
                size = max(1, COMPONENTS // dims)
                for low in range(0, len(at), size):
                    waiting.setdefault(dims, []).append((ids[at[low : low + size]], rows[low : low + size]))
                    if sum(len(p[0]) for p in waiting[dims]) + 256 > size:
                        yield block(dims)
        for dims in list(waiting):
            yield block(dims)

    prepare(vectors.sparkSession)
    return vectors.select("id", "v").mapInArrow(run, BLOCK.replace("share", column))


class Best:
    """The k best candidates so far of each query of a block, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.vectors = np.ascontiguousarray(matrix.T)
        self.score = [np.zeros(0, np.int64)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        self.safe = np.abs(self.vectors).max(initial=0) <= EXACT
        squares = self.vectors.astype(np.float64) ** 2
        self.left = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])

    def meet(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        dims = len(matrix)
        cuts = list(range(0, dims, DIMENSIONS))
        squares = matrix.astype(np.float64) ** 2
        # The norm of what remains from each cut on, a little larger than exact.
        left = [np.sqrt(squares[c:].sum(axis=0)) * (1 + 1e-9) for c in cuts]
        safe = self.safe and np.abs(matrix).max(initial=0) <= EXACT
        for q, query in enumerate(self.vectors):
            limit = self.score[q][-1] if len(self.score[q]) == self.k else None
            alive = np.flatnonzero(ids != self.ids[q])
            score = np.zeros(len(alive), np.int64)
            for n, c in enumerate(cuts):
                part = matrix[c : c + DIMENSIONS]
                part = part if len(alive) == matrix.shape[1] else part[:, alive]
                score = score + query[c : c + DIMENSIONS] @ part
                if limit is not None and safe and n + 1 < len(cuts):
                    bound = score + left[n + 1][alive] * (self.left[q, cuts[n + 1]] * (1 + 1e-9)) + 1e-3
                    kept = bound >= limit
                    alive, score = alive[kept], score[kept]
                    if not len(alive):
                        break
            if limit is not None:
                kept = score >= limit
                alive, score = alive[kept], score[kept]
            if len(alive):
                score, found = np.concatenate([self.score[q], score]), np.concatenate([self.found[q], ids[alive]])
                if len(score) > 4 * self.k:  # only what ties with the k-th best can matter
                    kept = score >= np.partition(score, len(score) - self.k)[-self.k]
                    score, found = score[kept], found[kept]
                order = np.lexsort((found, -score))[: self.k]
                self.score[q], self.found[q] = score[order], found[order]


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with the rows of other ids, ties to the
    smaller id; all of them if there are fewer than k.

    Components become floor(scale * x). Vectors that are null, empty, or hold a null or non-finite component take no part,
    nor do rows without an id. Only vectors of equal length are compared. A repeated query row counts once; repeated
    candidate rows are candidates of their own. Sums are 64-bit and wrap beyond it. Empty tables give an empty result.
    """
    spark = prepare(rows.sparkSession)
    candidates = integer_vectors(rows, id_column, vector, scale)
    asked = integer_vectors(queries, id_column, vector, scale).distinct()
    n = rows.count()
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, -(-n // SHARE), 1)
    wide = cut(blocks(candidates, shares, "share"))
    ask = blocks(asked, 1 << 30, "query_block")
    ask = ask.toDF("query_block", "dims", "q_size", "q_ids", "q_matrix")
    ask = cut(ask.withColumn("query_block", F.xxhash64("q_ids")))
    spread = ask.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")))
    pairs = spread.join(wide, ["share", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        current = None

        def result() -> pa.RecordBatch:
            counts = [len(f) for f in best.found]
            columns = [np.repeat(best.ids, counts), np.concatenate(best.found), np.concatenate(best.score)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["query_block"] != current:
                    if best is not None:
                        yield result()
                    current = row["query_block"]
                    ids = np.frombuffer(row["q_ids"], np.int64)
                    best = Best(ids, opened(row["q_matrix"], row["dims"], row["q_size"]), k)
                best.meet(np.frombuffer(row["ids"], np.int64), opened(row["matrix"], row["dims"], row["size"]))
        if best is not None:
            yield result()

    # Rows of one query block and share meet in one task, in runs.
    pairs = pairs.select("query_block", "share", "dims", "q_size", "q_ids", "q_matrix", "size", "ids", "matrix")
    pairs = pairs.repartition("query_block", "share").sortWithinPartitions("query_block", "share")
    partial = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
