"""Finding and joining spans of text: linear scans for patterns that a plain regular expression makes quadratic."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlens.llm.common import prepare

Span = tuple[str, int, int]


def matches(pattern: re.Pattern, text: str, fits: Callable[[re.Match], bool]) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if fits(m)]


class Cover:
    """Whether a span lies within one of the given spans, after those that overlap are joined."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a) - 1
        return i >= 0 and b <= self.ends[i]

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a


def scan(docs: DataFrame, find: Callable[[], Callable[[list[str]], list[list[Span]]]]) -> DataFrame:
    """Each row of `docs` with `spans`, an array of (kind, start, end) in code points.

    `find` is called once in each task and gives the function that finds the spans of some texts. Null texts are empty. All
    columns of `docs` stay; a column of its own called `spans` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "spans"]
    at = [c.lower() for c in kept].index("text")
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    schema = ", ".join([*fields, "`spans` array<struct<kind:string,start:bigint,end:bigint>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    keys = ("kind", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = find()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            spans = pa.array([[dict(zip(keys, s, strict=True)) for s in each] for each in found(texts)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], [*kept, "spans"])

    prepare(docs.sparkSession)
    return source.mapInArrow(run, schema)


def digest(kinds: tuple[str, ...], extra: tuple[str, ...]):
    """A column function: the joined spans of the given kinds, sorted, from the column `spans`."""
    order = [*kinds, *extra]

    def text(only: tuple[str, ...]):
        rank = F.array(*[F.lit(k) for k in order])
        kept = F.filter("spans", lambda s: s["kind"].isin(*only))
        keyed = F.transform(
            kept,
            lambda s: F.struct(
                s["start"].alias("s"), F.array_position(rank, s["kind"]).alias("r"), s["end"].alias("e"), s["kind"].alias("k")
            ),
        )
        parts = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string")))
        return F.concat_ws(",", parts)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    columns = [count(k).alias(f"n_{k}") for k in kinds]
    return [*columns, F.sha2(text(kinds).cast("binary"), 256).alias("base_sha256"), text((*kinds, *extra)).alias("spans")]
