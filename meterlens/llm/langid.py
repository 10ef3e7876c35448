"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

The subwords of a text are the two- and three-byte sequences within its words (ASCII letters folded, everything that is no
letter a space, spaces at word ends included), hashed to `BUCKETS` rows of an embedding. A text is the average of its
subwords' embeddings; a linear softmax on it gives the languages. Embedding and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows, whose average subword counts are made by Spark tasks. A
tenth of the sample is kept aside: on it a temperature makes the probabilities honest, and the rejection threshold is put
below nearly all of the rows that were predicted correctly.

A softmax is sure of texts in scripts and languages that it has never seen, so a second measure is calibrated on the same
rows: how usual a text's subwords are in the predicted language, as their mean log-odds against subwords that are all equally
frequent. The rows kept aside, measured in the best of the languages that are not theirs, stand for unknown languages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterlens.llm.common import crc32_mod, prepare, text_buffers

BUCKETS, WIDTH = 4096, 16
#: Most labelled rows that training uses.
SAMPLE_ROWS = 4000
#: Share of correctly predicted held-aside rows that the rejection threshold may lose.
REJECT_QUANTILE = 0.001
#: Rows kept aside from which on thresholds are set; fewer tell nothing of rare cases, and then only letterless texts go.
LEAST_ASIDE = 50
#: The least usual text lies above this quantile of texts in the wrong language, by this share of the way to the right ones.
WRONG_QUANTILE, ABOVE_WRONG = 0.95, 0.25
#: Subwords that say as much as one drawn by itself: those of a word depend on each other.
SUBWORDS_ALIKE = 5
#: Numbers of subwords for which the threshold is found from draws of held-aside rows, as short texts are told less surely.
SIZES, DRAWS = (16, 64, 256, 1024), 8
UNKNOWN = "und"
#: Bytes of one text whose subwords are counted at once.
SLICE_BYTES = 1 << 20

#: Letters for themselves, A-Z folded, everything else a space. Bytes above 127 belong to letters of any script.
LETTERS = np.array([b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in range(256)], np.uint32)


def subword_counts(text: np.ndarray) -> np.ndarray:
    """How often each bucket occurs among the subwords of one text, given as its UTF-8 bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    for low in range(0, len(text), SLICE_BYTES):
        part = LETTERS[text[max(0, low - 2) : low + SLICE_BYTES]]
        if not low:
            part = np.concatenate([np.full(1, 32, np.uint32), part])
        if low + SLICE_BYTES >= len(text):
            part = np.concatenate([part, np.full(1, 32, np.uint32)])
        two = part[:-1] | part[1:] << np.uint32(8)
        three = two[:-1] | part[2:] << np.uint32(16)
        # A slice begins with the last two bytes of the one before, so the pair of these two has been counted.
        two = two[1:] if low else two
        two, three = two[two != 0x2020], three[(three >> np.uint32(8)) != 0x2020]
        for codes in (two + np.uint32(1 << 24), three[(three & np.uint32(0xFFFF)) != 0x2020]):
            codes = codes * np.uint32(2654435761)
            counts += np.bincount((codes ^ codes >> np.uint32(15)) >> np.uint32(20), minlength=BUCKETS)
    return counts


@dataclass
class Model:
    """`weights`: the softmax of each bucket's embedding, so that averaging these rows gives the logits.

    `threshold` holds for long texts, `short` for ones of fewer subwords than the last of `SIZES` times four; shorter texts than
    the first of them are not held against it. `usual`: for each language the log-odds of the buckets; `least`: the mean from which on a text is of the language, less
    `slack` over the root of the number of subwords.
    """

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    short: tuple[float, ...] = ()
    usual: np.ndarray | None = None
    least: float = -np.inf
    slack: float = 0.0

    def rejects(self, counts: np.ndarray, language: int, probability: float) -> bool:
        """Whether a text, by its subword counts, is told with too little confidence or has too unusual subwords."""
        n = max(1, int(counts.sum()))
        threshold = self.threshold
        if self.short and n < 4 * SIZES[-1]:
            threshold = max((t for size, t in zip(SIZES, self.short, strict=True) if size <= n), default=0.0)
        if probability < threshold:
            return True
        if self.usual is None:
            return False
        return bool(counts @ self.usual[language] / n < self.least - self.slack / np.sqrt(n))

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.weights / np.maximum(counts.sum(axis=1, keepdims=True), 1) + self.bias) / self.temperature
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


class SparseCounts:
    """Rows of subword counts, kept as the buckets that are not 0 and their counts, and given as whole rows."""

    PAIR = np.dtype([("bucket", "<u2"), ("count", "<u4")])

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    @classmethod
    def pack(cls, counts: np.ndarray) -> bytes:
        there = np.flatnonzero(counts)
        pairs = np.empty(len(there), cls.PAIR)
        pairs["bucket"], pairs["count"] = there, counts[there]
        return pairs.tobytes()

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        pairs, out = np.frombuffer(self.rows[i], self.PAIR), np.zeros(BUCKETS, np.uint32)
        out[pairs["bucket"]] = pairs["count"]
        return out


def shares_of(counts: Sequence[np.ndarray]) -> np.ndarray:
    """Each row's counts over their sum; one matrix is filled row by row."""
    x = np.empty((len(counts), BUCKETS), np.float32)
    for i in range(len(counts)):
        x[i] = counts[i] / max(1, counts[i].sum())
    return x


def mean_of(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The mean of some rows of a matrix, without a copy of them."""
    total = np.zeros(x.shape[1], x.dtype)
    for i in rows:
        total += x[i]
    return total / np.float32(len(rows))


def fit(counts: Sequence[np.ndarray], labels: list[str], epochs: int = 30, seed: int = 7) -> Model:
    """Train on rows of subword counts. With no rows or one language there is nothing to tell apart."""
    languages = sorted(set(labels))
    n = len(languages)
    if n < 2:
        return Model(languages, np.zeros((BUCKETS, n)), np.zeros(n), 1.0, 0.0)
    target = np.array([languages.index(x) for x in labels])
    x = shares_of(counts)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, used = order[: len(x) // 10], order[len(x) // 10 :]
    # Common subwords say little: an average without their mean trains faster, and the mean goes into the bias.
    mean = mean_of(x, used)
    spread = 1 / (np.sqrt(mean) + 0.002)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, n)).astype(np.float32), np.zeros(n, np.float32)
    batch = max(4, min(64, len(used) // 40))
    for epoch in range(epochs):
        rate = np.float32(0.5 * (1 - epoch / epochs))
        rng.shuffle(used)
        for i in range(0, len(used), batch):
            rows = used[i : i + batch]
            z = (x[rows] - mean) * spread
            hidden = z @ embed
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), target[rows]] -= 1
            p /= len(rows)
            step_embed, step_out = z.T @ (p @ out.T), hidden.T @ p
            embed -= rate * step_embed
            out -= rate * step_out
            bias -= rate * p.sum(axis=0)
    weights = (spread[:, None] * embed).astype(np.float64) @ out
    model = Model(languages, weights, bias - mean @ weights, 1.0, 0.0)
    held = aside if len(aside) else used
    held_counts = np.array([counts[i] for i in held])

    def loss(temperature: float) -> float:
        model.temperature = temperature
        p = model.probabilities(held_counts)[np.arange(len(held)), target[held]]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    model.temperature = min((2.0**k for k in range(7)), key=loss)
    p = model.probabilities(held_counts)
    right = p.argmax(axis=1) == target[held]
    if len(aside) >= LEAST_ASIDE and right.any():
        model.threshold = float(np.quantile(p.max(axis=1)[right], REJECT_QUANTILE))
        set_short(model, x, target, aside[right], rng)
        set_usual(model, x, target, used, aside[right])
    return model


def set_short(model: Model, x: np.ndarray, target: np.ndarray, held: np.ndarray, rng: np.random.Generator) -> None:
    """Set the thresholds of short texts, from subwords drawn from the rows `held`."""
    found = []
    shares = x[held].astype(np.float64)
    shares /= shares.sum(axis=1, keepdims=True).clip(1e-12)
    there = shares.sum(axis=1) > 0.5
    for size in SIZES:
        best = []
        for _ in range(DRAWS):
            p = model.probabilities(rng.multinomial(max(1, size // SUBWORDS_ALIKE), shares[there]))
            best.append(p.max(axis=1)[p.argmax(axis=1) == target[held][there]])
        drawn = np.concatenate(best)
        found.append(min(model.threshold, float(np.quantile(drawn, REJECT_QUANTILE))) if len(drawn) else 0.0)
    model.short = tuple(found)


def set_usual(model: Model, x: np.ndarray, target: np.ndarray, used: np.ndarray, held: np.ndarray) -> None:
    """Set how usual the subwords of a text have to be, from rows `x` of subword shares."""
    n = len(model.languages)
    sums = np.zeros((n, BUCKETS))
    for i in used:
        sums[target[i]] += x[i]
    # A row counts as 200 subwords: those of one row depend on each other.
    odds = (200 * sums + 0.5) / (200 * sums.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    model.usual = np.log(odds * BUCKETS)
    means = x[held].astype(np.float64) @ model.usual.T
    rows = np.arange(len(held))
    right = means[rows, target[held]]
    means[rows, target[held]] = -np.inf
    low, high = float(np.quantile(means.max(axis=1), WRONG_QUANTILE)), float(np.quantile(right, REJECT_QUANTILE))
    model.least = min(high, low + ABOVE_WRONG * (high - low))
    spread = np.einsum("ij,ij->i", x[held], (model.usual[target[held]] - right[:, None]) ** 2)
    model.slack = 2 * float(np.sqrt(spread.mean() * SUBWORDS_ALIKE))


def count_rows(docs: DataFrame, label: str) -> DataFrame:
    """The subword counts of each row as `SparseCounts` packs them, beside the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column(1))
            counts = [SparseCounts.pack(subword_counts(data[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.binary())], ["label", "counts"])

    prepare(docs.sparkSession)
    chosen = docs.select(F.col(label).cast("string"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "label string, counts binary")


def train(docs: DataFrame, label: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the `rows` labelled rows whose ids have the smallest hashes: at most rows * 24 KB reach the driver, mostly far less."""
    labelled = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rank = F.xxhash64(F.col("doc_id").cast("string"))
    last = labelled.select(rank.alias("r")).orderBy("r").limit(rows).agg(F.max("r").alias("r")).first()["r"]
    if last is None:
        return fit(np.zeros((0, BUCKETS)), [])
    # Rows of one id share a hash; the limit holds for them too.
    found = count_rows(labelled.filter(rank <= F.lit(last)), label).limit(rows).collect()
    labels, counts = [r["label"] for r in found], SparseCounts([bytes(r["counts"]) for r in found])
    del found

    def before(i: int, j: int) -> int:
        a, b = (labels[i], counts[i].tobytes()), (labels[j], counts[j].tobytes())
        return (a > b) - (a < b)

    order = sorted(range(len(labels)), key=cmp_to_key(before))
    return fit(SparseCounts([counts.rows[i] for i in order]), [labels[i] for i in order])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of `docs` with lang_pred, lang_score and lang_rejected.

    The prediction comes from the text alone. Texts without a letter (null, empty, digits only) get `und`, score 0, and are
    rejected; so are texts whose calibrated probability lies below the model's threshold or whose subwords are too unusual in
    the predicted language, but these keep their prediction.
    Repeated rows get equal results; an empty table gives an empty result; columns of `docs` with the new names are
    replaced. A model without a language predicts `und`.
    """
    new = ("lang_pred", "lang_score", "lang_rejected")
    kept = [c for c in docs.columns if c.lower() not in new]
    at = [c.lower() for c in kept].index("text")
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column(at))
            best, score, rejected = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                counts = subword_counts(data[a:b])
                if not has_letter(data[a:b]) or not model.languages:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    rejected.append(True)
                    continue
                p = model.probabilities(counts[None])[0]
                k = int(p.argmax())
                best.append(model.languages[k])
                score.append(float(p[k]))
                rejected.append(model.rejects(counts, k, p[k]))
            columns = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, *new])

    prepare(docs.sparkSession)
    schema = ", ".join([*fields, "lang_pred string, lang_score double, lang_rejected boolean"])
    return source.mapInArrow(run, schema)


def has_letter(text: np.ndarray) -> bool:
    """Whether a text, given as its UTF-8 bytes, has a letter of any script."""
    low = text | 32
    if ((low >= 97) & (low <= 122)).any():
        return True
    return bool((text > 127).any()) and any(c.isalpha() for c in text.tobytes().decode())


def language_digest(docs: DataFrame) -> DataFrame:
    """Trained on the rows whose crc32(doc_id) modulo 5 is not 0, applied to all rows."""
    held_out = crc32_mod(F.col("doc_id"), 5) == 0
    model = train(docs.filter(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
