"""Secrets in texts: fixed patterns, and Shannon entropy in a sliding window over candidate strings.

A candidate is a maximal run of token characters of at least `window` characters. The entropy of the characters in the window
is held against the threshold of the narrowest character class that covers it (hex digits; letters of one case and digits;
letters and digits; the base64 alphabet), which all but a hundredth of the random strings of the class reach; counts change by one character in and one out, and so does the sum of n log n that the
entropy needs. Windows above the threshold that overlap are joined to one span of the kind `entropy`. Allow-listed
strings (paths, plain words, numbers, repeated or counted-up characters, UUIDs, addresses) are suppressed, and spans that
a fixed pattern covers are not reported again.
"""

from __future__ import annotations

import re
from math import log2

from pyspark.sql import DataFrame, functions as F

from meterlens.llm.spans import Cover, Span, digest, matches, scan

KINDS = ("assign", "access", "hex")
EXTRA = ("entropy",)

# The patterns of the contract.
ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits for a window of 20 characters: 0.01 quantiles of the entropy of random strings, rounded down. The second is for letters
#: of one case: 3.34 for the alphabet of base32, 3.41 with all ten digits.
THRESHOLDS = (("hex", 2.9), ("alnum", 3.34), ("base64", 3.64))
#: The same for letters of both cases and digits.
MIXED = 3.64
ALLOWED = (
    re.compile(r"[0-9_=+/-]*"),  # numbers, dates and rules
    re.compile(r"(?i)[a-z_=+/-]*[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"),
    re.compile(r"(?:[a-z]+[_/-])*[a-z]+[0-9]{0,4}"),  # names in parts
    re.compile(r"(?:[A-Z]?[a-z]+|[0-9]{1,4})(?:[/_=-](?:[A-Z]?[a-z]+|[0-9]{1,4}))*"),
)
#: Words, constants and paths: letters, digits at the ends of parts only, and three letters to a word of a part.
PARTS = re.compile(r"[A-Za-z]*[0-9]{0,4}(?:[_=+/-]+[A-Za-z]*[0-9]{0,4})*")
PART_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
WORD_LETTERS = 3


def classes_of(character: str) -> tuple[bool, bool, bool]:
    return character in "0123456789abcdefABCDEF", character.isalnum(), True


def high_windows(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined spans of `text` whose windows are above the threshold of the narrowest class that holds them."""
    nlog = [0.0] + [n * log2(n) for n in range(1, window + 1)]
    count: dict[str, int] = {}
    held = [0, 0, 0]
    upper = lower = 0
    total = 0.0
    out: list[tuple[int, int]] = []
    for i, new in enumerate(text):
        n = count.get(new, 0)
        total += nlog[n + 1] - nlog[n]
        count[new] = n + 1
        for j, inside in enumerate(classes_of(new)):
            held[j] += inside
        upper += new.isupper()
        lower += new.islower()
        if i >= window:
            old = text[i - window]
            n = count[old]
            total += nlog[n - 1] - nlog[n]
            count[old] = n - 1
            for j, inside in enumerate(classes_of(old)):
                held[j] -= inside
            upper -= old.isupper()
            lower -= old.islower()
        if i + 1 >= window:
            entropy = log2(window) - total / window
            need = next(bits for have, (_, bits) in zip(held, THRESHOLDS, strict=True) if have == window)
            if held[1] == window and held[0] < window and upper and lower:
                need = MIXED
            if entropy >= need:
                start = i + 1 - window
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
    return out


def allowed(text: str) -> bool:
    if any(p.fullmatch(text) for p in ALLOWED):
        return True
    if not PARTS.fullmatch(text):
        return False
    words = PART_WORD.findall(text)
    return sum(map(len, words)) >= WORD_LETTERS * len(words)


def find_secrets(text: str) -> list[Span]:
    base: list[Span] = [("assign", *s) for s in matches(ASSIGN, text, lambda m: len(m[1]) >= 8)]
    base += [("access", *s) for s in matches(ACCESS, text, lambda m: m.end() - m.start() >= 16)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    covered = Cover(base)
    more: list[Span] = []
    for m in CANDIDATE.finditer(text):
        if not allowed(m[0]):
            for a, b in high_windows(m[0]):
                a, b = a + m.start(), b + m.start()
                if not allowed(text[a:b]) and not covered.holds(a, b):
                    more.append(("entropy", a, b))
    return base + more


def secrets(docs: DataFrame) -> DataFrame:
    """Each row of `docs`, with `spans`: (kind, start, end) in code points, base kinds first.

    Null and empty texts have no spans; repeated rows are scanned each for itself; an empty table gives an empty result.
    Texts are scanned whole in linear time. All columns stay, but a column `spans` of `docs` is replaced.
    """
    return scan(docs, lambda: lambda texts: [find_secrets(t) for t in texts])


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every secret replaced by [kind]; overlapping spans are replaced together; n_chars follows if there."""
    found = secrets(docs)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.struct(
        F.when(s["e"] <= acc["at"], acc["out"])
        .when(s["s"] < acc["at"], acc["out"])
        .otherwise(
            F.concat(
                acc["out"],
                F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["s"] - acc["at"]).cast("int")),
                F.concat(F.lit("["), s["k"], F.lit("]")),
            )
        )
        .alias("out"),
        F.greatest(acc["at"], s["e"]).alias("at"),
    )
    rest = F.aggregate(
        ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    )
    text = F.when(F.size("spans") > 0, rest).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def secret_digest(docs: DataFrame) -> DataFrame:
    return secrets(docs.select("doc_id", "text")).select("doc_id", *digest(KINDS, EXTRA))
