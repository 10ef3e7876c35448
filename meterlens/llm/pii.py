"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained by gradient ascent on the small labelled table `LABELLED` and finds what the patterns miss: numbers
without a country code, identity numbers, addresses written in parts. A word without a digit and without @ is "plain" and
has no feature but that. The trained weights decide at once whether a plain word between plain words is certainly outside
of all spans, whatever its neighbours' labels are: its margin is then larger than anything that transitions can give. Such
words cut a text into short segments, which Viterbi decodes in numpy batches with the same result as for the whole text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from meterlens.llm.spans import Cover, Span, digest, matches, scan

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("crf_email", "crf_ip", "crf_card", "crf_phone", "crf_id")

# The patterns of the contract. E-mail addresses are found from their @, so that long runs stay linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# The labelled table: [kind words] marks a span.
LABELLED = """
write to [email jane.doe@example.org] for more
mail [email x_y.12@mail.example.com] or call [phone (443) 555-5793] now
reach us: [email first-last@sub.example.net], thanks
my address is [email ab12@example] at work
contact [email someone@localhost] please
the old host [ip 10.20.30.40] is down
server [ip 192.168.0.1:8080] and [ip 172.16.4.9/24] answer
ping [ip 8.8.4.4] from there
node [ip 137.187.58.226] and [ip 38.239.37.24] again
call [phone (826) 555-7388] after five
call [phone 826-555-7388] after five
dial [phone 555-0134] for help
her number is [phone 020 7946 0958] in town
phone [phone 0171 555 0199] or [phone 0049 30 1234567] today
ring [phone +1 (599) 555-3756] at noon
ring [phone +44 20 7946 0958] at noon
mobile [phone 443.555.5793] only
card [card 4111 1111 1111 1111] was charged
card [card 4111-1111-1111-1111] was charged
pay with [card 4808875255130719] please
the account [card 5500 0000 0000 0004] is closed
amex [card 3782 822463 10005] expired
his number [id 123-45-6789] was stolen
ssn [id 078-05-1120] on file
ssn [id 219-09-9999], born there
tax id [id 12-3456789] of the firm
iban [id DE89370400440532013000] was used
iban [id GB29NWBK60161331926819] was used
in 1999 the town had 12 houses and 3500 people
from 1914 to 1918 there was war
it costs 12.50 or 1,200 in all
version 3 and version 4.0 of the work
see page 12, line 3 and note 45
at 10:30 on 2024-05-17 we met
on 17.05.2024 at 9 we left
about 25% of 300 and 1/2 of it
chapter 7 has 100 pages and 20 plates
room 101 on floor 3 is free
the code a1b2c3 and x86 are names
token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587" is old
the value 0.123456 and 3.14159 are numbers
the sum 1234567 and 987654321 are counts
order 20240517 of 350 items
we like @home and user@ and @all
plain words stand here without any number
words
no
two words
""".strip().splitlines()

WORD = re.compile(r"\S+")
MARK = re.compile(r"[0-9@]")
TRIM_LEFT, TRIM_RIGHT = "\"'([{<,;:", "\"')]}>,;:.!?"
LABELS = ("O", *(f"{p}-{k}" for k in ("email", "ip", "card", "phone", "id") for p in "BI"))
FEATURES = 1 << 12


def plain(word: str) -> bool:
    return MARK.search(word) is None


def shape(word: str) -> str:
    """X, x and d for upper-case, lower-case letters and digits, other characters themselves; runs of over 8 are cut to 9."""
    if plain(word):
        return "w"
    long = "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in word[:64])
    long = long.rstrip(".,;:!?\"'")
    return re.sub(r"(.)\1{8,}", lambda m: m[1] * 9, long)


def short(long: str) -> str:
    return re.sub(r"(.)\1+", r"\1", long)


def features(before: str, here: str, after: str) -> list[str]:
    """The features of a word from the shapes of it and its neighbours."""
    b, h, a = short(before), short(here), short(after)
    return [f"h={here}", f"s={h}", f"d={here.count('d')}", f"b={b}|{h}", f"a={h}|{a}", f"n={b}|{h}|{a}"]


def slot(feature: str) -> int:
    """The weight row of a feature: FNV-1a, so that it is the same in every process."""
    h = 2166136261
    for byte in feature.encode():
        h = (h ^ byte) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % FEATURES


class Field:
    """Weights of the features for each label, of the label pairs, and of the labels at the ends of a text."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self.memo: dict[tuple[str, str, str], np.ndarray] = {}
        # What a label other than O can win by the transitions on both sides of it.
        gain = (move[:, :, None] + move[None, :, :] - move[:, :1, None] - move[None, :1, :])[:, 1:, :].max()
        lone = self.scores("w", "w", "w")
        edge = [self.scores(b, "w", a) for b, a in (("", "w"), ("w", ""), ("", ""))]
        self.certain = all(s[0] - s[1:].max() > gain for s in [lone, *edge])

    def scores(self, before: str, here: str, after: str) -> np.ndarray:
        key = (before, here, after)
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = self.memo[key] = self.emit[[slot(f) for f in features(*key)]].sum(axis=0)
        return found

    def decode(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over all segments at once, longest first; each has the label O before and after it."""
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(segments)
        while order:
            # Segments of similar length are padded together.
            size = len(segments[order[0]])
            most = max(1, 200_000 // max(1, size))
            group = [i for i in order[:most] if len(segments[i]) * 2 >= size] or order[:1]
            order = order[len(group) :]
            self._decode(segments, group, out)
        return out

    def _decode(self, segments: list[np.ndarray], group: list[int], out: list[np.ndarray]) -> None:
        lengths = np.array([len(segments[i]) for i in group])
        best = segments_at(segments, group, 0) + self.move[0]
        steps = []
        for t in range(1, int(lengths.max())):
            going = int((lengths > t).sum())
            ways = best[:going, :, None] + self.move
            back = ways.argmax(axis=1)
            steps.append(back)
            best[:going] = ways.max(axis=1) + segments_at(segments, group[:going], t)
        last = (best + self.move[:, 0]).argmax(axis=1)
        paths = [np.zeros(n, np.int64) for n in lengths]
        label = last.copy()
        for t in range(int(lengths.max()) - 1, -1, -1):
            going = int((lengths > t).sum())
            for j in range(going):
                paths[j][t] = label[j]
            if t:
                label[:going] = steps[t - 1][np.arange(going), label[:going]]
        for j, i in enumerate(group):
            out[i] = paths[j]


def segments_at(segments: list[np.ndarray], group: list[int], t: int) -> np.ndarray:
    return np.array([segments[i][t] for i in group])


def labelled_rows() -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in LABELLED:
        words, labels, kind = [], [], ""
        for word in line.split():
            if word[0] == "[" and word[1:] in ("email", "ip", "card", "phone", "id"):
                kind, first = word[1:], True
                continue
            closed = kind and "]" in word
            words.append(word.replace("]", "") if closed else word)
            labels.append(LABELS.index(("B-" if first else "I-") + kind) if kind else 0)
            if kind:
                first = False
            if closed:
                kind = ""
        rows.append((words, labels))
    return rows


@lru_cache(maxsize=1)
def train(rounds: int = 150, rate: float = 0.5, decay: float = 0.002) -> Field:
    """Gradient ascent on the log-likelihood of the labelled table with a small quadratic penalty; no randomness."""
    rows = labelled_rows()
    n = len(LABELS)
    slots = []
    for words, _ in rows:
        shapes = ["", *map(shape, words), ""]
        slots.append(np.array([[slot(f) for f in features(*shapes[i : i + 3])] for i in range(len(words))]))
    emit, move = np.zeros((FEATURES, n)), np.zeros((n, n))
    seen_emit, seen_move = np.full((FEATURES, n), 1e-8), np.full((n, n), 1e-8)
    for _ in range(rounds):
        d_emit, d_move = -decay * emit, -decay * move
        for at, (_, labels) in zip(slots, rows, strict=True):
            score = emit[at].sum(axis=1)
            steps = len(labels)
            ahead, behind = np.zeros((steps, n)), np.zeros((steps, n))
            ahead[0] = score[0] + move[0]
            for t in range(1, steps):
                ahead[t] = score[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + move, axis=0)
            behind[-1] = move[:, 0]
            for t in range(steps - 2, -1, -1):
                behind[t] = np.logaddexp.reduce(move + score[t + 1] + behind[t + 1], axis=1)
            total = np.logaddexp.reduce(ahead[-1] + move[:, 0])
            away = -np.exp(ahead + behind - total)
            away[np.arange(steps), labels] += 1
            for t in range(steps):
                d_emit[at[t]] += away[t]
            d_move[0] -= np.exp(ahead[0] + behind[0] - total)
            d_move[0, labels[0]] += 1
            d_move[:, 0] -= np.exp(ahead[-1] + behind[-1] - total)
            d_move[labels[-1], 0] += 1
            for t in range(1, steps):
                d_move -= np.exp(ahead[t - 1][:, None] + move + score[t] + behind[t] - total)
                d_move[labels[t - 1], labels[t]] += 1
        seen_emit += d_emit**2
        seen_move += d_move**2
        emit += rate * d_emit / np.sqrt(seen_emit)
        move += rate * d_move / np.sqrt(seen_move)
    return Field(emit, move)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("email", *s) for s in emails(text)]
    out += [("ip", *s) for s in addresses(text)]

    def card(m: re.Match) -> bool:
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        return 14 <= len(digits) <= 19 and luhn(digits)

    out += [("card", *s) for s in matches(CARD, text, card)]
    out += [("phone", *s) for s in matches(PHONE, text, lambda m: 10 <= sum(c.isdigit() for c in m[0]) <= 15)]
    return out


def find_personal(field: Field, texts: list[str]) -> list[list[Span]]:
    """The spans of each text: those of the patterns, and those of the field that meet none of the patterns' spans."""
    out, segments, places = [], [], []
    for i, text in enumerate(texts):
        marked = MARK.search(text) is not None
        out.append(base_spans(text) if marked else [])
        if not marked and field.certain:
            continue
        words = [m.span() for m in WORD.finditer(text)]
        if field.certain:
            wanted = sorted(
                {j for k, (a, b) in enumerate(words) if MARK.search(text, a, b) for j in (k - 1, k, k + 1) if 0 <= j < len(words)}
            )
        else:
            wanted = list(range(len(words)))
        known: dict[int, str] = {-1: "", len(words): ""}
        for k in wanted:
            for j in (k - 1, k, k + 1):
                if j not in known:
                    known[j] = shape(text[slice(*words[j])])
        start = 0
        for n, k in enumerate(wanted):
            if n + 1 == len(wanted) or wanted[n + 1] != k + 1:
                run = wanted[start : n + 1]
                segments.append(np.array([field.scores(known[j - 1], known[j], known[j + 1]) for j in run]))
                places.append((i, [words[j] for j in run]))
                start = n + 1
    covers = [Cover(spans) for spans in out]
    for (i, words), labels in zip(places, field.decode(segments), strict=True):
        for kind, a, b in runs(texts[i], words, labels):
            if not covers[i].meets(a, b):
                out[i].append((f"crf_{kind}", a, b))
    return out


def runs(text: str, words: list[tuple[int, int]], labels: np.ndarray) -> list[Span]:
    """Labelled words as spans without the punctuation around them. An I of another kind begins a span."""
    spans: list[Span] = []
    open_kind = ""
    for (a, b), label in zip(words, labels, strict=True):
        name = LABELS[label]
        if name == "O":
            open_kind = ""
            continue
        if name[0] == "B" or open_kind != name[2:]:
            spans.append((name[2:], a, b))
        else:
            spans[-1] = (name[2:], spans[-1][1], b)
        open_kind = name[2:]
    trimmed = []
    for kind, a, b in spans:
        left = TRIM_LEFT if kind != "phone" else TRIM_LEFT.replace("(", "")
        while a < b and text[a] in left:
            a += 1
        while a < b and text[b - 1] in TRIM_RIGHT:
            b -= 1
        if a < b and not plain(text[a:b]):
            trimmed.append((kind, a, b))
    return trimmed


def personal_data(docs: DataFrame) -> DataFrame:
    """Each row of `docs`, with `spans`: (kind, start, end) in code points; kinds of the field begin with crf_.

    Null and empty texts have no spans; repeated rows are scanned each for itself; an empty table gives an empty result.
    Texts are scanned whole. All columns stay, but a column `spans` of `docs` is replaced.
    """
    emit, move = train().emit, train().move

    def start():
        field = Field(emit, move)
        return lambda texts: find_personal(field, texts)

    return scan(docs, start)


def personal_digest(docs: DataFrame) -> DataFrame:
    return personal_data(docs.select("doc_id", "text")).select("doc_id", *digest(KINDS, EXTRA))
