"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A node of a conversation's lattice is (rows behind it, state), where the state says what the repaired rows end with: nothing
yet, a system row, a user row, or a whole exchange. Edges are the edits: keep, rerole, delete, insert. One heap goes forward
from the first node, one goes back from the last ones; both expand by cost, and on equal cost by place, so that a node's
label, the cheapest edits and among these the ASCII-least audit, is final when it leaves its heap. Both go on until the sum
of their next costs is above the best crossing, so all crossings of least cost are there, and the least concatenated audit of
them is taken.

Rows are range-partitioned by conversation and turn, so a conversation of any size is spread over tasks. A task cuts its rows
into segments of at most `SEGMENT` rows. Conversations of one segment are searched as a whole; of the others every segment
gets the least edits from each state to each state, and a pass over the segments picks one entry of each. The last pass
streams the rows in order with the picked audits and hashes the repaired text, one row at a time: the hash of a conversation
is sequential by its definition, but it needs no more memory than one row and one segment's edits.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meterlens.llm.common import cut, prepare

#: Rows of one conversation whose lattice is searched at once.
SEGMENT = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What a row is, by its first fault.
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)

#: States: nothing yet, after a system row, after a user row, after a whole exchange. Repaired rows may end in these two.
EMPTY, SYSTEM, ASKED, ANSWERED = range(4)
ENDS = (EMPTY, ANSWERED)
#: The state that a row with this initial leads to.
STEPS = {("s", EMPTY): SYSTEM, ("u", EMPTY): ASKED, ("u", SYSTEM): ASKED, ("u", ANSWERED): ASKED, ("a", ASKED): ANSWERED}
#: The same for a row whose role may be chosen, and backwards.
NEXT = {EMPTY: ASKED, SYSTEM: ASKED, ANSWERED: ASKED, ASKED: ANSWERED}
BEFORE = {q: [p for p in NEXT if NEXT[p] == q] for q in range(4)}
KEPT_BEFORE = {(c, q): [p for (d, p), r in STEPS.items() if d == c and r == q] for c in "sua" for q in range(4)}
LEGAL = {"su", "ua", "au"}
ROLE = {ASKED: "user", ANSWERED: "assistant"}

Entry = tuple[int, int, int, str]  # state before, state after, cost, audit


def edges_ahead(initials: list[str], faults: list[int], i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """The edits at a node: cost, letter, and the node that they lead to."""
    yield INSERT, "I", i, NEXT[q]
    if i == len(initials):
        return
    yield DELETE, "D", i + 1, q
    if faults[i] in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if faults[i] == CUT_OFF else 0
    if (initials[i], q) in STEPS:
        yield KEEP + more, "K", i + 1, STEPS[initials[i], q]
    yield REROLE + more, "R", i + 1, NEXT[q]


def edges_behind(initials: list[str], faults: list[int], i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """The edits that lead to a node: cost, letter, and the node that they come from."""
    for p in BEFORE[q]:
        yield INSERT, "I", i, p
    if i == 0:
        return
    yield DELETE, "D", i - 1, q
    if faults[i - 1] in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if faults[i - 1] == CUT_OFF else 0
    for p in KEPT_BEFORE.get((initials[i - 1], q), ()):
        yield KEEP + more, "K", i - 1, p
    for p in BEFORE[q]:
        yield REROLE + more, "R", i - 1, p


def least_edits(initials: list[str], faults: list[int], start: int = EMPTY, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits from the state `start` to one of `ends`, on equal cost the ASCII-least audit.

    None if no edits lead there. Two audits of one cost that lead to one node never are a beginning of each other, as what
    one has more would be inserts that cost something; so the lesser audit stays the lesser one whatever follows.
    """
    n = len(initials)
    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    behind: dict[tuple[int, int], tuple[int, str]] = {(n, q): (0, "") for q in ends}
    heap_ahead, heap_behind = [(0, 0, "", start)], [(0, 0, "", q) for q in ends]
    done_ahead: set[tuple[int, int]] = set()
    done_behind: set[tuple[int, int]] = set()
    best = 0 if (0, start) in behind else None
    while heap_ahead and heap_behind and (best is None or heap_ahead[0][0] + heap_behind[0][0] <= best):
        if heap_ahead[0][0] <= heap_behind[0][0]:
            cost, i, audit, q = heappop(heap_ahead)
            if (i, q) in done_ahead:
                continue
            done_ahead.add((i, q))
            for more, letter, j, r in edges_ahead(initials, faults, i, q):
                label = (cost + more, audit + letter)
                if label < ahead.get((j, r), (label[0] + 1, "")):
                    ahead[j, r] = label
                    heappush(heap_ahead, (label[0], j, label[1], r))
                    if (j, r) in behind and (best is None or label[0] + behind[j, r][0] < best):
                        best = label[0] + behind[j, r][0]
        else:
            cost, left, audit, q = heappop(heap_behind)
            i = n - left
            if (i, q) in done_behind:
                continue
            done_behind.add((i, q))
            for more, letter, j, r in edges_behind(initials, faults, i, q):
                label = (cost + more, letter + audit)
                if label < behind.get((j, r), (label[0] + 1, "")):
                    behind[j, r] = label
                    heappush(heap_behind, (label[0], n - j, label[1], r))
                    if (j, r) in ahead and (best is None or label[0] + ahead[j, r][0] < best):
                        best = label[0] + ahead[j, r][0]
    if best is None:
        return None
    crossings = (node for node in ahead.keys() & behind.keys() if ahead[node][0] + behind[node][0] == best)
    return best, min(ahead[node][1] + behind[node][1] for node in crossings)


def segment_entries(initials: list[str], faults: list[int], whole: bool) -> list[Entry]:
    """The least edits of a segment: of a whole conversation one entry, else one for each pair of states."""
    if whole:
        cost, audit = least_edits(initials, faults)
        return [(EMPTY, state_after(EMPTY, initials, audit), cost, audit)]
    found = [(p, q, least_edits(initials, faults, p, (q,))) for p in range(4) for q in range(4)]
    return [(p, q, *edits) for p, q, edits in found if edits is not None]


def state_after(state: int, initials: list[str], audit: str) -> int:
    row = 0
    for letter in audit:
        if letter == "K":
            state = STEPS[initials[row], state]
        elif letter != "D":
            state = NEXT[state]
        row += letter != "I"
    return state


class Choice:
    """Picks one entry of each segment of a conversation, segment after segment.

    A label is a cost and the audit so far without what all labels have in common. Labels that cannot win any more go: what
    can follow nothing or a system row can follow a whole exchange too, but for a kept system row, which can be deleted.
    """

    def __init__(self):
        self.labels: dict[int, tuple[int, str]] = {EMPTY: (0, "")}
        self.before: list[dict[int, int]] = []

    def add(self, entries: list[Entry]) -> None:
        new: dict[int, tuple[int, str, int]] = {}
        for p, q, cost, audit in entries:
            if p in self.labels:
                label = (self.labels[p][0] + cost, self.labels[p][1] + audit, p)
                if q not in new or label < new[q]:
                    new[q] = label
        if ANSWERED in new:
            answered = new[ANSWERED][0]
            new = {q: x for q, x in new.items() if x[0] <= answered + {EMPTY: DELETE, SYSTEM: 0}.get(q, x[0])}
        common = len(os.path.commonprefix([x[1] for x in new.values()]))
        self.labels = {q: (x[0], x[1][common:]) for q, x in new.items()}
        self.before.append({q: x[2] for q, x in new.items()})

    def picked(self) -> list[tuple[int, int]]:
        """The states before and after each segment."""
        q = min((q for q in ENDS if q in self.labels), key=lambda q: self.labels[q])
        found = []
        for step in reversed(self.before):
            found.append((step[q], q))
            q = step[q]
        return found[::-1]


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` modulo 20 names; nulls read as a space.

    0 drops the row, 1 empties its text, 2 takes out its `[.!?]`, 3 repeats it, 4 sets its role to user. conv_id and turn
    stay null where they are.
    """
    either = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code = F.crc32(F.concat(either[0], F.lit(":"), either[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    coded = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("_code")).filter("_code <> 0")
    new_text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return coded.select(
        "conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), copies.alias("_copy")
    ).drop("_copy")


def faults(text: Column, repeated: Column) -> Column:
    """The first fault of a row."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", BLANK).when(repeated, DUPLICATE).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(FINE)


def in_order(rows: DataFrame) -> DataFrame:
    """The rows in conversations' order, range-partitioned and written, with _slice, their partition, and their fault.

    Rows of one turn are ordered by role, then by a hash of the text. A row is a duplicate if its conversation has the same
    role and text before it. Repeated texts are found by counts of (conversation, role, digest), made before the shuffle; the
    join to these is on a unique side, so the rows of a hot key may be split.
    """
    number = F.monotonically_increasing_id()
    digest = F.sha2(F.col("text"), 256)
    rows = cut(rows.select("conv_id", "turn", "role", "text", number.alias("_n"), digest.alias("_digest")))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("_n").alias("c"))
    groups = rows.groupBy("conv_id", "role", "_digest").agg(F.min(place).alias("_first"), F.count("*").alias("_count"))
    groups = groups.filter("_count > 1").select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_digest").alias("_same"), "_first"
    )
    on = rows["conv_id"].eqNullSafe(groups["_conv"]) & (rows["role"] == groups["_role"]) & (rows["_digest"] == groups["_same"])
    repeated = F.col("_first").isNotNull() & (place > F.col("_first"))
    marked = rows.join(groups, on, "left").select(
        "conv_id", "turn", "role", "text", "_n", F.xxhash64("text").alias("_hash"), faults(F.col("text"), repeated).alias("_fault")
    )
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("_hash"), F.asc("_n")]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.select("conv_id", "turn", "role", "text", "_fault", F.spark_partition_id().alias("_slice")))


SEGMENTS = "conv_id {}, _slice int, _segment int, entries array<struct<before int, after int, cost long, audit string>>"


def segments(ordered: DataFrame, rows: int = SEGMENT) -> DataFrame:
    """The least edits of each segment. A segment is whole if its conversation neither begins nor ends a slice.

    Conversations at an end of a slice may go on in the next one. Segments are numbered within a conversation's slice.
    """
    kind = ordered.schema["conv_id"].dataType
    schema = SEGMENTS.format(kind.simpleString())

    def table(found: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        entry = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        names = ("before", "after", "cost", "audit")
        entries = [[dict(zip(names, e, strict=True)) for e in x[3]] for x in found]
        columns = [pa.array([x[0] for x in found], ids), *(pa.array([x[k] for x in found], pa.int32()) for k in (1, 2))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(entries, pa.list_(entry))], ["conv_id", "_slice", "_segment", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        initials: list[str] = []
        kinds: list[int] = []
        conv, place, number, first = None, None, 0, True
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for key, piece, initial, fault in zip(*columns, strict=True):
                if place is not None and key != conv:
                    found.append((conv, place, number, segment_entries(initials, kinds, whole=not first and number == 0)))
                    initials, kinds, number, first = [], [], 0, False
                elif len(initials) == rows:
                    found.append((conv, place, number, segment_entries(initials, kinds, whole=False)))
                    initials, kinds, number = [], [], number + 1
                conv, place = key, piece
                initials.append(initial)
                kinds.append(fault)
            if len(found) >= 1000:
                yield table(found, batch.schema.field(0).type)
                found = []
        if place is not None:
            found.append((conv, place, number, segment_entries(initials, kinds, whole=False)))
            yield table(found, batch.schema.field(0).type)

    narrow = ordered.select("conv_id", "_slice", F.substring("role", 1, 1), "_fault")
    return narrow.mapInArrow(run, schema)


def picked(parts: DataFrame) -> DataFrame:
    """For each segment the states before and after it on the least path of its conversation."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "_slice", "_segment", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice, places, conv = Choice(), [], None

        def close() -> list[tuple]:
            return [(conv, *at, *pair) for at, pair in zip(places, choice.picked(), strict=True)]

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if places and row["conv_id"] != conv:
                    found += close()
                    choice, places = Choice(), []
                conv = row["conv_id"]
                places.append((row["_slice"], row["_segment"]))
                choice.add([(e["before"], e["after"], e["cost"], e["audit"]) for e in row["entries"]])
            yield rows(found, batch)
        if places:
            yield rows(close(), batch)

    def rows(found: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        types = [like.schema.field("conv_id").type, *[pa.int32()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(types)], names)

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "_slice", "_segment")
    return dealt.mapInArrow(run, f"conv_id {kind}, _slice int, _segment int, before int, after int")


class Repair:
    """One conversation, fed with its rows in order and with the picked edits before each segment's rows."""

    def __init__(self):
        self.state, self.letters, self.at, self.audit, self.cost = EMPTY, "", 0, [], 0
        self.lines, self.hash = 0, hashlib.sha256()
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last, self.turns, self.low, self.high = None, 0, None, None

    def start(self, cost: int, audit: str) -> list[tuple[str, str]]:
        """Go on with the next segment's edits; the rows that end the one before."""
        rest = self.finish()
        self.letters, self.at = audit, 0
        self.audit.append(audit)
        self.cost += cost
        return rest

    def _put(self, role: str, text: str) -> tuple[str, str]:
        line = f"{role}:{text}"
        self.hash.update(("\n" + line if self.lines else line).encode())
        self.lines += 1
        return role, text

    def finish(self) -> list[tuple[str, str]]:
        """The rows inserted at the end of a segment."""
        out = []
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.state = NEXT[self.state]
            out.append(self._put(ROLE[self.state], ""))
            self.at += 1
        return out

    def row(self, turn: int | None, role: str, text: str, fault: int) -> list[tuple[str, str]]:
        """Count the row and give the repaired rows up to and with it."""
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT_OFF
        if self.rows:
            self.illegal += self.last + role[:1] not in LEGAL
        self.last = role[:1]
        self.rows += 1
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        out = self.finish()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = STEPS[role[:1], self.state]
            out.append(self._put(role, text))
        elif letter == "R":
            self.state = NEXT[self.state]
            out.append(self._put(ROLE[self.state], text))
        return out

    def digest(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost)
        return (*counts, "".join(self.audit), self.hash.hexdigest())


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def with_edits(rows: DataFrame, conversations: DataFrame | None, segment_rows: int) -> DataFrame:
    """The rows with their picked edits, a conversation's parts one after another in one partition.

    A row with _segment -1 and no slice stands for each of `conversations`, so that one without rows is there as well.
    """
    ordered = in_order(rows)
    parts = cut(segments(ordered, segment_rows))
    choices = picked(parts)
    on = choices["conv_id"].eqNullSafe(parts["conv_id"])
    for c in ("_slice", "_segment"):
        on = on & (choices[c] == parts[c])
    entry = F.filter("entries", lambda e: (e["before"] == choices["before"]) & (e["after"] == choices["after"]))[0]
    edits = parts.join(choices, on).select(parts["conv_id"], parts["_slice"], parts["_segment"], entry.alias("_entry"))
    # Numbers of rows within a slice: rows are read from the checkpoint, in order; a segment comes before its first row.
    nothing = F.lit(None)
    kinds = {f.name: f.dataType for f in ordered.schema.fields}
    lines = ordered.select(
        "conv_id", "_slice", F.lit(-1).alias("_segment"), F.monotonically_increasing_id().alias("_n"),
        "turn", "role", "text", "_fault", nothing.cast("long").alias("cost"), nothing.cast("string").alias("audit"),
    )
    heads = edits.select(
        "conv_id", "_slice", "_segment", F.lit(-1).cast("long"), nothing.cast(kinds["turn"]), nothing.cast("string"),
        nothing.cast("string"), nothing.cast("int"), F.col("_entry.cost"), F.col("_entry.audit"),
    )
    out = lines.union(heads)
    if conversations is not None:
        every = conversations.select("conv_id").distinct()
        blanks = [nothing.cast(t) for t in (kinds["turn"], "string", "string", "int", "long", "string")]
        out = out.union(every.select("conv_id", F.lit(-1), F.lit(-2), F.lit(-2).cast("long"), *blanks))
    return out.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "_slice", "_n", "_segment")


def in_batches(found: Iterator[tuple], first: pa.DataType, fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Tuples as batches; the first column has the type `first`."""
    schema = pa.schema([("conv_id", first), *fields])
    while out := list(islice(found, 256)):
        columns = [pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def streamed(batches: Iterator[pa.RecordBatch], segment_rows: int) -> Iterator[tuple[object, Repair, list[tuple[str, str]], bool]]:
    """Conversation, its repair, the repaired rows that a row gave, and whether the conversation ends there."""
    conv, repair, waiting, used = None, None, [], 0
    for batch in batches:
        for key, _, segment, _, turn, role, text, fault, cost, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if repair is None or key != conv:
                if repair is not None:
                    yield conv, repair, repair.finish(), True
                conv, repair, waiting, used = key, Repair(), [], 0
            if segment == -2:
                continue
            if segment >= 0:
                # The segments of a slice come before its rows, in order.
                if segment == 0:
                    waiting, used = [], 0
                waiting.append((cost, audit))
                continue
            out = []
            if used % segment_rows == 0:
                out = repair.start(*waiting[used // segment_rows])
            used += 1
            yield conv, repair, out + repair.row(turn, role, text, fault), False
    if repair is not None:
        yield conv, repair, repair.finish(), True


def repaired(rows: DataFrame, segment_rows: int = SEGMENT) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, as the cheapest edits leave them.

    Nulls in role and text read as one space, null conv_id is a conversation of its own, rows without a turn come first.
    Inserted rows have an empty text. Conversations that are deleted whole give no rows, nor does an empty table.
    Columns other than conv_id, turn, role and text are not looked at.
    """
    prepare(rows.sparkSession)
    space = F.lit(" ")
    clean = [F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")]
    found = with_edits(rows.select("conv_id", "turn", *clean), None, segment_rows)
    kind = found.schema["conv_id"].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for conv, _, lines, ends in streamed(batches, segment_rows):
            yield from ((conv, place + k, *line) for k, line in enumerate(lines))
            place = 0 if ends else place + len(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is not None:
            fields = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
            yield from in_batches(lines(chain([head], batches)), head.schema.field(0).type, fields)

    return found.mapInArrow(run, f"conv_id {kind}, place long, role string, text string")


def repair_digest(rows: DataFrame, segment_rows: int = SEGMENT) -> DataFrame:
    """Every conversation of `rows` after `damaged`: gaps, faults, cost, audit and the hash of what the repair leaves.

    A conversation all of whose rows were dropped has zeros, an empty audit and the hash of the empty string. A null conv_id
    is a conversation like any other. A role without an initial that fits, the empty one included, is never kept.
    """
    prepare(rows.sparkSession)
    plain = rows.select("conv_id", "turn", "role", "text")
    found = with_edits(damaged(plain), plain, segment_rows)
    kind = found.schema["conv_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is not None:
            fields = [*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())]
            found = streamed(chain([head], batches), segment_rows)
            done = ((conv, *repair.digest()) for conv, repair, _, ends in found if ends)
            yield from in_batches(done, head.schema.field(0).type, fields)

    return found.mapInArrow(run, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string")
