"""An adaptive context-mixing range coder for token ids, for many blocks in lockstep.

Every block is coded by itself: its state begins anew, so any block can be read alone. In a block the ids that followed the
last two ids (order 2) and the last id (order 1) when they stood there before, and the id that is most common of late (order
0), are the predictions. A symbol says which prediction comes true, the highest order first, or that none does; then the id
itself follows in 16-bit digits. The orders are mixed by their standing: for every combination of how often the predictions
of the three orders have held, a block has one adaptive distribution of the symbols, and that drives a carry-less range coder
with 16-bit output digits.

Numpy advances all blocks by one id at a time. A distribution is four 16-bit shares in one 64-bit number, so elementwise sums
and shifts of integers move all four; they give the same numbers in the encoder and the decoder.
"""

from __future__ import annotations

import numpy as np

#: Entries of a context table.
SLOTS = 1024
#: How often a prediction held, up to 7; how these are told apart when the orders are mixed; symbols.
HELD, LEVELS = 8, np.array([0, 1, 2, 2, 3, 3, 3, 3])
MIXED, SYMBOLS = 64, 4
WHOLE = 1 << 16
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
FOUR, DIGIT, WIDE = np.uint64(4), np.uint64(16), np.uint64(32)


def four(*shares: int) -> np.uint64:
    return np.uint64(sum(x << 16 * k for k, x in enumerate(shares)))


#: A share loses 1 / 32 with every symbol and the newest symbol's share gains NEWEST, so shares stay below 2^16, and their sum
#: below 2^16 + 128. Of their parts 1 / 256 is left for LEAST parts more of each symbol; the last symbol has the rest.
LOST, LOST_BITS = np.uint64(5), four(*[0x07FF] * 4)
NEWEST = np.array([four(*[0] * k, 2046) for k in range(SYMBOLS)])
SPARED, SPARED_BITS = np.uint64(8), four(*[0x00FF] * 4)
LEAST, EVEN = four(0, 16, 32, 48), four(*[WHOLE // SYMBOLS] * 4)
SUMS, END = four(1, 1, 1, 1), four(0, 0, 0, WHOLE - 1)
LOW = np.uint64(WHOLE - 1)


def held_next() -> np.ndarray:
    """By order, whether the prediction came true and how often it had held: how often it has held now, and above that all bits
    set unless a new prediction of the id takes its place.

    A prediction that fails while it is not well established gives way; order 0 changes its mind last.
    """
    change, fresh = np.zeros((3, 2, HELD), np.int64), np.zeros((3, 2, HELD), bool)
    for held in range(HELD):
        change[:, 1, held] = held < HELD - 1
        change[:2, 0, held], fresh[:2, 0, held] = (held >> 1) - held if held > 1 else 0, held <= 1
        change[2, 0, held], fresh[2, 0, held] = -1 if held else 1, held == 0
    return (np.where(fresh, 0, np.arange(HELD)) + change + np.where(fresh, 0, -HELD)).ravel()


NEXT = held_next()
#: The mixed state for how often the predictions of orders 2, 1 and 0 have held.
STATES = np.array([LEVELS[a] << 4 | LEVELS[b] << 2 | LEVELS[c] for a in range(HELD) for b in range(HELD) for c in range(HELD)])
#: The symbol for which of the predictions came true: order 2 counts 4, order 1 2 and order 0 1.
SYMBOL = np.array([3, 2, 1, 1, 0, 0, 0, 0])


class Model:
    """Predictions and symbol distributions of `n` blocks.

    A table entry holds an id plus 1 (0: none) and in its lowest three bits how often it held as a prediction. Orders 2
    and 1 have an entry for each context, order 0 has one. Blocks lie one after another in every table.
    """

    def __init__(self, n: int, digits: int):
        self.kind = np.dtype(np.int32 if digits == 1 else np.int64)
        self.n, rows = n, np.arange(n)
        self.slots, self.states = np.array([rows, rows + n]) * SLOTS, rows * MIXED
        self.tables = np.zeros(2 * n * SLOTS, self.kind)
        self.common = np.zeros(n, self.kind)
        self.shares = np.full(n * MIXED, EVEN)
        self.one, self.two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.next, self.orders = NEXT.astype(self.kind), np.array([[0], [2 * HELD], [4 * HELD]], np.uint8)

    def narrow(self, n: int) -> None:
        """Go on with the first `n` blocks."""
        self.n = n
        for name in ("slots", "states", "common", "one", "two"):
            setattr(self, name, getattr(self, name)[..., :n])

    def predict(self) -> None:
        """Look up what `symbol_at`, `parts_of` and `learn` need."""
        at = self.at = np.empty((2, self.n), np.int64)
        two, one = at
        np.multiply(self.one, 0x9E3779B1, out=one)
        np.multiply(self.two, 0x85EBCA77, out=two)
        two ^= one
        two *= 0x2545F491
        at >>= 13
        at &= SLOTS - 1
        at += self.slots
        entry = self.entry = np.empty((3, self.n), self.kind)
        self.tables.take(at, out=entry[:2], mode="clip")
        entry[2] = self.common
        held = self.held = entry & HELD - 1
        self.known = np.empty((4, self.n), self.kind)
        self.guess = np.right_shift(entry, 3, out=self.known[:3])
        self.state = self.states + STATES.take((held[0] << 6) + (held[1] << 3) + held[2], mode="clip")
        told = self.told = self.shares.take(self.state, mode="clip")
        sums = (told - (told >> SPARED & SPARED_BITS)) * SUMS
        # Where the symbols begin, 16 bits each, and where they end.
        self.begin = (sums << DIGIT) + LEAST
        self.end = (self.begin >> DIGIT) | END

    def symbol_at(self, place: np.ndarray) -> np.ndarray:
        """The symbol that the part of 2^16 belongs to."""
        symbol = (place >= (self.end & LOW)).view(np.uint8)
        symbol += (place >= (self.end >> DIGIT & LOW)).view(np.uint8)
        symbol += (place >= (self.end >> WIDE & LOW)).view(np.uint8)
        return symbol.astype(np.int64)

    def parts_of(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbols' parts begin among 2^32, and their sizes."""
        shift = symbol.view(np.uint64) << FOUR
        first = self.begin >> shift & LOW
        return first << DIGIT, ((self.end >> shift & LOW) - first) << DIGIT

    def learn(self, ids: np.ndarray) -> np.ndarray:
        """Which symbols the ids were."""
        stored = ids.astype(self.kind) + self.kind.type(1)
        right = self.guess == stored
        as_bits = right.view(np.uint8)
        symbol = SYMBOL.take((as_bits[0] << 2) + (as_bits[1] << 1) + as_bits[2], mode="clip")
        self.shares[self.state] = self.told - (self.told >> LOST & LOST_BITS) + NEWEST.take(symbol, mode="clip")
        how = as_bits << 3
        how |= self.held.astype(np.uint8)
        how |= self.orders
        # The entry's id where it is kept, else the stored one, and how often it has held.
        stored <<= 3
        new = self.entry
        new ^= stored
        new |= HELD - 1
        new &= self.next.take(how, mode="clip")
        new ^= stored
        self.tables[self.at] = new[:2]
        self.common[:] = new[2]
        self.two, self.one = self.one, ids
        return symbol


def settled(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first digit is known, or has to be made known because the range is small, and the range that is left: one that
    lies across a border is cut back to end there."""
    known, small = (low ^ (low + span)) < TOP, span < BOTTOM
    across = small > known
    if across.any():
        span = np.where(across, (np.uint64(0) - low) & (BOTTOM - np.uint64(1)), span)
    return known | small, span


class Writer:
    """The range coder's state of `n` blocks and the digits that they have put out."""

    def __init__(self, n: int, digits: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.out, self.used = np.zeros(n * digits, np.uint16), np.arange(n) * digits
        self.digits = digits

    def put(self, rows: slice | np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Code the part of the range from `begin` on, of `size` of 2^32 parts."""
        part = self.range[rows] >> WIDE
        low = self.low[rows] + part * begin
        span = part * size
        ready, span = settled(low, span)
        if isinstance(rows, slice):
            # Most blocks put out a digit, so all write one, and it stays where it is ready; further digits are few.
            used = self.used[rows]
            self.out[used] = (low >> np.uint64(48)).astype(np.uint16)
            moved = ready.astype(np.int64)
            used += moved
            shift = moved.view(np.uint64) << FOUR
            low, span = low << shift, span << shift
            ready, span = settled(low, span)
        self.low[rows], self.range[rows] = low, span
        rows = np.flatnonzero(ready) if isinstance(rows, slice) else rows[ready]
        while len(rows):
            low, span = self.low[rows], self.range[rows]
            self.out[self.used[rows]] = low >> np.uint64(48)
            self.used[rows] += 1
            low = low << DIGIT
            ready, span = settled(low, span << DIGIT)
            self.low[rows], self.range[rows] = low, span
            rows = rows[ready]

    def end(self) -> list[bytes]:
        n = len(self.low)
        for shift in (48, 32, 16, 0):
            self.out[self.used] = (self.low >> np.uint64(shift)).astype(np.uint16)
            self.used += 1
        first = (np.arange(n) * self.digits).tolist()
        data = self.out.astype("<u2", copy=False)
        return [data[a:b].tobytes() for a, b in zip(first, self.used.tolist(), strict=True)]


class Reader:
    """The range coder's state of blocks that are read."""

    def __init__(self, blocks: list[bytes]):
        sizes = np.array([len(b) // 2 for b in blocks], np.int64)
        # Damaged blocks may ask for more than there is; then they get zeros, and their checksums tell.
        self.data = np.concatenate([np.frombuffer(b"".join(blocks), "<u2"), np.zeros(4, np.uint16)])
        self.at = np.cumsum(sizes) - sizes
        n = len(blocks)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code = np.zeros(n, np.uint64)
        for _ in range(4):
            self.code = self.code << DIGIT | self.data.take(self.at, mode="clip")
            self.at += 1

    def scaled(self, rows: slice | np.ndarray) -> np.ndarray:
        """Which of the 2^32 parts of the range the code lies in."""
        parts = (self.code[rows] - self.low[rows]) // (self.range[rows] >> WIDE)
        return np.minimum(parts, np.uint64(0xFFFFFFFF))

    def take(self, rows: slice | np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        part = self.range[rows] >> WIDE
        low = self.low[rows] + part * begin
        span = part * size
        ready, span = settled(low, span)
        if isinstance(rows, slice):
            at, code, moved = self.at[rows], self.code[rows], ready.astype(np.int64)
            digit = self.data.take(at, mode="clip").astype(np.uint64)
            digit *= moved.view(np.uint64)
            shift = moved.view(np.uint64) << FOUR
            code <<= shift
            code |= digit
            at += moved
            low, span = low << shift, span << shift
            ready, span = settled(low, span)
        self.low[rows], self.range[rows] = low, span
        rows = np.flatnonzero(ready) if isinstance(rows, slice) else rows[ready]
        while len(rows):
            low, span, at = self.low[rows], self.range[rows], self.at[rows]
            self.code[rows] = self.code[rows] << DIGIT | self.data.take(at, mode="clip")
            self.at[rows] = at + 1
            low = low << DIGIT
            ready, span = settled(low, span << DIGIT)
            self.low[rows], self.range[rows] = low, span
            rows = rows[ready]


def active(lengths: np.ndarray) -> np.ndarray:
    """How many blocks, longest first, have an id at each place."""
    return np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")


def encode(blocks: list[np.ndarray], digits: int = 1) -> list[bytes]:
    """The bytes of each block of ids below 2^(16 * digits)."""
    lengths = np.array([len(b) for b in blocks], np.int64)
    order = np.argsort(-lengths, kind="stable")
    n, longest = len(blocks), int(lengths.max(initial=0))
    model, writer = Model(n, digits), Writer(n, (digits + 2) * longest + 64)
    lanes = np.zeros((n, longest), "<u2" if digits == 1 else "<i8")
    for lane, i in enumerate(order):
        lanes[lane, : lengths[i]] = blocks[i]
    grid = np.ascontiguousarray(lanes.T)
    for t, going in enumerate(active(lengths[order]).tolist()):
        if going < model.n:
            model.narrow(going)
        ids = grid[t, :going].astype(np.int64)
        model.predict()
        symbol = model.learn(ids)
        first, size = model.parts_of(symbol)
        # A new id's highest digit takes an equal share of its symbol's part.
        new = symbol == 3
        as_number, values = new.astype(np.uint64), ids.view(np.uint64)
        size >>= as_number << FOUR
        first += size * ((values >> np.uint64(16 * (digits - 1)) if digits > 1 else values) * as_number)
        writer.put(slice(0, going), first, size)
        if digits > 1:
            rows = np.flatnonzero(new)
            for shift in range(16 * (digits - 2), -1, -16):
                writer.put(rows, (values[rows] >> np.uint64(shift) & LOW) << DIGIT, np.full(len(rows), 1 << 16, np.uint64))
    found = writer.end()
    out: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        out[i] = found[lane]
    return out


def decode(blocks: list[bytes], lengths: list[int], digits: int = 1) -> list[np.ndarray]:
    """The ids of each block, given how many there are."""
    sizes = np.array(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    n = len(blocks)
    grid = np.zeros((int(sizes.max(initial=0)), n), np.int32 if digits == 1 else np.int64)
    model, reader, lane = Model(n, digits), Reader([blocks[i] for i in order]), np.arange(n)
    for t, going in enumerate(active(sizes[order]).tolist()):
        if going < model.n:
            model.narrow(going)
        rows = slice(0, going)
        model.predict()
        place = reader.scaled(rows)
        symbol = model.symbol_at(place >> DIGIT)
        first, size = model.parts_of(symbol)
        new = symbol == 3
        share = size >> DIGIT
        value = np.minimum((place - first) // share, LOW)
        as_number = new.astype(np.uint64)
        size >>= as_number << FOUR
        as_number *= value
        as_number *= share
        first += as_number
        reader.take(rows, first, size)
        if digits > 1:
            rows = np.flatnonzero(new)
            for _ in range(digits - 1):
                digit = reader.scaled(rows) >> DIGIT
                reader.take(rows, digit << DIGIT, np.full(len(rows), 1 << 16, np.uint64))
                value[rows] = value[rows] << DIGIT | digit
        # The predictions are ids plus 1, and so is the last row, which the new ids are read from.
        np.add(value, np.uint64(1), out=model.known[3], casting="unsafe")
        symbol *= going
        symbol += lane[:going]
        ids = model.known.take(symbol, mode="clip").astype(np.int64)
        ids -= 1
        model.learn(ids)
        grid[t, :going] = ids
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    lanes = np.ascontiguousarray(grid.T)
    for row, i in zip(lanes, order, strict=True):
        out[i] = row[: sizes[i]].astype(np.int64)
    return out
