"""Token ids by the tokenizers library, with a worker-wide memory of words.

The tokenizer drops white space, ends its pieces there and where a letter meets a plain punctuation mark, and lower-cases, so
the ids of a text are those of its lower-cased words and marks one after another; `Encoder` checks this for the tokenizer that
it is given and otherwise encodes whole texts. Texts are cut many at once, by arrays of their bytes, and the ids of a word are
looked up once for all its places there. Words that a worker has not met are encoded together. Words of plain Latin letters
with plain punctuation after them are remembered in two parts. A part is one piece, in lower case, so it goes to the library's
model itself where that gives the same ids; the library needs more time to normalize and cut a piece than to encode it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, models, pre_tokenizers

from meterlens.llm.common import text_buffers

#: Words, and lower-case parts of words, that a worker remembers; beyond these the memory starts anew. Results do not
#: depend on it.
MEMORY_WORDS, MEMORY_PARTS = 300_000, 100_000
#: Parts that are encoded at once.
PARTS = 256

LETTERS, MARKS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), ".,;:!?%&$*#|-"
SPACES = " \t\n\x0b\x0c\r"
#: Rows and bytes of text that are cut at once.
CUT_ROWS, CUT_BYTES = 1024, 1 << 22
PROBE = "Ab'll x,, 12y É. z\tß-q $5 &&& *** #a"


def memory(path: str) -> dict:
    """The words of this worker process. Functions that come by value bring no globals, so the memory is a module's."""
    holder = sys.modules.setdefault("_token_memory", ModuleType("_token_memory"))
    return holder.__dict__.setdefault(path, {})


def byte_kinds(**kinds: str) -> np.ndarray:
    """The number of each byte's kind, from 1 on in the order given; 0 for others."""
    kind = np.zeros(256, np.uint8)
    for n, signs in enumerate(kinds.values(), 1):
        kind[list(signs.encode())] = n
    return kind


SMALL, CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KINDS = byte_kinds(space=SPACES, letter=SMALL + CAPITAL, mark=MARKS)
SPACE, LETTER, MARK = 1, 2, 3


def word_cuts(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in lower case, and where words and marks begin, with the white space before them.

    A capital before a sign that is not ASCII stays, since the two may be one letter; the tokenizer sees to it.
    """
    kind = KINDS[data]
    capital = (data >= 65) & (data <= 90)
    capital[:-1] &= data[1:] < 128
    before, here = kind[:-1], kind[1:]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (here == SPACE) & (before != SPACE) | (here == LETTER) & (before == MARK) | (here == MARK) & (before == LETTER)
    cut[begin] = True
    return data + (capital.view(np.uint8) << 5), np.flatnonzero(cut[:-1])


def ids_of(data: np.ndarray, ends: np.ndarray, cuts: np.ndarray, look_up: Callable[[list[str]], list[bytes]], dtype: np.dtype) -> list[np.ndarray]:
    """The ids of each text, which ends at `ends[1:]` and is cut into pieces at `cuts`; `look_up` is asked once for each piece."""
    if not len(cuts):
        return [np.zeros(0, dtype)] * (len(ends) - 1)
    offsets = np.append(cuts, len(data)).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    encoded = pieces.dictionary_encode()
    found = pa.array(look_up(encoded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(encoded.indices)
    _, stops, joined = found.buffers()
    ids = np.frombuffer(joined, dtype) if joined is not None else np.zeros(0, dtype)
    stops = np.frombuffer(stops, np.int64, len(found) + 1) // dtype.itemsize
    at = stops[np.searchsorted(cuts, ends)].tolist()
    return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to larger ones, since words repeat more in these."""
    waiting: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        waiting.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= CUT_ROWS or size >= CUT_BYTES:
            yield pa.concat_batches(waiting)
            waiting, rows, size = [], 0, 0
    if waiting:
        yield pa.concat_batches(waiting)


def holding(texts: pa.Array, data: np.ndarray, signs: list[str]) -> list[int]:
    """The rows of the texts, whose bytes are `data`, that hold one of the strings."""
    found, together = np.zeros(len(texts), bool), data.tobytes()
    for sign in (s for s in signs if s.encode() in together):
        found |= pc.match_substring(texts, sign).to_numpy(zero_copy_only=False)
    return np.flatnonzero(found).tolist()


class Encoder:
    """Texts to ids of two bytes each (four where the vocabulary needs it), without special tokens.

    `remember` is the number of words that are remembered, if not `MEMORY_WORDS`.
    """

    def __init__(self, path: str, remember: int | None = None):
        self.remember = remember
        known = memory(path)
        if "words" not in known:
            tokenizer = Tokenizer.from_file(path)
            known |= {"tokenizer": tokenizer, "words": {}, "parts": {}, "bare": bare(tokenizer, path)}
            known["model"] = known["bare"] and model_of_pieces(tokenizer)
        self.tokenizer: Tokenizer = known["tokenizer"]
        self.words: dict[str, bytes] = known["words"]
        self.parts: dict[str, bytes] = known["parts"]
        self.bare: tuple[Tokenizer, np.ndarray] | None = known["bare"]
        self.model: tuple[models.Model, dict[int, str]] | None = known["model"]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        whole = self.tokenizer.encode(PROBE, add_special_tokens=False).ids
        low, cuts = word_cuts(np.frombuffer(PROBE.encode(), np.uint8), np.zeros(1, np.int64))
        words = [low[a:b].tobytes().decode().strip(SPACES) for a, b in zip(cuts, [*cuts[1:], len(low)], strict=True)]
        self.by_word = whole == [i for w in words for i in self.tokenizer.encode(w, add_special_tokens=False).ids]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self, words: list[str]) -> None:
        plain, cores, parted, odd = [], [], [], []
        for word in words:
            core = word.strip(SPACES)
            if core.isascii() and core.isalpha() and core.islower():
                plain.append(word)
                cores.append(core)
                continue
            letters = core.rstrip(MARKS)
            if not (letters.isascii() and letters.isalpha() or LETTERS.fullmatch(letters)):
                odd.append((word, core))
            elif letters == core and letters.islower():
                plain.append(word)
                cores.append(core)
            else:
                parted.append((word, letters.lower(), core[len(letters) :]))
        needed = {a for _, a, _ in parted}
        needed.update(b for _, _, b in parted)
        needed.discard("")
        self.words.update(zip([w for w, _ in odd], self._encode([c for _, c in odd]), strict=True))
        if len(self.parts) + len(needed) > MEMORY_PARTS:
            self.parts.clear()
        new = sorted(needed.difference(self.parts))
        for known, names, some in ((self.words, plain, cores), (self.parts, new, new)):
            for low in range(0, len(some), PARTS):
                known.update(zip(names[low : low + PARTS], self._encode_parts(some[low : low + PARTS]), strict=True))
        parts = self.parts
        self.words.update((w, parts[a] + parts[b] if b else parts[a]) for w, a, b in parted)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Parts are one piece each, so they are encoded one after another, or in one go and cut after the tokens that end a piece."""
        if self.model:
            model, spelled = self.model
            tokenize, size = model.tokenize, self.dtype.itemsize
            found = [[t.id for t in tokenize(p if p.isascii() else p.translate(spelled))] for p in parts]
            data = np.fromiter(chain.from_iterable(found), self.dtype).tobytes()
            cuts = [0, *accumulate(size * len(ids) for ids in found)]
            return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if self.bare:
            tokenizer, last = self.bare
            ids = np.array(tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(parts):
                data, cuts = ids.tobytes(), [0, *(ends * self.dtype.itemsize).tolist()]
                return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return self._encode(parts)

    def _look_up(self, words: list[str]) -> list[bytes]:
        if len(self.words) + len(words) > (self.remember or MEMORY_WORDS):
            self.words.clear()
        found = list(map(self.words.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([words[i] for i in new])
        for i in new:
            found[i] = self.words[words[i]]
        return found

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts, "")
        if not self.by_word:
            return [np.frombuffer(b, self.dtype) for b in self._encode(texts.to_pylist())]
        data, ends = text_buffers(texts)
        low, cuts = word_cuts(data, ends[:-1])
        found = ids_of(low, ends, cuts, self._look_up, self.dtype)
        # A special token's string is one token wherever it stands; the few texts that hold one are encoded whole.
        for i in holding(texts, data, self.special):
            found[i] = np.frombuffer(self._encode([texts[i].as_py()])[0], self.dtype)
        return found


def bare(tokenizer: Tokenizer, path: str) -> tuple[Tokenizer, np.ndarray] | None:
    """The tokenizer without its normalizer for lower-case parts between spaces, and which tokens end a piece.

    None if the vocabulary does not mark the ends of pieces, or if the shortened tokenizer differs on a probe.
    """
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    short = Tokenizer.from_file(path)
    short.normalizer = None
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    short.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        last[i] = token.endswith(suffix)
    probe = "thndhain é çöß ... &&& || *** zurück"
    same = tokenizer.encode(probe, add_special_tokens=False).ids == short.encode(probe, add_special_tokens=False).ids
    return (short, last) if same else None


def model_of_pieces(tokenizer: Tokenizer) -> tuple[models.Model, dict[int, str]] | None:
    """The tokenizer's model, for lower-case parts, and how it spells their letters that are not ASCII.

    None if the model needs anything else from the tokenizer, which a probe of all letters and marks shows.
    """
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = [c for c in map(chr, range(0xDF, 0x100)) if LETTERS.fullmatch(c)]
    spelled = str.maketrans({c: byte_level.pre_tokenize_str(c)[0][0] for c in letters})
    probe = [*SMALL, *letters, *MARKS, *"thndhain ... &&& || *** zurück internationalization".split(), *(f"a{c}{c}e" for c in letters)]
    found = [t.id for piece in probe for t in tokenizer.model.tokenize(piece.translate(spelled))]
    same = found == tokenizer.encode(" ".join(probe), add_special_tokens=False).ids
    return (tokenizer.model, spelled) if same else None
