import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meterlens.llm import coder, packing, queries, tokenfile, tokens
from meterlens.llm.common import table

PATH = queries.tokenizer_path()
TEXTS = [
    "Plain words, and MORE words.", "", None, "Été à Köln: naïve — “quotes” 12 345 ½ ² x_y a'll it's    b c",
    "<|endoftext|> inside <|startoftext|>", "é combining İstanbul ΣΑΣ ﬁ", "a" * 5000, "日本語 テキスト 😀 mixed", "&&& *** $$$ ###.,; a&&& b.*** --x",
    "tab\tnew\nline\x0bvt\x1cfs\x85nel",
]


TOKENIZER = Tokenizer.from_file(PATH)


def direct(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_tokenizers_ids(monkeypatch):
    encoder = tokens.Encoder(PATH)
    assert encoder.by_word and encoder.bare
    assert [ids.tolist() for ids in encoder.encode(TEXTS)] == [direct(t) for t in TEXTS]
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 5)
    monkeypatch.setattr(tokens, "MEMORY_PARTS", 3)
    assert [ids.tolist() for ids in encoder.encode(TEXTS)] == [direct(t) for t in TEXTS]


def test_words_and_marks_cut_at_once_give_the_tokenizers_ids():
    rng = random.Random(12)
    signs = ["a", "The", "B", "é", "É", "\u0301", "h\u0331", "H\u0331", "'", "'s", "'LL", "x's.", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "1", "½"]
    signs += [".", ",", "..", "&", "*-", "|", "=\u0338", "<", "_", "İ", "K", "ﬁ", "日本", "😀", "<|endoftext|>", "<|EndOfText|>", "ß", "ΣΑΣ", "word"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(5000)]
    encoder = tokens.Encoder(PATH)
    expected = [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    found = [ids.tolist() for low in range(0, 5000, 700) for ids in encoder.encode(texts[low : low + 700])]
    assert found == expected
    assert [len(ids) for ids in encoder.encode(pa.array([None, "", "a b", None]))] == [0, 0, 2, 0] and encoder.encode([]) == []


def test_words_are_looked_up_once_for_many_texts():
    encoder, asked = tokens.Encoder(PATH), []
    look_up = encoder._look_up
    encoder._look_up = lambda words: asked.extend(words) or look_up(words)
    texts = pa.array(["Some words, some WORDS. Words: words some words"] * 500)
    batches = [pa.record_batch([texts.slice(low, 100)], ["text"]) for low in range(0, 500, 100)]
    for batch in tokens.grouped(iter(batches)):
        encoder.encode(batch.column(0))
    assert sorted(asked) == sorted(["some", " some", " words", ",", ".", ":"])


def test_letters_go_to_the_model_itself():
    rng = random.Random(4)
    letters = [c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]) if c not in "×÷"]
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 15))) + rng.choice(["", "", ",", "..", "!?", "***"]) for _ in range(3000)]
    encoder, asked = tokens.Encoder(PATH), []
    encode = encoder._encode
    encoder.words, encoder.parts, encoder.bare = {}, {}, None
    encoder._encode = lambda texts: asked.extend(texts) or encode(texts)
    texts = [" ".join(words[low : low + 30]) for low in range(0, 3000, 30)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [direct(t) for t in texts]
    # Nothing with a letter in it is left to the whole tokenizer.
    assert len(encoder.parts) > 1000 and not [t for t in asked if any(c.isalpha() for c in t)]


def test_other_tokenizers_encode_whole_texts():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    encoder = tokens.Encoder(path)
    assert not encoder.by_word
    whole = Tokenizer.from_file(path)
    assert [i.tolist() for i in encoder.encode(TEXTS)] == [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_coder_round_trip():
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 60, n) for n in (0, 1, 2, 300, 2048)] + [np.zeros(700, np.int64), rng.integers(0, 65536, 900), np.tile([5, 9, 65535], 300)]
    coded = coder.encode(blocks)
    assert all((a == b).all() for a, b in zip(blocks, coder.decode(coded, [len(b) for b in blocks]), strict=True))
    for i in (3, 5, 7):  # every block can be read alone
        assert (coder.decode([coded[i]], [len(blocks[i])])[0] == blocks[i]).all()
    assert len(coded[5]) < 0.1 * 2 * len(blocks[5]) and len(coded[7]) < 0.2 * 2 * len(blocks[7])
    wide = [rng.integers(0, 1 << 32, 100), np.full(50, (1 << 32) - 1)]
    assert all((a == b).all() for a, b in zip(wide, coder.decode(coder.encode(wide, 2), [100, 50], 2), strict=True))
    assert coder.encode([]) == [] and coder.decode([], []) == []


def test_every_symbol_keeps_a_part_of_the_range():
    rng = np.random.default_rng(3)
    model = coder.Model(40, 1)
    symbols = np.arange(4)
    for step in range(1500):
        # Some blocks repeat themselves for ever, others never, the rest change.
        ids = np.where(np.arange(40) < 10, 7, np.where(np.arange(40) < 20, step, rng.integers(0, 3, 40)))
        model.predict()
        parts = np.array([model.parts_of(np.full(40, s)) for s in symbols]).astype(np.int64) >> 16
        first, size = parts[:, 0], parts[:, 1]
        assert (size >= 15).all() and (first[0] == 0).all() and (first[1:] == (first + size)[:-1]).all()
        assert (first[3] + size[3] == 65535).all()
        places = np.concatenate([first, first + size - 1])
        assert (np.array([model.symbol_at(p.astype(np.uint64)) for p in places]) == np.tile(symbols, 2)[:, None]).all()
        model.learn(ids)


def test_segments_are_checked():
    rng = np.random.default_rng(8)
    documents = [rng.integers(0, 300, n).astype(np.uint16) for n in (1, 0, 5000, 17)]
    data = tokenfile.to_bytes(documents)
    assert all((a == b).all() for a, b in zip(documents, tokenfile.from_bytes(data), strict=True))
    assert tokenfile.from_bytes(tokenfile.to_bytes([])) == []
    flipped = bytearray(data)
    flipped[-40] ^= 4
    for bad in (bytes(flipped), data[:-2], data[:10], b"XXXX" + data[4:]):
        with pytest.raises(tokenfile.Corrupt):
            tokenfile.from_bytes(bad)


def test_files_equal_the_tokenizers_ids(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 3000)
    rows = [(7 * i % 31, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (40, "same id", "x", 1), (40, "same id too", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, payload string, start int").repartition(3)
    found = sorted(tokenfile.token_round_trip(df, PATH, 2).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in found] == [r[0] for r in ordered]
    at = 0
    for r, (_, text, _, _) in zip(found, ordered, strict=True):
        ids = [*direct(text), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.token_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_sf_files(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    found = sorted(queries.QUERIES["op4_token_files"](spark, sf).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(docs)
    at = 0
    for r in found:
        ids = [*direct(docs[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def first_fit(sizes, length):
    free, where = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        j = next((j for j, f in enumerate(free) if f >= sizes[i]), len(free))
        if j == len(free):
            free.append(length)
        where[i] = (j, length - free[j])
        free[j] -= sizes[i]
    return [where[i] for i in range(len(sizes))]


def test_tournament_tree_equals_first_fit():
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 100, 257):
        sizes = np.array([rng.randint(1, rng.choice([5, 40, 100])) for _ in range(n)], np.int64)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == first_fit(sizes.tolist(), 100)


def check_packing(rows, docs, end_id):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for name, text in docs.items():
        ids, at = [*direct(text), end_id], 0
        for r in sorted(by_doc.pop(name), key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
    return len(by_sequence)


def test_sf_packing(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = queries.QUERIES["op6_packing"](spark, sf).collect()
    sequences = check_packing(rows, docs, 1)
    assert sum(r.length for r in rows) >= 0.97 * packing.LENGTH * sequences


def test_packing_cases(spark):
    rows = [(None, "no id", 1), (1, None, 1), (2, "", 1), (3, "word " * 5000, 1), (3, "word " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    found = packing.packed(df, PATH).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length) for r in found) == sorted(
        [(False, 0, 0, 3), (True, 1, 0, 1), (True, 2, 0, 1)] + [(True, 3, s, n) for s, n in ((0, 2048), (2048, 2048), (4096, 905))] * 2
    )
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and min(own)[0] == 0
    groups = packing.pack(packing.pieces(df, PATH, 1), group=2).collect()
    assert len(groups) == len(found) and len({r.sequence_id >> 32 for r in groups}) > 1
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_coded_bytes_stay_as_they_are():
    """Written files stay readable: the coder's passes may be merged, but its bytes are those of version 2."""
    numbers = np.arange(3000, dtype=np.int64)
    blocks = [numbers * numbers % 997 % 61, numbers[:500] % 7 * 9000, numbers[:0], numbers[:1200] * 7919 % 65521]
    assert [crc32(b) for b in coder.encode(blocks)] == [2794070124, 2305761521, 1696784233, 391824848]
    assert [crc32(b) for b in coder.encode([b * 60000 for b in blocks], 2)] == [3353228392, 2927930651, 1696784233, 2136021647]
