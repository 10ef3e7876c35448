import random
import re

import numpy as np
from pyspark.sql import functions as F

from meterlens.llm import minhash as m
from meterlens.llm.common import Words, byte_classes, text_buffers

import pyarrow as pa


def words_of(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", folded)


def set_of(text, k):
    w = words_of(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_force(rows, k, percent):
    """doc_id -> (n_shingles, component) for distinct ids."""
    sets = {i: set_of(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "x y", "Ab", "aB"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "two\x0bWORDS "), (8, "two words")]
    at = 10
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 12, 40, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((at, rng.choice([" ", "\n", "  "]).join(copy)))
            at += rng.choice([1, 3])
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        for k, percent in ((4, 80), (5, 80)):
            found = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
            expected = brute_force(rows, k, percent)
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
            assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_chain_of_near_copies(spark):
    """Each text is linked with the next only; the group reaches over all of them."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[12 * i : 12 * i + 120])) for i in range(20)]
    rows += [(200 + i, f"other text number {i} with words of its own a{i} b{i} c{i}") for i in range(20)]
    found = {r.doc_id: r.component_id for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    expected = brute_force(rows, 4, 80)
    assert found == {i: c for i, (_, c) in expected.items()}
    assert found[100] == 81


def test_defined_cases(spark):
    schema = "doc_id int, text string, component_id string, node long, bands string, kept int, a long"
    rows = [
        (1, "a b c d e f g", "x", 1, "y", 0, 5),
        (1, "a b c d e f g", "x", 1, "y", 0, 5),
        (2, "q r s t u v w", "x", 1, "y", 0, 5),
        (2, "a b c d e f g", "x", 1, "y", 0, 5),
        (None, "a b c d e f g", "x", 1, "y", 0, 5),
        (3, None, None, None, None, None, None),
    ]
    found = sorted(m.near_duplicates(spark.createDataFrame(rows, schema), 4).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in found if r.doc_id == 1] == [(1, 1, True)] * 2
    assert [(r.doc_id, r.component_id, r.kept) for r in found if r.doc_id == 2] == [(2, 1, False)] * 2
    assert [(r.n_shingles, r.component_id, r.kept) for r in found if r.doc_id is None] == [(4, None, True)]
    assert [(r.n_shingles, r.component_id) for r in found if r.doc_id == 3] == [(0, 3)]
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(3)
    rows = []
    for share in (0, 50, 80, 95, 100):
        common = rng.integers(0, 2**63, 4000).astype(np.uint64)
        own = rng.integers(0, 2**63, (2, 4000)).astype(np.uint64)
        sides = [np.concatenate([common[: 40 * share], x[: 2000 - 20 * share]]) for x in own]
        truth = 40 * share / (40 * share + 2 * (2000 - 20 * share))
        bits = [m.low_bits(m.minima(s)).view(np.int64).tolist() for s in sides]
        rows.append((truth, *bits))
    df = spark.createDataFrame(rows, "truth double, x array<long>, y array<long>")
    for r in df.select("truth", m.estimate("x", "y").alias("e")).collect():
        assert abs(r.truth - r.e) < m.SLACK


def test_long_word_and_long_text():
    texts = ["x" * 300_000 + " " + "y z " * 5, "a " * 50_000, ""]
    data, ends = text_buffers(pa.array(texts))
    words = Words(data, ends, byte_classes(m.SEPARATORS))
    assert np.diff(words.first).tolist() == [11, 50_000, 0]
    assert [len(s) for s in m.shingles(words, 4)] == [len(set_of(t, 4)) for t in texts]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    found = {r.node: r.component for r in m.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(40)}}
    assert m.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sf_table_equals_oracle(spark):
    import duckdb

    from meterlens.llm import oracles, queries

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(duck.execute(oracles.ORACLE["op1_minhash_dedup"]).fetchall())
    found = queries.QUERIES["op1_minhash_dedup"](spark, sf).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert found.filter(F.col("kept")).count() < len(expected)
