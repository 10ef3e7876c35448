import random

import numpy as np

from meterlens.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, share string, dims int"


def brute_force(rows, k, chosen):
    kept = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = {}
    for i, v in kept:
        if chosen(i):
            scored = sorted(
                (-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in kept if j != i and len(w) == len(v)
            )[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return out


def result(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {i: sorted(v) for i, v in found.items()}


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5, rng.random()]) for _ in range(40)]) for i in range(300)]
    rows += [(1000 + i, list(rows[i][1])) for i in range(30)]  # ties
    rows += [(2000, None), (2001, []), (2002, [None] * 40), (2003, [float("nan")] * 40), (2004, [float("inf")] * 40), (None, [1.0] * 40)]
    rows += [(3000 + i, [rng.random() for _ in range(3)]) for i in range(4)]
    rows += [(4000, [1e7] * 40), (4050, [-1e7] * 40)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    chosen = lambda i: i % 50 == 0
    expected = {i: v for i, v in brute_force(rows, 5, chosen).items() if v}
    for components in (1 << 16, 400):
        monkeypatch.setattr(topk, "COMPONENTS", components)
        assert result(topk.top_k(df, df.filter("vec_id % 50 = 0"), 5)) == expected


def test_pruning_drops_nothing():
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 40, (600, 64)).astype(np.int64)
    ids = np.arange(600)
    best = topk.Best(ids[:20], np.ascontiguousarray(vectors[:20].T), 5)
    for low in range(0, 600, 150):
        best.meet(ids[low : low + 150], np.ascontiguousarray(vectors[low : low + 150].T))
    scores = vectors @ vectors[:20].T
    for q in range(20):
        order = [i for i in np.lexsort((ids, -scores[:, q])) if i != q][:5]
        assert best.found[q].tolist() == order and best.score[q].tolist() == scores[order, q].tolist()


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0, "", 0), (1, [1.0, 1.0], 0, "", 0), (1, [1.0, 1.0], 0, "", 0)], SCHEMA)
    assert result(topk.top_k(df, df.filter("vec_id = 0"), 5)) == {0: [(1, 1, 256 * 256 * 3), (2, 1, 256 * 256 * 3)]}
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, empty, 5).count() == 0
    assert topk.top_k(df, empty, 5).count() == 0


def test_sf_table_equals_oracle(spark):
    import duckdb

    from meterlens.llm import oracles

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    expected = sorted(duck.execute(oracles.ORACLE["op3_exact_topk"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op3_exact_topk"](spark, sf).collect()) == expected
