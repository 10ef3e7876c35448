import math
import random
import re

import numpy as np
import pytest

from meterlens.llm import lexical

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, m long, score string"
ITEMS = "item_id long, text string, doc_id long, rank string"


def terms(text):
    return TERMS.findall(re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))


def brute_force(docs, items, k):
    found = [(i, terms(text)) for i, text in docs]
    found = [(i, t) for i, t in found if t]
    number, total = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = {}
    for item, asked in wanted.items():
        scored = []
        for i, t in found:
            m = 100 - 50 + (50 * len(t) * number) // total
            score = 0
            for x in asked:
                if tf := t.count(x):
                    weight = math.floor(1000 * math.log((2 * number + 2) / (2 * df[x] + 1)))
                    score += weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        if scored:
            out[item] = [(n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {item: sorted(rows, key=lambda x: x[0]) for item, rows in out.items()}


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "ABC", "straße", "你好", "x1", "7"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return "".join(w + rng.choice([" ", ", ", "-", "\n", "_"]) for w in rng.choices(vocabulary, weights, k=n))

    docs = [(i, text(rng.choice([1, 2, 5, 5, 5, 30, 80]))) for i in range(400)]
    docs += [(i, docs[3][1]) for i in range(1000, 1200)]  # one stratum with a third of the rows, all tied
    docs += [(7, text(9)), (7, docs[7][1]), (None, text(6)), (None, text(6)), (2000, None), (2001, ""), (2002, " \t.;"), (2003, text(20000))]
    rng.shuffle(docs)
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(40)]
    items += [(50, None), (51, "..."), (52, "nowhere to be found"), (None, text(4)), (3, text(5)), (60, docs[0][1] or "w1")]
    return docs, items


@pytest.mark.parametrize("k", [50, 3])
def test_equals_brute_force(spark, monkeypatch, k):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    expected = brute_force(docs, items, k)
    assert result(lexical.ranked(df, asked, k)) == expected
    # Small blocks, shares, buffers and query blocks change nothing.
    for name, value in (("BLOCK_DOCS", 7), ("SHARE_DOCS", 20), ("HELD_BYTES", 3000), ("QUERY_TERMS", 40)):
        monkeypatch.setattr(lexical, name, value)
    assert result(lexical.ranked(df, asked, k)) == expected


def test_index_is_written_once_and_read_again(spark, tmp_path):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = lexical.write_index(df, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert found.documents == sum(1 for _, t in docs if terms(t)) == index.selectExpr("sum(size(doc_ids))").first()[0]
    assert found.terms == sum(len(terms(t)) for _, t in docs)
    # A block holds one normaliser, and a term's postings by falling tf.
    for row in index.collect():
        runs, tfs = np.frombuffer(row["term_runs"], np.uint32), np.frombuffer(row["run_tfs"], np.uint32).astype(int)
        assert all((np.diff(tfs[a:b]) < 0).all() for a, b in zip(runs[:-1], runs[1:], strict=True))
    asked = spark.createDataFrame(items[:4], "item_id long, text string")
    for k in (2, 60):
        assert result(lexical.search(index, found, asked, k)) == brute_force(docs, items[:4], k)


def test_bounds_leave_blocks_out():
    """Blocks whose bound is below the k-th best score are not visited, and nothing is lost by it."""
    rng = np.random.default_rng(3)
    terms_ = np.arange(1, 41, dtype=np.uint64)
    queries = lexical.Queries([0], terms_, np.arange(40, 0, -1) * 50, np.array([0, 3]), np.array([0, 1, 2]))
    rows = []
    for m in range(60, 160):
        sets = [np.sort(rng.choice(terms_, rng.integers(1, 9), replace=False)) for _ in range(6)]
        rows.append(lexical.block(m, [m * 10 + i for i in range(6)], [s.tobytes() for s in sets], [np.ones(len(s), np.uint32).tobytes() for s in sets]))
    pruned, full = lexical.Best(queries, 3), lexical.Best(queries, 3)
    pruned.meet([lexical.Block(r, queries) for r in rows])
    for r in rows:
        full.meet([lexical.Block(r, queries)])
    assert [x.tolist() for x in pruned.found[0]] == [x.tolist() for x in full.found[0]]
    assert pruned.visits < len(rows) / 2


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for docs, items in ((none, no_items), (some, no_items), (none, spark.createDataFrame([(1, "a")], "item_id long, text string"))):
        df = lexical.ranked(docs, items)
        assert df.collect() == [] and df.columns == ["item_id", "rank", "doc_id", "score"]
