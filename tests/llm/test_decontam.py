import itertools
import random
import re

from meterlens.llm import decontam as d, queries
from meterlens.llm.common import table

DOCS, ITEMS = "doc_id long, text string, item_id int, words string, seed int", "item_id long, text string, place int"


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_force(docs, items):
    """Every diagonal of every pair, the best stretch by trying all starts and ends."""
    out = {}
    for doc_id, text in docs:
        w = plain_words(text)
        for item_id, item in items:
            v = plain_words(item)
            if doc_id is None or item_id is None or text is None or item is None:
                continue
            best = None
            for shift in range(-len(v) + 1, len(w)):
                if not any(
                    all(0 <= q + o + shift < len(w) and q + o < len(v) and w[q + o + shift] == v[q + o] for o in mask)
                    for mask in d.MASKS
                    for q in range(len(v))
                ):
                    continue
                low, high = max(0, -shift), min(len(v), len(w) - shift)
                top = None
                for a in range(low, high):
                    score = matched = 0
                    for b in range(a, high):
                        same = w[b + shift] == v[b]
                        score, matched = score + (1 if same else -3), matched + same
                        if top is None or score > top[0] or (score == top[0] and (b, a) < (top[3], top[2])):
                            top = (score, matched, a, b)
                if top and (top[1] >= d.MATCHED or (top[1] >= d.SPAN and top[1] >= d.COVERAGE * len(v))):
                    key = (-top[0], top[2] + shift, top[2])
                    if best is None or key < best[0]:
                        best = (key, (top[1], top[3] + 1 - top[2], len(v), top[2] + shift, top[3] + 1 + shift, top[2]))
            if best:
                out[doc_id, item_id] = best[1]
    return out


def found(df):
    return {
        (r.doc_id, r.item_id): (r.matched, r.length, r.item_words, r.word_start, r.word_end, r.item_start) for r in df.collect()
    }


def test_two_substitutions_in_fifteen_words_leave_a_seed():
    for gone in itertools.combinations(range(15), 2):
        assert any(
            all(start + o not in gone for o in mask) for mask in d.MASKS for start in range(15 - mask[-1])
        )


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "das"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 15, 30])))) for i in range(12)]
    items += [(20, items[4][1].upper().replace(" ", ", ")), (21, None), (22, ""), (None, items[2][1])]
    docs = []
    for n in range(40):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 40, 80]))]
        for _ in range(rng.choice([0, 1, 2])):
            passage = plain_words(rng.choice(items[:12])[1])
            for _ in range(rng.choice([0, 1, 2, 4])):
                passage[rng.randrange(len(passage))] = "changed"
            cut = rng.choice([0, 0, 3])
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[cut:]
        docs.append((n, rng.choice([" ", " -- ", "\n"]).join(text)))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "  ... ")]
    left = spark.createDataFrame([(*x, 1, "x", 2) for x in docs], DOCS)
    right = spark.createDataFrame([(*x, 3) for x in items], ITEMS)
    expected = brute_force(docs, items)
    assert len(expected) > 10
    assert found(d.overlaps(left, right)) == expected
    kept = {r.doc_id for r in d.decontaminated(left, right).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in expected}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    small = found(d.overlaps(docs, items))
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    assert small and found(d.overlaps(docs, items)) == small


def test_repeats_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, 1, "x", 2)] * 2 + [(1, "x " + passage, 1, "x", 2), (2, "clean", 1, "x", 2)], DOCS)
    items = spark.createDataFrame([(7, passage, 3)] * 2, ITEMS)
    assert found(d.overlaps(docs, items)) == {(1, 7): (20, 20, 20, 0, 20, 0)}
    assert d.decontaminated(docs, items).columns == docs.columns
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert d.overlaps(no_docs, items).count() == 0 and d.overlaps(docs, no_items).count() == 0
    assert d.decontaminated(docs, no_items).count() == 4


def test_planted_passages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    items = {r.item_id: plain_words(r.text) for r in table(spark, sf, "benchmark").collect()}
    expected = set()
    for r in table(spark, sf, "documents").collect():
        text = " " + " ".join(plain_words(r.text)) + " "
        expected |= {(r.doc_id, i) for i, w in items.items() if f" {' '.join(w)} " in text}
    got = found(queries.QUERIES["op7_decontamination"](spark, sf))
    assert expected <= set(got)
    assert all(matched >= d.MATCHED or matched >= d.SPAN for matched, *_ in got.values())


def test_no_python_in_the_plan(spark):
    sf = "/root/testdata/sf0.001"
    plan = queries.QUERIES["op7_decontamination"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
