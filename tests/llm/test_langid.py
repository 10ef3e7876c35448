import random

import numpy as np
from pyspark.sql import functions as F

from meterlens.llm import langid, queries
from meterlens.llm.common import table


def plain_counts(text):
    data = text.encode()
    folded = [32] + [b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in data] + [32]
    counts = np.zeros(langid.BUCKETS, np.int64)
    codes = []
    for i in range(len(folded) - 1):
        two = folded[i] | folded[i + 1] << 8
        if two != 0x2020:
            codes.append(two + (1 << 24))
    for i in range(len(folded) - 2):
        a, b, c = folded[i : i + 3]
        if (a, b) != (32, 32) and (b, c) != (32, 32):
            codes.append(a | b << 8 | c << 16)
    for code in codes:
        h = code * 2654435761 & 0xFFFFFFFF
        counts[(h ^ h >> 15) >> 20] += 1
    return counts


def test_subwords_equal_a_plain_count(monkeypatch):
    rng = random.Random(4)
    for size in (0, 1, 2, 3, 5, 40):
        text = "".join(rng.choice("aB é1  .ß") for _ in range(size))
        data = np.frombuffer(text.encode(), np.uint8)
        whole = langid.subword_counts(data)
        if data.size:
            assert (whole == plain_counts(text)).all()
        for cut in (3, 7):
            monkeypatch.setattr(langid, "SLICE_BYTES", cut)
            assert (langid.subword_counts(data) == whole).all()
            monkeypatch.undo()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    found = queries.QUERIES["op2_language_id"](spark, sf).join(langs, "doc_id").cache()
    assert found.count() == langs.count()
    held = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97
    assert found.filter("score < 0 or score > 1").count() == 0


def test_defined_cases(spark):
    train = [(i, f"the and of that {i}", "en") for i in range(40)] + [(100 + i, f"der und die nicht {i}", "de") for i in range(40)]
    schema = "doc_id long, text string, lang string"
    model = langid.train(spark.createDataFrame(train, schema))
    assert model.languages == ["de", "en"]
    schema = "doc_id long, text string, lang string, lang_pred int, Lang_Score string"
    rows = [(1, "the of and", None, 3, "x"), (2, None, "de", 3, "x"), (3, "", "de", 3, "x"), (4, "12 345 !", "de", 3, "x")]
    rows += [(5, "der und die nicht " * 200_000, "en", 3, "x"), (5, "der und die nicht", "en", 3, "x"), (None, "the of", "de", 3, "x"), (6, "жук", None, 1, "y")]
    found = langid.identify(spark.createDataFrame(rows, schema), model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_rejected"]
    got = [(r.doc_id, r.lang_pred, r.lang_rejected) for r in found.collect()]
    assert got[:4] == [(1, "en", False), (2, "und", True), (3, "und", True), (4, "und", True)]
    assert got[4:7] == [(5, "de", False), (5, "de", False), (None, "en", False)]
    assert got[7][1] in ("de", "en")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = langid.train(empty)
    assert none.languages == [] and langid.identify(empty, none).count() == 0
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame(rows[:1], schema), none).collect()] == ["und"]
    one = langid.train(spark.createDataFrame(train[:5], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame(rows[:1], schema), one).collect()] == ["en"]


def test_label_and_id_are_no_inputs(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = langid.train(docs)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(""), "doc_id": F.col("doc_id")})
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.lang_score) for r in df.collect())
    assert key(langid.identify(docs, model)) == key(langid.identify(other, model))


def test_sample_is_bounded(spark):
    rows = [(i, "the of and" if i % 2 else "der und die", "en" if i % 2 else "de") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, rows=50)
    assert model.languages == ["de", "en"]
    assert langid.identify(df, model).filter("lang = lang_pred").count() == 500


def test_foreign_and_junk_texts_are_rejected(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = langid.train(docs)
    rng = random.Random(6)
    clean = [r.text for r in docs.filter("length(text) > 300").orderBy("doc_id").limit(60).collect()]
    shuffled = ["".join(rng.sample(t[:1500], len(t[:1500]))) for t in clean]
    foreign = ["жук и мир это хорошо в городе", "中文文本没有空格的句子", "Il gatto dorme sul divano tutto il giorno e poi mangia il suo pesce"]
    mixed = [" ".join(w for pair in zip("the of and that with in".split() * 30, "der und die nicht zu von".split() * 30, strict=True) for w in pair)]
    short = ["the of and", "der und die nicht", "de la que los", "les des un que"]
    junk = ["qwx zzkj xqv kkq wzx 11 zzq jjx vvk", "xq 1234 zk 5678 #### wj 99 kq vx zj"]
    rows = [(k, t) for k, texts in enumerate((clean, shuffled, foreign + mixed + junk, short)) for t in texts]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    share = [np.mean([r.lang_rejected for r in found if r.doc_id == k]) for k in range(4)]
    assert share[0] <= 0.02 and share[1] >= 0.95 and share[2] == 1 and share[3] == 0, [(r.text[:40], r.lang_score, r.lang_rejected) for r in found if r.doc_id in (2, 3)]
    assert langid.identify(docs.filter("text rlike '[a-z]{3}'"), model).agg(F.avg(F.col("lang_rejected").cast("int"))).first()[0] <= 0.02
