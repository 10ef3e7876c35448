import os
import re
import subprocess
import sys

import corpus_pipeline as cp
from meterlens.llm import queries, secret_scan as ss
from meterlens.llm.common import table

from .test_decontam import plain_words
from .test_minhash import brute_force
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_are_registered():
    assert [name for name, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    kept = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    groups = brute_force(sorted(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    items = [" ".join(plain_words(r.text)) for r in table(spark, SF, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not any(f" {p} " in f" {' '.join(plain_words(t))} " for p in items)}
    clean = {}
    for i, text in kept.items():
        out, at = "", 0
        for kind, a, b in sorted(ss.find_secrets(text), key=lambda s: (s[1], s[2], s[0])):
            if b <= at:
                continue
            if a >= at:
                out += f"{text[at:a]}[{kind}]"
            at = max(at, b)
        clean[i] = out + text[at:]
    rows = cp.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(clean)
    check_packing(rows, clean, 1)
    assert len(clean) < len(docs)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int"
    words = " ".join(f"the word{i} of and" for i in range(10))
    rows = [(1, words, "en", "s", 5, "x", 1), (1, words, "en", "s", 5, "x", 1), (2, words, "en", "s", 5, "x", 1), (3, None, None, None, None, None, None)]
    rows += [(None, "the of and " + words[::-1], "en", "s", 5, "x", 1), (4, "", "de", "s", 0, "x", 1), (5, "der und " * 9 + "token = abcdefghij", "de", "s", 0, "x", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == cp.DOCUMENTS
            docs = out
            out.count()
        ids = {r.doc_id for r in docs.collect()}
        assert ids == ({1, None, 5} if given else set())


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = table(spark, SF, "benchmark").first().text
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in ("one", "two", "three"))
    texts = [(7, one), (7, two), (7, one), (8, two), (None, one), (None, three), (None, three), (None, item), (7, f"so {item} it is"), (9, "!!"), (9, "!!")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], schema)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = cp.near_dedup(spark, docs, SF)
    want = [(7, one), (7, two), (None, three), (9, "!!")]
    rest = [p for p in pairs(kept) if item not in p[1]]
    assert rest == sorted(want, key=str)
    assert pairs(cp.decontamination(spark, docs, SF)) == sorted([p for p in texts if item not in p[1]], key=str)
    assert pairs(cp.decontamination(spark, kept, SF)) == sorted(want, key=str)


def test_library_works_without_the_package(tmp_path):
    """The entry module of a copy without the package still lists the other queries."""
    root = os.path.dirname(os.path.abspath(cp.__file__))
    for name in ("meterlens", "oracle", "__spark_entry__.py"):
        if name == "meterlens":
            (tmp_path / name).mkdir()
            for inner in os.listdir(os.path.join(root, name)):
                if inner not in ("llm", "__pycache__"):
                    os.symlink(os.path.join(root, name, inner), tmp_path / name / inner)
        else:
            os.symlink(os.path.join(root, name), tmp_path / name)
    code = (
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), 'usage_summary' in e.queries(), any(k.startswith('op') for k in e.queries()))\n"
    )
    copied = (tmp_path / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(copied)
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert found.stdout.split()[1:] == ["True", "False"], found.stderr

