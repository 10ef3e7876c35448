import hashlib
import random
import re
import zlib

import pytest

from meterlens.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, _slice int"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_repair(rows):
    """Row by row, over all states: the least (cost, audit) with the rows that it leaves."""
    seen, found = set(), []
    for _, _, role, text in rows:
        last = text.strip(SPACE)[-1:]
        found.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))

    def with_inserts(labels):
        for _ in range(3):
            for q, (cost, audit, out) in list(labels.items()):
                r = "u" if q != "u" else "a"
                new = (cost + 5, audit + "I", [*out, ({"u": "user", "a": "assistant"}[r], "")])
                labels[r] = min(labels.get(r, new), new)
        return labels

    labels = with_inserts({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, found, strict=True):
        new = {}
        for q, (cost, audit, out) in labels.items():
            options = [(q, (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role and q + role[:1] in ("s", "u", "su", "ua", "au"):
                    options.append((role[:1], (cost + more, audit + "K", [*out, (role, text)])))
                r = "a" if q == "u" else "u"
                options.append((r, (cost + 1 + more, audit + "R", [*out, ({"u": "user", "a": "assistant"}[r], text)])))
            for r, label in options:
                new[r] = min(new.get(r, label), label)
        labels = with_inserts(new)
    cost, audit, out = min(labels[q] for q in ("", "a") if q in labels)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    counts = (*(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *counts, cost, audit, digest), out


def conversations(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    order = lambda r: (r[1] is not None, r[1] or 0)
    return {conv: sorted(group, key=order) for conv, group in groups.items()}


def cases():
    rng = random.Random(4)
    words = ["yes.", "no", "why?", "Stop!", "", " \n", None, "a\x00b.", "ö。", "long " * 3000 + "end."]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(0, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            # Rows of one turn would be ordered by a hash; here turns differ or the whole row repeats.
            rows += [(conv, 2 * turn - 3, role, rng.choice(words))] * rng.choice([1, 1, 1, 2])
    rows += [(None, t, "user", "hm.") for t in range(5)] + [(70, None, "user", "x."), (70, None, "user", "x."), (71, None, None, None)]
    rows += [(80, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [1024, 3])
def test_digest_equals_brute_force(spark, segment):
    rows = cases()
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    damaged = conversations(plain_damage(rows))
    got = {r[0]: tuple(r)[1:] for r in cr.repair_digest(df, segment).collect()}
    assert got == {conv: plain_repair(damaged.get(conv, []))[0] for conv in conversations(rows)}


def test_repaired_rows(spark):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in cases()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    for r in sorted(cr.repaired(df, 5).collect(), key=lambda r: (r.conv_id is None, r.conv_id, r.place)):
        found.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    expected = {conv: plain_repair(group)[1] for conv, group in conversations(rows).items()}
    assert found == {conv: [(k, *line) for k, line in enumerate(out)] for conv, out in expected.items() if out}


def test_dropped_conversation_and_empty_table(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    row = cr.repair_digest(spark.createDataFrame([(conv, 0, "user", "x.")], schema)).collect()
    assert [tuple(r) for r in row] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.repair_digest(spark.createDataFrame([], schema)).collect() == []
    assert cr.repaired(spark.createDataFrame([], schema)).collect() == []


def test_search_equals_row_by_row():
    rng = random.Random(1)
    words = {0: ["t{}."], 1: [""], 3: ["t{}"]}
    for _ in range(1500):
        n = rng.randrange(9)
        faults = [rng.choice([0, 0, 0, 1, 3]) for _ in range(n)]
        roles = [rng.choice(["system", "user", "assistant", "tool"]) for _ in range(n)]
        rows = [(0, k, role, words[f][0].format(k)) for k, (role, f) in enumerate(zip(roles, faults, strict=True))]
        expected = plain_repair(rows)[0][5:7]
        assert cr.least_edits([r[0] for r in roles], faults) == expected
        # Segments of any length give the same, with the tails of the labels only.
        choice, parts, size = cr.Choice(), [], rng.randrange(1, 5)
        for i in range(0, n, size):
            parts.append(cr.segment_entries([r[0] for r in roles[i : i + size]], faults[i : i + size], False))
            choice.add(parts[-1])
        chosen = [next(e for e in part if e[:2] == pair) for part, pair in zip(parts, choice.picked(), strict=True)]
        assert (sum(e[2] for e in chosen), "".join(e[3] for e in chosen)) == expected
