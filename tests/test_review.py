import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from meterlens import schemas
from meterlens.functions.decisions import BLOCK, PASS, REVIEW, reply_text, with_decision
from meterlens.operators import ingest, review_plan as rp, review_results as rr, review_score as rs
from meterlens.operators.review_plan import ReviewScope
from meterlens.plans.review_run import run_review, write_plan

ENTRIES = f"id long, token_id long, created_at long, model string, messages {schemas.MESSAGES}"
CONFIG = rs.config_hash("https://x/v1", "m", "p")


def no_cache(spark):
    return spark.createDataFrame([], schemas.REVIEW_RESULTS)


def keyword_scorer():
    def score(batches):
        for batch in batches:
            risky = batch.content.str.contains("危险请求")
            reply = risky.map(
                lambda bad: json.dumps(
                    {"decision": BLOCK, "risk_score": 95, "categories": ["网络攻击"], "reason": "攻击", "confidence": 0.97}
                    if bad
                    else {"decision": PASS, "risk_score": 3, "categories": [], "reason": "正常", "confidence": 0.98}
                )
            )
            yield batch[["content_hash"]].assign(reply=reply, prompt_tokens=10, completion_tokens=5, error=None)

    return rs.pandas_scorer(score)


def talk(*turns):
    return [{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(turns)]


def test_deltas_and_inherited_risk(spark):
    talks = [
        talk("普通问题"),
        talk("普通问题", "普通回答", "危险请求"),
        talk("普通问题", "普通回答", "危险请求", "拒绝", "继续"),
        talk("普通问题", "普通回答", "危险请求", "拒绝", "继续"),
        talk("其他模型请求"),
    ]
    lines = [
        json.dumps(
            {
                "time": 1000 + i,
                "headers": {"authorization": "Bearer sk-test"},
                "body": {"model": "gpt-test" if i < 4 else "other-model", "messages": t},
            }
        )
        for i, t in enumerate(talks)
    ]
    raw = spark.createDataFrame(
        [("a.jsonl", "s", 0, i, i + 1, 0, len(x), x) for i, x in enumerate(lines)], schemas.RAW_LINES
    )
    keys = spark.createDataFrame([(7, 1, "测试用户", "sk-test")], schemas.TOKENS)
    entries = ingest.assign_ids(ingest.audit_entries(raw, keys, F.lit(1)))
    options = rp.model_options(entries, [7], 1000, 1004).collect()
    assert [(o.model, o.request_count) for o in options] == [("gpt-test", 4), ("other-model", 1)]

    scope = ReviewScope([7], ["gpt-test"], 1000, 1004)
    run = run_review(entries, scope, no_cache(spark), keyword_scorer(), CONFIG, F.lit(1))
    totals = rp.plan_totals(run.plan).first()
    assert (totals.total_entries, totals.review_units) == (4, 3)
    counted = rs.counters(run.final).first()
    assert (counted.processed_entries, counted.reviewed_units, counted.cache_hits, counted.flagged_entries) == (4, 3, 0, 3)
    assert (counted.prompt_tokens, counted.completion_tokens, counted.progress) == (30, 15, 100.0)
    page = rr.results_page(run.final, run.results, spark.createDataFrame([], schemas.MATCHES), keys, CONFIG)
    rows = {r.audit_entry_id: r for r in page.collect()}
    assert len(rows) == 4 and rows[1].effective_decision == PASS
    assert rows[2].effective_decision == BLOCK and not rows[2].inherited
    assert rows[3].effective_decision == BLOCK and rows[3].inherited and rows[3].result_categories == ["网络攻击"]
    assert rows[4].effective_decision == BLOCK and rows[4].inherited and rows[4].delta_message_count == 0
    assert rows[3].key_name == "测试用户" and rows[3].origin == "继承 · 模型"

    again = run_review(entries, scope, run.results, keyword_scorer(), CONFIG, F.lit(2))
    assert rs.counters(again.final).first().cache_hits == 3 and again.results.isEmpty()


def test_scope_checks(spark):
    for bad in (
        ReviewScope([], ["m"], 1, 2),
        ReviewScope([1], [" "], 1, 2),
        ReviewScope([1], ["m"], 2, 1),
        ReviewScope([1], ["m"], 0, 1),
    ):
        with pytest.raises(ValueError):
            bad.checked()
    assert ReviewScope([1], ["m"], 1, 2, "odd").checked().role_mode == "user"


def test_replies(spark):
    replies = [
        '```json\n{"decision":"复核","risk_score":70,"categories":["提示词注入","unknown"],"reason":"可疑","confidence":0.8}\n```',
        '{"decision":"通过","risk_score":170,"categories":["欺诈"],"confidence":-1}',
        '{"decision":"阻断","risk_score":"70"}',
        '{"decision":"阻断","risk_score":70.0}',
        '{"decision":"阻断","categories":[1]}',
        '{"decision":"odd"}',
        "none",
    ]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    rows = [r.decision for r in with_decision(frame, "reply").orderBy("i").collect()]
    assert rows[0].categories == ["提示词注入", "其他风险"] and rows[0].risk_score == 70
    assert (rows[1].risk_score, rows[1].categories, rows[1].confidence) == (100, [], 0.0)
    assert rows[2:3] + rows[4:] == [None] * 4


def test_member_names_in_any_case(spark):
    replies = ['{"Decision":"阻断","RISK_SCORE":90,"Categories":["欺诈"],"reason":"r"}', '{"decision":"通过","Decision":"阻断"}']
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    rows = [r.decision for r in with_decision(frame, "reply").orderBy("i").collect()]
    assert (rows[0].decision, rows[0].risk_score, rows[0].categories, rows[0].reason) == (BLOCK, 90, ["欺诈"], "r")
    assert rows[1].decision == PASS


def test_replies_in_parts(spark):
    texts = ['"plain"', '[{"type":"text","text":"a"},{"text":1},{"x":2},{"text":"b"}]', "7", "null"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", reply_text(F.parse_json("t")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == ["plain", "ab", "", ""]


def test_results_under_the_older_settings_hash(spark):
    new, old = rs.config_hash("u", "m", "p"), rs.legacy_config_hash("u", "m", "p")
    row = lambda content, config, score: (content, config, PASS, score, [], "", 0.5, 1, 1, 1)
    cache = spark.createDataFrame([row("a", old, 1), row("b", old, 2), row("b", new, 3)], schemas.REVIEW_RESULTS)
    found = rs.with_legacy(cache, new, old).filter(F.col("config_hash") == new).collect()
    assert sorted((r.content_hash, r.risk_score) for r in found) == [("a", 1), ("b", 3)]


def test_settings_hash():
    joined = "\x00".join(["u", "m", "p", "auto", "schema-v2"])
    assert rs.config_hash("u", "m", "p", "other") == hashlib.sha256(joined.encode()).hexdigest()
    assert rs.config_hash("u", "m", "p", " low ") != rs.config_hash("u", "m", "p")


def sequential_plan(requests, mode="user"):
    """Parent, start and content of every request, one after the other, per key."""
    allowed = {"user": {"user", "human", "input"}, "user_tool": {"user", "human", "input", "tool", "function"}}.get(mode)
    out, history = {}, {}
    for rid, key, _, messages, reviewed in sorted(requests, key=lambda r: (r[1], r[2], r[0])):
        hashes = [(m["role"].strip().lower(), m["content"].strip()) for m in messages]
        branches = history.setdefault(key, [])
        if reviewed:
            parent, start = 0, 0
            for branch_id, branch in branches[-100:]:
                if len(branch) > start and branch == hashes[: len(branch)]:
                    parent, start = branch_id, len(branch)
            ok = [i for i, (role, text) in enumerate(hashes) if text and (allowed is None or role in allowed)]
            if not parent:
                start = ok[-1] if ok else len(hashes)
            parts = [f"[角色:{hashes[i][0]}]\n{hashes[i][1]}" for i in ok if i >= start]
            out[rid] = (parent, start, "\n\n---\n\n".join(parts))
        if hashes:
            branches.append((rid, hashes))
    return out


def random_requests(seed, count):
    """Few distinct messages and one key with most requests, so that prefixes collide all the time."""
    rng = random.Random(seed)
    requests = []
    for rid in range(1, count + 1):
        key = 1 if rng.random() < 0.7 else rng.randint(2, 3)
        if requests and rng.random() < 0.6:
            base = rng.choice(requests[-130:])[3]
            messages = base[: rng.randint(0, len(base))] + [
                {"role": rng.choice(["user", " Tool", "assistant"]), "content": rng.choice(["a", "b", " ", "c\r\nd"])}
                for _ in range(rng.randint(0, 2))
            ]
        else:
            messages = [{"role": "user", "content": rng.choice(["a", "hi "])}] * rng.randint(0, 3)
        messages = [{**m, "content": m["content"].replace("\r\n", "\n")} for m in messages]
        requests.append((rid, key, 1000 + rng.randint(0, count // 2), messages))
    return requests


@pytest.mark.parametrize(("seed", "mode", "slice_size"), [(1, "user", 20_000), (2, "user_tool", 100), (3, "all", 137)])
def test_plan_equals_sequential_model(spark, monkeypatch, seed, mode, slice_size):
    monkeypatch.setattr(rp, "HISTORY_SLICE", slice_size)
    requests = random_requests(seed, 700)
    frame = spark.createDataFrame([(r, k, t, "m", x) for r, k, t, x in requests], ENTRIES)
    rows = rp.review_plan(frame, ReviewScope([1, 2, 3], ["m"], 1, 10_000, mode)).collect()
    mine = {r.audit_entry_id: (r.parent_entry_id, r.delta_start, r.content) for r in rows}
    assert mine == sequential_plan([(*r, True) for r in requests], mode)


def test_anchors_are_parents_only(spark):
    requests = random_requests(4, 400)
    frame = spark.createDataFrame([(r, k, t, "m", x) for r, k, t, x in requests], ENTRIES)
    start = 1100
    older = {}
    for r in sorted((r for r in requests if r[2] < start), key=lambda r: (r[2], r[0]), reverse=True):
        older.setdefault(r[1], []).append(r)
    anchors = [(*r, False) for rows in older.values() for r in rows[:50]]
    expected = sequential_plan(anchors + [(*r, True) for r in requests if r[2] >= start])
    rows = rp.review_plan(frame, ReviewScope([1, 2, 3], ["m"], start, 10_000)).collect()
    assert {r.audit_entry_id: (r.parent_entry_id, r.delta_start, r.content) for r in rows} == expected


def test_inheritance_equals_sequential_model(spark):
    rng = random.Random(5)
    rows, effective = [], {}
    ranks = {PASS: 0, REVIEW: 1, BLOCK: 2}
    for i in range(1, 601):
        parent = 0 if rng.random() < 0.02 else rng.randint(max(1, i - 3), i - 1) if i > 1 else 0
        decision, score = rng.choice([PASS] * 8 + [REVIEW, BLOCK]), rng.choice([0, 3, 50, 90])
        rows.append((i, parent, 1000 + i // 4, decision, score, f"h{i}"))
        up = effective.get(parent, (PASS, 0, ""))
        if (ranks[up[0]], up[1]) > (ranks[decision], score):
            inherited = up[0] != PASS
            effective[i] = (up[0], up[1], up[2] if inherited else f"h{i}", inherited)
        else:
            effective[i] = (decision, score, f"h{i}", False)
    frame = spark.createDataFrame(
        rows,
        "audit_entry_id long, parent_entry_id long, created_at long, delta_decision string, delta_risk_score int,"
        " result_hash string",
    )
    mine = {
        r.audit_entry_id: (r.effective_decision, r.effective_risk_score, r.effective_result_hash, r.inherited)
        for r in rs.inherit_risk(frame).collect()
    }
    assert mine == effective


def test_failures_are_not_cached(spark):
    plan = spark.createDataFrame(
        [(1, i, 1, 1000 + i, "m", 0, 0, 1, c, hashlib.sha256((c + x).encode()).hexdigest(), len(c)) for i, c, x in
         [(1, "a", ""), (2, "a", ""), (3, "b", ""), (4, "b", ""), (5, "c", "changed")]],
        "job_id long, " + schemas.REVIEW_PLAN,
    )

    def scorer(batches):
        for batch in batches:
            good = batch.content == "a"
            yield batch[["content_hash"]].assign(
                reply=good.map(lambda g: '{"decision":"复核","risk_score":60}' if g else None),
                prompt_tokens=1, completion_tokens=1, error=good.map(lambda g: None if g else "timeout"),
            )

    scored = rs.score_new(plan, no_cache(spark), rs.pandas_scorer(scorer), CONFIG)
    assert rs.new_results(scored, no_cache(spark), F.lit(1)).count() == 1
    rows = {r.audit_entry_id: r for r in rs.outcomes(plan, no_cache(spark), scored, CONFIG).collect()}
    assert [(rows[i].status, rows[i].called, rows[i].cache_hit) for i in (1, 2, 3, 4)] == [
        ("done", True, False), ("done", False, True), ("error", False, False), ("error", False, False),
    ]
    assert (rows[3].delta_decision, rows[3].delta_risk_score, rows[3].error) == (REVIEW, 50, "timeout")
    assert rows[5].error == rs.CHANGED


def test_ready_rows(spark):
    rows = spark.createDataFrame(
        [(1, 7, 1, 0, "done"), (2, 7, 2, 1, "pending"), (3, 7, 3, 2, "pending"), (4, 7, 4, 99, "pending")],
        "audit_entry_id long, token_id long, created_at long, parent_entry_id long, status string",
    )
    assert sorted(r.audit_entry_id for r in rs.ready(rows).collect()) == [2, 4]


def test_stored_plan_replaces_only_its_job(spark, tmp_path):
    path = str(tmp_path / "plan")

    def plan(job, ids):
        rows = [(job, i, 1, 1000, "m", 0, 0, 1, "c", "h", 1) for i in ids]
        return spark.createDataFrame(rows, "job_id long, " + schemas.REVIEW_PLAN)

    write_plan(plan(1, [1, 2]), path)
    write_plan(plan(2, [3]), path)
    write_plan(plan(1, [4]), path)
    stored = spark.read.parquet(path)
    assert sorted((r.job_id, r.audit_entry_id) for r in stored.collect()) == [(1, 4), (2, 3)]
