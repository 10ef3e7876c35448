"""Review decisions: reading a reviewer's reply and comparing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import loose_json as lj
from .stage import pinned
from .text import trim

# Decisions from weakest to strongest, risk categories, and the result of a failed review.
PASS, REVIEW, BLOCK = "通过", "复核", "阻断"
DECISIONS = [PASS, REVIEW, BLOCK]
CATEGORIES = [
    "提示词注入",
    "越狱绕过",
    "凭据窃取",
    "敏感信息泄露",
    "恶意软件",
    "网络攻击",
    "欺诈",
    "隐私侵犯",
    "违法活动",
    "滥用骚扰",
    "其他风险",
]
OTHER_RISK = "其他风险"
FAILED_SCORE, FAILED_REASON = 50, "审查失败，需要人工确认"
REASON_LENGTH = 500


def decision_rank(decision: Column) -> Column:
    return F.when(decision == BLOCK, 2).when(decision == REVIEW, 1).otherwise(0)


def reply_text(content: Column) -> Column:
    """Text of a reply content variant: a string, or the texts of its parts run together."""
    parts = F.transform(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda p: F.when(
            F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING",
            F.try_variant_get(p, "$.text", "string"),
        ),
    )
    return F.coalesce(
        F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string")),
        F.array_join(F.array_compact(parts), ""),
        F.lit(""),
    )


def _json_part(reply: Column) -> Column:
    """From the first opening to the last closing brace of a reply, code fences removed."""
    plain = trim(reply)
    unfenced = F.regexp_replace(F.regexp_replace(plain, "^```(json)?", ""), r"```\s*$", "")
    inner = F.when(plain.startswith("```"), trim(unfenced)).otherwise(plain)
    return F.nullif(F.regexp_extract(inner, r"(?s)\{.*\}", 0), F.lit(""))


def _member(document: Column, name: str) -> Column:
    """A member of a variant object by its name, else by its name in other letters of case."""
    members = F.try_variant_get(document, "$[0]", "map<string,variant>")
    alike = F.map_values(F.map_filter(members, lambda key, _: F.lower(key) == name))
    return F.coalesce(F.try_variant_get(document, lj.path(name), "variant"), F.try_element_at(alike, F.lit(1)))


def with_decision(df: DataFrame, reply: str, out: str = "decision") -> DataFrame:
    """Add the decision struct read from a reply, NULL when the reply is not a valid decision.

    A missing field has its zero value; a field of the wrong type makes the whole reply invalid. The case of the
    members' names does not matter.
    """
    staged = lj.with_object(df.withColumn("_json", _json_part(F.col(reply))), "_json", "_reply")
    document = F.col("_reply")

    def typed(name: str, kinds: list[str], target: str, default: Column) -> tuple[Column, Column]:
        value = _member(document, name)
        absent = value.isNull() | F.is_variant_null(value)
        kind = F.schema_of_variant(value)
        fits = F.lit(False)
        for prefix in kinds:
            fits = fits | kind.startswith(prefix)
        read = F.try_variant_get(value, "$", target)
        return F.coalesce(absent | (fits & read.isNotNull()), F.lit(True)), F.coalesce(read, default)

    no_names = F.expr("cast(array() as array<string>)")
    ok_decision, decision = typed("decision", ["STRING"], "string", F.lit(""))
    ok_score, score = typed("risk_score", ["BIGINT"], "long", F.lit(0).cast("long"))
    ok_reason, reason = typed("reason", ["STRING"], "string", F.lit(""))
    ok_confidence, confidence = typed("confidence", ["BIGINT", "DECIMAL", "DOUBLE"], "double", F.lit(0.0))
    items = F.try_variant_get(_member(document, "categories"), "$", "array<variant>")
    ok_items, _ = typed("categories", ["ARRAY"], "array<variant>", F.expr("cast(array() as array<variant>)"))
    all_text = F.forall(
        F.coalesce(items, F.expr("cast(array() as array<variant>)")),
        lambda v: (F.schema_of_variant(v) == "STRING") | F.is_variant_null(v),
    )
    names = F.transform(items, lambda v: trim(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))))
    known = F.array(*[F.lit(c) for c in CATEGORIES])
    mapped = F.array_distinct(
        F.transform(names, lambda n: F.when(F.array_contains(known, n), n).otherwise(F.lit(OTHER_RISK)))
    )
    valid = (
        lj.is_object(document) & ok_decision & ok_score & ok_reason & ok_confidence & ok_items & all_text
        & decision.isin(DECISIONS)
    )
    result = F.struct(
        decision.alias("decision"),
        F.least(F.greatest(score, F.lit(0).cast("long")), F.lit(100).cast("long")).cast("int").alias("risk_score"),
        F.when(decision == PASS, no_names).otherwise(F.coalesce(mapped, no_names)).alias("categories"),
        F.substring(trim(reason), 1, REASON_LENGTH).alias("reason"),
        F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )
    return staged.withColumn(out, pinned(F.when(valid, result))).drop("_json", "_reply")
