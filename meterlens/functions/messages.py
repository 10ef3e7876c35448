"""Message lists of the chat dialects as Column expressions over a body variant."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from meterlens import schemas

from . import loose_json as lj
from .audit_fields import canonical_variant
from .stage import pinned
from .text import WHITE_SPACE, trim

# Stands for content that nests deeper than the expressions below go; such bodies take the Arrow path.
TOO_DEEP = "\x00too deep\x00"

# Fields that hold the text of a content part, and the markers of parts without text.
TEXT_FIELDS = ["text", "input_text", "output_text"]
IMAGE_MARK, DATA_MARK = "[image]", "[inline_data]"

# A candidate message: which dialect it belongs to, its role, its content and what stands in for an empty content.
CANDIDATE = "array<struct<dialect:int,role:string,content:variant,spare:variant>>"
CHAT, RESPONSES, CONTENTS, PROMPT = range(4)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _string(value: Column) -> Column:
    """Trimmed text of a JSON string; NULL for anything else and for blank text."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.nullif(trim(text), F.lit(""))


def _candidate(dialect: int, role: Column, content: Column, spare: Column | None = None) -> Column:
    return F.struct(
        F.lit(dialect).alias("dialect"),
        role.alias("role"),
        content.alias("content"),
        (F.lit(None).cast("variant") if spare is None else spare).alias("spare"),
    )


def _objects(member: Column) -> Column:
    """The objects of a list member; other items say nothing."""
    items = F.try_variant_get(member, "$", "array<variant>")
    objects = F.filter(items, lambda m: F.try_variant_get(m, "$", "map<string,variant>").isNotNull())
    return F.coalesce(objects, F.expr("cast(array() as array<variant>)"))


def _candidates(members: Column) -> Column:
    """All messages that a body with these members could mean, dialect by dialect: chat, responses, contents with parts,
    prompt."""

    def top(name: str) -> Column:
        return F.try_element_at(members, F.lit(name))

    def one(dialect: int, role: str, content: Column, spare: Column | None = None) -> Column:
        given = content.isNotNull() if spare is None else content.isNotNull() | spare.isNotNull()
        said = F.array(_candidate(dialect, F.lit(role), content, spare)).cast(CANDIDATE)
        return F.when(given, said).otherwise(F.array().cast(CANDIDATE))

    def role(m: Column, names: list[str], default: str) -> Column:
        return F.coalesce(*[_string(_field(m, name)) for name in names], F.lit(default))

    chat = F.transform(
        _objects(top("messages")),
        lambda m: _candidate(CHAT, role(m, ["role"], "message"), _field(m, "content"), _field(m, "tool_calls")),
    )
    spoken = F.transform(
        _objects(top("input")),
        lambda m: _candidate(RESPONSES, role(m, ["role", "type"], "input"), _field(m, "content")),
    )
    contents = F.transform(
        _objects(top("contents")), lambda m: _candidate(CONTENTS, role(m, ["role"], "user"), _field(m, "parts"))
    )
    plain_input = F.when(F.schema_of_variant(top("input")) == "STRING", top("input"))
    said = F.concat(
        one(CHAT, "system", top("system")),
        chat.cast(CANDIDATE),
        one(RESPONSES, "user", plain_input),
        spoken.cast(CANDIDATE),
        contents.cast(CANDIDATE),
        one(PROMPT, "user", top("prompt"), top("query")),
    )
    names = F.array(*[F.lit(name) for name in ("system", "messages", "input", "contents", "prompt", "query")])
    return F.when(F.arrays_overlap(F.map_keys(members), names), said).otherwise(F.array().cast(CANDIDATE))


def _object_text(value: Column) -> Column:
    """Text of an object: its own text, a marker for images and data, else the object as compact JSON."""
    image, inline = _field(value, "image_url"), _field(value, "inline_data")
    nested = F.try_variant_get(image, "$.image_url", "variant").isNotNull() | (
        F.try_variant_get(image, "$.inline_data", "variant").isNotNull()
    )
    own = [_string(_field(value, name)) for name in TEXT_FIELDS]
    own_of_image = [_string(_field(image, name)) for name in TEXT_FIELDS]
    kind = lj.json_kind(image)
    image_text = (
        F.when(kind == '"', _string(image))
        .when((kind == "[") | nested, F.lit(TOO_DEEP))
        .when(kind != "n", F.coalesce(*own_of_image, canonical_variant(image)))
    )
    return F.coalesce(
        *own,
        F.when(image.isNotNull(), F.concat_ws(" ", F.lit(IMAGE_MARK), image_text))
        .when(inline.isNotNull() & ~F.is_variant_null(inline), F.lit(DATA_MARK))
        .otherwise(canonical_variant(value)),
    )


def _text(value: Column, of_list: Column) -> Column:
    """Plain text of a content value, '' when there is none; `of_list` is the text if it is a list."""
    kind = lj.json_kind(value)
    return F.coalesce(
        F.when(kind == '"', _string(value))
        .when(kind == "[", of_list)
        .when(kind == "{", _object_text(value))
        .when(kind == "0", canonical_variant(value)),
        F.lit(""),
    )


def content_text(value: Column) -> Column:
    """Plain text of a content value: text, a list of parts joined by line ends, or one object."""
    parts = F.transform(
        F.try_variant_get(value, "$", "array<variant>"), lambda part: _text(part, F.lit(TOO_DEEP))
    )
    return _text(value, F.array_join(F.filter(parts, lambda t: t != ""), "\n"))


NO_MESSAGES = f"cast(array() as {schemas.MESSAGES})"


def with_messages(df: DataFrame, body: str = "body", out: str = "messages") -> DataFrame:
    """Add the normalised messages of the request body; a body that is no JSON object has none.

    Contents become text first and the first dialect with any text wins. Bodies with deeper nesting than one list
    of parts are rare; they are the only ones handed to Python.
    """
    staged = lj.with_object(df, body, "_body")
    staged = staged.withColumn("_body", F.try_variant_get("_body", "$[0]", "map<string,variant>"))
    staged = staged.withColumn("_said", _candidates(F.col("_body")))
    texts = F.transform(
        "_said",
        lambda c: F.struct(
            c["dialect"].alias("dialect"),
            c["role"].alias("role"),
            content_text(c["content"]).alias("content"),
            content_text(c["spare"]).alias("spare"),
        ),
    )
    staged = staged.withColumn("_said", texts)
    filled = F.filter(
        F.transform(
            "_said",
            lambda c: F.struct(
                c["dialect"].alias("dialect"),
                c["role"].alias("role"),
                F.when(c["content"] != "", c["content"]).otherwise(c["spare"]).alias("content"),
            ),
        ),
        lambda c: c["content"] != "",
    )
    staged = staged.withColumn("_said", filled)
    first = F.array_min(F.transform("_said", lambda c: c["dialect"]))
    chosen = F.transform(
        F.filter("_said", lambda c: c["dialect"] == first),
        lambda c: F.struct(c["role"].alias("role"), c["content"].alias("content")),
    )
    staged = staged.withColumn(out, F.coalesce(chosen, F.expr(NO_MESSAGES)))
    deep = F.exists("_said", lambda c: c["content"].contains(TOO_DEEP))
    staged = staged.withColumn("_deep", deep_messages(F.when(deep, F.col(body))))
    return staged.withColumn(out, pinned(F.coalesce("_deep", out))).drop("_body", "_said", "_deep")


def _deep_text(value) -> str:
    import json

    def compact(item) -> str:
        text = json.dumps(item, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        for character in "<>&\u2028\u2029":
            text = text.replace(character, f"\\u{ord(character):04x}")
        return text

    if value is None:
        return ""
    if isinstance(value, str):
        return value.strip(WHITE_SPACE)
    if isinstance(value, list):
        return "\n".join(text for text in map(_deep_text, value) if text)
    if isinstance(value, dict):
        own = [value[f].strip(WHITE_SPACE) for f in TEXT_FIELDS if isinstance(value.get(f), str) and value[f].strip(WHITE_SPACE)]
        if own:
            return own[0]
        if "image_url" in value:
            return f"{IMAGE_MARK} {_deep_text(value['image_url'])}".rstrip(" ")
        if value.get("inline_data") is not None:
            return DATA_MARK
    return compact(value)


def _deep_body(body: str) -> list[dict]:
    """The same dialect rules for one body whose content nests deeper than the expression goes."""
    import json

    document = json.loads(body)

    def spoken(items, roles, default, fields):
        for item in items if isinstance(items, list) else []:
            if isinstance(item, dict):
                role = next((item[r].strip(WHITE_SPACE) for r in roles if isinstance(item.get(r), str) and item[r].strip(WHITE_SPACE)), default)
                content = next(filter(None, (_deep_text(item.get(f)) for f in fields)), "")
                if content:
                    yield {"role": role, "content": content}

    system, prompt = _deep_text(document.get("system")), next(
        filter(None, (_deep_text(document.get(f)) for f in ("prompt", "query"))), ""
    )
    given = document.get("input")
    dialects = [
        ([{"role": "system", "content": system}] if system else [])
        + list(spoken(document.get("messages"), ["role"], "message", ["content", "tool_calls"])),
        [{"role": "user", "content": given.strip(WHITE_SPACE)}]
        if isinstance(given, str) and given.strip(WHITE_SPACE)
        else list(spoken(given, ["role", "type"], "input", ["content"])),
        list(spoken(document.get("contents"), ["role"], "user", ["parts"])),
        [{"role": "user", "content": prompt}] if prompt else [],
    ]
    return next(filter(None, dialects), [])


def deep_messages(body: Column) -> Column:
    """Arrow path of the message rules, for the bodies handed to it; NULL stays NULL."""

    @F.pandas_udf(schemas.MESSAGES)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            yield bodies.map(lambda b: None if b is None else _deep_body(b))

    return parse(body)
