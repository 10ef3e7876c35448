"""Reading JSON whose fields may carry the wrong type, on top of VARIANT.

A document is parsed once into a variant by `with_object`; the readers below take that variant. The document sits
inside a one-element array, because the parser ignores what follows the first value: wrapped this way, trailing
text makes the whole document invalid, as it should.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import trim

# The decimal forms that count as a number when they arrive as text.
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def with_object(df: DataFrame, text: str | Column, out: str) -> DataFrame:
    """Add `out`: the JSON object in `text` as a variant array of one element, NULL if it is not one object."""
    source = F.col(text) if isinstance(text, str) else text
    parsed = F.when(
        F.rtrim(source).endswith("}") | trim(source).endswith("}"),
        F.try_parse_json(F.concat(F.lit("["), source, F.lit("]"))),
    )
    return df.withColumn(out, parsed).withColumn(
        out, F.when(F.try_variant_get(out, "$[1]", "variant").isNull(), F.col(out))
    )


def path(key: str) -> str:
    return f"$[0].{key}"


def is_object(document: Column) -> Column:
    return F.coalesce(F.try_variant_get(document, "$[0]", "map<string,variant>").isNotNull(), F.lit(False))


def raw_text(document: Column, key: str) -> Column:
    return F.try_variant_get(document, path(key), "string")


def number_from_text(text: Column) -> Column:
    """Numeric text, trimmed, as a double; anything else is 0."""
    trimmed = trim(text)
    return F.coalesce(F.when(trimmed.rlike(NUMERIC_TEXT), trimmed.try_cast("double")), F.lit(0.0))


def long_from_text(text: Column) -> Column:
    """Numeric text rounded half away from zero; whole numbers, by far the most, skip the decimal path."""
    return F.coalesce(text.try_cast("long"), F.when(text.isNotNull(), round_to_long(number_from_text(text))), F.lit(0).cast("long"))


def round_to_long(value: Column) -> Column:
    """Round half away from zero to a long; 0 when it does not fit."""
    return F.coalesce(F.round(value, 0).try_cast("long"), F.lit(0).cast("long"))


def loose_number(document: Column, key: str) -> Column:
    """A JSON number or numeric text as a double, else 0 (true is 0, not 1)."""
    return number_from_text(raw_text(document, key))


def loose_long(document: Column, key: str) -> Column:
    return long_from_text(raw_text(document, key))


def json_kind(value: Column) -> Column:
    """'[' for a list, '{' for an object, '"' for a string, 'n' for null, '0' for other scalars."""
    scalar = F.schema_of_variant(value)
    return (
        F.when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), F.lit("["))
        .when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), F.lit("{"))
        .when(scalar == "STRING", F.lit('"'))
        .when(scalar == "VOID", F.lit("n"))
        .when(value.isNotNull(), F.lit("0"))
    )


def strict_text(document: Column, key: str) -> Column:
    """The value if it is a JSON string, else ''."""
    value = F.try_variant_get(document, path(key), "variant")
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", raw_text(document, key)), F.lit(""))


def strict_bool(document: Column, key: str) -> Column:
    """True only for JSON true."""
    value = F.try_variant_get(document, path(key), "variant")
    return F.coalesce(
        F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(document, path(key), "boolean")),
        F.lit(False),
    )


def scalar_text(value: Column) -> Column:
    """Any JSON scalar as trimmed text; NULL becomes ''."""
    return F.coalesce(trim(F.try_variant_get(value, "$", "string")), F.lit(""))
