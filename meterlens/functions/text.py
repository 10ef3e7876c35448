"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim(value: Column) -> Column:
    """Strip all Unicode white space from both ends (Spark's own trim strips blanks only)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def blank_to_null(value: Column) -> Column:
    """The trimmed text, or NULL when nothing is left."""
    return F.nullif(trim(value), F.lit(""))


def first_nonblank(*values: Column) -> Column:
    """The first value that is not blank, trimmed; '' when all are blank."""
    return F.coalesce(*[blank_to_null(value) for value in values], F.lit(""))


def first_nonempty(*values: Column) -> Column:
    """The first value that is neither NULL nor ''; '' when there is none."""
    return F.coalesce(*[F.nullif(value, F.lit("")) for value in values], F.lit(""))


def key_tail(key: Column) -> Column:
    """The last eight characters of a key, all that is ever shown of it."""
    return F.coalesce(F.right(key, F.lit(8)), F.lit(""))


def contains_pattern(query: str) -> str:
    """LIKE pattern of a case-insensitive search; % and _ in the query stay wildcards, backslash is literal."""
    return "%" + query.strip().lower().replace("\\", "\\\\") + "%"


def matches_any(query: str, *columns: Column) -> Column:
    """True when the search text occurs in at least one of the columns, ignoring case."""
    pattern = contains_pattern(query)
    found = F.lit(False)
    for column in columns:
        found = found | F.lower(F.coalesce(column, F.lit(""))).like(pattern)
    return found
