"""Text helpers shared by the other function modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlake.settings import usable_patterns

# Unicode white space plus the four information separators; patterns that use it
# start with (?U).
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def unicode_pattern(pattern: str) -> Column:
    """A user pattern as a literal: case-insensitive, with Unicode classes."""
    return F.lit("(?iU)" + pattern)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    ``use`` may name its argument many times: it is a lambda variable, so neither
    the expression nor its evaluation is repeated, and no optimizer rule can copy
    it into a filter in pieces.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def named_struct(**fields: Column) -> Column:
    """A struct with explicit field names, which also hold inside lambdas."""
    return F.named_struct(*[part for name, column in fields.items() for part in (F.lit(name), column)])


def match_all(text: Column, patterns) -> Column:
    """Distinct whole matches of all patterns, as one array; bad patterns are left out."""
    found = [
        F.regexp_extract_all(text, unicode_pattern(p), F.lit(0)) for p in usable_patterns(patterns)
    ]
    if not found:
        return F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*found)))


def unfold(table: DataFrame, keys: list[str], array: Column, name: str) -> DataFrame:
    """One row per element of an array, with ``keys``.

    Outer explode with the filter after it: for a plain explode the optimizer adds
    a filter on the array's size below it, which would make the array twice.
    """
    rows = table.select(*keys, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())
