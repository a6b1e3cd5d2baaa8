"""Names, keywords and token costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_KEYWORD_BYTES = 3
MIN_TOKENS = 16


def keywords(task: Column) -> Column:
    """Lower-cased words of at least three bytes, in order of first occurrence.

    Alphabetic characters (vowel signs too, but no other marks), numbers and _ make words.
    """
    words = F.filter(F.split(F.coalesce(task, F.lit("")), r"[^\p{IsAlphabetic}\p{N}_]+"), lambda w: F.octet_length(w) >= MIN_KEYWORD_BYTES)
    return F.array_distinct(F.transform(words, F.lower))


def last_segment(name: Column, language: Column) -> Column:
    """What follows the last separator: ``::`` in Rust, ``.`` or ``:`` in TypeScript."""
    rust = F.element_at(F.split(name, "::"), -1)
    typescript = F.element_at(F.split(name, "[.:]"), -1)
    return F.trim(F.when(language == "rust", rust).otherwise(typescript))


def qualify(scope: Column, name: Column) -> Column:
    """Scope segments and a name joined by ``::``."""
    return F.array_join(F.array_append(scope, name), "::")


def token_cost(byte_len: Column) -> Column:
    return F.greatest(F.call_function("div", byte_len.cast("long"), F.lit(4)), F.lit(MIN_TOKENS).cast("long"))


def span_length(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), (end - start).cast("long"))


def confidence(x: Column) -> Column:
    """A confidence within its bounds, 0 to 1; NaN stays."""
    x = x.cast("double")
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def payload(**fields: Column) -> Column:
    """A JSON object of these fields; nulls are left out."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))


def parsed(text: Column, schema: str) -> Column:
    """Fields of a JSON object; null where it is malformed or a field is missing."""
    return F.from_json(text, schema)


def contains_any_case(column: Column, needle: str) -> Column:
    """Literal, case-insensitive containment; ``%`` and ``_`` have no special meaning."""
    return F.contains(F.lower(column), F.lit(needle.lower()))
