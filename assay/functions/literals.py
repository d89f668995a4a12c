"""Nested literals in text fields: JSON, Python literals, or plain text, parsed by built-in functions.

A field may hold ``[[0, 0, 0], [0.5, 0.5, 0.5]]``, ``((0, 0, 0), (.5, .5, .5))``,
``0 0 0; 0.5 0.5 0.5`` or a flat list; what it means depends on what is wanted
of it. A quoted string that itself holds brackets or quotes stays plain text.
All but ``literal`` take its result, best as a column of its own: it is used
more than once in each of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

#: Fixed value: atomic numbers below it are numbers of elements.
ELEMENT_LIMIT = 119
TEXTS, ROW, ROWS = "array<string>", "array<double>", "array<array<double>>"


def strict_json(text: Column | str) -> Column:
    """A text that is JSON from end to end as VARIANT, else null (``try_parse_json`` overlooks what follows a value)."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), col(text), F.lit("}"))), "$.v", "variant")


def literal(text: Column | str) -> Column:
    """A text field as VARIANT: by JSON, else as a Python literal, else the text; null where it is empty."""
    t = F.trim(col(text))
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    # Numbers that Python writes and JSON does not: .5, 5. and +5; a comma that ends a tuple.
    numbers = F.regexp_replace(F.regexp_replace(F.regexp_replace(named, r"(?<![\w.])\.(\d)", "0.$1"), r"(\d)\.(?![\d\w])", "$1.0"), r"(?<![\w.])\+(\d)", "$1")
    python = F.regexp_replace(F.translate(numbers, "()'", '[]"'), r",\s*\]", "]")
    bare = F.when(F.contains(t, F.lit(",")) & ~F.startswith(python, F.lit("[")), F.concat(F.lit("["), F.regexp_replace(python, r",\s*$", ""), F.lit("]")))
    # A row of several lists is a tuple of them.
    rows = F.when(F.startswith(python, F.lit("[")), F.concat(F.lit("["), python, F.lit("]")))
    parsed = F.coalesce(strict_json(t), strict_json(python), strict_json(bare), strict_json(rows), t.cast("variant"))
    return F.when((t != "") & ~t.isin("null", "None"), parsed)


def kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def is_list(value: Column) -> Column:
    return F.startswith(kind(value), F.lit("ARRAY"))


def is_nested(value: Column) -> Column:
    """Whether a list's items are lists."""
    return F.startswith(kind(value), F.lit("ARRAY<ARRAY<"))


def leaves(value: Column) -> Column:
    """The leaves of a nested list as texts, in order."""
    flat = F.concat(F.lit("["), F.regexp_replace(F.regexp_replace(F.translate(F.to_json(value), "[]", ""), ",+", ","), "^,|,$", ""), F.lit("]"))
    return F.try_variant_get(F.try_parse_json(flat), "$", TEXTS)


def plain(value: Column) -> Column:
    """A scalar's text."""
    return F.try_variant_get(value, "$", "string")


def words(text: Column, separators: str) -> Column:
    return F.filter(F.transform(F.split(text, separators), lambda x: F.trim(x)), lambda x: x != "")


def is_element_number(text: Column) -> Column:
    x = text.try_cast("double")
    return F.coalesce((x == F.floor(x)) & (x >= 0) & (x < ELEMENT_LIMIT), F.lit(False))


def species_tokens(v: Column) -> Column:
    """The tokens of a species field, from a list or from text cut at blanks, commas, semicolons and bars."""
    return F.when(v.isNull(), F.array().cast(TEXTS)).when(is_list(v), leaves(v)).when(kind(v) == "STRING", words(plain(v), r"[;|,\s]+")).otherwise(F.array(plain(v)))


def are_numbers(v: Column, tokens: Column) -> Column:
    """Whether a species field holds atomic numbers: all tokens are, and it is a list or a text."""
    return (is_list(v) | (kind(v) == "STRING")) & (F.size(tokens) > 0) & F.forall(tokens, is_element_number)


def letters(v: Column) -> Column:
    """Tokens of a list, of text with separators, or else its characters."""
    s = plain(v)
    characters = F.filter(F.split(F.trim(s), ""), lambda x: x != "")
    return (
        F.when(v.isNull(), F.array().cast(TEXTS)).when(is_list(v), leaves(v))
        .when(kind(v) == "STRING", F.when(F.rlike(s, F.lit("[,;|]")), words(s, "[;|,]")).otherwise(characters)).otherwise(F.array(s))
    )


def triples(values: Column) -> Column:
    """A flat array cut into whole triples."""
    n = F.floor(F.size(values) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * 3 + 1, 3))).otherwise(F.array().cast(ROWS))


def coordinates(v: Column) -> Column:
    """Triples of a list of triples, a flat list, or rows of text cut at semicolons; others are left out."""
    as_doubles = lambda xs: F.transform(xs, lambda x: x.try_cast("double"))
    rows = F.filter(F.transform(words(plain(v), ";"), lambda r: as_doubles(words(r, r"[,\s]+"))), lambda r: (F.size(r) == 3) & ~F.exists(r, lambda x: x.isNull()))
    nested = F.filter(F.try_variant_get(v, "$", ROWS), lambda r: F.size(r) == 3)
    found = F.when(is_nested(v), nested).when(is_list(v), triples(F.try_variant_get(v, "$", ROW))).when(kind(v) == "STRING", rows)
    return F.coalesce(found, F.array().cast(ROWS))


def matrix_numbers(v: Column) -> Column:
    """The numbers of a lattice field, in order: three or nine, six in a list; null where it is no such list."""
    nested = F.try_variant_get(v, "$", ROWS)
    square = F.when((F.size(nested) == 3) & F.forall(nested, lambda r: F.size(r) == 3), F.flatten(nested))
    flat = F.when(is_nested(v), square).when(is_list(v), F.try_variant_get(v, "$", ROW)).when(kind(v) == "STRING", F.transform(words(plain(v), r"[;,\s]+"), lambda x: x.try_cast("double")))
    return F.when((F.size(flat).isin(3, 9) | is_list(v) & (F.size(flat) == 6)) & ~F.exists(flat, lambda x: x.isNull()), flat)
