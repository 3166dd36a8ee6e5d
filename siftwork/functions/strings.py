"""Small string building blocks the other function modules share."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import wraps
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.vocab import WHITESPACE

# Java matches \w, \d, \s and \b on ASCII unless told otherwise; the rules here are Unicode rules.
UNICODE = "(?U)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row, however often the body uses it.

    A Column is a tree: a part used ten times is ten parts, and nested uses multiply.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remembered(build: Callable[..., Any]) -> Callable[..., Any]:
    """Columns over fixed names, built once per session of the driver and for each set of plain arguments.

    Every part of a Column costs a round trip to the JVM. A stream plans anew for every micro-batch and a service for
    every request, so expressions that are the same each time are kept.
    """
    kept: dict[tuple, Any] = {}

    @wraps(build)
    def once(*args: Any, **more: Any) -> Any:
        key = (id(SparkContext._gateway), args, tuple(sorted(more.items())))
        if key not in kept:
            kept[key] = build(*args, **more)
        return kept[key]

    return once


def strip(c: Column) -> Column:
    """Both ends without white space of any kind (``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def text_of(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def filled(c: Column) -> Column:
    """Null when the text is empty, for use in ``coalesce`` chains."""
    return F.nullif(c, F.lit(""))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


# Fixed lists and tables enter a plan as one parsed literal. Built value by value they would
# cost a driver round trip each, and long chains of conditions instead of one lookup.


def sql_literal(value: str | float | int | bool) -> str:
    if isinstance(value, bool) or not isinstance(value, (str, float)):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(map(sql_literal, values)) + ")") if values else empty_strings()


def lookup(table: dict[str, str | float | int | bool], key: Column) -> Column:
    """Value of a fixed table, null for other keys."""
    pairs = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def term_table(rows: dict[str, Sequence[str]], extra: dict[str, Sequence[str]] | None = None) -> Column:
    """Fixed rows as an array of (key, rank, terms, extra); rank is 0 for the first row, then -1 ..."""

    def arr(values: Sequence[str]) -> str:
        return "array(" + ", ".join(map(sql_literal, values)) + ")"

    structs = [
        f"named_struct('key', {sql_literal(k)}, 'rank', {-i}, 'terms', {arr(terms)}, 'extra', {arr((extra or {}).get(k, ['']))})"
        for i, (k, terms) in enumerate(rows.items())
    ]
    return F.expr("array(" + ", ".join(structs) + ")")


def is_one_of(c: Column, values: Sequence[str]) -> Column:
    return F.array_contains(string_array(values), c)


def non_empty(arr: Column) -> Column:
    """Trimmed elements of an array without the empty ones; null counts as no elements."""
    return F.filter(F.transform(F.coalesce(arr, empty_strings()), strip), lambda x: x != "")


def starts_with_any_of(first_characters: set[str]) -> str:
    """A look-ahead that lets the matcher skip positions no alternative can start at."""
    return "(?=[" + "".join(re.escape(c) for c in sorted(first_characters)) + "])"


def either(values: Sequence[str]) -> str:
    """One regular expression that finds any of the given literals."""
    return starts_with_any_of({v[0] for v in values}) + "(?:" + "|".join(re.escape(v) for v in values) + ")"


def guarded(pattern: str) -> str:
    """An alternation ``(a|b|c)`` of parts that start with plain letters, behind that look-ahead."""
    depth, starts, fresh = 0, set(), True
    for c in pattern[1:-1]:
        if fresh and c.isalpha():
            starts.add(c)
        fresh = depth == 0 and c == "|"
        depth += (c == "(") - (c == ")")
    return starts_with_any_of(starts) + pattern


def contains_any(c: Column, values: Sequence[str]) -> Column:
    """Does the text hold any of these fixed terms as a substring?"""
    return c.rlike(either(values))


def contains_any_of(c: Column, terms: Column) -> Column:
    """The same for an array column of terms."""
    return F.exists(terms, lambda t: F.contains(c, t))


def count_of(c: Column, terms: Column) -> Column:
    """How many of these terms occur as substrings."""
    return F.size(F.filter(terms, lambda t: F.contains(c, t)))


def quote_terms(terms: Column) -> Column:
    """Escape regular-expression characters in every term of an array."""
    return F.transform(terms, lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}_\s])", r"\\$1"))


def any_word_pattern(terms: Column) -> Column:
    """One whole-word pattern for a list column; null for an empty list. Built once per profile row."""
    body = F.array_join(quote_terms(F.transform(terms, F.lower)), "|")
    return F.when(F.size(terms) > 0, F.concat(F.lit(UNICODE + r"\b(?:"), body, F.lit(r")\b")))


def word_patterns(terms: Column) -> Column:
    """A whole-word pattern per term, in list order."""
    return F.transform(
        quote_terms(F.transform(terms, F.lower)),
        lambda t: F.concat(F.lit(UNICODE + r"\b"), t, F.lit(r"\b")),
    )


def dedupe_ignoring_case(arr: Column) -> Column:
    """Trimmed values, no empties, first spelling of each value wins."""
    return F.aggregate(
        non_empty(arr),
        empty_strings(),
        lambda seen, x: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(x)), seen).otherwise(
            F.array_append(seen, x)
        ),
    )


def dedupe_exact(arr: Column) -> Column:
    """Trimmed values, no empties, case kept apart."""
    return F.array_distinct(non_empty(arr))


def title_case(c: Column) -> Column:
    """Every word capitalised, words being runs of letters."""
    return F.array_join(
        F.transform(
            F.regexp_extract_all(c, F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0)),
            F.initcap,
        ),
        "",
    )


def round4(c: Column) -> Column:
    """Four decimals, ties to even, on plain double arithmetic."""
    return F.rint(c * F.lit(10000.0)) / F.lit(10000.0)


def first_of(arr: Column) -> Column:
    return F.get(arr, F.lit(0))
