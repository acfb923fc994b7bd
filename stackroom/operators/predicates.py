"""Conditions as boolean Columns.

Three rules for missing values. A negated scalar condition holds for a missing value, but not
for dates and years; a range never does. A multi-valued field without values satisfies
nothing, not even a negated condition. An exclusion of the tag language holds without tags.
Conditions compile on the driver to expressions, so that Catalyst pushes them down.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold, fold_value

POSITIVE = {"isNot": "is", "doesNotContain": "contains"}
RANGES = frozenset({"isGreaterThan", "isLessThan", "isBefore", "isAfter"})
OPERATIONS = ("is", "isNot", "contains", "doesNotContain", "beginsWith", "endsWith", "isGreaterThan", "isLessThan", "isBefore", "isAfter")
#: Other names of fields that conditions may use.
ALIASES = {"author": "creator", "authors": "creator", "creators": "creator", "tags": "tag", "collections": "collection", "itemtype": "itemType", "dateadded": "dateAdded", "datemodified": "dateModified", "doi": "DOI"}


class Unsupported(ValueError):
    """A condition that this engine does not express."""


def canonical_field(name: str) -> str:
    return ALIASES.get(name.lower(), name)


def escape_like(value: str) -> str:
    """value as a LIKE pattern (ESCAPE '\\') that matches itself only."""
    return re.sub(r"([\\%_])", r"\\\1", value)


def like_pattern(operation: str, value: str) -> str:
    value = escape_like(value)
    shapes = {"contains": f"%{value}%", "beginsWith": f"{value}%", "endsWith": f"%{value}"}
    try:
        return shapes[POSITIVE.get(operation, operation)]
    except KeyError:
        raise Unsupported(f"{operation} has no pattern") from None


def compare(value: Column, expected: str, operation: str) -> Column:
    """One operation on one value that is there. Text compares folded; ranges as numbers if both
    sides are, else as folded text."""
    if operation not in OPERATIONS:
        raise Unsupported(f"unknown operation {operation}")
    left, right = fold(value), fold_value(expected)
    if operation in RANGES:
        up = operation in ("isGreaterThan", "isAfter")
        as_text = left > right if up else left < right
        try:
            number = float(right)
        except ValueError:
            return as_text
        parsed = left.try_cast("double")
        return F.when(parsed.isNotNull(), parsed > number if up else parsed < number).otherwise(as_text)
    positive = POSITIVE.get(operation, operation)
    found = {"is": left == right, "contains": F.contains(left, F.lit(right)), "beginsWith": F.startswith(left, F.lit(right)), "endsWith": F.endswith(left, F.lit(right))}[positive]
    return ~found if operation in POSITIVE else found


def scalar(value: Column, operation: str, expected: str) -> Column:
    """A missing value is '' for text operations and matches no range."""
    found = compare(value, expected, operation)
    return value.isNotNull() & found if operation in RANGES else found


def dated(value: Column, operation: str, expected: str) -> Column:
    """Dates and years: a missing one satisfies nothing."""
    return value.isNotNull() & compare(value, expected, operation)


def multi(values: Column, operation: str, expected: str) -> Column:
    """Multi-valued: some value for positive operations, all for negated ones, and one at least."""
    values = F.coalesce(values, F.array().cast("array<string>"))
    each = lambda v: compare(v, expected, operation)
    return (F.size(values) > 0) & (F.forall(values, each) if operation in POSITIVE else F.exists(values, each))


def membership(keys: Column, operation: str, wanted: Sequence[str]) -> Column:
    """Collections: is any of the keys (of a subtree); isNot holds without collections."""
    if operation not in ("is", "isNot"):
        raise Unsupported(f"collection {operation}")
    inside = F.arrays_overlap(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, wanted))) if wanted else F.lit(False)
    return ~F.coalesce(inside, F.lit(False)) if operation == "isNot" else F.coalesce(inside, F.lit(False))


def tag_filter(tags: Column, entries: str | Sequence[str] | None) -> Column | None:
    """The tag language: entries hold together; ' OR ' or '||' within one; a leading - excludes.
    Names compare folded and whole. None without any term."""
    tags = F.transform(F.coalesce(tags, F.array().cast("array<string>")), fold)
    clauses = []
    for entry in normalize_tags(entries):
        terms = []
        for term in re.split(r"\s+OR\s+|\|\|", entry):
            term = term.strip()
            exclude = term.startswith("-")
            name = term[1:].strip() if exclude else term
            if not name:
                continue
            if "%" in name or "*" in name:
                raise Unsupported(f"wildcard in tag {name}")
            held = F.array_contains(tags, fold_value(name))
            terms.append(~held if exclude else held)
        if terms:
            clauses.append(functools.reduce(operator.or_, terms))
    return functools.reduce(operator.and_, clauses) if clauses else None


def normalize_tags(value) -> list[str]:
    """A string, JSON list, list of strings or of {"tag": ...} as a list of entries."""
    import json

    if value is None:
        return []
    if isinstance(value, str):
        text = value.strip()
        if text.startswith("["):
            try:
                return normalize_tags(json.loads(text))
            except ValueError:
                pass
        return [text] if text else []
    if isinstance(value, Mapping):
        return normalize_tags(value.get("tag"))
    return [t for v in value for t in normalize_tags(v)]


@dataclass(frozen=True)
class Field:
    """How a condition field is read: kind is scalar, dated, multi or membership. text is the column of
    text operations, order that of ranges (by default the same)."""

    kind: str
    text: Column
    order: Column | None = None


def condition(fields: Mapping[str, Field], field: str, operation: str, value: str, keys: Callable[[str], Sequence[str]] | None = None) -> Column:
    """One condition. keys gives the collection keys that a collection's value stands for."""
    if operation not in OPERATIONS:
        raise Unsupported(f"unknown operation {operation}")
    found = fields.get(field) or fields.get(canonical_field(field))
    if found is None:
        raise Unsupported(f"unknown field {field}")
    column = found.order if operation in RANGES and found.order is not None else found.text
    if found.kind == "membership":
        return membership(column, operation, list(keys(value)) if keys else [value])
    return {"scalar": scalar, "dated": dated, "multi": multi}[found.kind](column, operation, value)


def all_or_any(fields: Mapping[str, Field], conditions: Sequence[Mapping[str, str]], join_mode: str = "all", keys=None) -> Column:
    """A list of {field, operation, value} as one boolean Column; without conditions, everything. Searches
    inside of values come last, so that cheaper conditions spare them."""
    if join_mode not in ("all", "any"):
        raise Unsupported(f"join mode {join_mode}")
    each = [condition(fields, c["field"], c["operation"], str(c["value"]), keys) for c in sorted(conditions, key=lambda c: POSITIVE.get(c["operation"], c["operation"]) == "contains")]
    return functools.reduce(operator.and_ if join_mode == "all" else operator.or_, each) if each else F.lit(True)
