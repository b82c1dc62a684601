"""Whitelisted predicates over entities: filters become a Column, never SQL text."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.text import like_escape

# What may be searched, by which operators.
TEXT_COLUMNS = ("display_name", "primary_organization", "primary_role", "primary_email")
OPERATORS: dict[str, tuple[tuple[str, ...], Callable[[Column, object], Column]]] = {
    "contains": (("text",), lambda c, v: c.ilike(f"%{like_escape(v)}%")),
    "equals": (("text", "number"), lambda c, v: c == v),
    "not_equals": (("text", "number"), lambda c, v: c != v),
    "gt": (("number",), lambda c, v: c > v),
    "gte": (("number",), lambda c, v: c >= v),
    "lt": (("number",), lambda c, v: c < v),
    "lte": (("number",), lambda c, v: c <= v),
}
COLUMNS = {**{c: "text" for c in TEXT_COLUMNS}, "event_name": "text", "event_year": "number", "event_count": "number"}


@dataclass
class Predicate:
    """A condition over an entity's columns, event_count and the flags in `events`; what went into it and what didn't.

    events: by flag, a condition over one record's event_name and event_year; the flag says whether some record of the
    entity satisfies it, so it is one more maximum in the aggregate that counts the entity's events.
    """

    condition: Column
    applied: list[dict] = field(default_factory=list)
    rejected: list[tuple[dict, str]] = field(default_factory=list)
    events: dict[str, Column] = field(default_factory=dict)


def column_ids() -> list[str]:
    return sorted(COLUMNS)


def operator_ids() -> list[str]:
    return sorted(OPERATORS)


def _number(value: str) -> float | None:
    try:
        x = float(value)
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def build(filters: Sequence[dict], logic: str = "AND") -> Predicate:
    """Each filter {column, operator, value} is checked and becomes a clause; clauses on events hold if some event of the entity satisfies them.

    Logic other than OR means AND. Without any valid filter everything matches.
    """
    clauses, out = [], Predicate(F.lit(True))
    for f in filters:
        column, name, value = f.get("column", ""), f.get("operator", ""), str(f.get("value", "")).strip()
        kind = COLUMNS.get(column)
        if kind is None:
            out.rejected.append((f, "unknown column"))
        elif name not in OPERATORS:
            out.rejected.append((f, "unknown operator"))
        elif kind not in OPERATORS[name][0]:
            out.rejected.append((f, "operator doesn't fit the column"))
        elif not value:
            out.rejected.append((f, "blank value"))
        elif kind == "number" and _number(value) is None:
            out.rejected.append((f, "not a number"))
        else:
            literal = _number(value) if kind == "number" else value
            test = OPERATORS[name][1]
            if column in ("event_name", "event_year"):
                flag = f"_event{len(out.events)}"
                out.events[flag] = F.coalesce(test(F.col(column), literal), F.lit(False))
                clause = F.col(flag)
            else:
                clause = test(F.col(column), literal)
            clauses.append(F.coalesce(clause, F.lit(False)))
            out.applied.append(f)
    if clauses:
        out.condition = reduce((lambda a, b: a | b) if logic.upper() == "OR" else (lambda a, b: a & b), clauses)
    return out


def keyword(text: str) -> Predicate:
    """The fallback of a failed translation: the text in any of the four text columns."""
    return build([{"column": c, "operator": "contains", "value": text} for c in TEXT_COLUMNS], "OR")
