"""The filter language: text to clauses, clauses to text, clauses to a predicate.

White space separates clauses, which must all hold. ``field:value`` looks in one field, a bare word in all; ``-`` in front
negates; commas give alternatives after a field; double quotes keep spaces, commas and colons. An unknown field makes the whole
token a bare word, a known field without a value no clause.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clause:
    field: str | None
    values: tuple[str, ...]
    negated: bool = False


def _parts(text: str, marks: str) -> list[str]:
    """Cut at unquoted marks; an unclosed quote runs to the end."""
    return ["".join(m) for m in re.findall(rf'((?:"[^"]*(?:"|$)|[^"{marks}])+)', text)]


def parse(text: str, fields: set[str]) -> list[Clause]:
    out = []
    for token in _parts(text, r"\s"):
        negated = token.startswith("-") and len(token) > 1
        body = token[negated:]
        name, colon, rest = body.partition(":")
        if colon and '"' not in name and name.lower() in fields:
            values = tuple(v for v in (p.replace('"', "").lower() for p in _parts(rest, ",")) if v)
            if values:
                out.append(Clause(name.lower(), values, negated))
        elif word := body.replace('"', "").lower():
            out.append(Clause(None, (word,), negated))
    return out


def render(clauses: list[Clause]) -> str:
    quote = lambda v: f'"{v}"' if re.search(r"[\s,:]", v) else v
    return " ".join("-" * c.negated + (f"{c.field}:" if c.field else "") + ",".join(map(quote, c.values)) for c in clauses)


def predicate(clauses: list[Clause], columns: dict[str, Column], exact: frozenset[str] = frozenset()) -> Column:
    """Clauses as one condition; ``columns`` by field, bare words look into all of them. Nulls count as empty."""
    text = {name: F.lower(F.coalesce(c.cast("string"), F.lit(""))) for name, c in columns.items()}

    def one(clause: Clause) -> Column:
        within = [text[clause.field]] if clause.field else list(text.values())
        tests = [c == v if clause.field in exact else c.contains(v) for c in within for v in clause.values]
        found = functools.reduce(operator.or_, tests)
        return ~found if clause.negated else found

    return functools.reduce(operator.and_, map(one, clauses), F.lit(True))
