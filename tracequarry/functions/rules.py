"""Ordered label rules, kept as data: one table gives a Catalyst expression and, for checks, SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """The first rule whose patterns are all found, and none of whose `lacks` is, gives the outcome.

    also: a further test as (function of the text's Column, SQL with {x} for the text).
    """

    outcome: str
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    also: tuple[Callable[[Column], Column], str] | None = None


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chain(rules: Sequence[Rule], text: Column, default: str | None) -> Column:
    """The rules as a when-chain; a null text fails every pattern."""
    out = None
    for r in rules:
        test = F.lit(True)
        for p in r.has:
            test = test & F.coalesce(text.rlike(p), F.lit(False))
        for p in r.lacks:
            test = test & ~F.coalesce(text.rlike(p), F.lit(False))
        if r.also:
            test = test & F.coalesce(r.also[0](text), F.lit(False))
        out = F.when(test, r.outcome) if out is None else out.when(test, r.outcome)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def chain_sql(rules: Sequence[Rule], text: str, default: str | None) -> str:
    """The same in SQL."""
    parts = []
    for r in rules:
        tests = [f"coalesce(regexp_matches({text}, {literal(p)}), false)" for p in r.has]
        tests += [f"NOT coalesce(regexp_matches({text}, {literal(p)}), false)" for p in r.lacks]
        if r.also:
            tests.append(f"coalesce({r.also[1].format(x=text)}, false)")
        parts.append(f"WHEN {' AND '.join(tests) or 'true'} THEN {literal(r.outcome)}")
    return f"CASE {' '.join(parts)} ELSE {literal(default) if default is not None else 'NULL'} END"
