"""Small helpers on columns; names are compared as Spark resolves them: without case."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also within a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(columns: Iterable[str], added: Iterable[str]) -> list[str]:
    """The columns that none of `added` replaces."""
    names = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in names]


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names like the given ones that no column has."""
    held, out = {c.lower() for c in columns}, []
    for name in names:
        k, made = 0, f"__{name}"
        while made.lower() in held:
            k, made = k + 1, f"__{name}_{k + 1}"
        held.add(made.lower())
        out.append(made)
    return out
