"""Naming a value inside an expression."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"__let_(\d+)_(\d+)")
_NAMED: ContextVar[list[list[Column]] | None] = ContextVar("named", default=None)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once. Rules that use a value in many places would otherwise repeat it in each, and plans of nested
    rules would grow without need.

    Within ``staged`` the value becomes a column of an earlier projection, which stays in generated code. Elsewhere, where
    there is no table at hand, it is a lambda over an array of one, which is interpreted."""
    levels = _NAMED.get()
    if levels is None:
        return F.element_at(F.transform(F.array(x), f), 1)
    level = 1 + max((int(m[1]) for m in NAME.finditer(str(x))), default=-1)
    while len(levels) <= level:
        levels.append([])
    levels[level].append(x)
    return f(F.col(f"__let_{level}_{len(levels[level]) - 1}"))


def staged(df: DataFrame, make: Callable[[], dict[str, Column]]) -> DataFrame:
    """df with the columns that ``make`` gives. Values named by ``let`` are added first, in as many projections as they build on
    each other, and dropped at the end. They are worked out for every row."""
    levels: list[list[Column]] = []
    token = _NAMED.set(levels)
    try:
        made = make()
    finally:
        _NAMED.reset(token)
    out = df
    for level, values in enumerate(levels):
        out = out.withColumns({f"__let_{level}_{i}": x for i, x in enumerate(values)})
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[x.alias(c) for c, x in made.items()])
