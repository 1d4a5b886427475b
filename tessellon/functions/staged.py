"""Expressions in stages, so that a value used many times is computed once and the expression tree stays linear.

On a DataFrame the stages are projections, which keep whole-stage code generation (Catalyst does not merge a projection
whose costly columns are used repeatedly). As a single Column the stages are lambda bindings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[dict[str, Column]], dict[str, Column]]


def column(inputs: dict[str, Column], stages: list[Stage], final: Callable[[dict[str, Column]], Column]) -> Column:
    def bind(env: dict[str, Column], k: int) -> Column:
        if k == len(stages):
            return final(env)
        held = F.struct(*(c.alias(n) for n, c in (env | stages[k](env)).items()))
        names = list(env | stages[k](env))
        return F.element_at(F.transform(F.array(held), lambda v: bind({n: v[n] for n in names}, k + 1)), 1)

    first = F.struct(*(c.alias(n) for n, c in inputs.items()))
    return F.element_at(F.transform(F.array(first), lambda v: bind({n: v[n] for n in inputs}, 0)), 1)


def frame(df: DataFrame, inputs: dict[str, Column], stages: list[Stage], out: dict[str, Callable[[dict[str, Column]], Column]]) -> DataFrame:
    """df with the columns `out`."""
    kept = [c for c in df.columns if c not in out]
    at = df.select(*kept, *(c.alias(f"_st_{n}") for n, c in inputs.items()))
    names = list(inputs)
    for stage in stages:
        made = stage({n: F.col(f"_st_{n}") for n in names})
        at = at.select(*kept, *(F.col(f"_st_{n}") for n in names if n not in made), *(c.alias(f"_st_{n}") for n, c in made.items()))
        names = [n for n in names if n not in made] + list(made)
    env = {n: F.col(f"_st_{n}") for n in names}
    return at.select(*kept, *(f(env).alias(n) for n, f in out.items()))
