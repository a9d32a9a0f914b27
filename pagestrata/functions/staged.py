"""Feature columns in stages, so that each expression is written and computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, *stages: Callable[[Callable[[str], Column]], dict[str, Column]], prefix: str = "") -> DataFrame:
    """Adds the columns of each stage; a stage sees those before it under short names."""

    def column(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    for stage in stages:
        df = df.withColumns({f"{prefix}{k}": v for k, v in stage(column).items()})
    return df


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nested(stages: list[Callable[[Callable[[str], Column]], dict[str, Column]]], result: Callable[[Callable[[str], Column]], Column]) -> Column:
    """`result` over the columns of all stages, inside one expression: for items of arrays,
    where `staged` can't add columns."""

    def step(k: int, known: dict[str, Column]) -> Column:
        if k == len(stages):
            return result(known.__getitem__)
        own = stages[k](known.__getitem__)
        made = F.struct(*(v.alias(name) for name, v in own.items()))
        return bound(made, lambda s: step(k + 1, known | {name: s[name] for name in own}))

    return step(0, {})


def without(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith(prefix)))
