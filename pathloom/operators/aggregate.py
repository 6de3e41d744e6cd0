"""Grouping and aggregates; Spark aggregates partially before it shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.values import SemanticError, Typed


def _sum(x: Typed, distinct: bool) -> Column:
    zero = F.lit(0).cast("long") if x.kind == "int" else F.lit(0.0) if x.kind == "float" else F.lit(0)
    return F.coalesce(F.sum_distinct(x.col) if distinct else F.sum(x.col), zero)


def _of_distinct(f: Callable[[Column], Column]) -> Callable[[Typed, bool], Column]:
    return lambda x, distinct: f(x.col)


def _moments(x: Typed, distinct: bool) -> Column:
    if not distinct:
        return F.stddev_pop(x.col)
    s = F.collect_set(x.col.cast("double"))
    n = F.nullif(F.size(s), F.lit(0))
    mean = F.aggregate(s, F.lit(0.0), lambda a, v: a + v) / n
    return F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)


#: name -> (builder, kind of the result or None for the argument's)
AGGREGATES: dict[str, tuple[Callable[[Typed, bool], Column], str | None]] = {
    "count": (lambda x, d: F.count_distinct(x.col) if d else F.count(x.col), "int"),
    "sum": (_sum, None),
    "avg": (lambda x, d: F.sum_distinct(x.col.cast("double")) / F.nullif(F.count_distinct(x.col), F.lit(0)) if d else F.avg(x.col), "float"),
    "max": (_of_distinct(F.max), None),
    "min": (_of_distinct(F.min), None),
    "std": (_moments, "float"),
    "bit_and": (_of_distinct(F.bit_and), "int"),
    "bit_or": (_of_distinct(F.bit_or), "int"),
    "bit_xor": (lambda x, d: F.aggregate(F.collect_set(x.col.cast("long")), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)) if d else F.bit_xor(x.col), "int"),
    "collect": (lambda x, d: F.collect_set(x.col) if d else F.collect_list(x.col), "list"),
    "collect_set": (lambda x, d: F.collect_set(x.col), "list"),
}


def aggregate_column(name: str, x: Typed, distinct: bool = False) -> Typed:
    """An aggregate by name: sums of nothing are 0, lists of nothing empty, other aggregates of nothing null; ``std`` is
    that of the population."""
    if name.lower() not in AGGREGATES:
        raise SemanticError(f"unknown aggregate: {name}")
    build, kind = AGGREGATES[name.lower()]
    return Typed(build(x, distinct), kind or x.kind, x.kind if kind == "list" else "any")


def aggregate(df: DataFrame, keys: dict[str, Column], items: dict[str, Column]) -> DataFrame:
    """Groups by ``keys`` (null is a group of its own) with aggregated ``items``; without keys one row, even of nothing."""
    if not keys:
        return df.agg(*(c.alias(n) for n, c in items.items()))
    grouped = df.groupBy(*(c.alias(n) for n, c in keys.items()))
    return grouped.agg(*(c.alias(n) for n, c in items.items())) if items else df.select(*(c.alias(n) for n, c in keys.items())).distinct()
