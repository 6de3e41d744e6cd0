"""Set operations. INTERSECT and MINUS keep every left row, duplicates too, unlike those of SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from pathloom.operators.joins import join
from pathloom.values import same_names


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both."""
    same_names(a, b)
    return a.union(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return union_all(a, b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left rows that the right side has; null equals null."""
    same_names(a, b)
    return join(a, b.distinct(), [(c, c) for c in a.columns], "left_semi")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left rows that the right side lacks; null equals null."""
    same_names(a, b)
    return join(a, b.distinct(), [(c, c) for c in a.columns], "left_anti")


def union_versions(versions: list[DataFrame]) -> DataFrame:
    """All versions of a loop's result."""
    return reduce(lambda x, y: x.unionByName(y), versions)
