"""Row operators: projection, filter, duplicates, unwinding, order, limits, samples, literal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.values import SemanticError, ordering


def project(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One output column for each name."""
    return df.select(*(c.alias(n) for n, c in columns.items()))


def where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition is true; null drops a row. The condition reaches the scan as it is."""
    return df.where(condition.cast("boolean"))


def dedup(df: DataFrame) -> DataFrame:
    """Distinct rows; null equals null."""
    return df.distinct()


def unwind(df: DataFrame, values: Column, name: str, is_list: bool = True, keep: bool = True) -> DataFrame:
    """One row for each element of a list; a scalar gives one row; null and empty lists give none.

    ``keep`` keeps the other columns (they are dropped where the rows come through a pipe).
    """
    items = values if is_list else F.when(values.isNotNull(), F.array(values))
    others = [c for c in df.columns if c != name] if keep else []
    return df.select(*others, F.explode(items).alias(name))


def sort(df: DataFrame, factors: list[tuple[str, bool]]) -> DataFrame:
    """Total order by ``(column, descending)``; null is the largest value."""
    return df.orderBy(*(ordering(F.col(f"`{c}`"), d) for c, d in factors))


def limit(df: DataFrame, count: int, offset: int = 0) -> DataFrame:
    """``count`` rows after ``offset``."""
    if count < 0 or offset < 0:
        raise SemanticError("limit and offset must not be negative")
    return (df.offset(offset) if offset else df).limit(count)


def top_n(df: DataFrame, factors: list[tuple[str, bool]], count: int, offset: int = 0) -> DataFrame:
    """Order and limit in one: Spark keeps ``offset + count`` rows for each task and merges them."""
    return limit(sort(df, factors), count, offset)


def sample(df: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``count`` rows: a random order cut at ``count``, merged from each task's own."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(count).drop("__r")


def values(spark: SparkSession, names: list[str], rows: list[list[Column]]) -> DataFrame:
    """A literal table."""
    one = spark.range(1)
    out = None
    for r in rows:
        part = one.select(*(c.alias(n) for n, c in zip(names, r, strict=True)))
        out = part if out is None else out.union(part)
    return out
