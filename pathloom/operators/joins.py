"""Joins on null-safe keys, pattern tests and pattern lists. Spark picks the strategy; nothing is hinted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.values import null_safe


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null. Right columns whose name the left side has already are dropped.

    ``how``: inner, left, left_semi, left_anti. An empty key list makes an inner join a product.
    """
    renamed = right
    names = {}
    for c in right.columns:
        names[c] = f"__r_{c}" if c in left.columns else c
        if names[c] != c:
            renamed = renamed.withColumnRenamed(c, names[c])
    on = null_safe([(left[a], renamed[names[b]]) for a, b in keys])
    if not keys and how == "inner":
        return cross(left, renamed)
    out = left.join(renamed, on, how)
    return out.drop(*(n for n in names.values() if n.startswith("__r_"))) if how in ("inner", "left") else out


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all shared column names; a product if there are none."""
    return join(left, right, [(c, c) for c in left.columns if c in right.columns], how)


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows."""
    return left.crossJoin(right)


def pattern_apply(rows: DataFrame, matches: DataFrame, negate: bool = False) -> DataFrame:
    """Rows with (or without) a match on the shared columns; without shared columns all rows or none, by existence."""
    shared = [c for c in rows.columns if c in matches.columns]
    if shared:
        return join(rows, matches.select(*shared).distinct(), [(c, c) for c in shared], "left_anti" if negate else "left_semi")
    found = matches.limit(1).agg(F.count("*").alias("__n"))
    return rows.crossJoin(found).where(F.col("__n") == (0 if negate else 1)).drop("__n")


def rollup_apply(rows: DataFrame, matches: DataFrame, value: str, name: str) -> DataFrame:
    """All rows with the list of their matches' ``value``; no match gives an empty list."""
    shared = [c for c in rows.columns if c in matches.columns and c != value]
    lists = matches.groupBy(*shared).agg(F.collect_list(value).alias(name)) if shared else matches.agg(F.collect_list(value).alias(name))
    out = join(rows, lists, [(c, c) for c in shared], "left") if shared else rows.crossJoin(lists)
    kind = lists.schema[name].dataType
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def rollup_count(rows: DataFrame, matches: DataFrame, name: str) -> DataFrame:
    """All rows with the number of their matches: what the size of ``rollup_apply``'s list would be, without the list."""
    shared = [c for c in rows.columns if c in matches.columns]
    counts = matches.groupBy(*shared).agg(F.count("*").alias(name)) if shared else matches.agg(F.count("*").alias(name))
    out = join(rows, counts, [(c, c) for c in shared], "left") if shared else rows.crossJoin(counts)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))
