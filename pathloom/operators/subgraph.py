"""Subgraph around a set of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.setops import union_versions
from pathloom.runtime import cut


def subgraph(view: DataFrame, start: DataFrame, steps: int, vid: str = "_vid", both_types: list[str] | None = None, edge_filter: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of each step from 0 to ``steps``: ``(_step, _vid)`` and the view's columns with ``_step``.

    Row k holds the vertices first reached after k steps and the edges that leave them. Left out are: at the last step,
    edges to ids never reached; and of a type walked both ways (``both_types``), edges to an id reached before, if they are
    walked backward or lead to the step just before (such an edge stands in an earlier row already).
    """
    if edge_filter is not None:
        view = view.where(edge_filter)
    twice = F.col("_type").isin(both_types or []) if both_types else F.lit(False)
    seen = cut(start.select(F.col(vid).alias("_vid")).where("_vid is not null").distinct().withColumn("_depth", F.lit(0)))
    layer, vertices, edges = seen, [seen.select(F.lit(0).alias("_step"), "_vid")], []
    if steps == 0:
        return vertices[0], view.withColumn("_step", F.lit(0)).limit(0)
    for k in range(1, steps + 2):
        rows = layer.select("_vid").join(view, layer["_vid"] == view["_from"]).drop("_vid")
        old = seen.select(F.col("_vid").alias("__old"), F.col("_depth").alias("__depth"))
        rows = rows.join(old, rows["_to"] == old["__old"], "left")
        known = F.col("__old").isNotNull()
        rows = rows.where(~(twice & known & ((F.col("_dir") < 0) | (F.col("__depth") == k - 2))))
        if k == steps + 1:
            rows = rows.where(known)
        rows = cut(rows)
        edges.append(rows.drop("__old", "__depth").withColumn("_step", F.lit(k - 1)))
        if k == steps + 1:
            break
        layer = cut(rows.where("__old is null").select(F.col("_to").alias("_vid")).distinct().withColumn("_depth", F.lit(k)))
        if layer.isEmpty():
            break
        vertices.append(layer.select(F.lit(k).alias("_step"), "_vid"))
        seen = seen.union(layer)
    return union_versions(vertices), union_versions(edges)
