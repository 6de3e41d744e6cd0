"""Traversals. Every hop is one join of a frontier with an edge view; loops without a bound end with an empty frontier.

Walks of GO statements keep a *set* of reached ids between steps, so a step counts edges that leave distinct vertices.
Pattern traversals enumerate *trails*: no edge is used twice, whichever way it is walked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.setops import union_versions
from pathloom.runtime import cut
from pathloom.values import SemanticError

#: After so many hops a frontier is written out, so that plans and recomputation stay bounded.
CUT_EVERY = 3
#: Most hops of a pattern that names no upper bound: no id or edge table reaches it, the frontier is empty before.
OPEN_END = 2**31 - 1


def given(ids: DataFrame, values: list | None) -> DataFrame:
    """Start ids that a statement lists: their values go along, so that the first hop can filter its scan by them."""
    if values is not None:
        ids._given_ids = values
    return ids


def around(view: DataFrame, here: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Edges of a view that leave the ids of a frontier. For listed start ids that is a filter on the scan, not a join."""
    values = getattr(start, "_given_ids", None) if start is not None else None
    if values is not None and here.columns == ["_vid"]:
        return view.where(F.col("_from").isin(values))
    return here.join(view, here["_vid"] == view["_from"]).drop("_vid")


def _frontier(df: DataFrame, hop: int) -> DataFrame:
    return cut(df) if hop % CUT_EVERY == 0 else df


def expand(view: DataFrame, start: DataFrame, steps: int, vid: str = "_vid", origin: bool = False) -> DataFrame:
    """Ids reached after exactly ``steps`` hops: a set, or with ``origin`` distinct ``(_origin, _vid)`` pairs.

    Revisited ids count again; 0 steps return the start ids.
    """
    here = start.select(F.col(vid).alias("_vid")).where("_vid is not null").distinct()
    if origin:
        here = here.select(F.col("_vid").alias("_origin"), "_vid")
    keep = ["_origin"] if origin else []
    hops = view.select("_from", "_to")
    for k in range(1, steps + 1):
        here = around(hops, here, start if k == 1 else None).select(*keep, F.col("_to").alias("_vid")).distinct()
        here = _frontier(here, k) if k < steps else here
    return here


def expand_all(
    view: DataFrame, start: DataFrame, first: int, last: int | None = None, vid: str = "_vid", origin: bool = False, step_limits: list[int] | None = None, step_samples: list[int] | None = None, seed: int = 0
) -> DataFrame:
    """One row for each edge that leaves the frontier at each step from ``first`` to ``last``, with ``_step``.

    ``step_limits`` and ``step_samples`` bound the edges of a whole step, one number for each step.
    """
    last = first if last is None else last
    if last < first:
        raise SemanticError("the last step lies before the first")
    first = max(first, 1) if last > 0 else first
    caps = step_limits or step_samples
    if caps and len(caps) != last:
        raise SemanticError("one limit or sample size is needed for each step")
    here = start.select(F.col(vid).alias("_vid")).where("_vid is not null").distinct()
    if origin:
        here = here.select(F.col("_vid").alias("_origin"), "_vid")
    keep = ["_origin"] if origin else []
    steps = []
    for k in range(1, last + 1):
        rows = around(view, here, start if k == 1 else None)
        if caps:
            rows = rows.limit(caps[k - 1]) if step_limits else rows.orderBy(F.rand(seed + k)).limit(caps[k - 1])
            rows = cut(rows)
        if k >= first:
            steps.append(rows.withColumn("_step", F.lit(k)))
        if k < last:
            following = rows if caps else around(view.select("_from", "_to"), here, start if k == 1 else None)
            here = _frontier(following.select(*keep, F.col("_to").alias("_vid")).distinct(), k)
    if not steps:
        return here.join(view, here["_vid"] == view["_from"]).drop("_vid").withColumn("_step", F.lit(0)).limit(0)
    return union_versions(steps)


def get_neighbors(view: DataFrame, start: DataFrame, vid: str = "_vid", condition: Column | None = None, per_vertex_limit: int | None = None, per_vertex_sample: int | None = None, order: list[Column] | None = None, seed: int = 0) -> DataFrame:
    """Edges around each start id, at most ``per_vertex_limit`` (in ``order``) or a sample of each id's edges.

    The rank filter lets Spark drop surplus rows of an id in each task before the shuffle.
    """
    here = start.select(F.col(vid).alias("_vid")).where("_vid is not null").distinct()
    rows = around(view, here, start)
    if condition is not None:
        rows = rows.where(condition)
    count = per_vertex_limit if per_vertex_limit is not None else per_vertex_sample
    if count is None:
        return rows
    by = order or ([F.rand(seed)] if per_vertex_sample is not None else [F.col("_type"), F.col("_to"), F.col("_rank"), F.col("_dir")])
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("_from").orderBy(*by))).where(F.col("__n") <= count).drop("__n")


def neighbor_stats(view: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """Aggregates over the edges of each source id."""
    return view.groupBy("_from").agg(*(c.alias(n) for n, c in stats.items())).withColumnRenamed("_from", "_vid")


def destinations(view: DataFrame, start: DataFrame, vid: str = "_vid") -> DataFrame:
    """Distinct neighbours only: no property is read."""
    return expand(view, start, 1, vid)


def edge_struct(props: list[str]) -> Column:
    """An edge view's row as one value."""
    return F.struct("_type", "_src", "_dst", "_rank", "_dir", *props)


def same_edge(a: Column, b: Column) -> Column:
    """Whether two edge values are one edge, whichever way each is walked."""
    return (a["_type"] == b["_type"]) & (a["_src"] == b["_src"]) & (a["_dst"] == b["_dst"]) & (a["_rank"] == b["_rank"])


def traverse(
    view: DataFrame, rows: DataFrame, from_col: str, to_col: str, edge_col: str, least: int = 1, most: int | None = None, used: list[tuple[str, bool]] | None = None, props: list[str] | None = None,
    single: bool = True, edge_filter: Column | None = None, into: bool = False, nodes_col: str | None = None,
) -> DataFrame:
    """Follow one pattern edge from the vertex in ``from_col``: adds ``edge_col`` and ``to_col``.

    A single edge is one value, a variable-length one a list of values (``single`` False); ``least`` 0 keeps each row with
    an empty list. Edges of earlier columns of the same pattern (``used``: name, is list) are not used again.
    ``edge_filter`` holds for every edge and is applied before the loop. ``into``: ``to_col`` exists already and must be
    reached. ``nodes_col`` adds the list of ids between the two ends. With ``most`` OPEN_END the loop ends when no trail goes on.
    """
    most = least if most is None else most
    if least < 0 or most < least:
        raise SemanticError("the bounds of a variable-length pattern are out of order")
    props = props or []
    if edge_filter is not None:
        view = view.where(edge_filter)
    edges = view.select(F.col("_from").alias("__from"), F.col("_to").alias("__to"), edge_struct(props).alias("__e"))
    kind = edges.schema["__e"].dataType.simpleString()

    def fresh(e: Column) -> Column:
        ok = F.lit(True)
        for name, is_list in used or []:
            c = F.col(f"`{name}`")
            ok = ok & (~F.exists(c, lambda x: same_edge(x, e)) if is_list else ~same_edge(c, e))
        return ok

    if single:
        on = F.col(f"`{from_col}`") == F.col("__from")
        if into:
            on = on & (F.col(f"`{to_col}`") == F.col("__to"))
        out = rows.join(edges, on).where(fresh(F.col("__e")))
        out = out.withColumn(edge_col, F.col("__e"))
        out = out if into else out.withColumn(to_col, F.col("__to"))
        return out.drop("__from", "__to", "__e")
    step = rows.withColumn("__path", F.array().cast(f"array<{kind}>")).withColumn("__here", F.col(f"`{from_col}`"))
    if nodes_col:
        step = step.withColumn(nodes_col, F.array().cast(f"array<{view.schema['_to'].dataType.simpleString()}>"))
    found = [step] if least == 0 else []
    for k in range(1, most + 1):
        nxt = step.join(edges, F.col("__here") == F.col("__from")).where(~F.exists("__path", lambda x: same_edge(x, F.col("__e"))) & fresh(F.col("__e")))
        if nodes_col and k > 1:
            nxt = nxt.withColumn(nodes_col, F.concat(nodes_col, F.array("__here")))
        nxt = nxt.withColumn("__path", F.concat("__path", F.array("__e"))).withColumn("__here", F.col("__to")).drop("__from", "__to", "__e")
        if k % 2 == 0 and k < most:
            nxt = cut(nxt)
            if nxt.isEmpty():
                break
        step = nxt
        if k >= least:
            found.append(step)
        if len(found) >= 16:
            # long trails: the plan of what is found stays small
            found = [cut(union_versions(found))]
    out = union_versions(found) if found else step.limit(0)
    if into:
        out = out.where(F.col("__here").eqNullSafe(F.col(f"`{to_col}`"))).drop("__here")
    else:
        out = out.withColumnRenamed("__here", to_col)
    return out.withColumnRenamed("__path", edge_col)


def append_vertices(vertices: DataFrame, rows: DataFrame, vid: str) -> DataFrame:
    """Keep rows whose vertex exists (a dangling edge leads nowhere in a pattern); ``vertices`` may repeat ids."""
    ids = vertices.select(F.col("_vid").alias("__v"))
    return rows.join(ids, F.col(f"`{vid}`") == F.col("__v"), "left_semi")
