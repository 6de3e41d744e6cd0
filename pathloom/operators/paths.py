"""Path search between two sets of ids. Paths are ``_nodes`` (ids) and ``_rels`` (edge values) in walking order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.setops import union_versions
from pathloom.operators.traverse import CUT_EVERY, edge_struct, same_edge
from pathloom.runtime import cut

DEFAULT_STEPS = 5
#: After so many levels the ids seen so far are written out as one table.
CUT_SEEN = 8
#: Words of 64 bits in the bitmap of a block of sources (one word where there are no more sources than bits in it).
WORDS = 16


def _ids(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.select(F.col(col).alias(name)).where(F.col(name).isNotNull()).distinct()


def _written(view: DataFrame, props: list[str] | None) -> DataFrame:
    """The edges of a search, written once: every level reads the columns it needs and computes no view again."""
    return cut(view.select("_from", "_to", edge_struct(props or []).alias("_edge")))


def distances(view: DataFrame, start: DataFrame, steps: int, vid: str = "_vid", backward: bool = False) -> DataFrame:
    """Breadth-first distance from the nearest start id: ``(_vid, _depth)`` up to ``steps``."""
    a, b = ("_to", "_from") if backward else ("_from", "_to")
    hops = view.select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    seen = cut(_ids(start, vid, "_vid").withColumn("_depth", F.lit(0)))
    layer = seen
    for k in range(1, steps + 1):
        nxt = layer.join(hops, layer["_vid"] == hops["__a"]).select(F.col("__b").alias("_vid")).distinct().join(seen.select("_vid"), "_vid", "left_anti")
        layer = cut(nxt.withColumn("_depth", F.lit(k)))
        if layer.isEmpty():
            break
        seen = seen.union(layer)
        seen = cut(seen) if k % CUT_SEEN == 0 else seen
    return seen


def _numbered(sources: DataFrame) -> tuple[DataFrame, int]:
    """Sources ``_start`` with a place each: block ``__b``, and in its bitmap word ``__at`` and bit ``__bit``; words of a bitmap.

    Numbers follow the order of the ids, so that sources near each other share blocks; no step counts through all of them.
    """
    ids = cut(sources.repartitionByRange("_start").sortWithinPartitions("_start").withColumn("__n", F.monotonically_increasing_id()))
    words = WORDS if ids.count() > 64 else 1
    bits = 64 * words
    n = F.col("__n")
    place = [F.floor(n / bits).alias("__b"), F.floor(n % bits / 64).cast("int").alias("__at"), F.expr("shiftleft(1L, cast(__n % 64 as int))").alias("__bit")]
    return cut(ids.select("_start", *place)), words


def _all_of(words: int) -> Column:
    """The common bitmap of a group."""
    return F.array(*(F.bit_or(F.col("__m")[i]) for i in range(words))).alias("__m")


def _has() -> Column:
    """Whether the source of a row (``__at``, ``__bit``) is in the bitmap of the row."""
    return F.col("__m")[F.col("__at")].bitwiseAND(F.col("__bit")) != 0


def _full(words: int) -> Column:
    return F.array(*(F.lit(-1).cast("long") for _ in range(words)))


def _masked(df: DataFrame, words: int, without: bool = False) -> DataFrame:
    """Bitmaps ``__m`` less, or common with, those in ``__o`` (where it is null: the empty one). A bitmap is one column, an
    array: Catalyst rewrites a condition on so many columns once for each set of their new names."""
    def one(i):
        b = F.coalesce(F.col("__o")[i], F.lit(0).cast("long"))
        return F.col("__m")[i].bitwiseAND(F.bitwise_not(b) if without else b)

    df = df.select(*(c for c in df.columns if c not in ("__m", "__o")), F.array(*(one(i) for i in range(words))).alias("__m"))
    return df.where(F.exists("__m", lambda x: x != 0))


def _other(df: DataFrame, vid: str) -> DataFrame:
    return df.select("__b", F.col("__v").alias(vid), F.col("__m").alias("__o"))


def _levels(view: DataFrame, sources: DataFrame, targets: DataFrame, steps: int, src: str, dst: str, edge: Column | None):
    """Breadth-first search of all sources: numbered sources, words of a bitmap, ids and edges by level.

    A row of an id's table says which sources of a block reach it at that level first, a row of an edge's table for which
    of them it ends a shortest walk: bits of a bitmap. So tables grow with ids and edges times blocks, not times sources.
    ``__left`` is the distance to a target. Without ``edge`` only ids are told.
    """
    goal = cut(_ids(targets, dst, "_end"))
    base = cut(view.select("_from", "_to").distinct() if edge is None else view.select("_from", "_to", edge.alias("_edge")))
    back = distances(base, goal, steps, "_end", backward=True).select(F.col("_vid").alias("__v"), F.col("_depth").alias("__left"))
    carried = [] if edge is None else ["__e"]
    edges = base.select(F.col("_from").alias("__from"), F.col("_to").alias("__to"), *([] if edge is None else [F.col("_edge").alias("__e")]))
    # edges that lead towards a target are written once and read at every level
    edges = cut(edges.join(back.where(F.col("__left") < steps).select(F.col("__v").alias("__to"), "__left"), "__to"))
    ids, words = _numbered(_ids(sources, src, "_start").join(back.select("__v"), F.col("_start") == F.col("__v"), "left_semi"))
    first = ids.groupBy("__b", F.col("_start").alias("__v")).agg(F.array(*(F.bit_or(F.when(F.col("__at") == i, F.col("__bit")).otherwise(F.lit(0).cast("long"))) for i in range(words))).alias("__m"))
    layer = seen = cut(first.join(back, "__v").select("__b", "__v", "__left", "__m"))
    # targets that no edge enters are never found: only the others count
    wanted = back.where("__left = 0").join(edges.select(F.col("__to").alias("__v")).union(ids.select("_start")).distinct(), "__v", "left_semi").count()
    hops, reached = [], []
    for k in range(1, steps + 1):
        hop = layer.select("__b", "__v", "__m").join(edges.where(F.col("__left") <= steps - k), F.col("__v") == F.col("__from")).select("__b", "__from", "__to", "__left", *carried, "__m")
        if edge is None:
            hop = hop.groupBy("__b", "__to", "__left").agg(_all_of(words))
        known = seen.groupBy("__b", "__v").agg(_all_of(words))
        hop = _masked(hop.join(_other(known, "__to"), ["__b", "__to"], "left"), words, without=True)
        hop = cut(hop)
        if hop.isEmpty():
            break
        layer = hop.select("__b", F.col("__to").alias("__v"), "__left", "__m")
        if edge is not None:
            hops.append(hop)
            layer = cut(layer.groupBy("__b", "__v", "__left").agg(_all_of(words)))
        reached.append(layer)
        seen = seen.union(layer)
        seen = cut(seen.groupBy("__b", "__v", "__left").agg(_all_of(words))) if k % CUT_SEEN == 0 else seen
        # a source whose targets are all found needs no further level
        if k < steps:
            at_goal = seen.where("__left = 0").groupBy("__b", "__v").agg(_all_of(words))
            done = at_goal.groupBy("__b").agg(F.count("*").alias("__found"), F.array(*(F.bit_and(F.col("__m")[i]) for i in range(words))).alias("__o"))
            layer = _masked(layer.join(done.where(F.col("__found") >= wanted).drop("__found"), "__b", "left"), words, without=True)
    return ids, words, reached, hops, edges


def shortest_lengths(view: DataFrame, sources: DataFrame, targets: DataFrame, steps: int = DEFAULT_STEPS, src: str = "_vid", dst: str = "_vid") -> DataFrame:
    """Lengths of the shortest paths of every (source, target) pair within ``steps``: ``_start, _end, _length``. No path is built."""
    ids, _, reached, _, _ = _levels(view, sources, targets, steps, src, dst, None)
    found = None
    for k, layer in enumerate(reached, 1):
        one = layer.where("__left = 0").select("__b", F.col("__v").alias("_end"), F.lit(k).cast("long").alias("_length"), "__m")
        found = one if found is None else found.union(one)
    if found is None:
        return ids.select("_start", F.col("_start").alias("_end"), F.lit(0).cast("long").alias("_length")).limit(0)
    return found.join(ids, "__b").where(_has()).select("_start", "_end", "_length")


def _one_path_each(view: DataFrame, sources: DataFrame, targets: DataFrame, steps: int = DEFAULT_STEPS, src: str = "_vid", dst: str = "_vid", props: list[str] | None = None, least: int = 1) -> DataFrame:
    """One shortest path of each pair, the one whose edges come first; its tables hold a row for each source and id."""
    goal = cut(_ids(targets, dst, "_end"))
    base = _written(view, props)
    back = distances(base, goal, steps, "_end", backward=True).select(F.col("_vid").alias("__v"), F.col("_depth").alias("__left"))
    edges = base.select(F.col("_from").alias("__from"), F.col("_to").alias("__to"), F.col("_edge").alias("__e"))
    # edges that lead towards a target are written once and read at every level
    edges = cut(edges.join(back.where(F.col("__left") < steps).select(F.col("__v").alias("__to"), "__left"), "__to"))
    seen = cut(_ids(sources, src, "_start").withColumn("_vid", F.col("_start")).join(back.withColumnRenamed("__v", "_vid").select("_vid"), "_vid", "left_semi").select("_start", "_vid", F.lit(0).alias("_depth")))
    layer, preds = seen.select("_start", "_vid"), []
    wanted = None
    for k in range(1, steps + 1):
        hop = layer.join(edges, (layer["_vid"] == edges["__from"]) & (F.col("__left") <= steps - k)).select("_start", F.col("__from").alias("_prev"), F.col("__to").alias("_vid"), "__e")
        hop = hop.join(seen.select("_start", "_vid"), ["_start", "_vid"], "left_anti")
        hop = hop.groupBy("_start", "_vid").agg(F.min(F.struct(F.struct("__e._type", "__e._src", "__e._dst", "__e._rank").alias("o"), F.col("_prev").alias("p"), F.col("__e").alias("e"))).alias("m")).select("_start", F.col("m.p").alias("_prev"), "_vid", F.col("m.e").alias("__e"))
        hop = cut(hop)
        if hop.isEmpty():
            break
        preds.append(hop)
        layer = hop.select("_start", "_vid").distinct()
        seen = seen.union(layer.withColumn("_depth", F.lit(k)))
        seen = cut(seen) if k % CUT_SEEN == 0 else seen
        # a source whose targets are all found needs no further level
        if k < steps:
            hit = seen.join(goal, seen["_vid"] == goal["_end"]).groupBy("_start").agg(F.count("*").alias("n"))
            wanted = goal.count() if wanted is None else wanted
            layer = layer.join(hit.where(F.col("n") >= wanted).select("_start"), "_start", "left_anti")
    # from the last level to the first: paths of all lengths grow at their front together
    path = None
    for k in range(len(preds), 0, -1):
        p = preds[k - 1]
        if path is not None:
            back_one = p.select(F.col("_start").alias("__s"), F.col("_vid").alias("__v"), "_prev", "__e")
            path = path.join(back_one, (path["_start"] == back_one["__s"]) & (path["__at"] == back_one["__v"])).select("_start", "_end", "_length", F.col("_prev").alias("__at"), F.concat(F.array("_prev"), "_nodes").alias("_nodes"), F.concat(F.array("__e"), "_rels").alias("_rels"))
        if k >= least:
            ends = p.join(goal, p["_vid"] == goal["_end"], "left_semi").where(F.col("_vid") != F.col("_start"))
            ends = ends.select("_start", F.col("_vid").alias("_end"), F.lit(k).cast("long").alias("_length"), F.col("_prev").alias("__at"), F.array("_prev", "_vid").alias("_nodes"), F.array("__e").alias("_rels"))
            path = ends if path is None else path.union(ends)
        if path is not None and k > 1 and (len(preds) - k) % CUT_EVERY == CUT_EVERY - 1:
            path = cut(path)
    if path is None:
        e = edges.select(F.col("__from").alias("_start"), F.col("__to").alias("_end"), F.lit(0).cast("long").alias("_length"), F.array("__from").alias("_nodes"), F.array("__e").alias("_rels"))
        return e.limit(0)
    return path.drop("__at")


def shortest_paths(view: DataFrame, sources: DataFrame, targets: DataFrame, steps: int = DEFAULT_STEPS, src: str = "_vid", dst: str = "_vid", single: bool = False, props: list[str] | None = None, least: int = 1) -> DataFrame:
    """Shortest paths of every (source, target) pair within ``steps``: ``_start, _end, _length, _nodes, _rels``.

    Level by level from all sources at once; ids that cannot reach a target within the steps left are never entered (their
    distance backward from the targets is known first). All shortest paths, or one of each pair with ``single`` (the one
    whose edges come first). A pair of one id with itself is left out. Trails by nature: a shortest path repeats no vertex.
    Paths are put together last, of a first half of each source and a second half that a block of sources shares: the rows
    returned are made by that join and never written.
    """
    if single:
        return _one_path_each(view, sources, targets, steps, src, dst, props, least)
    ids, words, _, hops, edges = _levels(view, sources, targets, steps, src, dst, edge_struct(props or []))
    if len(hops) < max(least, 1):
        return edges.select(F.col("__from").alias("_start"), F.col("__to").alias("_end"), F.lit(0).cast("long").alias("_length"), F.array("__from").alias("_nodes"), F.array("__e").alias("_rels")).limit(0)
    half = len(hops) - len(hops) // 2
    # first halves follow only edges on the way to a target that has no shorter walk
    need, ways = None, {}
    for k in range(len(hops), 0, -1):
        ends = (F.col("__left") == 0) & F.lit(k >= least)
        if need is None:
            way = hops[k - 1].where(ends)
        else:
            on = hops[k - 1].join(_other(need, "__to"), ["__b", "__to"], "left")
            way = _masked(on.withColumn("__o", F.when(ends, _full(words)).otherwise(F.col("__o"))), words)
        if k <= half:
            way = ways[k] = cut(way)
        need = way.groupBy("__b", F.col("__from").alias("__v")).agg(_all_of(words))
        need = cut(need) if k > half else need
    kind = edges.schema["__e"].dataType.simpleString()
    vid = edges.schema["__to"].dataType.simpleString()
    # second halves, from the last level on; they begin after the id that they are joined at
    tail = None
    for k in range(len(hops), half, -1):
        p = hops[k - 1]
        if tail is not None:
            later = tail.select("__b", F.col("__mid").alias("__to"), "_end", "_length", "_nodes", "_rels", F.col("__m").alias("__o"))
            tail = _masked(p.join(later, ["__b", "__to"]), words)
            tail = tail.select("__b", F.col("__from").alias("__mid"), "_end", "_length", F.concat(F.array("__to"), "_nodes").alias("_nodes"), F.concat(F.array("__e"), "_rels").alias("_rels"), "__m")
        if k >= least:
            ends = p.where("__left = 0").select("__b", F.col("__from").alias("__mid"), F.col("__to").alias("_end"), F.lit(k).cast("long").alias("_length"), F.array("__to").alias("_nodes"), F.array("__e").alias("_rels"), "__m")
            tail = ends if tail is None else tail.union(ends)
        if k > half + 1 and (len(hops) - k) % CUT_EVERY == CUT_EVERY - 1:
            tail = cut(tail)
    if half >= least:
        # a first half that ends at a target is a path by itself
        ends = ways[half].where("__left = 0").select("__b", F.col("__to").alias("__mid")).distinct()
        ends = ends.select("__b", "__mid", F.col("__mid").alias("_end"), F.lit(half).cast("long").alias("_length"), F.array().cast(f"array<{vid}>").alias("_nodes"), F.array().cast(f"array<{kind}>").alias("_rels"), _full(words).alias("__m"))
        tail = ends if tail is None else tail.union(ends)
    head = ids.select("__b", "__at", "__bit", "_start", F.col("_start").alias("__mid"), F.array("_start").alias("__nodes"), F.array().cast(f"array<{kind}>").alias("__rels"))
    found = []
    for k in range(1, half + 1):
        head = head.withColumnRenamed("__mid", "__from").join(ways[k].drop("__left"), ["__b", "__from"]).where(_has())
        head = head.select("__b", "__at", "__bit", "_start", F.col("__to").alias("__mid"), F.concat("__nodes", F.array("__to")).alias("__nodes"), F.concat("__rels", F.array("__e")).alias("__rels"))
        if k < half:
            head = cut(head)
            if k >= least:
                goal = ways[k].where("__left = 0").select("__b", F.col("__to").alias("__mid")).distinct()
                found.append(head.join(goal, ["__b", "__mid"], "left_semi").select("_start", F.col("__mid").alias("_end"), F.lit(k).cast("long").alias("_length"), F.col("__nodes").alias("_nodes"), F.col("__rels").alias("_rels")))
    found.append(head.join(tail, ["__b", "__mid"]).where(_has()).select("_start", "_end", "_length", F.concat("__nodes", "_nodes").alias("_nodes"), F.concat("__rels", "_rels").alias("_rels")))
    return union_versions(found)


def all_paths(view: DataFrame, sources: DataFrame, targets: DataFrame, steps: int = DEFAULT_STEPS, src: str = "_vid", dst: str = "_vid", no_loop: bool = False, props: list[str] | None = None, edge_filter: Column | None = None) -> DataFrame:
    """All paths of at most ``steps`` edges between two sets, no edge twice (``no_loop``: no vertex twice).

    A partial path is dropped as soon as no target lies within the steps it has left. Columns as for shortest paths.
    """
    if edge_filter is not None:
        view = view.where(edge_filter)
    goal = cut(_ids(targets, dst, "_end"))
    base = _written(view, props)
    back = distances(base, goal, steps, "_end", backward=True).select(F.col("_vid").alias("__to"), F.col("_depth").alias("__left"))
    edges = base.select(F.col("_from").alias("__from"), F.col("_to").alias("__to"), F.col("_edge").alias("__e"))
    edges = cut(edges.join(back.where(F.col("__left") < steps), "__to"))
    walk = _ids(sources, src, "_start").select("_start", F.col("_start").alias("__at"), F.array("_start").alias("_nodes"))
    kind = edges.schema["__e"].dataType.simpleString()
    walk = walk.withColumn("_rels", F.array().cast(f"array<{kind}>"))
    found = []
    for k in range(1, steps + 1):
        nxt = walk.join(edges, (walk["__at"] == edges["__from"]) & (F.col("__left") <= steps - k))
        again = F.array_contains("_nodes", F.col("__to")) if no_loop else F.exists("_rels", lambda x: same_edge(x, F.col("__e")))
        nxt = nxt.where(~again).select("_start", F.col("__to").alias("__at"), F.concat("_nodes", F.array("__to")).alias("_nodes"), F.concat("_rels", F.array("__e")).alias("_rels"))
        walk = cut(nxt)
        if walk.isEmpty():
            break
        found.append(walk.join(goal, walk["__at"] == goal["_end"]).select("_start", "_end", F.lit(k).cast("long").alias("_length"), "_nodes", "_rels"))
    if not found:
        return walk.select("_start", F.col("__at").alias("_end"), F.lit(0).cast("long").alias("_length"), "_nodes", "_rels").limit(0)
    return union_versions(found)
