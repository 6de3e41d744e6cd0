"""Registered queries over the relational test tables seen as a graph, each with its DuckDB counterpart.

Vertex ids are integers: ten times the key plus a digit for the tag. ``handoff`` joins the users of consecutive events,
which gives a cyclic multigraph for walks and paths.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom import values as V
from pathloom.functions.geo import point_distance
from pathloom.functions.scalar import cosine_of_arrays
from pathloom.functions.udf import standard_deviation
from pathloom.operators import joins, paths, relational, setops, subgraph, traverse
from pathloom.plans.session import Session
from pathloom.sources.files import dump
from pathloom.sources.fulltext import search
from pathloom.sources.space import Space

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = range(6)


def _vid(col: str, kind: int):
    return (F.col(col).cast("long") * 10 + kind).alias("_vid")


_SPACES: weakref.WeakKeyDictionary[SparkSession, dict[str, Space]] = weakref.WeakKeyDictionary()


def graph(spark: SparkSession, sf_dir: str) -> Space:
    """The test tables as a space, put together once for each session and folder: only plans are kept, no data."""
    held = _SPACES.setdefault(spark, {})
    if sf_dir not in held:
        held[sf_dir] = _graph(spark, sf_dir)
    return held[sf_dir]


def _graph(spark: SparkSession, sf_dir: str) -> Space:
    """Tags and edges of the tables. Edge ranks are surrogates: lines of one order and part are numbered in a fixed order."""
    def t(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    space = Space(spark, "trade", "int64")
    space = space.with_tag("region", t("region").select(_vid("r_regionkey", REGION), F.col("r_name").alias("name")))
    space = space.with_tag("nation", t("nation").select(_vid("n_nationkey", NATION), F.col("n_name").alias("name")))
    space = space.with_tag("customer", t("customer").select(_vid("c_custkey", CUSTOMER), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment")))
    space = space.with_tag("supplier", t("supplier").select(_vid("s_suppkey", SUPPLIER), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")))
    space = space.with_tag("part", t("part").select(_vid("p_partkey", PART), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price")))
    space = space.with_tag("ord", t("orders").select(_vid("o_orderkey", ORDER), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("timestamp_ntz").alias("odate"), F.col("o_orderpriority").alias("priority")))

    def edge(name, df, a, ka, b, kb, *props, rank=None):
        cols = [(F.col(a).cast("long") * 10 + ka).alias("_src"), (F.col(b).cast("long") * 10 + kb).alias("_dst")]
        cols.append((F.col(rank).cast("long") if rank else F.lit(0).cast("long")).alias("_rank"))
        return space.with_edge(name, df.select(*cols, *props), rank="_rank")

    space = edge("in_region", t("nation"), "n_nationkey", NATION, "n_regionkey", REGION)
    people = t("customer").select((F.col("c_custkey") * 10 + CUSTOMER).alias("_src"), (F.col("c_nationkey").cast("long") * 10 + NATION).alias("_dst"))
    sellers = t("supplier").select((F.col("s_suppkey") * 10 + SUPPLIER).alias("_src"), (F.col("s_nationkey").cast("long") * 10 + NATION).alias("_dst"))
    space = space.with_edge("in_nation", people.union(sellers))
    space = edge("placed", t("orders"), "o_custkey", CUSTOMER, "o_orderkey", ORDER, F.col("o_totalprice").alias("total"))
    lines = t("lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    holds = lines.withColumn("_n", number)
    space = edge("holds", holds, "l_orderkey", ORDER, "l_partkey", PART, F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"), rank="_n")
    supplied = lines.withColumn("_n", F.row_number().over(Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")))
    space = edge("supplied_by", supplied, "l_partkey", PART, "l_suppkey", SUPPLIER, F.col("l_quantity").alias("quantity"), rank="_n")
    events = t("events")
    nxt = events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("to_user"))
    hand = events.join(nxt, "event_id")
    # foreign keys: every edge ends at a vertex
    return edge("handoff", hand, "user_id", CUSTOMER, "to_user", CUSTOMER, F.col("event_type").alias("kind"), F.col("value"), rank="event_id").closed()


_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _say(name: str, text: str, sql: str | None) -> None:
    """Register a query given as statements."""
    _QUERIES[name] = (lambda spark, d, text=text: Session(spark, graph(spark, d)).execute(text), sql)


def _call(name: str, sql: str | None):
    """Register a query given as a function of the space."""
    def wrap(f):
        _QUERIES[name] = (lambda spark, d, f=f: f(graph(spark, d)), sql)
        return f

    return wrap


def _tables(name: str, sql: str | None):
    """Register a query given as a function of the session and the folder."""
    def wrap(f):
        _QUERIES[name] = (f, sql)
        return f

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    return {n: f for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {n: s for n, (_, s) in _QUERIES.items() if s}


# -- SQL fragments ---------------------------------------------------------------------------------
H = "h AS (SELECT a.user_id*10+2 AS s, b.user_id*10+2 AS d, a.event_id AS r, a.event_type AS k, a.value AS v FROM events a JOIN events b ON b.event_id = a.event_id + 1)"
SPARSE = f"{H}, e AS (SELECT * FROM h WHERE k = 'purchase' AND v > 100)"
PLACED = "placed AS (SELECT o_custkey*10+2 AS s, o_orderkey*10+5 AS d, o_totalprice AS total FROM orders)"
LINES = "li AS (SELECT l_orderkey*10+5 AS o, l_partkey*10+4 AS p, l_suppkey*10+3 AS sup, l_quantity AS q, l_extendedprice AS price, l_discount AS disc, l_returnflag AS flag FROM lineitem)"


def _sparse(space: Space, direction: str = "out", props: list[str] | None = None) -> DataFrame:
    """The hand-offs of large purchases: few edges for each user, many cycles."""
    return space.edge_view(["handoff"], direction, ["kind", "value", *(props or [])]).where("kind = 'purchase' and value > 100").select("_from", "_to", "_type", "_src", "_dst", "_rank", "_dir", *(props or []))


def _ids(space: Space, *ids: int) -> DataFrame:
    return space.spark.range(1).select(F.explode(F.array(*(F.lit(i).cast("long") for i in ids))).alias("_vid"))


def _path_text(df: DataFrame) -> DataFrame:
    return df.select("_start", "_end", "_length", F.array_join(F.col("_nodes").cast("array<string>"), ">").alias("nodes"), F.array_join(F.transform("_rels", lambda e: e["_rank"].cast("string")), ",").alias("ranks"))


# -- flagship ------------------------------------------------------------------------------------------
_say(
    "flagship_go_parts_by_brand",
    "GO 2 STEPS FROM 2, 12, 22, 32, 42 OVER placed, holds YIELD holds._dst AS p, $$.part.brand AS b, holds.quantity AS q | GROUP BY $-.b YIELD $-.b AS brand, count(*) AS n, sum($-.q) AS quantity | ORDER BY $-.n DESC, $-.brand | LIMIT 10",
    f"WITH {PLACED}, {LINES}, f AS (SELECT DISTINCT d FROM placed WHERE s IN (2,12,22,32,42)) SELECT p_brand AS brand, count(*) AS n, sum(q) AS quantity FROM f JOIN li ON li.o = f.d JOIN part ON p_partkey*10+4 = li.p GROUP BY 1 ORDER BY n DESC, brand LIMIT 10",
)

# -- scans and look-ups (S, E) -------------------------------------------------------------------------
_say("s1_scan_vertices", "MATCH (v:customer) WHERE v.customer.acctbal > 9000 RETURN id(v) AS id, v.customer.name AS name, v.customer.acctbal AS bal", "SELECT c_custkey*10+2 AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 9000")
_say("s2_scan_edges", "MATCH ()-[e:placed]->() WHERE e.total > 400000 RETURN src(e) AS s, dst(e) AS d, e.total AS total", f"WITH {PLACED} SELECT s, d, total FROM placed WHERE total > 400000")
_say("s4_index_full_scan", "LOOKUP ON supplier YIELD id(vertex) AS id, supplier.name AS name", "SELECT s_suppkey*10+3 AS id, s_name AS name FROM supplier")
_say("s5_index_prefix_scan", 'LOOKUP ON part WHERE part.brand == "Brand#2" AND part.type == "ECONOMY" YIELD id(vertex) AS id, part.size AS size', "SELECT p_partkey*10+4 AS id, CAST(p_size AS BIGINT) AS size FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
_say("s6_index_range_scan", "LOOKUP ON part WHERE part.size >= 10 AND part.size < 20 YIELD id(vertex) AS id, part.price AS price", "SELECT p_partkey*10+4 AS id, p_retailprice AS price FROM part WHERE p_size >= 10 AND p_size < 20")
_say("s6_edge_range_scan", "LOOKUP ON holds WHERE holds.quantity > 45 AND holds.discount < 0.02 YIELD src(edge) AS s, dst(edge) AS d, holds.quantity AS q", f"WITH {LINES} SELECT o AS s, p AS d, q FROM li WHERE q > 45 AND disc < 0.02")
_say("s8_fetch_vertices", "FETCH PROP ON customer 2, 12, 72, 99999999992 YIELD id(vertex) AS id, customer.name AS name, customer.segment AS segment", "SELECT c_custkey*10+2 AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey IN (0, 1, 7)")
_say("s8_fetch_piped", "GO FROM 2, 12 OVER placed YIELD dst(edge) AS o | FETCH PROP ON ord $-.o YIELD id(vertex) AS id, ord.status AS status, ord.total AS total", f"WITH {PLACED} SELECT o_orderkey*10+5 AS id, o_orderstatus AS status, o_totalprice AS total FROM orders WHERE o_orderkey*10+5 IN (SELECT d FROM placed WHERE s IN (2, 12))")
_say("s9_fetch_edges", "MATCH ()-[e:placed]->() WHERE src(e) == 12 RETURN src(e) AS s, dst(e) AS d | FETCH PROP ON placed $-.s -> $-.d YIELD src(edge) AS s, dst(edge) AS d, placed.total AS total", f"WITH {PLACED} SELECT s, d, total FROM placed WHERE s = 12")
_say("s11_value", 'YIELD 1 AS a, "x" AS b, 2.5 AS c', "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b, CAST(2.5 AS DOUBLE) AS c")


@_tables("s7_fulltext_scan", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: x = 'license')) AS a, len(list_filter(ws, lambda x: x = 'apache')) AS b FROM w),
f AS (SELECT count(*) AS nn, avg(n) AS av, sum(CAST(a > 0 AS BIGINT)) AS da, sum(CAST(b > 0 AS BIGINT)) AS db FROM t)
SELECT doc_id, round(ln(1 + (nn - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / av)) + ln(1 + (nn - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / av)), 5) AS score FROM t, f WHERE a > 0 OR b > 0""")
def _fulltext(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return search(docs, "doc_id", "text", "license apache").select("doc_id", F.round("score", 5).alias("score"))


@_call("s10_get_neighbors_limit", f"WITH {PLACED} SELECT s, d, total FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY total DESC, d) AS n FROM placed WHERE s IN (2, 12, 22, 32)) WHERE n <= 3")
def _neighbors(space):
    got = traverse.get_neighbors(space.edge_view(["placed"], props=["total"]), _ids(space, 2, 12, 22, 32), per_vertex_limit=3, order=[F.desc("total"), F.col("_to")])
    return got.select(F.col("_from").alias("s"), F.col("_to").alias("d"), "total")


@_call("e5_neighbor_stats", f"WITH {PLACED} SELECT s AS _vid, count(*) AS n, round(sum(total), 2) AS total, round(avg(total), 4) AS mean, max(total) AS most, min(total) AS least FROM placed GROUP BY s")
def _stats(space):
    t = F.col("total")
    return traverse.neighbor_stats(space.edge_view(["placed"], props=["total"]), {"n": F.count("*"), "total": F.round(F.sum(t), 2), "mean": F.round(F.avg(t), 4), "most": F.max(t), "least": F.min(t)})


@_call("e6_both_directions_self_loops", f"WITH {H}, b AS (SELECT s, d FROM h UNION ALL SELECT d, s FROM h WHERE s <> d) SELECT s AS _from, count(*) AS n, sum(CAST(s = d AS BIGINT)) AS loops FROM b GROUP BY 1")
def _loops(space):
    v = space.edge_view(["handoff"], "both", [])
    return v.groupBy("_from").agg(F.count("*").alias("n"), F.sum((F.col("_from") == F.col("_to")).cast("long")).alias("loops"))


@_call("e7_neighbor_sample", None)
def _sample(space):
    return traverse.get_neighbors(space.edge_view(["placed"], props=[]), space.tag("customer"), per_vertex_sample=2, seed=7).select("_from", "_to")


@_call("e8_distinct_destinations", f"WITH {H} SELECT DISTINCT d AS _vid FROM h WHERE s IN (2, 12)")
def _dst(space):
    return traverse.destinations(space.edge_view(["handoff"], props=[]), _ids(space, 2, 12))


# -- traversal (T) -----------------------------------------------------------------------------------
@_call("t1_expand", f"WITH {SPARSE}, a AS (SELECT DISTINCT d FROM e WHERE s = 2), b AS (SELECT DISTINCT e.d FROM a JOIN e ON e.s = a.d), c AS (SELECT DISTINCT e.d FROM b JOIN e ON e.s = b.d) SELECT d AS _vid FROM c")
def _expand(space):
    return traverse.expand(_sparse(space), _ids(space, 2), 3)


@_call("t2_expand_with_origin", f"WITH {SPARSE}, a AS (SELECT DISTINCT s AS o, d FROM e WHERE s IN (2, 12, 22)) SELECT DISTINCT a.o AS _origin, e.d AS _vid FROM a JOIN e ON e.s = a.d")
def _expand_origin(space):
    return traverse.expand(_sparse(space), _ids(space, 2, 12, 22), 2, origin=True)


@_call("t3_expand_all_m_to_n", f"WITH {SPARSE}, f1 AS (SELECT DISTINCT d FROM e WHERE s = 2), f2 AS (SELECT DISTINCT e.d FROM f1 JOIN e ON e.s = f1.d) SELECT CAST(2 AS INTEGER) AS step, s, e.d, r FROM f1 JOIN e ON e.s = f1.d UNION ALL SELECT 3, s, e.d, r FROM f2 JOIN e ON e.s = f2.d")
def _expand_all(space):
    return traverse.expand_all(_sparse(space), _ids(space, 2), 2, 3).select(F.col("_step").alias("step"), F.col("_from").alias("s"), F.col("_to").alias("d"), F.col("_rank").alias("r"))


_say("t4_go_statement", "GO FROM 2, 12 OVER placed WHERE placed.total > 100000 YIELD $^.customer.name AS name, placed._dst AS o, placed.total AS total, $$.ord.status AS status", f"WITH {PLACED} SELECT c_name AS name, d AS o, total, o_orderstatus AS status FROM placed JOIN customer ON c_custkey*10+2 = s JOIN orders ON o_orderkey*10+5 = d WHERE s IN (2, 12) AND total > 100000")
_say("t4_go_two_steps_all_types", "GO 2 STEPS FROM 2 OVER placed, holds YIELD DISTINCT holds._dst AS p, $$.part.name AS name", f"WITH {PLACED}, {LINES} SELECT DISTINCT p, p_name AS name FROM placed JOIN li ON li.o = placed.d JOIN part ON p_partkey*10+4 = p WHERE s = 2")
_say("t5_go_reversely", "GO FROM 1, 11 OVER in_nation REVERSELY YIELD in_nation._dst AS who, src(edge) AS s, dst(edge) AS d", "SELECT * FROM (SELECT c_custkey*10+2 AS who, c_custkey*10+2 AS s, CAST(c_nationkey AS BIGINT)*10+1 AS d FROM customer UNION ALL SELECT s_suppkey*10+3, s_suppkey*10+3, CAST(s_nationkey AS BIGINT)*10+1 FROM supplier) WHERE d IN (1, 11)")
_say("t5_go_bidirect", 'GO FROM 2 OVER handoff BIDIRECT WHERE handoff.kind == "purchase" AND handoff.value > 100 YIELD handoff._dst AS d, rank(edge) AS r', f"WITH {SPARSE} SELECT d, r FROM e WHERE s = 2 UNION ALL SELECT s, r FROM e WHERE d = 2 AND s <> d")
_say("t6_go_step_limits", "GO 2 STEPS FROM 2 OVER placed, holds YIELD dst(edge) AS d LIMIT [5, 7]", None)
_say("t6_go_step_sample", "GO 2 STEPS FROM 2 OVER placed, holds YIELD dst(edge) AS d SAMPLE [5, 7]", None)

_TRAIL = f"{SPARSE}, w AS (SELECT s AS a, d AS b, [r] AS rs, 1 AS n FROM e WHERE s IN (2, 12) UNION ALL SELECT w.a, e.d, list_append(rs, e.r), n + 1 FROM w JOIN e ON e.s = w.b WHERE n < 3 AND NOT list_contains(rs, e.r))"


@_call("t7_trails", f"WITH RECURSIVE {_TRAIL} SELECT a, b, CAST(n AS BIGINT) AS n, array_to_string(rs, ',') AS ranks FROM w WHERE n >= 2")
def _trails(space):
    rows = traverse.traverse(_sparse(space), _ids(space, 2, 12).withColumnRenamed("_vid", "a"), "a", "b", "e", 2, 3, single=False)
    return rows.select("a", "b", F.size("e").cast("long").alias("n"), F.array_join(F.transform("e", lambda x: x["_rank"].cast("string")), ",").alias("ranks"))


_say("t7_match_variable_length", 'MATCH (v:customer)-[e:handoff*1..2 {kind: "purchase"}]->(b) WHERE id(v) IN [2, 12] RETURN id(v) AS a, id(b) AS b, size(e) AS n', f"WITH {H}, p AS (SELECT * FROM h WHERE k = 'purchase') SELECT s AS a, d AS b, CAST(1 AS BIGINT) AS n FROM p WHERE s IN (2, 12) UNION ALL SELECT x.s, y.d, 2 FROM p x JOIN p y ON y.s = x.d AND y.r <> x.r WHERE x.s IN (2, 12)")
_say("t8_zero_steps", "MATCH (v:customer)-[e:placed*0..1]->(b) WHERE id(v) IN [2, 12] RETURN id(v) AS a, id(b) AS b, size(e) AS n", f"WITH {PLACED} SELECT s AS a, d AS b, CAST(1 AS BIGINT) AS n FROM placed WHERE s IN (2, 12) UNION ALL SELECT c_custkey*10+2, c_custkey*10+2, 0 FROM customer WHERE c_custkey IN (0, 1)")
_say("t9_traverse_filters", 'MATCH (c:customer {segment: "MACHINERY"})-[:placed]->(o:ord)-[e:holds]->(p:part) WHERE e.quantity > 48 AND p.part.size < 10 AND o.ord.status == "F" RETURN c.customer.name AS name, p.part.name AS part, e.quantity AS q', "SELECT c_name AS name, p_name AS part, l_quantity AS q FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'MACHINERY' AND l_quantity > 48 AND p_size < 10 AND o_orderstatus = 'F'")
_say("t10_append_vertices", "MATCH (r:region)<-[:in_region]-(n:nation)<-[:in_nation]-(s:supplier) RETURN r.region.name AS region, n.nation.name AS nation, count(*) AS n", "SELECT r_name AS region, n_name AS nation, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")

_BFS = f"{SPARSE}, w AS (SELECT s AS a, d AS b, [s, d] AS ns, [r] AS rs, 1 AS n FROM e WHERE s IN (2, 12) AND s <> d UNION ALL SELECT w.a, e.d, list_append(ns, e.d), list_append(rs, e.r), n + 1 FROM w JOIN e ON e.s = w.b WHERE n < 5 AND NOT list_contains(ns, e.d)), m AS (SELECT a, b, min(n) AS n FROM w WHERE b IN (32, 42, 52) GROUP BY a, b)"


@_call("t11_all_shortest_paths", f"WITH RECURSIVE {_BFS} SELECT w.a AS _start, w.b AS _end, CAST(w.n AS BIGINT) AS _length, array_to_string(ns, '>') AS nodes, array_to_string(rs, ',') AS ranks FROM w JOIN m ON m.a = w.a AND m.b = w.b AND m.n = w.n")
def _all_shortest(space):
    return _path_text(paths.shortest_paths(_sparse(space), _ids(space, 2, 12), _ids(space, 32, 42, 52), 5))


# of all shortest paths of a pair the one whose edges, from the first on, come first
_ONE = "SELECT w.a AS _start, w.b AS _end, CAST(w.n AS BIGINT) AS _length, array_to_string(ns, '>') AS nodes FROM w JOIN m ON m.a = w.a AND m.b = w.b AND m.n = w.n"
_VALID = f"SELECT _start, _end, _length, count(*) AS n, CAST(1 AS BIGINT) AS found FROM ({_ONE}) GROUP BY ALL"


def _one_of_all(space, starts, ends):
    """Single shortest paths held against all shortest ones: how many a pair has, and whether the one found is among them."""
    every = _path_text(paths.shortest_paths(_sparse(space), starts, ends, 5)).groupBy("_start", "_end", "_length").agg(F.count("*").alias("n"), F.collect_set(F.concat_ws("|", "nodes", "ranks")).alias("all"))
    one = _path_text(paths.shortest_paths(_sparse(space), starts, ends, 5, single=True)).select("_start", "_end", "_length", F.concat_ws("|", "nodes", "ranks").alias("p"))
    return one.join(every, ["_start", "_end", "_length"]).select("_start", "_end", "_length", "n", F.array_contains("all", F.col("p")).cast("long").alias("found"))


@_call("t12_single_shortest_path", f"WITH RECURSIVE {_BFS} {_VALID.replace('GROUP BY ALL', 'WHERE _start = 2 AND _end = 32 GROUP BY ALL')}")
def _single_shortest(space):
    return _one_of_all(space, _ids(space, 2), _ids(space, 32))


@_call("t13_shortest_lengths_many_pairs", f"WITH RECURSIVE {_BFS} {_VALID}")
def _many(space):
    return _one_of_all(space, _ids(space, 2, 12), _ids(space, 32, 42, 52))


_ALL = f"{SPARSE}, w AS (SELECT s AS a, d AS b, [s, d] AS ns, [r] AS rs, 1 AS n FROM e WHERE s = 2 UNION ALL SELECT w.a, e.d, list_append(ns, e.d), list_append(rs, e.r), n + 1 FROM w JOIN e ON e.s = w.b WHERE n < 4 AND NOT list_contains(rs, e.r))"


@_call("t14_all_paths", f"WITH RECURSIVE {_ALL} SELECT a AS _start, b AS _end, CAST(n AS BIGINT) AS _length, array_to_string(ns, '>') AS nodes, array_to_string(rs, ',') AS ranks FROM w WHERE b IN (32, 42)")
def _all(space):
    return _path_text(paths.all_paths(_sparse(space), _ids(space, 2), _ids(space, 32, 42), 4))


@_call("t15_noloop_paths", f"WITH RECURSIVE {_ALL} SELECT a AS _start, b AS _end, CAST(n AS BIGINT) AS _length, array_to_string(ns, '>') AS nodes, array_to_string(rs, ',') AS ranks FROM w WHERE b IN (32, 42) AND len(list_distinct(ns)) = len(ns)")
def _noloop(space):
    return _path_text(paths.all_paths(_sparse(space), _ids(space, 2), _ids(space, 32, 42), 4, no_loop=True))


_say("t16_find_path_statement", 'FIND SHORTEST PATH FROM 2 TO 0, 10, 20, 30, 40 OVER in_nation, in_region UPTO 3 STEPS YIELD path AS p | YIELD length($-.p) AS n, id(endNode($-.p)) AS last', "SELECT CAST(2 AS BIGINT) AS n, CAST(n_regionkey AS BIGINT)*10 AS last FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 0")


_SUB = f"{SPARSE}, l0 AS (SELECT 2 AS v), l1 AS (SELECT DISTINCT d AS v FROM e WHERE s IN (SELECT v FROM l0) EXCEPT SELECT v FROM l0), l2 AS (SELECT DISTINCT d AS v FROM e WHERE s IN (SELECT v FROM l1) EXCEPT SELECT v FROM l0 EXCEPT SELECT v FROM l1), seen AS (SELECT v FROM l0 UNION SELECT v FROM l1 UNION SELECT v FROM l2)"


@_call("t17_subgraph_edges", f"WITH {_SUB} SELECT CAST(0 AS INTEGER) AS step, s, d, r FROM e WHERE s IN (SELECT v FROM l0) UNION ALL SELECT 1, s, d, r FROM e WHERE s IN (SELECT v FROM l1) UNION ALL SELECT 2, s, d, r FROM e WHERE s IN (SELECT v FROM l2) AND d IN (SELECT v FROM seen)")
def _subgraph_edges(space):
    return subgraph.subgraph(_sparse(space), _ids(space, 2), 2)[1].select(F.col("_step").alias("step"), F.col("_from").alias("s"), F.col("_to").alias("d"), F.col("_rank").alias("r"))


@_call("t17_subgraph_vertices", f"WITH {_SUB} SELECT CAST(0 AS INTEGER) AS step, CAST(v AS BIGINT) AS v FROM l0 UNION ALL SELECT 1, v FROM l1 UNION ALL SELECT 2, v FROM l2")
def _subgraph_vertices(space):
    return subgraph.subgraph(_sparse(space), _ids(space, 2), 2)[0].select(F.col("_step").alias("step"), F.col("_vid").alias("v"))


_BOTH = f"{SPARSE}, b AS (SELECT s AS f, d AS t, s, d, r FROM e UNION ALL SELECT d, s, s, d, r FROM e WHERE s <> d), l0 AS (SELECT 2 AS v), l1 AS (SELECT DISTINCT t AS v FROM b WHERE f IN (SELECT v FROM l0) EXCEPT SELECT v FROM l0)"


@_call("t17_subgraph_both", f"WITH {_BOTH} SELECT DISTINCT s, d, r FROM b WHERE f IN (SELECT v FROM l0) UNION SELECT DISTINCT s, d, r FROM b WHERE f IN (SELECT v FROM l1) AND t IN (SELECT v FROM l0 UNION SELECT v FROM l1)")
def _subgraph_both(space):
    edges = subgraph.subgraph(_sparse(space, "both"), _ids(space, 2), 1, both_types=["handoff"])[1]
    return edges.select(F.col("_src").alias("s"), F.col("_dst").alias("d"), F.col("_rank").alias("r"))


_say("t19_path_build", "MATCH p = (c:customer)-[:in_nation]->(n:nation)-[:in_region]->(r:region) WHERE c.customer.acctbal > 9500 RETURN length(p) AS n, [x IN nodes(p) | id(x)][2] AS last, id(startNode(p)) AS first", "SELECT CAST(2 AS BIGINT) AS n, CAST(n_regionkey AS BIGINT)*10 AS last, c_custkey*10+2 AS first FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9500")


@_call("t20_loop_versions", f"WITH {SPARSE}, a AS (SELECT DISTINCT d FROM e WHERE s = 2), b AS (SELECT DISTINCT e.d FROM a JOIN e ON e.s = a.d) SELECT d AS _vid FROM a UNION ALL SELECT d FROM b")
def _versions(space):
    view = _sparse(space)
    return setops.union_versions([traverse.expand(view, _ids(space, 2), k) for k in (1, 2)])


# The same operators over all hand-offs, hubs included, with starts and targets taken from a table. DuckDB's recursion is too
# slow there, so these have no SQL; tests compare them with tests/brute.py.
def _segment(space: Space, segment: str) -> DataFrame:
    """Ids of all customers of a market segment."""
    return space.tag("customer").where(F.col("segment") == segment).select("_vid")


@_call("t1_expand_whole", None)
def _expand_whole(space):
    return traverse.expand(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING"), 3)


@_call("t2_expand_with_origin_whole", None)
def _expand_origin_whole(space):
    return traverse.expand(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING"), 2, origin=True)


@_call("t3_expand_all_m_to_n_whole", None)
def _expand_all_whole(space):
    return traverse.expand_all(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING"), 2, 3).select(F.col("_step").alias("step"), F.col("_from").alias("s"), F.col("_to").alias("d"), F.col("_rank").alias("r"))


@_call("t7_trails_whole", None)
def _trails_whole(space):
    rows = traverse.traverse(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING").withColumnRenamed("_vid", "a"), "a", "b", "e", 1, 2, single=False)
    return rows.select("a", "b", F.array_join(F.transform("e", lambda x: x["_rank"].cast("string")), ",").alias("ranks"))


@_call("t11_all_shortest_paths_whole", None)
def _all_shortest_whole(space):
    return _path_text(paths.shortest_paths(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING"), _segment(space, "MACHINERY")))


@_call("t13_shortest_lengths_whole", None)
def _many_whole(space):
    return paths.shortest_lengths(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING"), _segment(space, "MACHINERY"))


@_call("t14_all_paths_whole", None)
def _all_paths_whole(space):
    return _path_text(paths.all_paths(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING"), _segment(space, "MACHINERY"), 2))


@_call("t15_noloop_paths_whole", None)
def _noloop_whole(space):
    return _path_text(paths.all_paths(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING"), _segment(space, "MACHINERY"), 2, no_loop=True))


@_call("t17_subgraph_edges_whole", None)
def _subgraph_edges_whole(space):
    return subgraph.subgraph(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING"), 2)[1].select(F.col("_step").alias("step"), F.col("_from").alias("s"), F.col("_to").alias("d"), F.col("_rank").alias("r"))


@_call("t17_subgraph_vertices_whole", None)
def _subgraph_vertices_whole(space):
    return subgraph.subgraph(space.edge_view(["handoff"], props=[]), _segment(space, "BUILDING"), 2)[0].select(F.col("_step").alias("step"), F.col("_vid").alias("v"))


_say("t14_find_all_path_statement", "FIND ALL PATH FROM 2 TO 32, 42 OVER handoff WHERE handoff.value > 120 UPTO 3 STEPS YIELD path AS p | YIELD id(startNode($-.p)) AS a, id(endNode($-.p)) AS b, length($-.p) AS n", f"WITH RECURSIVE {H}, e AS (SELECT * FROM h WHERE v > 120), w AS (SELECT s AS a, d AS b, [r] AS rs, 1 AS n FROM e WHERE s = 2 UNION ALL SELECT w.a, e.d, list_append(rs, e.r), n + 1 FROM w JOIN e ON e.s = w.b WHERE n < 3 AND NOT list_contains(rs, e.r)) SELECT CAST(a AS BIGINT) AS a, b, CAST(n AS BIGINT) AS n FROM w WHERE b IN (32, 42)")
_say("t15_find_noloop_statement", "FIND NOLOOP PATH FROM 2 TO 32, 42 OVER handoff WHERE handoff.value > 120 UPTO 3 STEPS YIELD path AS p | YIELD count(*) AS n", f"WITH RECURSIVE {H}, e AS (SELECT * FROM h WHERE v > 120), w AS (SELECT s AS a, d AS b, [s, d] AS ns, 1 AS n FROM e WHERE s = 2 AND s <> d UNION ALL SELECT w.a, e.d, list_append(ns, e.d), n + 1 FROM w JOIN e ON e.s = w.b WHERE n < 3 AND NOT list_contains(ns, e.d)) SELECT count(*) AS n FROM w WHERE b IN (32, 42)")
_say("t17_subgraph_statement", "GET SUBGRAPH 2 STEPS FROM 2 OUT in_nation, in_region YIELD VERTICES AS v, EDGES AS e | YIELD size($-.v) AS v, size($-.e) AS e", "SELECT CAST(1 AS BIGINT) AS v, CAST(x AS BIGINT) AS e FROM (SELECT unnest([1, 1, 0]) AS x)")
_say("t11_match_shortest", "MATCH p = allShortestPaths((c:customer)-[:in_nation*..3]-(s:supplier)) WHERE id(c) IN [2, 12] AND s.supplier.acctbal > 5000 RETURN id(c) AS c, id(s) AS s, length(p) AS n", "SELECT c_custkey*10+2 AS c, s_suppkey*10+3 AS s, CAST(2 AS BIGINT) AS n FROM customer JOIN supplier ON s_nationkey = c_nationkey WHERE c_custkey IN (0, 1) AND s_acctbal > 5000")
_say("e1_multi_tag_vertices", "FETCH PROP ON * 2, 3, 4 YIELD id(vertex) AS id, tags(vertex)[0] AS tag, size(keys(vertex)) AS k", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), 'customer', CAST(3 AS BIGINT)), (3, 'supplier', 2), (4, 'part', 5)) AS t(id, tag, k)")
_say("e13_index_aggregate", "LOOKUP ON part WHERE part.size > 25 YIELD part.type AS t, part.price AS p | GROUP BY $-.t YIELD $-.t AS t, count(*) AS n, max($-.p) AS m | ORDER BY $-.n DESC, $-.t | LIMIT 3", "SELECT p_type AS t, count(*) AS n, max(p_retailprice) AS m FROM part WHERE p_size > 25 GROUP BY 1 ORDER BY n DESC, t LIMIT 3")

# -- projection, predicates, expressions (P) ------------------------------------------------------------
_say("p1_project", "LOOKUP ON part YIELD id(vertex) AS id, part.size * 2 + 1 AS a, part.size / 7 AS b, part.size % 7 AS c, part.price / 7 AS d, -part.size AS e", "SELECT p_partkey*10+4 AS id, CAST(p_size*2+1 AS BIGINT) AS a, CAST(p_size // 7 AS BIGINT) AS b, CAST(p_size % 7 AS BIGINT) AS c, p_retailprice / 7 AS d, CAST(-p_size AS BIGINT) AS e FROM part")
_say("p2_filter", 'LOOKUP ON customer WHERE customer.segment STARTS WITH "M" AND NOT customer.acctbal < 5000 OR customer.name ENDS WITH "7" YIELD id(vertex) AS id', "SELECT c_custkey*10+2 AS id FROM customer WHERE (starts_with(c_mktsegment, 'M') AND NOT c_acctbal < 5000) OR ends_with(c_name, '7')")
_say("p3_dedup", "LOOKUP ON part YIELD DISTINCT part.brand AS brand, part.type AS type", "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
_say("p4_unwind", "UNWIND [3, 1, 2, 3] AS x WITH x WHERE x > 1 RETURN x, x * x AS y", "SELECT CAST(x AS BIGINT) AS x, CAST(x*x AS BIGINT) AS y FROM (SELECT unnest([3,1,2,3]) AS x) WHERE x > 1")
_say("p5_assign", "$a = GO FROM 2, 12 OVER placed YIELD dst(edge) AS o; GO FROM $a.o OVER holds YIELD $a.o AS o, holds._dst AS p, holds.quantity AS q", f"WITH {PLACED}, {LINES} SELECT li.o AS o, p, q FROM placed JOIN li ON li.o = placed.d WHERE s IN (2, 12)")
_say("p7_pattern_semi", "MATCH (c:customer) WHERE (c)-[:placed]->() AND c.customer.acctbal > 5000 RETURN id(c) AS id", "SELECT c_custkey*10+2 AS id FROM customer WHERE c_acctbal > 5000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_say("p7_pattern_anti", "MATCH (c:customer) WHERE NOT (c)-[:handoff]->() RETURN id(c) AS id, c.customer.name AS name", f"WITH {H} SELECT c_custkey*10+2 AS id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM h WHERE s = c_custkey*10+2)")
_say("p9_rollup", "MATCH (n:nation) RETURN n.nation.name AS name, size((n)<-[:in_nation]-()) AS n", "SELECT n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation")
_say(
    "px_case_and_predicates",
    'LOOKUP ON part YIELD id(vertex) AS id, CASE WHEN part.size < 10 THEN "small" WHEN part.size < 30 THEN "middle" ELSE "large" END AS c, CASE part.type WHEN "ECONOMY" THEN 1 ELSE 0 END AS e, part.size IN [1, 2, 3] AS i, part.size > 20 XOR part.price > 1000.0 AS x, part.name CONTAINS "red" AS r, part.name =~ "red .*" AS m, part.brand IS NULL AS n',
    "SELECT p_partkey*10+4 AS id, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS c, CAST(CASE p_type WHEN 'ECONOMY' THEN 1 ELSE 0 END AS BIGINT) AS e, p_size IN (1,2,3) AS i, (p_size > 20) <> (p_retailprice > 1000) AS x, contains(p_name, 'red') AS r, regexp_full_match(p_name, 'red .*') AS m, p_brand IS NULL AS n FROM part",
)
_say(
    "px_lists",
    "LOOKUP ON part YIELD id(vertex) AS id, size([x IN range(1, part.size) WHERE x % 3 == 0]) AS n, reduce(s = 0, x IN range(1, part.size) | s + x) AS t, any(x IN [1, 5, 9] WHERE x == part.size) AS a, all(x IN [1, 5, 9] WHERE x < part.size) AS b, single(x IN [1, 5, 9] WHERE x > part.size) AS c, [10, 20, 30][-1] AS d, head(tail([part.size, 7])) AS e",
    "SELECT p_partkey*10+4 AS id, CAST(p_size // 3 AS BIGINT) AS n, CAST(p_size * (p_size + 1) // 2 AS BIGINT) AS t, p_size IN (1,5,9) AS a, p_size > 9 AS b, p_size BETWEEN 5 AND 8 AS c, CAST(30 AS BIGINT) AS d, CAST(7 AS BIGINT) AS e FROM part",
)

# -- joins (J) -------------------------------------------------------------------------------------------
_say("j2_shared_alias_join", "MATCH (c:customer)-[:in_nation]->(n:nation), (s:supplier)-[:in_nation]->(n) WHERE c.customer.acctbal > 9000 AND s.supplier.acctbal > 5000 RETURN id(c) AS c, id(s) AS s, n.nation.name AS n", "SELECT c_custkey*10+2 AS c, s_suppkey*10+3 AS s, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 5000")
_say("j3_optional_match", "MATCH (c:customer) WHERE c.customer.acctbal > 8000 OPTIONAL MATCH (c)-[e:placed]->(o) RETURN id(c) AS c, id(o) AS o, e.total AS total", "SELECT c_custkey*10+2 AS c, o_orderkey*10+5 AS o, o_totalprice AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 8000")
_say("j4_product", "MATCH (r:region), (n:nation) WHERE n.nation.name > r.region.name RETURN id(r) AS r, id(n) AS n", "SELECT CAST(r_regionkey AS BIGINT)*10 AS r, CAST(n_nationkey AS BIGINT)*10+1 AS n FROM region, nation WHERE n_name > r_name")
_say("j5_yield_join", "$a = LOOKUP ON nation YIELD id(vertex) AS id, nation.name AS name; $b = GO FROM 2, 12, 22, 32 OVER in_nation YIELD src(edge) AS c, dst(edge) AS n; YIELD $b.c AS c, $a.name AS name FROM $a INNER JOIN $b ON $a.id == $b.n", "SELECT c_custkey*10+2 AS c, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey < 4")
_say("j7_go_joins_input", "LOOKUP ON customer WHERE customer.acctbal > 9800 YIELD id(vertex) AS id, customer.name AS name | GO FROM $-.id OVER placed YIELD $-.name AS name, placed.total AS total", "SELECT c_name AS name, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9800")


@_call("j1_null_safe_join", "WITH a AS (SELECT CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS k, count(*) AS n FROM part GROUP BY 1), b AS (SELECT CASE WHEN p_size > 30 THEN NULL ELSE p_size END AS k, count(*) AS m FROM part GROUP BY 1) SELECT CAST(a.k AS BIGINT) AS k, n, m FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _null_join(space):
    p = space.tag("part")
    a = p.groupBy(F.when(F.col("size") <= 40, F.col("size")).alias("k")).agg(F.count("*").alias("n"))
    b = p.groupBy(F.when(F.col("size") <= 30, F.col("size")).alias("k")).agg(F.count("*").alias("m"))
    return joins.join(a, b, [("k", "k")])


@_call("j6_semi_anti", "SELECT 'with' AS side, count(*) AS n FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) UNION ALL SELECT 'without', count(*) FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def _semi_anti(space):
    s, e = space.tag("supplier"), space.edge("supplied_by").where("quantity > 49").select(F.col("_dst").alias("_vid"))
    one = [joins.pattern_apply(s, e, neg).agg(F.count("*").alias("n")).select(F.lit(w).alias("side"), "n") for w, neg in (("with", False), ("without", True))]
    return one[0].union(one[1])


# -- aggregation (A) -------------------------------------------------------------------------------------
_say(
    "a1_group_by",
    "LOOKUP ON holds YIELD holds.flag AS f, holds.quantity AS q, holds.price AS p | GROUP BY $-.f YIELD $-.f AS flag, count(*) AS n, sum($-.q) AS q, avg($-.p) AS a, max($-.p) AS most, min($-.p) AS least, std($-.q) AS sd | YIELD $-.flag AS flag, $-.n AS n, $-.q AS q, round($-.a, 4) AS a, $-.most AS most, $-.least AS least, round($-.sd, 4) AS sd",
    f"WITH {LINES} SELECT flag, count(*) AS n, sum(q) AS q, round(avg(price), 4) AS a, max(price) AS most, min(price) AS least, round(stddev_pop(q), 4) AS sd FROM li GROUP BY 1",
)
_say("a2_global", "LOOKUP ON part WHERE part.size > 1000 YIELD part.size AS s | YIELD count(*) AS n, sum($-.s) AS t, max($-.s) AS m, size(collect($-.s)) AS k", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS m, CAST(0 AS BIGINT) AS k")
_say("a4_implicit_grouping", "MATCH (c:customer)-[e:placed]->() RETURN c.customer.segment AS segment, count(*) AS n, round(sum(e.total), 2) AS total, count(DISTINCT id(c)) AS people", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT c_custkey) AS people FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_say("a5_distinct", "LOOKUP ON part YIELD part.brand AS b, part.size AS s, part.type AS t | GROUP BY $-.b YIELD $-.b AS b, count(DISTINCT $-.t) AS t, sum(DISTINCT $-.s) AS s, size(collect_set($-.s)) AS k", "SELECT p_brand AS b, count(DISTINCT p_type) AS t, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, count(DISTINCT p_size) AS k FROM part GROUP BY 1")
_say("a11_bits", "LOOKUP ON part YIELD part.brand AS b, part.size AS s | GROUP BY $-.b YIELD $-.b AS b, bit_and($-.s) AS a, bit_or($-.s) AS o, bit_xor($-.s) AS x", "SELECT p_brand AS b, CAST(bit_and(p_size) AS BIGINT) AS a, CAST(bit_or(p_size) AS BIGINT) AS o, CAST(bit_xor(p_size) AS BIGINT) AS x FROM part GROUP BY 1")
_say("a16_filter_after_group", "LOOKUP ON part YIELD part.brand AS b | GROUP BY $-.b YIELD $-.b AS b, count(*) AS n | YIELD $-.b AS b, $-.n AS n WHERE $-.n > 8", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 8")

# -- order, limits, samples (L), sets (U) ------------------------------------------------------------------
_say("l1_sort", "LOOKUP ON supplier YIELD supplier.name AS name, supplier.acctbal AS bal | ORDER BY $-.bal DESC, $-.name", "SELECT s_name AS name, s_acctbal AS bal FROM supplier")
_say("l2_limit", "LOOKUP ON customer YIELD customer.name AS name | ORDER BY $-.name | LIMIT 3, 7", "SELECT c_name AS name FROM customer ORDER BY 1 LIMIT 7 OFFSET 3")
_say("l3_top_n", "MATCH (c:customer)-[e:placed]->() RETURN c.customer.name AS name, e.total AS total ORDER BY total DESC, name LIMIT 12", "SELECT c_name AS name, o_totalprice AS total FROM customer JOIN orders ON o_custkey = c_custkey ORDER BY total DESC, name LIMIT 12")
_say("l4_sample", "LOOKUP ON customer YIELD id(vertex) AS id | SAMPLE 10", None)
_say("l5_skip_limit", "MATCH (p:part) WITH p.part.brand AS b, count(*) AS n ORDER BY b SKIP 2 LIMIT 3 RETURN b, n", "SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 3 OFFSET 2")
_A, _B = "LOOKUP ON part WHERE part.size < 12 YIELD part.brand AS b", "LOOKUP ON part WHERE part.size > 45 YIELD part.brand AS b"
_SA, _SB = "SELECT p_brand AS b FROM part WHERE p_size < 12", "SELECT p_brand AS b FROM part WHERE p_size > 45"
_say("u1_union_all", f"{_A} UNION ALL {_B}", f"{_SA} UNION ALL {_SB}")
_say("u2_union", f"{_A} UNION {_B}", f"{_SA} UNION {_SB}")
_say("u3_intersect_keeps_duplicates", f"{_A} INTERSECT {_B}", f"SELECT * FROM ({_SA}) WHERE b IN ({_SB})")
_C, _SC = "LOOKUP ON part WHERE part.brand < \"Brand#3\" YIELD part.brand AS b", "SELECT p_brand FROM part WHERE p_brand < 'Brand#3'"
_say("u4_minus_keeps_duplicates", f"{_A} MINUS {_C}", f"SELECT * FROM ({_SA}) WHERE b NOT IN ({_SC})")
_say("u6_match_sets", "MATCH (c:customer) WHERE c.customer.acctbal > 9000 RETURN c.customer.segment AS s UNION MATCH (c:customer) WHERE c.customer.acctbal < 0 RETURN c.customer.segment AS s", "SELECT c_mktsegment AS s FROM customer WHERE c_acctbal > 9000 UNION SELECT c_mktsegment FROM customer WHERE c_acctbal < 0")

# -- functions (F) ------------------------------------------------------------------------------------------
_say(
    "f_numbers",
    'LOOKUP ON part YIELD id(vertex) AS id, abs(part.size - 25) AS a, floor(part.price) AS b, ceil(part.price) AS c, round(part.price, 1) AS d, round(part.price, 0, "down") AS e, round(sqrt(part.price), 6) AS f, round(log(part.price), 6) AS g, round(log10(part.price), 6) AS h, sign(part.size - 25) AS i, pow(part.size, 2) AS j, bit_and(part.size, 6) AS k, bit_xor(part.size, 5) AS l, round(cbrt(part.price), 6) AS m, round(hypot(part.size, 3), 6) AS n, exp2(3) AS o, round(radians(part.size), 6) AS p, round(sin(part.size), 6) AS q',
    "SELECT p_partkey*10+4 AS id, CAST(abs(p_size-25) AS BIGINT) AS a, floor(p_retailprice) AS b, ceil(p_retailprice) AS c, round(CAST(p_retailprice AS DECIMAL(20,6)), 1)::DOUBLE AS d, floor(p_retailprice) AS e, round(sqrt(p_retailprice), 6) AS f, round(ln(p_retailprice), 6) AS g, round(log10(p_retailprice), 6) AS h, CAST(sign(p_size-25) AS BIGINT) AS i, CAST(p_size*p_size AS BIGINT) AS j, CAST(p_size & 6 AS BIGINT) AS k, CAST(xor(p_size, 5) AS BIGINT) AS l, round(cbrt(p_retailprice), 6) AS m, round(sqrt(p_size*p_size+9), 6) AS n, CAST(8 AS DOUBLE) AS o, round(radians(p_size), 6) AS p, round(sin(p_size), 6) AS q FROM part",
)
_say(
    "f_strings",
    'LOOKUP ON part YIELD id(vertex) AS id, upper(part.name) AS a, length(part.name) AS b, left(part.name, 3) AS c, right(part.name, 3) AS d, substr(part.name, 2, 4) AS e, replace(part.name, "e", "_") AS f, reverse(part.name) AS g, lpad(part.brand, 10, "*") AS h, rpad(part.brand, 4, "*") AS i, split(part.name, " ")[0] AS j, concat(part.name, "-", part.size) AS k, concat_ws("/", part.brand, part.type) AS l, trim("  x ") AS m, strcasecmp(part.type, "economy") == 0 AS n, md5(part.name) AS o, toString(part.size) AS p, toInteger("1.5") AS q, toFloat("2.25") AS r, toBoolean("TRUE") AS s, size(extract(part.name, "[aeiou]")) AS t',
    "SELECT p_partkey*10+4 AS id, upper(p_name) AS a, CAST(strlen(p_name) AS BIGINT) AS b, left(p_name, 3) AS c, right(p_name, 3) AS d, substr(p_name, 3, 4) AS e, replace(p_name, 'e', '_') AS f, reverse(p_name) AS g, lpad(p_brand, 10, '*') AS h, rpad(p_brand, 4, '*') AS i, split_part(p_name, ' ', 1) AS j, concat(p_name, '-', p_size) AS k, concat_ws('/', p_brand, p_type) AS l, 'x' AS m, lower(p_type) = 'economy' AS n, md5(p_name) AS o, CAST(p_size AS VARCHAR) AS p, CAST(1 AS BIGINT) AS q, CAST(2.25 AS DOUBLE) AS r, TRUE AS s, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS t FROM part",
)
_say(
    "f_times",
    'LOOKUP ON ord YIELD id(vertex) AS id, ord.odate.year AS y, ord.odate.month AS m, ord.odate.day AS d, toString(date("2020-02-28") + duration({days: 2})) AS n, timestamp("2001-09-09T01:46:40") AS t, toString(date({year: 2021, month: 3})) AS x',
    "SELECT o_orderkey*10+5 AS id, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, '2020-03-01' AS n, CAST(1000000000 AS BIGINT) AS t, '2021-03-01' AS x FROM orders",
)
_say("f_graph_values", "MATCH (c:customer)-[e:placed]->(o:ord) WHERE e.total > 480000 RETURN type(e) AS t, rank(e) AS r, src(e) == id(c) AS s, none_direct_dst(e) == id(o) AS d, size(keys(c)) AS k, tags(o)[0] AS g, properties(e).total AS total", "SELECT 'placed' AS t, CAST(0 AS BIGINT) AS r, TRUE AS s, TRUE AS d, CAST(3 AS BIGINT) AS k, 'ord' AS g, CAST(o_totalprice AS VARCHAR) AS total FROM orders WHERE o_totalprice > 480000")


_say(
    "f_lists",
    "LOOKUP ON part YIELD id(vertex) AS id, size(toSet([part.size, part.size, 1])) AS a, last(range(1, part.size)) AS b, size(replace([1, 2, 2], 2, part.size)) AS c, size(erase([1, 2, part.size], 2)) AS d, size(setAdd(toSet([1]), part.size)) AS e, size(split(part.name, ' ')) AS f, size(keys({a: 1, b: 2})) AS g, reverse([1, part.size])[0] AS h, coalesce(NULL, part.size) AS i, size([1, 2] + part.size) AS j, part.size IN range(1, 10) AS k",
    "SELECT p_partkey*10+4 AS id, CAST(CASE WHEN p_size = 1 THEN 1 ELSE 2 END AS BIGINT) AS a, CAST(p_size AS BIGINT) AS b, CAST(3 AS BIGINT) AS c, CAST(CASE WHEN p_size = 2 THEN 1 ELSE 2 END AS BIGINT) AS d, CAST(CASE WHEN p_size = 1 THEN 1 ELSE 2 END AS BIGINT) AS e, CAST(len(string_split(p_name, ' ')) AS BIGINT) AS f, CAST(2 AS BIGINT) AS g, CAST(p_size AS BIGINT) AS h, CAST(p_size AS BIGINT) AS i, CAST(3 AS BIGINT) AS j, p_size BETWEEN 1 AND 10 AS k FROM part",
)
_say("m4_upsert_edge", "UPSERT EDGE ON placed 2 -> 99999995 SET total = 5.5; UPDATE EDGE ON placed 2 -> 99999995 SET total = total * 2 WHEN total > 5; GO FROM 2 OVER placed YIELD dst(edge) AS d, placed.total AS total", f"WITH {PLACED} SELECT d, total FROM placed WHERE s = 2 UNION ALL SELECT 99999995, 11.0")
_say("d_index_statements", "CREATE TAG INDEX by_size ON part(size); CREATE EDGE INDEX by_total ON placed(total); DROP EDGE INDEX by_total; SHOW TAG INDEXES", "SELECT 'by_size' AS \"Index Name\", 'part' AS \"By\", 'size' AS \"Columns\"")
_say("d_use_space", "CREATE SPACE other AS trade; USE other; CREATE TAG extra(x int); INSERT VERTEX extra(x) VALUES 1: (5); LOOKUP ON extra YIELD extra.x AS x UNION ALL LOOKUP ON region YIELD id(vertex) AS x", "SELECT CAST(5 AS BIGINT) AS x")


@_tables("f_cosine", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS cosine FROM embeddings, q")
def _cosine(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine_of_arrays(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@_tables("f_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _json(spark, d):
    from pathloom.functions.scalar import call
    from pathloom.values import Typed

    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", call("json_extract", [Typed(F.col("props"), "string")]).col["k"].cast("long").alias("k"))


@_call("f_udf_standard_deviation", f"WITH {PLACED} SELECT s AS _from, round(stddev_pop(total), 4) AS sd FROM placed GROUP BY 1")
def _udf(space):
    g = space.edge_view(["placed"], props=["total"]).groupBy("_from").agg(F.collect_list("total").alias("x"))
    return g.select("_from", F.round(standard_deviation([V.Typed(F.col("x"), "list", "float")]).col, 4).alias("sd"))


@_tables("f_geo_point_distance", "SELECT c_custkey, round(2 * 6371010.0 * asin(least(1.0, sqrt(pow(sin(radians((c_custkey % 90) - 10) / 2), 2) + cos(radians(c_custkey % 90)) * cos(radians(10)) * pow(sin(radians((c_custkey % 180) - 20) / 2), 2)))), 2) AS d FROM customer")
def _geo(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    p = F.concat(F.lit("POINT("), (F.col("c_custkey") % 180).cast("string"), F.lit(" "), (F.col("c_custkey") % 90).cast("string"), F.lit(")"))
    return c.select("c_custkey", F.round(point_distance(p, F.lit("POINT(20 10)")), 2).alias("d"))


_say("f_geo_shapes", 'RETURN ST_Covers(ST_GeogFromText("POLYGON((0 0,10 0,10 10,0 10,0 0))"), ST_Point(5, 5)) AS c, ST_Intersects("LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)") AS i, round(ST_Distance(ST_Point(0, 0), ST_Point(1, 0)), 1) AS d, ST_DWithin("POINT(0 0)", "POINT(1 0)", 111196.0) AS w, S2_CellIdFromPoint(ST_Point(0, 0)) AS s, ST_IsValid("POINT(200 0)") AS v', "SELECT TRUE AS c, TRUE AS i, CAST(111195.1 AS DOUBLE) AS d, TRUE AS w, CAST(1152921504606846977 AS BIGINT) AS s, FALSE AS v")

# -- mutation (M), catalog, plans --------------------------------------------------------------------------
_say("m1_insert_vertex", 'INSERT VERTEX region(name) VALUES 0: ("ZERO"), 990: ("NEW"); INSERT VERTEX IF NOT EXISTS region(name) VALUES 10: ("KEPT"); LOOKUP ON region YIELD id(vertex) AS id, region.name AS name', "SELECT CAST(r_regionkey AS BIGINT)*10 AS id, CASE WHEN r_regionkey = 0 THEN 'ZERO' ELSE r_name END AS name FROM region UNION ALL SELECT 990, 'NEW'")
_say("m2_insert_edge", "INSERT EDGE placed(total) VALUES 2 -> 5: (1.5), 2 -> 5@7: (2.5); GO FROM 2 OVER placed YIELD dst(edge) AS d, rank(edge) AS r, placed.total AS total", f"WITH {PLACED} SELECT d, CAST(0 AS BIGINT) AS r, total FROM placed WHERE s = 2 AND d <> 5 UNION ALL SELECT 5, 0, 1.5 UNION ALL SELECT 5, 7, 2.5")
_say("m3_update_vertex", 'UPDATE VERTEX ON customer 2 SET acctbal = acctbal + 10 WHEN acctbal > -100000; UPSERT VERTEX ON customer 72 SET segment = "NEW"; FETCH PROP ON customer 2, 72 YIELD id(vertex) AS id, customer.acctbal AS bal, customer.segment AS segment', "SELECT c_custkey*10+2 AS id, CASE WHEN c_custkey = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS bal, CASE WHEN c_custkey = 7 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey IN (0, 7)")
_say("m5_delete_vertex_with_edges", "DELETE VERTEX 2 WITH EDGE; MATCH (c:customer)-[e:placed]->() RETURN count(*) AS n, count(DISTINCT id(c)) AS c", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders WHERE o_custkey <> 0")
_say("m6_delete_tag", "DELETE TAG nation FROM 1, 11; LOOKUP ON nation YIELD id(vertex) AS id", "SELECT CAST(n_nationkey AS BIGINT)*10+1 AS id FROM nation WHERE n_nationkey NOT IN (0, 1)")
_say("m7_delete_edge", "DELETE EDGE in_region 1 -> 0, 11 -> 10; LOOKUP ON in_region YIELD src(edge) AS s, dst(edge) AS d", "SELECT CAST(n_nationkey AS BIGINT)*10+1 AS s, CAST(n_regionkey AS BIGINT)*10 AS d FROM nation WHERE NOT (n_nationkey = 0 AND n_regionkey = 0) AND NOT (n_nationkey = 1 AND n_regionkey = 1)")
_say("m8_ttl", 'UPDATE VERTEX ON part 4 SET size = 99999999999; ALTER TAG part TTL_COL = "size", TTL_DURATION = 100; LOOKUP ON part YIELD id(vertex) AS id', "SELECT p_partkey*10+4 AS id FROM part WHERE p_partkey = 0")
_say("d_show_stats", "SUBMIT JOB STATS", "SELECT 'Tag' AS \"Type\", * FROM (SELECT 'region' AS \"Name\", count(*) AS \"Count\" FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'ord', count(*) FROM orders) UNION ALL SELECT 'Edge', * FROM (SELECT 'in_region', count(*) FROM nation UNION ALL SELECT 'in_nation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'placed', count(*) FROM orders UNION ALL SELECT 'holds', count(*) FROM lineitem UNION ALL SELECT 'supplied_by', count(*) FROM lineitem UNION ALL SELECT 'handoff', count(*) - 1 FROM events) UNION ALL SELECT 'Space', 'vertices', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) UNION ALL SELECT 'Space', 'edges', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events) - 1")
_say("d_create_and_describe", "CREATE TAG IF NOT EXISTS note(body string NOT NULL DEFAULT \"-\", stars int64) ; DESCRIBE TAG note", "SELECT 'body' AS \"Field\", 'string' AS \"Type\", 'NO' AS \"Null\", '-' AS \"Default\", NULL::VARCHAR AS \"Comment\" UNION ALL SELECT 'stars', 'int64', 'YES', NULL, NULL")
_say("d_show_tags", "SHOW TAGS", "SELECT unnest(['customer','nation','ord','part','region','supplier']) AS \"Name\"")
_say("x_explain", "EXPLAIN LOOKUP ON part WHERE part.size > 10 YIELD id(vertex) AS id", None)


@_call("c_dump", "SELECT 'vertex' AS kind, 'region' AS name, CAST(r_regionkey*10 AS VARCHAR) AS key FROM region UNION ALL SELECT 'edge', 'in_region', concat(n_nationkey*10+1, ',', n_regionkey*10, ',0') FROM nation")
def _dump(space):
    return dump(Space(space.spark, "small", "int64", {"region": space.tags["region"]}, {"in_region": space.edges["in_region"]})).select("kind", "name", "key")


@_call("l3_top_n_api", "SELECT p_name AS name, p_retailprice AS price, p_partkey*10+4 AS _vid FROM part ORDER BY price DESC, _vid LIMIT 5 OFFSET 2")
def _top(space):
    return relational.top_n(space.tag("part").select("name", "price", "_vid"), [("price", True), ("_vid", False)], 5, 2)


# -- more functions, expressions and catalog statements ------------------------------------------------------
_say("t10_dangling_edges", "INSERT EDGE placed(total) VALUES 2 -> 88888885: (7.5); MATCH (c:customer)-[e:placed]->(o) WHERE id(c) == 2 RETURN id(o) AS o, e.total AS total", f"WITH {PLACED} SELECT d AS o, total FROM placed WHERE s = 2")
_say("t10_dangling_edges_of_go", "INSERT EDGE placed(total) VALUES 2 -> 88888885: (7.5); GO FROM 2 OVER placed YIELD dst(edge) AS o", f"WITH {PLACED} SELECT d AS o FROM placed WHERE s = 2 UNION ALL SELECT 88888885")
_say("e9_typed_properties", "MATCH (p:part) WHERE properties(p).size > 40 RETURN id(p) AS id, properties(p).size + 1 AS n, properties(p).price / 2 AS half, properties(p).brand AS b", "SELECT p_partkey*10+4 AS id, CAST(p_size + 1 AS BIGINT) AS n, p_retailprice / 2 AS half, p_brand AS b FROM part WHERE p_size > 40")
_say("t7_open_end", 'MATCH (n:nation)-[e:in_region*]->(r) RETURN id(n) AS n, id(r) AS r, size(e) AS k', "SELECT CAST(n_nationkey AS BIGINT)*10+1 AS n, CAST(n_regionkey AS BIGINT)*10 AS r, CAST(1 AS BIGINT) AS k FROM nation")
_CHAIN = "CREATE SPACE line(vid_type = int64); USE line; CREATE TAG dot(n int); CREATE EDGE next(); INSERT VERTEX dot(n) VALUES " + ", ".join(f"{k}: ({k})" for k in range(13)) + "; INSERT EDGE next() VALUES " + ", ".join(f"{k} -> {k + 1}: ()" for k in range(12)) + "; "
_say("t7_twelve_hops", _CHAIN + "MATCH (a:dot)-[e:next*]->(b:dot) WHERE id(a) == 0 RETURN id(b) AS b, size(e) AS n", "SELECT CAST(x AS BIGINT) AS b, CAST(x AS BIGINT) AS n FROM (SELECT unnest(range(1, 13)) AS x)")
_say(
    "f_more_numbers",
    "LOOKUP ON part YIELD id(vertex) AS id, round(exp(part.size / 50.0), 6) AS a, round(log2(part.size), 6) AS b, round(asin(part.size / 100.0), 6) AS c, round(cos(part.size), 6) AS d, round(acos(part.size / 100.0), 6) AS e, round(tan(part.size), 6) AS f, round(atan(part.size), 6) AS g, round(e(), 6) AS h, round(pi(), 6) AS i",
    "SELECT p_partkey*10+4 AS id, round(exp(p_size / 50.0), 6) AS a, round(log2(p_size), 6) AS b, round(asin(p_size / 100.0), 6) AS c, round(cos(p_size), 6) AS d, round(acos(p_size / 100.0), 6) AS e, round(tan(p_size), 6) AS f, round(atan(p_size), 6) AS g, round(exp(1), 6) AS h, round(pi(), 6) AS i FROM part",
)
_say(
    "f_random_and_clock",
    "LOOKUP ON part YIELD id(vertex) AS id, rand() >= 0.0 AND rand() < 1.0 AS a, rand32(5, 9) >= 5 AND rand32(5, 9) < 9 AS b, rand64(100) < 100 AS c, now() > 1600000000 AS d, now() - timestamp() < 5 AS e, size(uuid()) AS f",
    "SELECT p_partkey*10+4 AS id, true AS a, true AS b, true AS c, true AS d, true AS e, CAST(36 AS BIGINT) AS f FROM part",
)
_say(
    "f_more_strings",
    'LOOKUP ON part YIELD id(vertex) AS id, lower(part.brand) AS a, ltrim("  x ") AS b, rtrim("  x ") AS c, hash(part.name) == hash(part.name) AS d, hash(part.name) == hash(part.brand) AS e, udf_is_in(part.size, 1, 2, 3) AS f, round(cos_similarity(1, part.size, 2, 3), 6) AS g',
    "SELECT p_partkey*10+4 AS id, lower(p_brand) AS a, 'x ' AS b, '  x' AS c, true AS d, false AS e, p_size IN (1, 2, 3) AS f, round((2 + 3.0 * p_size) / (sqrt(1 + p_size * p_size) * sqrt(13.0)), 6) AS g FROM part",
)
_say(
    "f_more_times",
    'YIELD toString(time("10:20:30")) AS a, toString(time({hour: 1, minute: 2, second: 3})) AS b, toString(datetime("2021-02-03T04:05:06")) AS c, datetime({year: 2020, month: 5}).month AS d, time("10:20:30").minute AS e, datetime("2021-02-03T04:05:06").second AS f',
    "SELECT '10:20:30.000000000' AS a, '01:02:03.000000000' AS b, '2021-02-03T04:05:06.000000000' AS c, CAST(5 AS BIGINT) AS d, CAST(20 AS BIGINT) AS e, CAST(6 AS BIGINT) AS f",
)
_say(
    "f_path_values",
    "MATCH p = (c:customer)-[e:in_nation]->(n:nation)-[:in_region]->(r:region) WHERE c.customer.acctbal > 9900 RETURN id(c) AS c, size(relationships(p)) AS a, hasSameEdgeInPath(p) AS b, hasSameVertexInPath(p) AS d, id(startNode(reversePath(p))) AS f, _nodeid(p, 1) AS g, type(_edge(p, 0)) AS h, is_edge(e) AS i, is_edge(c) AS j, none_direct_src(e) AS k, typeid(e) > 0 AS l, _joinkey(c) == id(c) AS m, _any(null, id(n)) AS o",
    "SELECT c_custkey*10+2 AS c, CAST(2 AS BIGINT) AS a, false AS b, false AS d, CAST(n_regionkey AS BIGINT)*10 AS f, CAST(n_nationkey AS BIGINT)*10+1 AS g, 'in_nation' AS h, true AS i, false AS j, c_custkey*10+2 AS k, true AS l, true AS m, CAST(n_nationkey AS BIGINT)*10+1 AS o FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9900",
)
_say(
    "f_more_geo",
    'YIELD ST_AsText(ST_Point(1, 2)) AS a, ST_AsText(ST_Centroid(ST_GeogFromText("POINT(3 4)"))) AS b, ST_CoveredBy(ST_Point(5, 5), ST_GeogFromText("POLYGON((0 0,10 0,10 10,0 10,0 0))")) AS c, ST_CoveredBy(ST_Point(15, 5), ST_GeogFromText("POLYGON((0 0,10 0,10 10,0 10,0 0))")) AS d, size(S2_CoveringCellIds(ST_Point(1, 1))) AS e, ST_IsValid(ST_Point(1, 1)) AS f',
    "SELECT 'POINT(1 2)' AS a, 'POINT(3 4)' AS b, true AS c, false AS d, CAST(1 AS BIGINT) AS e, true AS f",
)
_say(
    "px_null_empty_casts",
    'LOOKUP ON part YIELD id(vertex) AS id, CASE WHEN part.size > 25 THEN part.size END IS NULL AS a, CASE WHEN part.size > 25 THEN part.size END IS NOT NULL AS b, part.name IS EMPTY AS c, part.name IS NOT EMPTY AS d, (int)"17" + part.size AS e, (string)part.size AS f, (float)part.size / 2 AS g, (bool)"true" AS h',
    "SELECT p_partkey*10+4 AS id, p_size <= 25 AS a, p_size > 25 AS b, false AS c, true AS d, CAST(17 + p_size AS BIGINT) AS e, CAST(p_size AS VARCHAR) AS f, p_size / 2.0::DOUBLE AS g, true AS h FROM part",
)
_say("t16_path_with_properties", "FIND SHORTEST PATH WITH PROP FROM 2 TO 0, 10, 20, 30, 40 OVER in_nation, in_region UPTO 3 STEPS YIELD path AS p | YIELD length($-.p) AS n, properties(endNode($-.p)).name AS region, properties(nodes($-.p)[1]).name AS nation, properties(startNode($-.p)).segment AS segment", "SELECT CAST(2 AS BIGINT) AS n, r_name AS region, n_name AS nation, c_mktsegment AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey = 0")
_say("p9_rollup_list", "MATCH (n:nation) WHERE size((n)-[:in_region]->()) == 1 RETURN n.nation.name AS name, size([x IN (n)-[:in_region]->() | length(x)]) AS n, size((n)<-[:in_region]-()) AS none", "SELECT n_name AS name, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS none FROM nation")
_say("p8_pattern_without_shared_names", "MATCH (r:region) WHERE (:nation)-[:in_region]->(:region) RETURN id(r) AS id", "SELECT CAST(r_regionkey AS BIGINT)*10 AS id FROM region")
_say("a14_key_or_last", "LOOKUP ON nation YIELD nation.name AS n | GROUP BY $-.n YIELD $-.n AS n, upper($-.n) AS u, count(*) AS k", "SELECT n_name AS n, upper(n_name) AS u, count(*) AS k FROM nation GROUP BY 1")
_say("j8_join_key_of_vertices", "MATCH (c:customer)-[:in_nation]->(n) WHERE c.customer.acctbal > 9900 MATCH (n)-[:in_region]->(r) RETURN id(c) AS c, id(r) AS r", "SELECT c_custkey*10+2 AS c, CAST(n_regionkey AS BIGINT)*10 AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9900")


# samples cannot be told by SQL row by row, but their sizes, bounds and membership can
@_call("l4_sample_checked", "SELECT CAST(10 AS BIGINT) AS n, CAST(10 AS BIGINT) AS ids, CAST(10 AS BIGINT) AS known")
def _sample_checked(space):
    got = Session(space.spark, space).execute("LOOKUP ON customer YIELD id(vertex) AS id | SAMPLE 10")
    return got.join(space.tag("customer").select(F.col("_vid").alias("id"), F.lit(1).alias("k")), "id", "left").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("k").alias("known"))


@_call("e7_neighbor_sample_checked", f"WITH {PLACED} SELECT s AS _from, least(2, count(*)) AS n, least(2, count(*)) AS known FROM placed GROUP BY 1")
def _neighbor_sample_checked(space):
    got = traverse.get_neighbors(space.edge_view(["placed"], props=[]), space.tag("customer"), per_vertex_sample=2, seed=7)
    known = space.edge("placed").select(F.col("_src").alias("_from"), F.col("_dst").alias("_to"), F.lit(1).cast("long").alias("k"))
    return got.select("_from", "_to").join(known, ["_from", "_to"], "left").groupBy("_from").agg(F.count("*").alias("n"), F.sum("k").alias("known"))


@_call("t6_step_bounds_checked", "SELECT CAST(7 AS BIGINT) AS limited, CAST(7 AS BIGINT) AS sampled")
def _step_bounds(space):
    n = [Session(space.spark, space).execute(f"GO 2 STEPS FROM 2 OVER placed, holds YIELD dst(edge) AS d {w} [5, 7]").agg(F.count("*").alias(a)) for w, a in (("LIMIT", "limited"), ("SAMPLE", "sampled"))]
    return joins.cross(n[0], n[1])


_DDL = 'CREATE SPACE lab(vid_type = FIXED_STRING(16), partition_num = 3); USE lab; CREATE TAG a(x int64 NOT NULL DEFAULT 5, s string); CREATE EDGE b(w double); CREATE TAG INDEX a_x ON a(x); CREATE EDGE INDEX b_w ON b(w); CREATE FULLTEXT TAG INDEX a_s ON a(s); '


def _rows(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})" if rows else f"SELECT * FROM (SELECT {', '.join(f'NULL::VARCHAR AS {c}' for c in columns.split(', '))}) WHERE false"


_say("d_describe_edge", _DDL + 'ALTER EDGE b ADD (note string NOT NULL DEFAULT "-"); DESCRIBE EDGE b', _rows('"Field", "Type", "Null", "Default", "Comment"', "('w', 'double', 'YES', NULL::VARCHAR, NULL::VARCHAR)", "('note', 'string', 'NO', '-', NULL)"))
_say("d_show_edges", _DDL + "SHOW EDGES", _rows('"Name"', "('b')"))
_say("d_drop_edge", _DDL + "DROP EDGE INDEX b_w; DROP EDGE b; SHOW EDGES", _rows('"Name"'))
_say("d_drop_tag", _DDL + "CREATE TAG c(); DROP TAG c; SHOW TAGS", _rows('"Name"', "('a')"))
_say("d_drop_tag_index", _DDL + "DROP TAG INDEX a_x; SHOW TAG INDEXES", _rows('"Index Name", "By", "Columns"'))
_say("d_describe_tag_index", _DDL + "DESCRIBE TAG INDEX a_x", _rows('"Field", "Type"', "('x', 'int64')"))
_say("d_describe_edge_index", _DDL + "DESCRIBE EDGE INDEX b_w", _rows('"Field", "Type"', "('w', 'double')"))
_say("d_show_edge_indexes", _DDL + "SHOW EDGE INDEXES", _rows('"Index Name", "By", "Columns"', "('b_w', 'b', 'w')"))
_say("d_tag_index_status", _DDL + "SHOW TAG INDEX STATUS", _rows('"Name", "Index Status"', "('a_x', 'FINISHED')", "('a_s', 'FINISHED')"))
_say("d_edge_index_status", _DDL + "SHOW EDGE INDEX STATUS", _rows('"Name", "Index Status"', "('b_w', 'FINISHED')"))
_say("d_fulltext_indexes", _DDL + "SHOW FULLTEXT INDEXES", _rows('"Index Name", "By", "Columns"', "('a_s', 'a', 's')"))
_say("d_drop_fulltext_index", _DDL + "DROP FULLTEXT INDEX a_s; SHOW FULLTEXT INDEXES", _rows('"Index Name", "By", "Columns"'))
_say("d_show_create_tag", _DDL + "SHOW CREATE TAG a", "SELECT 'a' AS \"Tag\", concat('CREATE TAG `a` (', chr(10), ' `x` int64 NOT NULL DEFAULT 5,', chr(10), ' `s` string NULL', chr(10), ') ttl_duration = 0, ttl_col = \"\"') AS \"Create Tag\"")
_say("d_show_create_edge", _DDL + "SHOW CREATE EDGE b", "SELECT 'b' AS \"Edge\", concat('CREATE EDGE `b` (', chr(10), ' `w` double NULL', chr(10), ') ttl_duration = 0, ttl_col = \"\"') AS \"Create Edge\"")
_say("d_show_create_tag_index", _DDL + "SHOW CREATE TAG INDEX a_x", _rows('"Index", "Create Index"', "('a_x', 'CREATE TAG INDEX `a_x` ON `a` (x)')"))
_say("d_show_create_edge_index", _DDL + "SHOW CREATE EDGE INDEX b_w", _rows('"Index", "Create Index"', "('b_w', 'CREATE EDGE INDEX `b_w` ON `b` (w)')"))
_say("d_describe_space", _DDL + "DESCRIBE SPACE lab", _rows('"Name", "Vid Type", "Tags", "Edges"', "('lab', 'string', '1', '1')"))
_say("d_show_spaces", _DDL + "CREATE SPACE IF NOT EXISTS lab(vid_type = int64); CREATE SPACE other(vid_type = int64); DROP SPACE other; SHOW SPACES", _rows('"Name"', "('lab')", "('trade')"))
_say("d_alter_space", _DDL + "ALTER SPACE lab partition_num = 7; SHOW CREATE SPACE lab", _rows('"Space", "Create Space"', "('lab', 'CREATE SPACE `lab` (vid_type = FIXED_STRING(16), partition_num = 7)')"))
_say("d_clear_space", _DDL + 'INSERT VERTEX a(x, s) VALUES "v": (1, "t"); CLEAR SPACE lab; LOOKUP ON a YIELD a.x AS x', "SELECT CAST(1 AS BIGINT) AS x WHERE false")
_say("d_show_charset", "SHOW CHARSET", _rows('"Charset", "Description", "Default collation", "Maxlen"', "('utf8', 'UTF-8 Unicode', 'utf8_bin', '4')"))
_say("d_show_collation", "SHOW COLLATION", _rows('"Collation", "Charset"', "('utf8_bin', 'utf8')"))
_say("d_show_stats_of_space", _DDL + 'INSERT VERTEX a(x, s) VALUES "v": (1, "t"), "w": (2, "u"); INSERT EDGE b(w) VALUES "v" -> "w": (1.5); SHOW STATS', _rows('"Type", "Name", "Count"', "('Tag', 'a', CAST(2 AS BIGINT))", "('Edge', 'b', 1)", "('Space', 'vertices', 2)", "('Space', 'edges', 1)"))
_say("s7_es_query", _DDL + 'INSERT VERTEX a(x, s) VALUES "v": (1, "red fox"), "w": (2, "blue fox"), "y": (3, "red hen"); LOOKUP ON a WHERE ES_QUERY(a_s, "red") YIELD id(vertex) AS id, score() > 0 AS scored', _rows("id, scored", "('v', true)", "('y', true)"))
