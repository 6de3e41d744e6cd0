import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import joins, paths, relational, setops, subgraph, traverse
from pathloom.sources.space import Space
from pathloom.values import SemanticError
from tests import brute


def make(spark, seed, n=6, m=12):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(edges)], "_src long, _dst long, _rank long")
    nodes = spark.createDataFrame([(k, k * 10) for k in range(n)], "_vid long, w long")
    return edges, Space(spark, "g", "int64").with_tag("t", nodes).with_edge("e", df, rank="_rank")


def ids(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "_vid long")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_expand_all_counts_edges_of_distinct_frontiers(spark, seed):
    edges, g = make(spark, seed)
    got = traverse.expand_all(g.edge_view(), ids(spark, 0, 1), 1, 3).select("_step", "_rank").collect()
    assert sorted((r[0], r[1]) for r in got) == sorted(brute.go_steps(edges, [0, 1], 1, 3))
    assert traverse.expand(g.edge_view(), ids(spark, 0), 0).collect()[0][0] == 0


@pytest.mark.parametrize("seed,both", [(1, False), (2, True), (3, True)])
def test_trails(spark, seed, both):
    edges, g = make(spark, seed)
    view = g.edge_view(None, "both" if both else "out")
    got = traverse.traverse(view, ids(spark, 0), "_vid", "to", "es", 0, 3, single=False).collect()
    want = brute.trails(edges, 0, 0, 3, both)
    assert sorted((tuple(e["_rank"] for e in r["es"]), r["to"]) for r in got) == sorted(want)


@pytest.mark.parametrize("seed", [1, 4, 5])
def test_paths(spark, seed):
    edges, g = make(spark, seed)
    got = paths.shortest_paths(g.edge_view(), ids(spark, 0, 1), ids(spark, 3, 4), 4).collect()
    have = sorted((r["_start"], r["_end"], tuple(r["_nodes"]), tuple(e["_rank"] for e in r["_rels"])) for r in got)
    assert have == sorted(brute.shortest(edges, [0, 1], [3, 4], 4))
    every = paths.all_paths(g.edge_view(), ids(spark, 0), ids(spark, 3), 3).collect()
    assert sorted(tuple(e["_rank"] for e in r["_rels"]) for r in every) == sorted(t for t, end in brute.trails(edges, 0, 1, 3) if end == 3)
    simple = paths.all_paths(g.edge_view(), ids(spark, 0), ids(spark, 3), 3, no_loop=True).collect()
    assert sorted(tuple(r["_nodes"]) for r in simple) == sorted(tuple(r["_nodes"]) for r in every if len(set(r["_nodes"])) == len(r["_nodes"]))


def test_subgraph_covers_reached_vertices(spark):
    edges, g = make(spark, 7)
    v, e = subgraph.subgraph(g.edge_view(), ids(spark, 0), 2)
    depth = {0: 0}
    for k in (1, 2):
        for a, b in edges:
            if depth.get(a) == k - 1 and b not in depth:
                depth[b] = k
    assert {r["_vid"]: r["_step"] for r in v.collect()} == depth
    assert sorted(r["_rank"] for r in e.collect()) == sorted(n for n, (a, b) in enumerate(edges) if a in depth and b in depth)


def test_empty_inputs(spark):
    _, g = make(spark, 1)
    none = ids(spark, 0).limit(0)
    assert traverse.expand_all(g.edge_view(), none, 1, 2).count() == 0
    assert paths.shortest_paths(g.edge_view(), none, ids(spark, 1), 3).count() == 0
    assert paths.all_paths(g.edge_view(), ids(spark, 0), none, 3).count() == 0


def test_self_loop_once_in_both_directions(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "_src long, _dst long")
    g = Space(spark, "g").with_edge("e", df)
    assert g.edge_view(None, "both").where("_from = 1").count() == 2


def test_set_operations_keep_left_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (None,)], "x int")
    assert sorted(r[0] or 0 for r in setops.intersect(a, b).collect()) == [0, 1, 1]
    assert [r[0] for r in setops.minus(a, b).collect()] == [2]
    with pytest.raises(SemanticError):
        setops.union(a, b.withColumnRenamed("x", "y"))


def test_null_order_and_joins(spark):
    a = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r[0] for r in relational.sort(a, [("x", False)]).collect()] == [1, 3, None]
    assert [r[0] for r in relational.top_n(a, [("x", True)], 2).collect()] == [None, 3]
    assert joins.join(a, a.withColumnRenamed("x", "y"), [("x", "y")]).count() == 3
    lists = joins.rollup_apply(a, spark.createDataFrame([(1, "p")], "x int, v string"), "v", "vs")
    assert {r["x"]: r["vs"] for r in lists.collect()} == {1: ["p"], None: [], 3: []}
    assert joins.pattern_apply(a, spark.range(0).select(F.col("id").alias("z"))).count() == 0


def test_neighbour_limits(spark):
    _, g = make(spark, 9)
    rows = traverse.get_neighbors(g.edge_view(), ids(spark, 0, 1, 2, 3), per_vertex_limit=1)
    assert max((r["count"] for r in rows.groupBy("_from").count().collect()), default=0) <= 1


def test_listed_ids_reach_the_scan(spark, tmp_path):
    """Start ids of a statement are pushed into the files of an edge or tag table."""
    from pathloom.plans.session import Session

    spark.createDataFrame([(k, k + 1, float(k)) for k in range(50)], "_src long, _dst long, w double").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(k, k % 3) for k in range(50)], "_vid long, n long").write.parquet(str(tmp_path / "t"))
    space = Space(spark, "g", "int64").with_edge("e", spark.read.parquet(str(tmp_path / "e"))).with_tag("t", spark.read.parquet(str(tmp_path / "t")))
    s = Session(spark, space)
    for text, pushed, want in (
        ("GO FROM 3, 9 OVER e YIELD dst(edge) AS d, e.w AS w", "In(_src, [3,9])", [(4, 3.0), (10, 9.0)]), ("GO 2 STEPS FROM 3 OVER e YIELD dst(edge) AS d", "EqualTo(_src,3)", [(5,)]),
        ("FETCH PROP ON t 4, 5 YIELD t.n AS n", "In(_vid, [4,5])", [(1,), (2,)]), ("FETCH PROP ON e 7 -> 8 YIELD e.w AS w", "EqualTo(_src,7)", [(7.0,)]),
    ):
        df = s.execute(text)
        plan = df._jdf.queryExecution().toString()
        assert "PushedFilters: [" in plan and (pushed in plan or pushed.replace("EqualTo", "In").replace(",", ", [", 1).replace(")", "])") in plan), plan[-1500:]
        assert sorted(tuple(r) for r in df.collect()) == want


def test_patterns_end_at_vertices_unless_declared(spark):
    from pathloom.plans.session import Session

    v = spark.createDataFrame([(1,), (2,)], "_vid long")
    e = spark.createDataFrame([(1, 2), (1, 9), (8, 2)], "_src long, _dst long")
    space = Space(spark, "g", "int64").with_tag("t", v).with_edge("e", e)
    text = "MATCH (a)-[x:e]->(b) RETURN src(x) AS s, dst(x) AS d"
    assert sorted(map(tuple, Session(spark, space).execute(text).collect())) == [(1, 2)]
    assert len(Session(spark, space.closed()).execute(text).collect()) == 3
    assert len(Session(spark, space.closed()).execute("INSERT EDGE e() VALUES 2 -> 7: (); " + text).collect()) == 1
    with pytest.raises(SemanticError):
        Session(spark, space).execute("ALTER SPACE g vid_type = int64")


def test_a_cut_is_written_once_and_keeps_odd_types(spark):
    from pathloom.runtime import cut

    df = spark.range(5).selectExpr("id", "array(struct(id as x, map('k', id) as m)) as s")
    assert sorted(map(str, cut(df).collect())) == sorted(map(str, df.collect()))
    odd = df.selectExpr("id", "null as nothing")
    assert cut(odd).count() == 5 and cut(df.limit(0)).isEmpty()


def test_shortest_paths_write_edges_by_blocks_of_sources(spark, monkeypatch):
    # 70 sources, two full layers of 12, 10 targets: a level by source would hold 70 * 12 * 12 rows
    a, b, c, d = range(70), range(100, 112), range(200, 212), range(300, 310)
    pairs = [(x, y) for left, right in ((a, b), (b, c), (c, d)) for x in left for y in right]
    view = Space(spark, "layers", "int64").with_edge("e", spark.createDataFrame(pairs, "_src long, _dst long")).edge_view()
    written, cut = [], paths.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(paths, "cut", counted)
    found = paths.shortest_paths(view, ids(spark, *a), ids(spark, *d))
    assert found.count() == found.select("_nodes").distinct().count() == 70 * 12 * 12 * 10
    lengths = paths.shortest_lengths(view, ids(spark, *a), ids(spark, *d))
    assert sorted(tuple(r) for r in lengths.collect()) == sorted((x, y, 3) for x in a for y in d)
    assert max(written) <= 70 * 12 + 12 * 12 + 12 * 10
