"""Registered queries against DuckDB on the smallest tables, where these exist."""

import math
from pathlib import Path

import pytest

from pathloom import queries
from tests import brute

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
SOME = ["flagship_go_parts_by_brand", "s2_scan_edges", "s7_fulltext_scan", "t3_expand_all_m_to_n", "t7_match_variable_length", "t9_traverse_filters", "p7_pattern_anti", "a1_group_by", "j3_optional_match", "u3_intersect_keeps_duplicates", "f_numbers", "f_strings", "m3_update_vertex", "t10_dangling_edges", "t7_twelve_hops", "t12_single_shortest_path", "t16_path_with_properties", "t17_subgraph_both", "e9_typed_properties", "u4_minus_keeps_duplicates", "f_path_values", "px_null_empty_casts", "s7_es_query", "d_alter_space", "e7_neighbor_sample_checked"]


def plain(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(float(f"{r[i]:.9g}") if isinstance(r[i], float) and not math.isnan(r[i]) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), list(want.columns))


def test_every_query_has_a_name_and_a_function():
    assert all(callable(f) for f in queries.queries().values())
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_whole_edge_table_against_brute_force(spark):
    import pyarrow.parquet as pq

    def t(name, *columns):
        return list(zip(*(pq.read_table(DATA / f"{name}.parquet", columns=[c]).column(0).to_pylist() for c in columns), strict=True))

    users = {i: u * 10 + 2 for i, u in t("events", "event_id", "user_id")}
    ranks = sorted(i for i in users if i + 1 in users)
    edges = [(users[i], users[i + 1]) for i in ranks]
    segment = {c * 10 + 2: s for c, s in t("customer", "c_custkey", "c_mktsegment")}
    have = {a for a, _ in edges}
    starts, goals = (sorted(c for c in segment if segment[c] == s) for s in ("BUILDING", "MACHINERY"))
    active, ends = [c for c in starts if c in have], [c for c in goals if c in {b for _, b in edges}]
    assert len(active) > 1 and len(ends) > 1

    def got(name):
        return sorted(tuple(r) for r in queries.queries()[name](spark, str(DATA)).collect())

    def reach(first, steps):
        here = set(first)
        for _ in range(steps):
            here = {b for a, b in edges if a in here}
        return here

    assert got("t1_expand_whole") == sorted((v,) for v in reach(starts, 3))
    assert got("t2_expand_with_origin_whole") == sorted((c, v) for c in starts for v in reach([c], 2))
    assert got("t3_expand_all_m_to_n_whole") == sorted((k, *edges[n], ranks[n]) for k, n in brute.go_steps(edges, starts, 2, 3))
    trails = {c: brute.trails(edges, c, 1, 2) for c in active}

    def text(used):
        return ",".join(str(ranks[n]) for n in used)

    assert got("t7_trails_whole") == sorted((c, b, text(used)) for c in active for used, b in trails[c])
    short = brute.shortest(edges, active, ends, 5)
    assert got("t11_all_shortest_paths_whole") == sorted((a, b, len(e), ">".join(map(str, v)), text(e)) for a, b, v, e in short)
    assert got("t13_shortest_lengths_whole") == sorted({(a, b, len(e)) for a, b, _, e in short})
    every = [(c, b, (c, *(edges[n][1] for n in used)), used) for c in active for used, b in trails[c] if b in ends]
    for name, rows in (("t14_all_paths_whole", every), ("t15_noloop_paths_whole", [x for x in every if len(set(x[2])) == len(x[2])])):
        assert got(name) == sorted((a, b, len(e), ">".join(map(str, v)), text(e)) for a, b, v, e in rows)
    depth = dict.fromkeys(starts, 0)
    for k in (1, 2):
        depth |= dict.fromkeys({b for a, b in edges if depth.get(a) == k - 1} - set(depth), k)
    assert got("t17_subgraph_vertices_whole") == sorted((k, v) for v, k in depth.items())
    assert got("t17_subgraph_edges_whole") == sorted((depth[a], a, b, r) for (a, b), r in zip(edges, ranks, strict=True) if a in depth and (depth[a] < 2 or b in depth))
