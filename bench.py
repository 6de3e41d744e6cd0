"""Time the headline graph queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query is run once to warm up and then timed; its result is counted in full by Spark, nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from pathloom import queries

HEADLINE = [
    "flagship_go_parts_by_brand", "s2_scan_edges", "s6_edge_range_scan", "s8_fetch_piped", "s10_get_neighbors_limit", "e5_neighbor_stats", "t3_expand_all_m_to_n", "t4_go_two_steps_all_types", "t7_trails", "t9_traverse_filters",
    "t10_append_vertices", "t11_all_shortest_paths", "t14_all_paths", "t17_subgraph_edges", "p7_pattern_semi", "p9_rollup", "j2_shared_alias_join", "j3_optional_match", "a1_group_by", "a4_implicit_grouping", "l3_top_n", "u3_intersect_keeps_duplicates",
    "f_numbers", "f_strings", "f_cosine",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16)).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries.queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "graph queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
