"""EXPLAIN and PROFILE: the statement's own operators and Spark's plan."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from pathloom.plans.ast import Statement

_OPERATORS = {
    "go": ["Start", "Expand", "ExpandAll", "Filter", "Project"], "lookup": ["Start", "IndexScan", "Filter", "Project"], "fetch_vertices": ["Start", "GetVertices", "Project"],
    "fetch_edges": ["Start", "GetEdges", "Project"], "find_path": ["Start", "Loop", "PathSearch", "DataCollect", "Project"], "subgraph": ["Start", "Loop", "Subgraph", "DataCollect", "Project"],
    "cypher": ["Start", "Scan", "Traverse", "AppendVertices", "Filter", "Project"], "yield": ["Start", "Project"], "group": ["Aggregate"], "order": ["Sort"], "limit": ["Limit"], "sample": ["Sample"], "unwind": ["Unwind"],
}


def operators(s: Statement) -> list[str]:
    """Names of a statement's operators, sources first."""
    if s.kind == "pipe":
        right = operators(s["right"])
        left = operators(s["left"])
        if left[-1:] == ["Sort"] and right[:1] == ["Limit"]:
            return [*left[:-1], "TopN", *right[1:]]
        return left + [x for x in right if x != "Start"]
    if s.kind == "set":
        return [*operators(s["left"]), *operators(s["right"]), {"union": "Union+Dedup", "union_all": "Union", "intersect": "Intersect", "minus": "Minus"}[s["op"]]]
    if s.kind == "assign":
        return [*operators(s["of"]), "Assign"]
    return list(_OPERATORS.get(s.kind, [s.kind]))


def describe(spark: SparkSession, s: Statement, df: DataFrame | None, style: str = "row", profile: bool = False) -> DataFrame:
    """Rows ``(id, name, detail)``: our operators, then the lines of Spark's formatted plan; PROFILE runs the statement."""
    names = operators(s)
    if style.startswith("dot"):
        text = "digraph plan {\n" + "\n".join(f'  "{n}_{k}" -> "{m}_{k + 1}";' for k, (n, m) in enumerate(zip(names, names[1:], strict=False))) + "\n}"
        return spark.createDataFrame([(0, "dot", text)], "id int, name string, detail string")
    rows = [(k, n, "") for k, n in enumerate(names)]
    if df is not None:
        if profile:
            t = time.time()
            n = df.count()
            rows.append((len(rows), "profile", f"rows {n}, seconds {time.time() - t:.3f}"))
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        rows += [(len(rows) + k, "spark", line) for k, line in enumerate(plan.splitlines()) if line.strip()]
    return spark.createDataFrame(rows, "id int, name string, detail string")
