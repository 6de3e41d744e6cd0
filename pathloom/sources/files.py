"""Graph tables from and to files: CSV with headers that name keys and properties, parquet, and whole spaces."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.plans.catalog_statements import spark_type
from pathloom.sources.space import Space
from pathloom.values import SemanticError

_KEYS = {":VID": "_vid", ":SRC_VID": "_src", ":DST_VID": "_dst", ":RANK": "_rank"}


def read_csv(space: Space, path: str, null: str | None = None) -> Space:
    """Add the tag or edge table of a CSV file with a header like ``:VID(string),player.name:string,player.age:int`` or
    ``:SRC_VID(string),:DST_VID(string),:RANK,like.likeness:int``. A file may hold properties of several tags. Rows with
    the same key are one vertex or edge."""
    raw = space.spark.read.option("header", True).option("nullValue", null or "\u0000").csv(path)
    keys, props = {}, {}
    for c in raw.columns:
        head = re.match(r"(:[A-Z_]+)(?:\((\w+)\))?$", c)
        if head and head[1] in _KEYS:
            keys[_KEYS[head[1]]] = (c, "long" if (head[2] or "").startswith("int") or head[1] == ":RANK" else "string")
            continue
        m = re.match(r"(\w+)\.(\w+):([\w<>()]+)$", c)
        if not m:
            raise SemanticError(f"a column header that names nothing: {c}")
        props.setdefault(m[1], []).append((m[2], spark_type(m[3]), c))
    key_cols = [F.col(f"`{c}`").cast(t).alias(k) for k, (c, t) in keys.items()]
    for name, cols in props.items():
        df = raw.select(*key_cols, *(F.col(f"`{c}`").try_cast(t).alias(p) for p, t, c in cols)).dropDuplicates(list(keys))
        old = space.tags.get(name) if "_vid" in keys else space.edges.get(name)
        df = old.unionByName(df.select(*old.columns) if "_rank" in df.columns or "_vid" in keys else df.withColumn("_rank", F.lit(0).cast("long")).select(*old.columns)) if old is not None else df
        space = space.with_tag(name, df) if "_vid" in keys else space.with_edge(name, df)
    return space


def write_csv(df: DataFrame, path: str) -> None:
    """A result as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_space(space: Space, path: str) -> None:
    """Write a space: one parquet table for each tag and edge type, edges clustered by source, and a description."""
    for kind, tables in (("tag", space.tags), ("edge", space.edges)):
        for n, df in tables.items():
            out = df if kind == "tag" else df.repartition("_src").sortWithinPartitions("_src", "_dst", "_rank")
            out.write.mode("overwrite").parquet(f"{path}/{kind}={n}")
    facts = [(json.dumps({"name": space.name, "vid_type": space.vid_type, "tags": list(space.tags), "edges": list(space.edges), "indexes": space.indexes}),)]
    space.spark.createDataFrame(facts, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")


def load_space(spark: SparkSession, path: str) -> Space:
    """Read a written space; predicates and columns are pushed into its files."""
    facts = json.loads(spark.read.text(f"{path}/description").head()[0])
    space = Space(spark, facts["name"], facts["vid_type"], indexes=facts["indexes"])
    for n in facts["tags"]:
        space = space.with_tag(n, spark.read.parquet(f"{path}/tag={n}"))
    for n in facts["edges"]:
        space = space.with_edge(n, spark.read.parquet(f"{path}/edge={n}"), rank="_rank")
    return space


def dump(space: Space, limit: int | None = None) -> DataFrame:
    """All vertices and edges as text rows ``(kind, name, key, properties)``."""
    out = None
    for kind, tables in (("vertex", space.tags), ("edge", space.edges)):
        for n, df in tables.items():
            keys = ["_vid"] if kind == "vertex" else ["_src", "_dst", "_rank"]
            props = [c for c in df.columns if c not in keys]
            one = df.select(F.lit(kind).alias("kind"), F.lit(n).alias("name"), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)).alias("key"), F.to_json(F.struct(*props)).alias("properties") if props else F.lit("{}").alias("properties"))
            out = one if out is None else out.union(one)
    return out if limit is None or out is None else out.limit(limit)
