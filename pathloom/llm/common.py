"""Shared plumbing: table access, durable lineage cuts, batch mapping, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.runtime import cut, hadoop_path, shared_dir, temporary

__all__ = ["batch", "connected_components", "crc_mod", "cut", "discard", "held", "map_batches", "shared_dir", "store", "table", "temporary"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the corpus tables through Spark's own reader (works for any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write a columnar table to the shared folder and read it back."""
    path = temporary(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pathloom_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Remove stored tables that no result reads any more."""
    for df in stored:
        fs, where = hadoop_path(df.sparkSession, df._pathloom_path)
        fs.delete(where, True)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a short name; batches are bounded by Spark's Arrow row and byte limits."""
    return df.mapInArrow(fn, schema)


def batch(columns: dict[str, list | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from columns in the order of ``schema``."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)],
        schema=schema,
    )


_HELD: tuple[Hashable, Any] = (None, None)


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a task remembers for later tasks of its Python worker: one value, that of the last key asked for.

    Workers are used again by later stages; holding one value bounds a worker to the memory of the operator it runs.
    """
    global _HELD
    if _HELD[0] != key:
        _HELD = (None, None)  # freed before the next is made
        give_back()
        _HELD = (key, make())
    return _HELD[1]


def give_back() -> None:
    """Return the memory that earlier tasks of this worker freed to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def crc_mod(column: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from every node that has an edge: rows ``(node, component)``.

    Alternating large-star and small-star contraction. Both are aggregates or joins on a node key that Spark
    pre-aggregates, so a hub never meets its neighbours in one task; every round ends in a durable checkpoint.
    Nodes without edges are not returned. An empty edge table gives an empty result.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    links = cut(links)
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u points at the least node around u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        # small star: u and its smaller neighbours point at the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        small = cut(small)
        done = small.exceptAll(links).isEmpty() and links.exceptAll(small).isEmpty()
        links = small
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = links.groupBy("u").agg(F.min("v").alias("component"))
    roots = links.select(F.col("v").alias("node")).distinct().join(pairs.select(F.col("u").alias("node")), "node", "left_anti")
    return pairs.select(F.col("u").alias("node"), "component").union(roots.select("node", F.col("node").alias("component")))
