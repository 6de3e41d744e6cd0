"""The folder that executors share, and durable lineage cuts for iterative operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor shares: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session in one process (tests); on a cluster that would lose rows, so
    it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_pathloom_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="pathloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._pathloom_shared = own
    return own


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path and the path itself, as the JVM knows them."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def temporary(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, where = hadoop_path(spark, path)
    fs.deleteOnExit(where)
    return path


def _storable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def cut(df: DataFrame) -> DataFrame:
    """Write a step's rows to the shared folder and go on from there.

    A lost executor loses nothing, and the plan of the next step starts small. The rows are written once, as columns that
    later steps prune and filter; a checkpoint, which computes them twice, serves the few types that have no such form.
    """
    spark = df.sparkSession
    if len(set(df.columns)) == len(df.columns) and _storable(df.schema):
        path = temporary(spark, "step")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
        fs, where = hadoop_path(spark, sc._jsc.sc().getCheckpointDir().get())
        fs.deleteOnExit(where)
    return df.checkpoint(eager=True)
