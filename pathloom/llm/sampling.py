"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_ids(rows: DataFrame, id_col: str, label_col: str, per_class: int) -> dict:
    """Up to ``per_class`` ids of each label, those with the smallest hash: ``id -> label``.

    Labels are counted first (few distinct ones, read by the driver); of each, rows whose hash lies below a share that
    keeps about twice ``per_class`` go on to be ranked, so what meets in one task is bounded by the sample, not by the table or its partitions. (Should a share leave
    fewer than ``per_class``, the sample is that much smaller.) Rows without id or label are left out; an id that comes
    twice keeps its smallest label.
    """
    w = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    slim = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null")
    # one row a label: the shares become part of the filter, so nothing is dealt out by label before it
    counts = {r["label"]: r["n"] for r in slim.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    within = [(F.col("label") == F.lit(k)) & (place < F.lit((2.0 * per_class + 50) / n)) for k, n in sorted(counts.items())]
    some = slim.where(functools.reduce(operator.or_, within, F.lit(False)))
    top = some.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_class)
    out: dict = {}
    for r in sorted(top.select("id", "label").collect(), key=lambda r: (r["label"], r["id"]), reverse=True):
        out[r["id"]] = r["label"]
    return out


def texts_of(docs: DataFrame, ids: dict, id_col: str, text_col: str, max_chars: int) -> list[tuple]:
    """``(id, text, label)`` of the sampled ids in id order; texts over ``max_chars`` are not used for fitting."""
    if not ids:
        return []
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], f"_i {kind}"))
    slim = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    rows = slim.join(wanted, "_i", "left_semi").where(F.length("_t") <= max_chars).collect()
    found = {(r[0], r[1]): ids[r[0]] for r in rows}
    return [(i, t, found[i, t]) for i, t in sorted(found)]
