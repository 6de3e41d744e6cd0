"""Full-text search over a text column: an inverted index built by Spark, ranked by BM25."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-cased words of a text: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(term, key, tf, length)``, one row for each word of each text."""
    words = df.where(F.col(text).isNotNull()).select(key, terms(F.col(text)).alias("w"))
    return words.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def search(df: DataFrame, key: str, text: str, query: str, limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(key, score)`` of the texts that match a query: words (any of them), ``+word`` (needed), ``-word`` (excluded),
    ``word*`` (beginnings). Only words of the query are counted, so no index of the whole table is shuffled."""
    wanted, needed, barred = [], [], []
    for raw in query.split():
        sign = raw[0] if raw[0] in "+-" else ""
        word = re.sub(r"[^\w*]+", "", raw.lower(), flags=re.U)
        if word:
            (needed if sign == "+" else barred if sign == "-" else wanted).append(word)
    rows = df.where(F.col(text).isNotNull()).select(key, terms(F.col(text)).alias("w"))

    def count(word: str) -> Column:
        if word.endswith("*"):
            return F.size(F.filter("w", lambda x: x.startswith(word[:-1])))
        return F.size(F.filter("w", lambda x: x == word))

    scored = wanted + needed
    rows = rows.select(key, F.size("w").alias("length"), *(count(w).alias(f"t{n}") for n, w in enumerate(scored)), *(count(w).alias(f"n{n}") for n, w in enumerate(barred)))
    # statistics over all texts: one aggregate row
    facts = rows.agg(F.count("*").alias("N"), F.avg("length").alias("avg"), *(F.sum((F.col(f"t{n}") > 0).cast("long")).alias(f"d{n}") for n in range(len(scored))))
    hit = F.lit(False)
    for n in range(len(scored)):
        hit = hit | (F.col(f"t{n}") > 0)
    rows = rows.where(hit)
    for n in range(len(wanted), len(scored)):
        rows = rows.where(F.col(f"t{n}") > 0)
    for n in range(len(barred)):
        rows = rows.where(F.col(f"n{n}") == 0)
    full = rows.crossJoin(F.broadcast(facts))
    score = F.lit(0.0)
    for n in range(len(scored)):
        idf = F.log(1 + (F.col("N") - F.col(f"d{n}") + 0.5) / (F.col(f"d{n}") + 0.5))
        tf = F.col(f"t{n}").cast("double")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("avg")))
    out = full.select(key, score.alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit is not None else out


def es_query(session, space, name: str, index: str, query: str) -> DataFrame:
    """Rows of a tag or edge type that match a query on a declared full-text index, with ``score``."""
    from pathloom.values import SemanticError

    entry = space.indexes.get(index)
    if entry is None or not entry["fulltext"] or entry["on"] != name:
        raise SemanticError(f"no full-text index {index} on {name}")
    is_tag = name in space.tags
    df = space.tag(name) if is_tag else space.edge(name)
    keys = ["_vid"] if is_tag else ["_src", "_dst", "_rank"]
    text = F.concat_ws(" ", *(F.col(f.split("(")[0]) for f in entry["fields"]))
    keyed = df.select(F.struct(*keys).alias("__k"), text.alias("__t"))
    found = search(keyed, "__k", "__t", query)
    return df.withColumn("__k", F.struct(*keys)).join(found, "__k").drop("__k")
