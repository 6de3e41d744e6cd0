"""Line deduplication with content-defined chunks (operator 1).

Every line with a word is hashed; a rolling hash over the hashes of two neighbouring lines chooses boundaries: a chunk ends
between two lines whose rolled hash is divisible by a small number. Boundaries depend on the lines beside them alone, so a
passage has the same inner chunks wherever it stands and whatever was inserted before it. Multi-line chunks that recur
anywhere in the table are removed except for their first occurrence, after the bytes of all occurrences were compared.

The first and last lines of a repeated passage lie in chunks that reach beyond it, and a passage of two or three lines may
hold no whole chunk. These are found by the rolled hashes themselves: two neighbouring lines that stood together before
are a repeated window, compared in the same way. A line of many words is a passage by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pathloom.llm.bpe import _arrow
from pathloom.llm.common import batch, discard, held, store

#: What a piece of a text is: a multi-line chunk, a window of two lines, or one long line.
CHUNK, WINDOW, LINE = 0, 1, 2
_COUNTS = ("_n_lines", "_n_removed", "_n_by_chunk", "_n_by_window", "_n_by_line")


def line_hashes(lines: list[str]) -> np.ndarray:
    """64-bit hashes of lines."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))


def rolled(hashes: np.ndarray) -> np.ndarray:
    """Rolling hash over windows of two line hashes."""
    with np.errstate(over="ignore"):
        x = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + (hashes[1:] ^ (hashes[1:] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pieces(text: str | None, every: int = 3, long_words: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First line, end line, hash and kind of all pieces of a text that may be removed.

    A chunk ends between two lines whose rolled hash is divisible by ``every``; it counts with two lines at least (and is
    its only window, if it has two). Blank lines belong to no piece but may lie inside one. Of windows that overlap the
    equal one before them every second is left out. No pieces for null, empty and blank texts.
    """
    lines = (text or "").split("\n")
    at = np.array([k for k, x in enumerate(lines) if x.strip()], np.int64)
    n = len(at)
    if not n:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    own = [lines[k] for k in at.tolist()]
    h = line_hashes(own)
    windows = rolled(h)
    ends = np.flatnonzero(windows % np.uint64(every) == 0) + 1
    begin, end = np.concatenate(([0], ends)), np.concatenate((ends, [n]))
    kind = np.full(len(windows), WINDOW)
    kind[begin[end - begin == 2]] = CHUNK
    # runs of equal windows: one line again and again
    same = np.concatenate(([False], windows[1:] == windows[:-1]))
    run = np.arange(len(windows)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(windows)))) if len(windows) else np.zeros(0, np.int64)
    keep = np.flatnonzero(run % 2 == 0)
    big = np.flatnonzero(end - begin > 2)
    whole = np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes()) for a, b in zip(begin[big].tolist(), end[big].tolist(), strict=True)], np.uint64)
    long = np.array([k for k, x in enumerate(own) if len(x.split()) >= long_words], np.int64)
    return (
        np.concatenate((at[keep], at[begin[big]], at[long])), np.concatenate((at[keep + 1], at[end[big] - 1], at[long])) + 1,
        np.concatenate((windows[keep], whole, h[long])), np.concatenate((kind[keep], np.full(len(big), CHUNK), np.full(len(long), LINE))),
    )


def removed(lines: list[str], found: list[tuple[int, int, int]], few_words: int = 10) -> np.ndarray:
    """For each line the kind of the repeated piece that removes it, or -1: found are ``(first, end, kind)``.

    Blank lines between removed lines go with them. A stretch of fewer than ``few_words`` words stays.
    """
    cause = np.full(len(lines), 99)
    for first, end, kind in found:
        np.minimum(cause[first:end], kind, out=cause[first:end])
    gone = cause < 99
    blank = np.array([not x.strip() for x in lines])
    some = np.flatnonzero(gone & ~blank)
    for a, b in zip(some[:-1].tolist(), some[1:].tolist(), strict=True):
        if b - a > 1 and blank[a + 1 : b].all():
            cause[a + 1 : b] = max(cause[a], cause[b])
    gone = cause < 99
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if sum(len(x.split()) for x in lines[a:b]) < few_words:
            cause[a:b] = 99
    return np.where(cause < 99, cause, -1)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", every: int = 3, long_words: int = 50, few_words: int = 10) -> DataFrame:
    """All rows and columns of ``docs`` without repeated passages in the text, and what was removed by line:
    ``_n_lines``, ``_n_removed``, ``_n_by_chunk``, ``_n_by_window``, ``_n_by_line``.

    The first occurrence by id (null before all others), then by place, stays; so does what has an equal hash but different
    bytes. ``length_col``, if there is such a column, gets the new length. Null text stays null; a text that consists of
    repeated passages becomes empty. Rows that repeat both id and text are the same document and lose the same lines. An
    empty table gives no rows. Columns of the input named like the new ones are replaced.
    """
    kind = docs.schema[id_col].dataType
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    docs = docs.drop(*_COUNTS)
    slim = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    place_schema = pa.schema([("id", _arrow(kind)), ("key", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("hash", pa.int64()), ("kind", pa.int8())])

    def place(batches):
        held("lines", dict)
        for b in batches:
            for s in range(0, b.num_rows, 512):
                t = b.slice(s, 512)
                got = [pieces(x.as_py(), every, long_words) for x in t.column(2)]
                row = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
                first, end, h, what = (np.concatenate([g[k] for g in got]) for k in range(4))
                yield batch({
                    "id": t.column(0).take(pa.array(row)), "key": t.column(1).take(pa.array(row)), "first": first.astype(np.int32), "end": end.astype(np.int32),
                    "hash": h.view(np.int64), "kind": what.astype(np.int8),
                }, place_schema)

    placed = store(slim.mapInArrow(place, f"id {kind.simpleString()}, key long, first int, end int, hash long, kind byte"), "pieces")
    repeated = placed.groupBy("hash").agg(F.count("*").alias("c"), F.min(F.struct("id", "key", "first")).alias("keep")).where("c > 1").drop("c")
    # written first: a plain join of two tables, whose hot hashes Spark splits over tasks
    repeated = store(repeated, "repeated")
    found = placed.join(repeated, "hash").select("id", "key", "first", "end", "hash", "kind", (F.struct("id", "key", "first") == F.col("keep")).alias("stays"))
    # a document's own pieces: bounded by the document
    lists = found.groupBy("id", "key").agg(F.collect_list(F.struct("first", "end", "hash", "kind", "stays")).alias("_pieces")).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "_pieces")
    keyed = docs.withColumn("_own", key)
    joined = keyed.join(lists, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left").drop("_id", "_key", "_own")
    joined = store(joined, "lines", "zstd")
    discard(placed, repeated)

    at, size = joined.columns.index(text_col), joined.columns.index("_pieces")
    length_at = joined.columns.index(length_col) if length_col and length_col in docs.columns else -1

    def bytes_of(batches):
        for b in batches:
            for t, c in zip(b.column(0), b.column(1), strict=True):
                lines = t.as_py().split("\n")
                mine = c.as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["hash"] for x in mine], pa.int64()), pa.array(["\n".join(y for y in lines[x["first"] : x["end"]] if y.strip()) for x in mine], pa.string()),
                ], names=["hash", "piece"])

    # byte comparison: all occurrences of a hash are equal if the least and the greatest are; those that differ are
    # collisions of 64-bit hashes, a handful in any table
    texts_of = joined.where("_pieces is not null").select(text_col, "_pieces").mapInArrow(bytes_of, "hash long, piece string")
    differ = frozenset(r[0] for r in texts_of.groupBy("hash").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a <> b").select("hash").collect())
    shared = docs.sparkSession.sparkContext.broadcast(differ)

    def cut_out(batches):
        for b in batches:
            texts, counts = [], []
            for t, c in zip(b.column(at), b.column(size), strict=True):
                text = t.as_py()
                mine = [(x["first"], x["end"], x["kind"]) for x in (c.as_py() or []) if not x["stays"] and x["hash"] not in shared.value]
                n, by = 0 if text is None else text.count("\n") + 1, [0, 0, 0]
                if mine:
                    lines = text.split("\n")
                    cause = removed(lines, mine, few_words)
                    text = "\n".join(x for x, k in zip(lines, cause.tolist(), strict=True) if k < 0)
                    by = np.bincount(cause[cause >= 0], minlength=3).tolist()
                texts.append(text)
                counts.append((n, sum(by), *by))
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols[text_col] = pa.array(texts, b.schema.field(at).type)
            if length_at >= 0:
                old = b.column(length_at).to_pylist()
                cols[length_col] = pa.array([len(t) if n[1] else o for t, n, o in zip(texts, counts, old, strict=True)], b.schema.field(length_at).type)
            del cols["_pieces"]
            cols |= {name: pa.array([n[k] for n in counts], pa.int64()) for k, name in enumerate(_COUNTS)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return joined.mapInArrow(cut_out, StructType([*(f for f in joined.schema.fields if f.name != "_pieces"), *(StructField(c, LongType()) for c in _COUNTS)]))
