"""Token ids in directly addressable codes (operator 4).

An id is cut into chunks of ``bits`` bits, lowest first. Level k holds chunk k of all ids that have one, and a bitmap
whose bit tells whether the id goes on in level k + 1. A rank directory (ones before each block of 512 bits) turns an
index in level k into its index in level k + 1, so any id is read with a few look-ups and no block is decoded.

Segment layout, little-endian: magic ``PLDC``, u8 version, u8 bits, u16 levels, u64 ids; then for each level u64 count,
the chunks (``bits`` 8 or 16: u8 or u16 each), the bitmap (count bits, padded to 64) and the rank directory (u32 each).

A token file is a plain file of segments, one after the other, as they are: any token is reached by seeking. Each task
writes one file; the catalogue beside the files, a small table of few files, tells file, offset and documents of every
segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.bpe import _arrow, encoder
from pathloom.llm.common import batch, temporary
from pathloom.runtime import hadoop_path

MAGIC, VERSION, BLOCK = b"PLDC", 1, 512
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray, bits: int = 8) -> bytes:
    """Encode unsigned 32-bit ids as one segment."""
    if bits not in (8, 16):
        raise ValueError("bits must be 8 or 16")
    rest, levels, kind = np.asarray(ids, np.uint32), [], np.dtype(f"<u{bits // 8}")
    while True:
        more = rest >= (1 << bits)
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate((bitmap, np.zeros(-len(bitmap) % 8, np.uint8)))
        blocks = np.concatenate((bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8))).reshape(-1, BLOCK // 8)
        ones = _ONES[blocks].sum(1, dtype=np.uint32)
        ranks = np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))[: len(ones)]
        levels.append(struct.pack("<Q", len(rest)) + (rest & ((1 << bits) - 1)).astype(kind).tobytes() + bitmap.tobytes() + ranks.astype("<u4").tobytes())
        if not more.any():
            break
        rest = rest[more] >> bits
    return MAGIC + struct.pack("<BBHQ", VERSION, bits, len(levels), len(ids)) + b"".join(levels)


class Segment:
    """Random access to the ids of one segment, of which just the bytes are read that an access needs.

    read: gives so many bytes at a position; ``at`` is the position of the segment. Bytes in memory serve as well.
    """

    def __init__(self, data: bytes | Callable[[int, int], bytes], at: int = 0):
        self.read = (lambda p, n: data[p : p + n]) if isinstance(data, (bytes, memoryview)) else data
        head = self.read(at, 16)
        if head[:4] != MAGIC or head[4] != VERSION:
            raise ValueError("not a segment of this format")
        _, self.bits, n_levels, self.n = struct.unpack_from("<BBHQ", head, 4)
        self.kind, self.levels = np.dtype(f"<u{self.bits // 8}"), []
        at += 16
        for _ in range(n_levels):
            (n,) = struct.unpack("<Q", self.read(at, 8))
            chunks = at + 8
            bitmap = chunks + n * self.kind.itemsize
            ranks = bitmap + (n + 63) // 64 * 8
            at = ranks + 4 * ((n + BLOCK - 1) // BLOCK)
            self.levels.append((n, chunks, bitmap, ranks))

    def __len__(self) -> int:
        return self.n

    def _chunks(self, level: int, start: int, stop: int) -> np.ndarray:
        size = self.kind.itemsize
        return np.frombuffer(self.read(self.levels[level][1] + start * size, (stop - start) * size), self.kind)

    def _bits(self, level: int, first: int, last: int) -> np.ndarray:
        """Bytes of a bitmap."""
        return np.frombuffer(self.read(self.levels[level][2] + first, last - first), np.uint8)

    def get(self, index: int) -> int:
        """The id at a position; reads one chunk and at most one block of a bitmap and one rank for each level."""
        if not 0 <= index < self.n:
            raise IndexError(index)
        value, shift = 0, 0
        for level in range(len(self.levels)):
            value |= int(self._chunks(level, index, index + 1)[0]) << shift
            shift += self.bits
            if level + 1 == len(self.levels) or not self._bits(level, index >> 3, (index >> 3) + 1)[0] >> (index & 7) & 1:
                break
            index = self._rank(level, index)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range: the range on level 0 maps to one range on each further level, found by one rank each."""
        out, where, shift = np.zeros(stop - start, np.uint32), None, 0
        for level in range(len(self.levels)):
            part = self._chunks(level, start, stop).astype(np.uint32) << shift
            if where is None:
                out = part
            else:
                out[where] |= part
            shift += self.bits
            if level + 1 == len(self.levels) or start == stop:
                break
            first = start >> 3
            flags = np.unpackbits(self._bits(level, first, (stop + 7) >> 3), bitorder="little")[start - 8 * first : stop - 8 * first].view(bool)
            own = np.flatnonzero(flags)
            if not len(own):
                break
            where = own if where is None else where[own]
            start = self._rank(level, start)
            stop = start + len(own)
        return out

    def _rank(self, level: int, index: int) -> int:
        """Ids before ``index`` that go on in the next level: the directory's count and the ones since its block began."""
        _, _, _, ranks = self.levels[level]
        block, last = index // BLOCK, index >> 3
        (before,) = struct.unpack("<I", self.read(ranks + 4 * block, 4))
        bits = self._bits(level, block * BLOCK // 8, last + 1)
        return before + int(_ONES[bits[:-1]].sum()) + int(_ONES[bits[-1] & ((1 << (index & 7)) - 1)])


def _opened(path: str):
    """File system and path of a Hadoop-style path, as Arrow knows them (local files, HDFS and object stores)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 20, partitions: int | None = None) -> None:
    """Encode every whole text, append ``end_id`` to each and write token files in ascending id order under ``path``.

    ``path/part-<n>.pldc`` are the files, ``path/catalogue`` has a row for each segment: ``part``, ``file``, ``segment``,
    ``at`` (its offset), ``n_ids``, ``doc_ids``, ``lengths``. Texts are dealt into ranges of the id column and encoded
    there in order, so nothing but text is shuffled. A file gets its name once it is whole; a task that runs again
    writes the same bytes again. A segment is closed once it holds ``segment_ids`` ids; a document is never cut. Null
    text is empty (its end id alone is written); null ids come first; rows with the same id are ordered by text; an empty
    table writes no segment; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = slim.repartitionByRange(partitions, "id") if partitions else slim.repartitionByRange("id")
    kind = slim.schema["id"].dataType
    out = pa.schema([
        ("part", pa.int64()), ("file", pa.string()), ("segment", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(_arrow(kind))), ("lengths", pa.list_(pa.int64())),
    ])
    last = struct.pack("<I", end_id)
    top = path.rstrip("/")
    fs, root = hadoop_path(docs.sparkSession, top)
    fs.mkdirs(root)

    def run(batches):
        from pyspark import TaskContext

        enc, context = encoder(tokenizer, leaf_chars=32768), TaskContext.get()
        part, segment, at = context.partitionId(), 0, 0
        files, where = _opened(f"{top}/part-{part:05d}.pldc")
        draft = f"{where}.{context.attemptNumber()}-{context.taskAttemptId()}"
        ids, lengths, pieces, size, sink = [], [], [], 0, None

        def close():
            data = pack(np.frombuffer(b"".join(pieces), "<u4"))
            sink.write(data)
            return len(data), batch({"part": [part], "file": [f"part-{part:05d}.pldc"], "segment": [segment], "at": [at], "n_ids": [size], "doc_ids": [ids], "lengths": [lengths]}, out)

        for b in batches:
            texts = b.column(1)
            for row, i in enumerate(b.column(0).to_pylist()):
                coded = enc.encode_bytes(texts[row].as_py()) + last
                if sink is None:
                    sink = files.open_output_stream(draft)
                ids.append(i)
                lengths.append(len(coded) // 4)
                pieces.append(coded)
                size += lengths[-1]
                if size >= segment_ids:
                    n, row_ = close()
                    yield row_
                    ids, lengths, pieces, size, segment, at = [], [], [], 0, segment + 1, at + n
        if ids:
            yield close()[1]
        if sink is not None:
            sink.close()
            files.move(draft, where)

    ddl = f"part long, file string, segment long, at long, n_ids long, doc_ids array<{kind.simpleString()}>, lengths array<long>"
    rows = dealt.sortWithinPartitions("id", "text").mapInArrow(run, ddl)
    # its few rows go into few files: an executor without Hadoop's native library starts a process for each file it writes
    rows.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism).write.parquet(f"{top}/catalogue")


def starts(catalogue: DataFrame) -> DataFrame:
    """``(part, segment, start)``: the number of ids before each segment.

    Starts are summed within a part first; only one row for each part meets in the last window.
    """
    heads = catalogue.select("part", "segment", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n_part"))
    parts = parts.select("part", (F.sum("n_part").over(Window.orderBy("part")) - F.col("n_part")).alias("before"))
    inside = Window.partitionBy("part").orderBy("segment")
    heads = heads.select("part", "segment", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("within"))
    return heads.join(parts, "part").select("part", "segment", (F.col("before") + F.col("within")).alias("start"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the segments under ``path``."""
    return spark.read.parquet(f"{path.rstrip('/')}/catalogue")


def digest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Read every document's ids back from the token files: ``(id, start, n_tokens, ids_crc32)``.

    Each document is addressed by its place in its segment: through the rank directories, reading its own bytes alone.
    Only the digests of documents meet the starts of their segments.
    """
    rows = catalogue(spark, path)
    kind, top = rows.schema["doc_ids"].dataType.elementType, path.rstrip("/")
    out = pa.schema([(id_col, _arrow(kind)), ("part", pa.int64()), ("segment", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for part, name, segment, at, doc_ids, lengths in zip(*(b.column(k) for k in range(6)), strict=True):
                files, where = _opened(f"{top}/{name.as_py()}")
                with pa.memory_map(where) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(where) as f:
                    seg, n = Segment(lambda p, k, f=f: f.read_at(k, p), at.as_py()), np.asarray(lengths.values)
                    first = np.cumsum(n) - n
                    crc = [zlib.crc32(seg.slice(s, s + k).astype("<u4", copy=False)) for s, k in zip(first.tolist(), n.tolist(), strict=True)]
                yield batch({id_col: doc_ids.values, "part": [part.as_py()] * len(n), "segment": [segment.as_py()] * len(n), "within": first, "n_tokens": n, "ids_crc32": crc}, out)

    ddl = f"{id_col} {kind.simpleString()}, part long, segment long, within long, n_tokens long, ids_crc32 long"
    docs = rows.select("part", "file", "segment", "at", "doc_ids", "lengths").mapInArrow(run, ddl)
    return docs.join(starts(rows), ["part", "segment"]).select(id_col, (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def write_and_digest(docs: DataFrame, tokenizer: str, end_id: int, label: str = "ids") -> DataFrame:
    """Write the ids of all texts to the shared folder, read the files back and digest each document."""
    path = temporary(docs.sparkSession, label)
    write(docs, path, tokenizer, end_id)
    return digest(docs.sparkSession, path)
