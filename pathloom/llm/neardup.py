"""Near-duplicate documents by MinHash (operator 10).

One-permutation hashing: every shingle is hashed once, the hash range is cut into bins and a bin keeps its least hash.
Empty bins borrow from the bin that a fixed random sequence names first among those in use (optimal densification), so a
bin of two documents agrees with the probability of their similarity, for short documents too. Bins form bands, and
documents that agree in a band share a bucket.

Documents with equal shingle sets are one class, represented by the smallest id, before any bucket is built. A bucket
yields a star: each member is paired with the one that meets the most others over all its buckets, which is the original
where copies were made of one text. Verified pairs make components.
What the stars left open is then closed exactly: in every bucket whose members lie in several components, the members
outside the bucket's largest component are compared with all members of other components, in blocks of bounded size that
return links and never pairs. So every pair that shares a bucket is verified, refuted, or within a component already.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.bpe import _arrow
from pathloom.llm.common import batch, connected_components, cut, discard, held, store

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    """64-bit hash of a word; recent words are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int = 5, known: _WordHash | None = None) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word shingles of a text, A-Z lower-cased, words between ASCII white space.

    Fewer words than ``width``, but not none: the whole sequence is the one shingle. No words or null: an empty set.
    ``known``: hashes of words seen before.
    """
    known = _WordHash() if known is None else known
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
        for k in range(n):
            total = _mix(total + h[k : len(h) - n + 1 + k] * _ODD[k % 8])
    return np.unique(total)


@functools.lru_cache(2)
def _tables(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bound of each bin, and for each bin the sequence of bins it borrows from."""
    bounds = np.array([(b << 64) // bins for b in range(bins)], dtype=object).astype(np.uint64)
    rng = np.random.Generator(np.random.PCG64(20240607))
    return bounds, rng.integers(0, bins, (bins, 1024)).astype(np.int64)


def signature(hashes: np.ndarray, bands: int = 32, rows: int = 5) -> np.ndarray:
    """Band hashes of a non-empty sorted set of hashes."""
    bins = bands * rows
    bounds, borrow = _tables(bins)
    at = np.searchsorted(hashes, bounds)
    low = hashes[np.minimum(at, len(hashes) - 1)]
    upper = np.concatenate((at[1:], [len(hashes)]))
    used = upper > at
    source = np.arange(bins)
    empty = np.flatnonzero(~used)
    for first, last in ((0, 16), (16, 128), (128, 1024)):
        if not len(empty):
            break
        hit = used[borrow[empty, first:last]]
        found = hit.any(1)
        source[empty[found]] = borrow[empty[found], first + hit[found].argmax(1)]
        empty = empty[~found]
    if len(empty):
        source[empty] = np.flatnonzero(used)[0]
    with np.errstate(over="ignore"):
        values = _mix(low[source] + np.arange(bins, dtype=np.uint64) * _ODD[0]).reshape(bands, rows)
        return _mix((values * _ODD[:rows]).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """``(id, n, class, bands)``: set size, digest of the set and band hashes (no digest and bands for empty sets)."""
    kind = docs.schema[id_col].dataType
    out = pa.schema([("id", _arrow(kind)), ("n", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        known = held("neardup", _WordHash)
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                s = b.slice(k, 1024)
                n, digest, band = [], [], []
                for t in s.column(1):
                    h = shingles(t.as_py(), width, known)
                    n.append(len(h))
                    digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    band.append(signature(h, bands, rows).view(np.int64) if len(h) else None)
                yield batch({"id": s.column(0), "n": n, "class": digest, "bands": band}, out)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, n long, class binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Full shingle sets of the wanted ids: ``(id, hashes)``."""
    kind = docs.schema[id_col].dataType
    out = pa.schema([("id", _arrow(kind)), ("hashes", pa.binary())])

    def run(batches):
        known = held("neardup", _WordHash)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                s = b.slice(k, 512)
                yield batch({"id": s.column(0), "hashes": [shingles(t.as_py(), width, known).tobytes() for t in s.column(1)]}, out)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return slim.mapInArrow(run, f"id {kind.simpleString()}, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets have ``100 * intersection >= per_cent * union``."""
    kind = pairs.schema["a"].dataType
    out = pa.schema([("a", _arrow(kind)), ("b", _arrow(kind))])

    def run(batches):
        held("neardup links", dict)
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), max(0, len(q) - 1))
                both = int((q[at] == p).sum()) if len(p) else 0
                keep.append(both > 0 and 100 * both >= per_cent * (len(p) + len(q) - both))
            yield t.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    full = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return full.mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of two lists of sorted sets: shingles that many of both hold by a matrix product, others one by one."""
    a, b = np.concatenate(left), np.concatenate(right)
    la, lb = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.int32)
    if not len(both):
        return out
    pa_, pb = np.minimum(np.searchsorted(both, a), len(both) - 1), np.minimum(np.searchsorted(both, b), len(both) - 1)
    ka, kb = both[pa_] == a, both[pb] == b
    pa_, la, pb, lb = pa_[ka], la[ka], pb[kb], lb[kb]
    ca, cb = np.bincount(pa_, minlength=len(both)), np.bincount(pb, minlength=len(both))
    common = ca.astype(np.int64) * cb > 0.005 * len(left) * len(right) + 16
    place = np.cumsum(common) - 1
    width = 2048
    for lo in range(0, int(common.sum()), width):
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for m, p, l in ((x, pa_, la), (y, pb, lb)):
            k = common[p] & (place[p] >= lo) & (place[p] < lo + width)
            m[l[k], place[p[k]] - lo] = 1
        out += (x @ y.T).astype(np.int32)
    # the rest: every pair of places of one shingle
    ra, rb = ~common[pa_], ~common[pb]
    order = np.argsort(pb[rb], kind="stable")
    keys, rows = pb[rb][order], lb[rb][order]
    p, l = pa_[ra], la[ra]
    lo = np.searchsorted(keys, p)
    n = np.searchsorted(keys, p, side="right") - lo
    total, start = np.cumsum(n), 0
    while start < len(p):
        # as many as make about a million pairs of places at once, one at least
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + 1_000_000, side="right")))
        m = n[start:end]
        at = np.repeat(lo[start:end] - np.cumsum(m) + m, m) + np.arange(m.sum())
        np.add.at(out, (np.repeat(l[start:end], m), rows[at]), 1)
        start = end
    return out


def _links_of(own: list[tuple], other: list[tuple], per_cent: int) -> list[tuple]:
    """Links ``(id, id)`` between different components: one for each own member and component it is linked with."""
    out = []
    x, y = [np.frombuffer(r[2], np.uint64) for r in own], [np.frombuffer(r[2], np.uint64) for r in other]
    both = overlaps(x, y)
    nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    names: dict = {}
    cx = np.array([names.setdefault(r[1], len(names)) for r in own])
    cy = np.array([names.setdefault(r[1], len(names)) for r in other])
    for k in range(len(own)):
        row = both[k].astype(np.int64)
        at = np.flatnonzero((100 * row >= per_cent * (nx[k] + ny - row)) & (cx[k] != cy))
        if len(at):
            _, first = np.unique(cy[at], return_index=True)
            out += [(own[k][0], other[at[f]][0]) for f in first]
    return out


def _block_links(blocks: DataFrame, kind, per_cent: int) -> DataFrame:
    """Links found in blocks ``(bucket, i, j)``; a block's rows are read one after the other, so one block is held at a time."""
    out = pa.schema([("a", _arrow(kind)), ("b", _arrow(kind))])

    def run(batches):
        held("neardup links", dict)
        key, own, other = None, [], []
        for t in batches:
            keys = list(zip(*(t.column(k).to_pylist() for k in range(3)), strict=True))
            mine, ids, component = t.column(3).to_pylist(), t.column(4).to_pylist(), t.column(5).to_pylist()
            found = []
            for r, k in enumerate(keys):
                if k != key:
                    if own and other:
                        found += _links_of(own, other, per_cent)
                    key, own, other = k, [], []
                (own if mine[r] else other).append((ids[r], component[r], t.column(6)[r].as_py()))
            if found:
                yield batch({"a": [f[0] for f in found], "b": [f[1] for f in found]}, out)
        if own and other and (found := _links_of(own, other, per_cent)):
            yield batch({"a": [f[0] for f in found], "b": [f[1] for f in found]}, out)

    dealt = blocks.select("bucket", "i", "j", "own", "id", "component", "hashes").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    name = kind.simpleString()
    return dealt.mapInArrow(run, f"a {name}, b {name}").distinct()


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, per_cent: int = 80, bands: int = 32, rows: int = 5, star_pairs: int = 3, block_shingles: int = 250_000, block_rows: int = 2048
) -> DataFrame:
    """Rows ``(id, n_shingles, component_id, kept)``, one for each row of ``docs``.

    component_id is the smallest id reachable by links, itself included; kept tells whether it is the row's own. Empty
    sets link with nothing. With 32 bands of 5 a pair at exactly 0.8 is missed with a probability of 3 in a million.
    ``star_pairs``: pairs of each document that are verified before its buckets are looked at again; it bounds work, not
    results. ``block_shingles``, ``block_rows``: shingles and sets on one side of a block, about. Rows that share an id are taken as one document with either text. Null ids get a null component.
    """
    signed = store(_signatures(docs, id_col, text_col, width, bands, rows), "signatures")
    some = signed.where("n > 0 and id is not null")
    classes = some.groupBy("class").agg(F.min(F.struct("id", "n", "bands")).alias("m")).select("class", F.col("m.id").alias("id"), F.col("m.n").alias("n"), F.col("m.bands").alias("bands"))
    classes = store(classes, "classes")

    members = classes.select("id", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    # buckets with company: the members that all later steps look at
    members = store(members.join(sizes, "bucket"), "buckets")
    met = members.groupBy("id").agg(F.sum("c").alias("met"))
    hubs = members.join(met, "id").groupBy("bucket").agg(F.max(F.struct("met", F.xxhash64("id").alias("h"), "id", "n")).alias("m"))
    stars = members.join(hubs.select("bucket", F.col("m.id").alias("hub"), F.col("m.n").alias("hub_n")), "bucket")
    fits = f"100 * least(n, hub_n) >= {per_cent} * greatest(n, hub_n)"
    stars = stars.where("id <> hub").where(fits).groupBy("id", "hub").agg(F.count("*").alias("c"))
    best = F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "hub")))
    # a document has one hub for each band at most: the list is bounded by the number of bands
    stars = stars.groupBy("id").agg(F.slice(best, 1, star_pairs).alias("s")).select("id", F.explode("s.hub").alias("hub"))
    first = cut(stars.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct())

    wanted = members.select("id").distinct()
    sets = store(_sets(docs, wanted, id_col, text_col, width), "sets")
    links = cut(_verified(first, sets, per_cent))
    found = cut(connected_components(links, "a", "b"))

    # what the stars left open, bucket by bucket
    placed = members.join(found, members["id"] == found["node"], "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    several = parts.groupBy("bucket").agg(F.count("*").alias("k"), F.max(F.struct("c", "component", "w")).alias("m"), F.sum("w").alias("w"), F.sum("c").alias("c")).where("k > 1")
    several = several.select("bucket", F.col("m.component").alias("main"), F.greatest(F.ceil(F.col("w") / block_shingles), F.ceil(F.col("c") / block_rows)).cast("int").alias("all_blocks"), F.greatest(F.ceil((F.col("w") - F.col("m.w")) * 2 / block_shingles), F.ceil((F.col("c") - F.col("m.c")) * 2 / block_rows)).cast("int").alias("own_blocks"))
    open_ = placed.join(several, "bucket")
    h = F.xxhash64("id", "bucket")
    own = open_.where("component <> main").select("bucket", "id", "component", F.lit(True).alias("own"), F.pmod(h, "own_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"))
    other = open_.select("bucket", "id", "component", F.lit(False).alias("own"), F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("i"), F.pmod(h, "all_blocks").cast("int").alias("j"))
    blocks = own.unionByName(other).join(sets, "id")
    more = cut(_block_links(blocks, docs.schema[id_col].dataType, per_cent))
    if not more.isEmpty():
        # links within a component are told by its smallest id
        old = found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
        found = cut(connected_components(old.union(more), "a", "b"))

    named = classes.select("class", F.col("id").alias("node")).join(found, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    named = store(named, "named")
    discard(classes, members, sets)
    # empty sets are their own components: they never meet in one task of the join
    slim = signed.select("id", "n", "class")
    out = slim.where("class is not null").join(named, "class", "left").select("id", "n", "component")
    out = out.unionByName(slim.where("class is null").select("id", "n", F.lit(None).cast(docs.schema[id_col].dataType).alias("component")))
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), (own == F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id; all columns kept.

    Rows are matched by id; rows with a null id, and rows that repeat a kept id, stay.
    """
    gone = components(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("_pl_id")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_pl_id"), "left_anti")
