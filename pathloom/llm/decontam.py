"""Benchmark decontamination with suffix arrays of the training text (operator 3).

The training table is read in shards (the batches of a task). Each shard becomes one word sequence with a sorted suffix
array; every test suffix is found in it by binary search, which gives the range of training suffixes that share its
window, hence all verbatim occurrences with their places; runs of occurrences on one diagonal give longest matches.

Only training suffixes that start with two neighbouring words of some item (or with a one-word item) can share a window,
so the array of a shard holds just those: nothing that could match is left out. The test set is collected in blocks of
bounded size; each block is one pass over the training table and items never cross blocks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.bpe import _arrow
from pathloom.llm.common import batch, store

#: Bytes that belong to words once A-Z is lower-cased: 0-9, a-z and everything outside ASCII. The rest becomes a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class TestSuffixes:
    """The windows of a block of items, ready for binary search: arrays and one vocabulary, built once and broadcast.

    window: words of a window; an item with fewer words, but not none, is one window. Equal windows of one item are
    all kept, as each has its own place.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = 13):
        self.window = window
        items = [(i, w) for i, w in items if w]
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        code = self.vocabulary
        counts = np.array([len(w) for _, w in items], np.int64)
        # after each item as many zeros as a window needs, so that short items are padded
        begin = np.cumsum(counts + window) - (counts + window)
        flat = np.zeros(int((counts + window).sum()), np.int64)
        for b, (_, w) in zip(begin.tolist(), items, strict=True):
            flat[b : b + len(w)] = [code.setdefault(x, len(code) + 1) for x in w]
        windows = np.maximum(counts - window + 1, 1)
        self.owner = np.repeat(np.arange(len(items)), windows)
        self.offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        self.length = np.minimum(counts, window)[self.owner]
        self.bits = max(1, len(code).bit_length() + 1)
        per = 62 // self.bits
        self.columns = [(c, min(c + per, window)) for c in range(0, window, per)]
        self.top = (1 << self.bits) - 1
        start = begin[self.owner] + self.offset
        self.low = self.keys(flat, start)
        self.high = self._open_ended() if (self.length < window).any() else self.low
        self.first = np.zeros(len(code) + 1, bool)
        self.first[flat[begin[counts == 1]]] = True
        both = (flat[:-1] > 0) & (flat[1:] > 0)
        self.pairs = np.unique(flat[:-1][both] * (len(code) + 1) + flat[1:][both])

    def keys(self, flat: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """The ``window`` word codes after each start as a few integers that sort alike."""
        out = []
        for a, b in self.columns:
            key = np.zeros(len(start), np.int64)
            for c in range(a, b):
                key = (key << self.bits) | flat[start + c]
            out.append(key)
        return out

    def _open_ended(self) -> list[np.ndarray]:
        """Keys with the greatest code in all places after the words of a short item."""
        out = []
        for (a, b), low in zip(self.columns, self.low, strict=True):
            free = np.clip(b - np.maximum(self.length, a), 0, b - a)
            out.append(low | ((np.int64(1) << (free * self.bits)) - 1))
        return out


def _search(sorted_keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of many keys (of several integers each) at once."""
    n = len(sorted_keys[0])
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, n - 1)
        below = np.zeros(len(mid), bool)
        same = np.ones(len(mid), bool)
        for s, w in zip(sorted_keys, wanted, strict=True):
            x = s[at]
            below |= same & (x < w)
            same &= x == w
        if right:
            below |= same
        lo = np.where(open_ & below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


class Shard:
    """A word sequence of several texts with its suffix array over the suffixes that could match."""

    def __init__(self, texts: list[str | None], test: TestSuffixes):
        code = test.vocabulary.get
        lists = [words(t) for t in texts]
        self.counts = np.array([len(x) for x in lists], np.int64)
        # one separator after each text; 0 stands for it and for words that no item has
        flat = np.zeros(int(self.counts.sum()) + len(lists) + test.window, np.int64)
        self.begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.counts + 1)))[:-1]
        for b, x in zip(self.begin.tolist(), lists, strict=True):
            flat[b : b + len(x)] = np.fromiter((code(w, 0) for w in x), np.int64, len(x))
        a, b = flat[:-1], flat[1:]
        start = np.flatnonzero((a > 0) & ((b > 0) | test.first[a]))
        pair = flat[start] * (len(test.vocabulary) + 1) + flat[start + 1]
        if len(test.pairs):
            at = np.minimum(np.searchsorted(test.pairs, pair), len(test.pairs) - 1)
            start = start[(test.pairs[at] == pair) | test.first[flat[start]]]
        else:
            start = start[test.first[flat[start]]]
        start = start[start + test.window <= len(flat)]
        keys = test.keys(flat, start)
        order = np.lexsort(keys[::-1])
        self.suffixes, self.keys, self.size = start[order], [k[order] for k in keys], len(flat)

    def find(self, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences: (test window, position in the shard)."""
        if not len(self.suffixes) or not len(test.owner):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # most suffixes of a large test set find no training suffix with their first words: one look-up each
        some = np.flatnonzero(np.searchsorted(self.keys[0], test.low[0]) < np.searchsorted(self.keys[0], test.high[0], side="right"))
        lo, hi = _search(self.keys, [k[some] for k in test.low], False), _search(self.keys, [k[some] for k in test.high], True)
        n = hi - lo
        which = np.repeat(some, n)
        return which, self.suffixes[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def scan(texts: list[str | None], test: TestSuffixes) -> list[dict]:
    """For each text: words, hit words (as sorted word spans), items with occurrences and the longest match."""
    shard = Shard(texts, test)
    which, at = shard.find(test)
    out = [{"n_words": int(n), "spans": [], "items": [], "longest": 0, "longest_item": None, "longest_at": None} for n in shard.counts]
    if not len(which):
        return out
    doc = np.searchsorted(shard.begin, at, side="right") - 1
    delta = np.zeros(shard.size + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + test.length[which], -1)
    covered = np.cumsum(delta) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        d = int(np.searchsorted(shard.begin, s, side="right")) - 1
        out[d]["spans"].append((s - int(shard.begin[d]), e - int(shard.begin[d])))
    for d, n in np.unique(np.stack((doc, test.owner[which]), 1), axis=0).tolist():
        out[d]["items"].append(test.ids[n])
    # longest verbatim match: neighbouring windows of one item at neighbouring places
    owner, diagonal = test.owner[which], at - test.offset[which]
    order = np.lexsort((at, diagonal, owner, doc))
    d, o, g, p, size = doc[order], owner[order], diagonal[order], at[order], test.length[which][order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)))
    heads = np.flatnonzero(new)
    run = np.diff(np.concatenate((heads, [len(new)])))
    for h, r in zip(heads.tolist(), (run - 1 + size[heads]).tolist(), strict=True):
        row = out[d[h]]
        if r > row["longest"]:
            row.update(longest=r, longest_item=test.ids[o[h]], longest_at=int(p[h] - shard.begin[d[h]]))
    return out


def blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Collect the test set in blocks of about ``block_bytes`` of text (one item at least), in item order."""
    held, size = [], 0
    for row in items.select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        w = words(row[1])
        if held and size + len(row[1] or "") > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], w))
        size += len(row[1] or "")
    yield held


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 13, block_bytes: int = 8 << 20, shard_chars: int = 8 << 20,
) -> DataFrame:
    """Rows ``(id, n_words, n_hit, items, longest, longest_item, longest_at)``, one for each row of ``docs``.

    A word is hit if it lies in any occurrence of any window. Null or empty texts have no words; null and wordless items
    have no windows; an item id that occurs twice counts once. An empty test set leaves everything clean.
    """
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    schema = pa.schema([
        (id_col, _arrow(kind)), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(_arrow(item_kind))), ("longest", pa.int64()),
        ("longest_item", _arrow(item_kind)), ("longest_at", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("place", pa.int64()),
    ])
    ddl = f"{id_col} {kind.simpleString()}, n_words long, n_hit long, items array<{item_kind.simpleString()}>, longest long, longest_item {item_kind.simpleString()}, longest_at long, spans array<array<long>>"
    tests = blocks(items, item_col, item_text, block_bytes)
    first = next(tests)
    second = next(tests, None)
    if second is not None:
        return _many_blocks(docs, itertools.chain((first, second), tests), id_col, text_col, window, shard_chars, ddl, schema)
    return _pass(docs, first, id_col, text_col, window, shard_chars, ddl, schema)[0].drop("spans")


def _pass(docs, held, id_col, text_col, window, shard_chars, ddl, schema):
    """Find one block's windows in every document: the rows and the broadcast they use."""
    schema = pa.schema([f for f in schema if f.name != "place"])
    shared = docs.sparkSession.sparkContext.broadcast(TestSuffixes(held, window))

    def run(batches):
        test = shared.value
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= shard_chars):
                    size += len(texts[end] or "")
                    end += 1
                rows = scan(texts[at:end], test)
                yield batch({id_col: ids.slice(at, end - at), "n_hit": [sum(e - s for s, e in r["spans"]) for r in rows]} | {k: [r[k] for r in rows] for k in ("n_words", "items", "longest", "longest_item", "longest_at", "spans")}, schema)
                at = end

    return docs.select(id_col, text_col).mapInArrow(run, ddl), shared


def _many_blocks(docs, tests, id_col, text_col, window, shard_chars, ddl, schema) -> DataFrame:
    """One pass for each block, written before the next block is collected, so that one block is held at a time; what the
    passes say of a row is merged by (id, text digest).

    Rows with equal id and text give equal results, so each is computed once and repeated as often as it occurs.
    """
    key = docs.select(F.col(id_col), F.col(text_col), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("_digest"), F.col(text_col).isNull().alias("_null"))
    count = key.groupBy(id_col, "_digest", "_null").agg(F.count("*").alias("_copies"))
    wide = key.select(F.struct(id_col, "_digest", "_null").alias("_k"), text_col)
    parts = None
    kind = wide.schema["_k"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    inner = pa.schema([pa.field("_k", to_arrow_type(kind)) if f.name == id_col else f for f in schema])
    inner_ddl = ddl.replace(f"{id_col} {docs.schema[id_col].dataType.simpleString()}", f"_k {kind.simpleString()}", 1)
    for held in tests:
        one, shared = _pass(wide, held, "_k", text_col, window, shard_chars, inner_ddl, inner)
        one = store(one, "block")
        shared.destroy()
        parts = one if parts is None else parts.unionByName(one)
    best = F.max_by(F.struct("longest", "longest_item", "longest_at"), F.col("longest"))
    merged = parts.groupBy("_k").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), best.alias("b")
    )
    # sum of the union of spans: each adds what lies beyond the furthest end so far
    union = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e")), lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), x[1] - F.greatest(x[0], a["e"]))).alias("n"), F.greatest(a["e"], x[1]).alias("e")))
    merged = merged.select("_k.*", "n_words", union["n"].alias("n_hit"), "items", "b.*")
    joined = merged.join(count.withColumnRenamed(id_col, "_id"), F.col("_id").eqNullSafe(F.col(id_col)) & (merged["_digest"] == count["_digest"]) & (merged["_null"] == count["_null"]))
    return joined.withColumn("_r", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(id_col, "n_words", "n_hit", "items", "longest", "longest_item", "longest_at")


def digest(found: DataFrame, id_col: str = "doc_id", share: int = 20) -> DataFrame:
    """Contract columns: contaminated if hit words make at least one in ``share``."""
    ids = F.array_distinct(F.col("items").cast("array<string>"))
    return found.select(
        id_col, "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest", F.col("longest_item").cast("string").alias("longest_item"), "longest_at",
    )


def affected(row: dict, share: int = 20, window: int = 13) -> bool:
    """Whether a scanned text is affected: it holds a whole window word for word, or the hits of items that are shorter
    than a window make one in ``share`` of its words at least (a benchmark item of a word or two says little by itself)."""
    hit = sum(e - s for s, e in row["spans"])
    return row["longest"] >= window or (hit > 0 and share * hit >= row["n_words"])


def remove(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    share: int = 20, window: int = 13, block_bytes: int = 8 << 20, shard_chars: int = 8 << 20,
) -> DataFrame:
    """Documents without the affected ones (see ``affected``), all columns kept.

    With a test set of one block, rows are dropped where they are read. With more, rows are matched by id and text
    digest, so rows that share an id are judged each by its own text. Null and empty texts have no words and stay, as
    does everything if the test set is empty; repeated rows are all kept or all removed; of columns only id and text are
    looked at, whatever the others are called.
    """
    tests = blocks(items, item_col, item_text, block_bytes)
    first = next(tests)
    if next(tests, None) is None:
        shared = docs.sparkSession.sparkContext.broadcast(TestSuffixes(first, window))
        at = docs.columns.index(text_col)

        def run(batches):
            test = shared.value
            for b in batches:
                texts, keep, done = b.column(at).to_pylist(), [], 0
                while done < len(texts):
                    end, size = done, 0
                    while end < len(texts) and (end == done or size + len(texts[end] or "") <= shard_chars):
                        size += len(texts[end] or "")
                        end += 1
                    keep += [not affected(r, share, window) for r in scan(texts[done:end], test)]
                    done = end
                yield b.filter(pa.array(keep, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    keyed = docs.select(F.struct(F.col(id_col).alias("i"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("d")).alias("_pl_key"), F.col(text_col).alias("_pl_text"))
    bad = find_contamination(keyed, items, "_pl_key", "_pl_text", item_col, item_text, window, block_bytes, shard_chars)
    bad = bad.where(f"longest >= {window} or (n_hit > 0 and {share} * n_hit >= n_words)").select(F.col("_pl_key.i").alias("_pl_i"), F.col("_pl_key.d").alias("_pl_d")).distinct()
    on = F.col(id_col).eqNullSafe(F.col("_pl_i")) & (F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col("_pl_d"))
    return docs.join(bad, on, "left_anti")
