"""BPE encoding and decoding of whole texts (operator 2).

Tree concatenation: a long text is cut into halves, recursively, down to leaves; leaves are encoded in parallel, and
each join re-encodes a growing window of raw text around the cut until the window's tokens agree with the left half on
one side and with the right half on the other. Cuts may fall anywhere, inside words too.

Why agreement is enough: a BPE result is the right one exactly when every two neighbouring tokens are what BPE makes of
their joined text. Tokens left of the left agreement were checked in the left half, those right of the right agreement
in the right half and those between in the window; every neighbouring pair lies wholly in one of the three.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import batch, held

#: Python's str.split() also splits at these, the tokenizers' white space does not hold them.
_EXTRA_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_RUN = 3  # tokens that must agree in a row on either side of a join
_EDGE = 160  # characters at either end of a leaf whose tokens' places are kept for the joins
_NOWHERE = -(1 << 40)  # the place of a token between the edges


class TreeEncoder:
    """Encodes and decodes with one tokenizer file.

    leaf_chars: texts (or unsplit words) up to twice this length are encoded in one go.
    cache_words: distinct words whose ids are remembered in each of two generations.
    """

    def __init__(self, path: str, leaf_chars: int = 4096, cache_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.leaf_chars = leaf_chars
        self.by_words = _drops_white_space(path)
        self.words = _Words(self.tokenizer, cache_words)
        self.window_tokens = 16
        self.reach = 1 + max((len(a.content) for a in self.tokenizer.get_added_tokens_decoder().values()), default=0)

    # -- encoding -----------------------------------------------------------
    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; no ids for null or empty text."""
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) > 2 * self.leaf_chars:
            return self.tree(text)[0].astype("<u4").tobytes()
        return self._short(text)

    def leaves(self, text: str | None) -> int:
        """Leaves of the tree that ``encode`` makes of a text: none for no text, one if it is encoded in one go."""
        return len(cuts(self.leaf_chars, len(text))) - 1 if text and len(text) > 2 * self.leaf_chars else int(bool(text))

    def _short(self, text: str) -> bytes:
        if not self.by_words:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = _SPACE.split(text) if _EXTRA_SPACE.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))

    def leaf(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the start and end of each token in the raw text."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.asarray(e.offsets, np.int64).reshape(-1, 2)
        return np.asarray(e.ids, np.int64), spans[:, 0], spans[:, 1]

    def edged(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``leaf``, but tokens between the edges may have no places: joins look at the edges first.

        Where words are encoded each by itself, what lies between a blank near the start and one near the end is encoded
        word by word; text without such blanks is encoded as a whole.
        """
        first, last = text.find(" ", _EDGE), text.rfind(" ", 0, max(0, len(text) - _EDGE))
        if not self.by_words or not 0 < first < last:
            return self.leaf(text)
        head, tail = self.leaf(text[:first]), self.leaf(text[last:])
        between = np.frombuffer(self._short(text[first:last]), "<u4").astype(np.int64)
        nowhere = np.full(len(between), _NOWHERE, np.int64)
        return tuple(np.concatenate((h, m, t)) for h, m, t in zip(head, (between, nowhere, nowhere), (tail[0], tail[1] + last, tail[2] + last), strict=True))

    def tree(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode the leaves of a text in parallel threads, then join them pairwise."""
        at = cuts(self.leaf_chars, len(text))
        with ThreadPoolExecutor(2) as pool:
            leaves = list(pool.map(lambda k: self.edged(text[at[k] : at[k + 1]]), range(len(at) - 1)))
        return self.join_all(text, at, leaves)

    def join_all(self, text: str, at: list[int], leaves: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Join encoded leaves (offsets relative to each leaf) bottom-up into the encoding of ``text``."""
        level = [(at[k], at[k + 1], (ids, s + at[k], e + at[k])) for k, (ids, s, e) in enumerate(leaves)]
        while len(level) > 1:
            up = [(a[0], b[1], self._join(text, a, b)) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = up + level[len(up) * 2 :]
        return level[0][2]

    def _join(self, text: str, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (begin, middle, (li, ls, le)), (_, end, (ri, rs, re_)) = left, right
        k = self.window_tokens
        while True:
            a, b = max(0, len(li) - k), min(len(ri), k)
            if (a and ls[a] < 0) or (b < len(ri) and re_[b - 1] < 0):
                k *= 2  # the places of these tokens are not known
                continue
            lo = int(ls[a]) if a else begin
            hi = int(re_[b - 1]) if b < len(ri) else end
            if (a and middle - lo < self.reach) or (b < len(ri) and hi - middle < self.reach):
                k *= 2  # a special token that the cut runs through must lie in the window whole
                continue
            wi, ws, we = self.leaf(text[lo:hi])
            ws, we = ws + lo, we + lo
            i = 0 if a == 0 else _agreement(li[a:], ls[a:], le[a:], wi, ws, we, first=True)
            j = len(wi) if b == len(ri) else _agreement(ri[:b], rs[:b], re_[:b], wi, ws, we, first=False)
            if i is not None and j is not None and (a == 0 or b == len(ri) or i[1] <= j[1]):
                head = (li[: a + i[0]], ls[: a + i[0]], le[: a + i[0]]) if a else (li[:0],) * 3
                tail = (ri[j[0] + 1 :], rs[j[0] + 1 :], re_[j[0] + 1 :]) if b < len(ri) else (ri[:0],) * 3
                w0, w1 = (i[1] if a else 0), (j[1] + 1 if b < len(ri) else len(wi))
                if w0 <= w1:
                    return tuple(np.concatenate((h, w[w0:w1], t)) for h, w, t in zip(head, (wi, ws, we), tail, strict=True))
            k *= 2

    # -- decoding -----------------------------------------------------------
    def decode_many(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of several id lists, special tokens kept."""
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


class _Words(dict):
    """Ids of words between white space, encoded when met. Two generations of at most ``limit`` words are kept; a word is
    kept from its second time on, as most words of a large corpus never come again."""

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.tokenizer, self.limit, self.old, self.once = tokenizer, limit, {}, set()
        self.model, self.tails = tokenizer.model, {"": b""}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            plain = _PLAIN.fullmatch(word)
            if plain:
                letters, tail = plain.groups()
                end = self.tails.get(tail)
                if end is None:
                    end = self._whole(tail)
                    if len(self.tails) < 10_000:
                        self.tails[tail] = end
                low = letters.lower()
                stem = self.get(low)
                if stem is None:
                    stem = array("I", [t.id for t in self.model.tokenize(low if low.isascii() else low.translate(_BYTE_CHARS))]).tobytes()
                    if low != word:
                        self._keep(low, stem)
                got = stem + end
            else:
                got = self._whole(word)
            self._keep(word, got)
        else:
            self._put(word, got)
        return got

    def _keep(self, word: str, ids: bytes) -> None:
        h = hash(word)
        if h not in self.once:
            if len(self.once) >= 2 * self.limit:
                self.once.clear()
            self.once.add(h)
        else:
            self._put(word, ids)

    def _put(self, word: str, ids: bytes) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


def _byte_chars() -> dict[int, str]:
    """For letters of two UTF-8 bytes: the printable characters that stand for these bytes in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the characters from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    by_byte = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {c: "".join(by_byte[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_BYTE_CHARS = _byte_chars()
#: Letters that lower-case one to one and compose with nothing before them, then ASCII marks without an apostrophe.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")


def cuts(leaf_chars: int, length: int) -> list[int]:
    """Bounds of the leaves of a text: halves of halves, until none is longer than ``leaf_chars``."""
    parts = 1
    while length / parts > leaf_chars:
        parts *= 2
    return [length * i // parts for i in range(parts + 1)]


def _agreement(ids, starts, ends, wi, ws, we, first: bool):
    """Indexes (in the half, in the window) of a token where _RUN tokens in a row agree: the first or the last such."""
    if len(ids) < _RUN or len(wi) < _RUN:
        return None
    where = {(int(s), int(e), int(t)): n for n, (s, e, t) in enumerate(zip(ws, we, wi, strict=True))}
    same = [where.get((int(s), int(e), int(t)), -(10**9)) for s, e, t in zip(starts, ends, ids, strict=True)]
    spots = range(len(same) - _RUN + 1)
    for p in spots if first else reversed(spots):
        if same[p] >= 0 and all(same[p + d] == same[p] + d for d in range(_RUN)):
            # the token in the middle of the run has an agreeing neighbour on either side
            return p + _RUN // 2, same[p] + _RUN // 2
    return None


@functools.lru_cache(8)
def _drops_white_space(path: str) -> bool:
    """Whether words between white space are encoded each by itself and white space leaves no token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    head, rest = steps[0], steps[1:]
    pattern = (head.get("pattern") or {}).get("Regex", "")
    normal = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
    return (
        head.get("type") == "Split" and head.get("behavior") == "Removed" and head.get("invert") is True
        and r"[^\s" in pattern and r"[\p{L}]+" in pattern and any(x.get("type") == "Lowercase" for x in normal) and any(x.get("type") == "ByteLevel" for x in rest) and r"|\s" not in pattern
        and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") for s in rest)
        and all(s.get("type") in ("NFC", "Lowercase", "Replace") for s in normal)
        and spec.get("post_processor") is None
        and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or a.get("normalized") for a in spec.get("added_tokens", []))
    )


def encoder(path: str, leaf_chars: int = 4096, cache_words: int = 300_000) -> TreeEncoder:
    """One encoder for each Python worker and tokenizer file."""
    return held(("bpe", path, leaf_chars, cache_words), lambda: TreeEncoder(path, leaf_chars, cache_words))


def _as_tokens(enc: TreeEncoder, ids: list[bytes], leaves: list[int]) -> dict[str, list]:
    return {"ids": ids, "n_tokens": [len(x) // 4 for x in ids]}


def _as_digests(enc: TreeEncoder, ids: list[bytes], leaves: list[int]) -> dict[str, list]:
    texts = enc.decode_many([np.frombuffer(x, "<u4") for x in ids])
    return {
        "n_leaves": leaves,
        "n_tokens": [len(x) // 4 for x in ids],
        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
        "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
    }


_TOKEN_FIELDS = [("ids", pa.binary(), "binary"), ("n_tokens", pa.int64(), "long")]
_DIGEST_FIELDS = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string"), ("n_leaves", pa.int64(), "long")]


def _encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, leaf_chars: int, spread_chars: int, finish, fields) -> DataFrame:
    """Encode every whole text; ``finish`` makes the columns ``fields`` of the ids, in the task that encoded them."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    short = slim.where(F.col("text").isNull() | (F.length("text") <= spread_chars))
    long = slim.where(F.length("text") > spread_chars)
    kind = slim.schema["id"].dataType
    out = pa.schema([("id", _arrow(kind)), *((n, t) for n, t, _ in fields)])

    def direct(batches):
        enc = encoder(tokenizer, leaf_chars)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                s = b.slice(k, 256)
                texts = s.column(1).to_pylist()
                yield batch({"id": s.column(0)} | finish(enc, [enc.encode_bytes(t) for t in texts], [enc.leaves(t) for t in texts]), out)

    leaf_schema = pa.schema([("id", _arrow(kind)), ("key", pa.string()), ("leaf", pa.int64()), ("text", pa.string())])

    def split(batches):
        at_of = functools.partial(cuts, leaf_chars)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                key, at = hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), at_of(len(t))
                n = len(at) - 1
                yield batch({"id": [i] * n, "key": [key] * n, "leaf": list(range(n)), "text": [t[at[k] : at[k + 1]] for k in range(n)]}, leaf_schema)

    part_schema = pa.schema([*leaf_schema, ("ids", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])

    def leaves(batches):
        enc = encoder(tokenizer, leaf_chars)
        for b in batches:
            got = [enc.leaf(t.as_py()) for t in b.column(3)]
            cols = {n: [g[k].astype("<u4").tobytes() for g in got] for k, n in enumerate(("ids", "starts", "ends"))}
            yield batch({f.name: b.column(k) for k, f in enumerate(leaf_schema)} | cols, part_schema)

    def joined(key, tab):
        enc = encoder(tokenizer, leaf_chars)
        rows = sorted(tab.to_pylist(), key=lambda r: r["leaf"])
        copies = sum(r["leaf"] == 0 for r in rows)
        rows = rows[::copies]  # the same document twice brings every leaf twice
        at = [0]
        for r in rows:
            at.append(at[-1] + len(r["text"]))
        text = "".join(r["text"] for r in rows)
        ids = enc.join_all(text, at, [tuple(np.frombuffer(r[n], "<u4").astype(np.int64) for n in ("ids", "starts", "ends")) for r in rows])[0]
        done = finish(enc, [ids.astype("<u4").tobytes()], [len(rows)])
        return pa.Table.from_batches([batch({"id": [rows[0]["id"]] * copies} | {k: v * copies for k, v in done.items()}, out)])

    ddl = ", ".join((f"id {kind.simpleString()}", *(f"{n} {t}" for n, _, t in fields)))
    leaf_ddl = f"id {kind.simpleString()}, key string, leaf long, text string"
    a = short.mapInArrow(direct, ddl)
    b = (
        long.mapInArrow(split, leaf_ddl)
        .repartition("id", "key", "leaf")
        .mapInArrow(leaves, f"{leaf_ddl}, ids binary, starts binary, ends binary")
        .groupBy("id", "key")
        .applyInArrow(joined, ddl)
    )
    return a.unionByName(b).withColumnRenamed("id", id_col)


def encode_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 4096, spread_chars: int = 65536) -> DataFrame:
    """Encode every whole text: rows ``(id, ids, n_tokens)``, ids as little-endian unsigned 32-bit integers.

    Texts up to ``spread_chars`` are encoded where they are read, without a shuffle (in-task tree above two leaves).
    Longer ones are cut into leaves that are dealt over the cluster, encoded there and joined, one document at a time.
    Null or empty text gives no ids; repeated rows give repeated results; other columns are ignored; an empty table
    gives no rows.
    """
    return _encoded(docs, tokenizer, id_col, text_col, leaf_chars, spread_chars, _as_tokens, _TOKEN_FIELDS)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 4096, spread_chars: int = 65536) -> DataFrame:
    """Encode and decode whole texts and digest both: ``(id, n_tokens, ids_sha256, decoded_sha256, n_leaves)``.

    The id lists go from encoder to decoder within a task: nothing but the digests leaves it. Rows as in
    ``encode_table``; the digests of no ids are those of empty strings.
    """
    return _encoded(docs, tokenizer, id_col, text_col, leaf_chars, spread_chars, _as_digests, _DIGEST_FIELDS)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decode_table(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """Decode every id list: rows ``(id, text)``, special tokens kept; no ids give an empty text."""
    kind = tokens.schema[id_col].dataType
    out = pa.schema([(id_col, _arrow(kind)), ("text", pa.string())])

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                s = b.slice(k, 256)
                yield batch({id_col: s.column(0), "text": enc.decode_many([np.frombuffer(x or b"", "<u4") for x in s.column(1).to_pylist()])}, out)

    return tokens.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind.simpleString()}, text string")
