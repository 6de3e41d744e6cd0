"""Language identification by cross-parsing (operator 9).

For each language a suffix automaton of labelled text gives longest-match lengths: a text is parsed greedily into the
longest phrases that occur in the language's text. The language that needs the fewest phrases wins, phrases being
weighted by log2 of the length of its text (what naming one phrase of it costs) and divided by the letters parsed.

A phrase never crosses the end of a word (runs of letters, lower-cased, with one space on either side), so the number of
phrases is a sum over words, and words that recur are parsed once in each worker.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.bpe import _arrow
from pathloom.llm.common import batch, crc_mod, held
from pathloom.llm.sampling import labelled_ids

_LETTERS = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """Suffix automaton of one text; only the transitions are kept, which is what longest matches need."""

    def __init__(self, text: str):
        go, link, length = [{}], [-1], [0]
        last = 0
        for c in text:
            cur = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.go = go

    def phrases(self, text: str) -> int:
        """Phrases of the greedy longest-match parse; a character that never occurs is a phrase by itself."""
        go, state, n = self.go, 0, 0
        root = go[0]
        for c in text:
            state = go[state].get(c, 0) if state else 0
            if not state:
                n += 1
                state = root.get(c, 0)
        return n

    def longest_match(self, text: str, start: int) -> int:
        """Length of the longest prefix of ``text[start:]`` that occurs in the automaton's text."""
        state, n = 0, 0
        for c in text[start:]:
            state = self.go[state].get(c)
            if state is None:
                break
            n += 1
        return n


def normal(text: str | None) -> str:
    """Runs of letters, lower-cased, between single spaces."""
    return " " + " ".join(_LETTERS.findall((text or "").lower())) + " "


class Model:
    """Automata of all languages with a memory of parsed words."""

    def __init__(self, texts: dict[str, str], cache_words: int = 400_000, cache_length: int = 64):
        self.languages = sorted(texts)
        self.automata = [SuffixAutomaton(texts[k]) for k in self.languages]
        self.cost = np.array([math.log2(max(2, len(texts[k]))) for k in self.languages])
        self.cache_words, self.cache_length = cache_words, cache_length
        self.forget()

    def forget(self) -> None:
        self.index, self.counts, self.used = _Rows(self), np.zeros((1024, len(self.languages)), np.int32), 0
        self.passing: list[list[int]] = []

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Predicted language and confidence of each text; ``und`` and 0 where there is no letter or no model."""
        out: list[tuple[str, float]] = []
        for text in texts:
            words = _LETTERS.findall(text.lower()) if text else []
            if not words or not self.languages:
                out.append(("und", 0.0))
                continue
            if self.used > self.cache_words:
                self.forget()
            long = [w for w in words if len(w) > self.cache_length]
            known = [w for w in words if len(w) <= self.cache_length] if long else words
            self.passing = []
            rows = np.fromiter(map(self.index.__getitem__, known), np.int64, len(known))
            total = self.counts[rows[rows >= 0]].sum(0, dtype=np.int64)
            if self.passing:
                total = total + np.array(self.passing, np.int64).sum(0)
            for w in long:
                total = total + [a.phrases(f" {w} ") for a in self.automata]
            bits = total * self.cost / (sum(map(len, words)) + 2 * len(words))
            best = int(np.argmin(bits))
            inverse = 1.0 / np.maximum(bits, 1e-9) ** 2
            out.append((self.languages[best], float(inverse[best] / inverse.sum())))
        return out


class _Rows(dict):
    """Row of a word's phrase counts. Words are parsed when met and remembered from their second time on, as most words of a
    large corpus never come again; counts of the others pass by in ``passing`` and have no row."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.once = model, set()

    def __missing__(self, word: str) -> int:
        m, h, padded = self.model, hash(word), f" {word} "
        found = [a.phrases(padded) for a in m.automata]
        if h not in self.once:
            if len(self.once) >= 2 * m.cache_words:
                self.once.clear()
            self.once.add(h)
            m.passing.append(found)
            return -1
        if m.used == len(m.counts):
            m.counts = np.concatenate((m.counts, np.zeros_like(m.counts)))
        m.counts[m.used] = found
        self[word] = m.used
        m.used += 1
        return m.used - 1


def pieces(text: str | None, words: int = 40) -> list[str]:
    """Distinct normalised lines of a text, long ones cut after every so many words; those without a letter are left out."""
    out: dict[str, None] = {}
    for line in (text or "").splitlines():
        found = _LETTERS.findall(line.lower())
        for k in range(0, len(found), words):
            out[" " + " ".join(found[k : k + words]) + " "] = None
    return list(out)


def _sampled(found: list[str], chars: int) -> list[str]:
    """Pieces in the order of their hashes, up to ``chars`` characters together, one at least."""
    out, size = [], 0
    for p in sorted(found, key=lambda p: (xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")), p)):
        if out and size + len(p) > chars:
            break
        out.append(p)
        size += len(p)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 60, chars_per_language: int = 40_000) -> dict[str, str]:
    """Training text by language from a bounded sample of the given rows.

    ``docs_per_language`` whole texts of each language are sampled; of all their distinct lines (in pieces of 40 words)
    those with the smallest hashes are learned from, up to ``chars_per_language`` characters, so every part of every
    sampled text has the same chance. Rows without id, language or a letter are left out before the sample is drawn.
    """
    docs = docs.where(F.col(text_col).rlike(r"\p{L}"))
    ids = labelled_ids(docs, id_col, lang_col, docs_per_language)
    if not ids:
        return {}
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(list(ids.items()), f"_i {kind}, _l string"))
    out = pa.schema([("lang", pa.string()), ("piece", pa.string())])

    def run(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = _sampled(pieces(text.as_py()), chars_per_language)
                yield batch({"lang": [lang] * len(found), "piece": found}, out)

    chosen = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_k")).join(wanted, "_i").where("_k = _l")
    got: dict[str, set[str]] = {}
    for r in chosen.select("_l", "_t").mapInArrow(run, "lang string, piece string").collect():
        got.setdefault(r[0], set()).add(r[1])
    return {k: "".join(_sampled(list(v), chars_per_language)) for k, v in got.items()}


def predict(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, lang_pred, score)`` for every row: whole texts, no shuffle. Ties go to the first language by name.

    Null, empty and letterless texts give ``und`` and 0. The broadcast model is bounded by the fit's parameters.
    """
    kind = docs.schema[id_col].dataType
    out = pa.schema([(id_col, _arrow(kind)), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(texts.items())))

    def run(batches):
        model = held(("langid", shared.value), lambda: Model(dict(shared.value)))
        for b in batches:
            got = model.score(b.column(1).to_pylist())
            yield batch({id_col: b.column(0), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}, out)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> DataFrame:
    """Fit on the rows outside the held-out fold and predict all rows: ``(id, held_out, lang_pred, score)``.

    Null, empty and letterless texts give ``und`` and 0; ties go to the first language by name; a row without id belongs to
    no held-out fold and is never learned from; repeated rows give repeated results; an empty table gives no rows, and a
    table without languages ``und`` throughout; other columns are not looked at.
    """
    fold = crc_mod(id_col, folds)
    texts = fit(docs.where(fold != held_out), id_col, text_col, lang_col)
    return predict(docs, texts, id_col, text_col).select(id_col, F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
