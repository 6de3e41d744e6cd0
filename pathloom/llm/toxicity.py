"""Toxicity from the nearest labelled examples by exact TF-IDF cosine (operator 5).

Terms are words and word beginnings, weighted by inverse document frequency and by how much their presence says about the
label. The labelled examples are unit vectors in an inverted index of blocks. For each term and block the
index holds the largest weight in the block; the sum of these over a text's terms bounds every cosine in the block, so
blocks are scored in order of their bound until the bound falls below the k-th best cosine: the k nearest are exact.
Votes are weighted by closeness and calibrated on the examples themselves, each scored without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.bpe import _arrow
from pathloom.llm.common import batch, crc_mod, held
from pathloom.llm.sampling import labelled_ids, texts_of

_LETTERS = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)


def word_terms(word: str) -> list[str]:
    """Terms of one lower-cased word: itself and its beginnings (marked by a caret)."""
    return [word, *("^" + word[:n] for n in STARTS if len(word) > n)]


class Index:
    """Labelled unit vectors in blocks with the largest weight of each term in each block.

    A term's weight is its inverse document frequency times its relevance, chi2² / (chi2² + doubt²), where chi2 tells how
    strongly its presence goes with the label. Terms below min_chi2 (3.84: presence that one unrelated term in twenty
    shows) have no weight; the vocabulary has no other bound than the examples. k: votes for each text; share: part of
    the labelled rows that have label 1, where the sample was balanced (else that of the sample).
    """

    def __init__(self, examples: list[tuple], min_chi2: float = 3.84, doubt: float = 40.0, block: int = 128, k: int = 9, share: float | None = None):
        self.k, self.block = k, block
        sets = [set(chain.from_iterable(map(word_terms, set(_LETTERS.findall((t or "").lower()))))) for _, t, _ in examples]
        y = np.array([int(label == 1) for _, _, label in examples], np.float64)
        n, positive = len(y), float(y.sum())
        real = share if share is not None and 0 < share < 1 else (positive + 1) / (n + 2)
        # an example stands for as many labelled rows as its label has for each one sampled
        ratio = (real / (1 - real)) / ((positive + 1) / (n - positive + 1))
        stands = np.where(y > 0, ratio, 1.0)
        self.prior = real
        have = Counter(chain.from_iterable(sets))
        having = Counter(chain.from_iterable(s for s, label in zip(sets, y, strict=True) if label))
        scored = []
        for term, df in have.items():
            a = having[term]
            if df >= 2 and 0 < positive < n and df < n:
                chi2 = n * (a * n - df * positive) ** 2 / (df * (n - df) * positive * (n - positive))
                if chi2 >= min_chi2:
                    scored.append((-chi2, term, df))
        scored.sort()
        self.terms = {term: i for i, (_, term, _) in enumerate(scored)}
        self.idf = np.array([(math.log((1 + n) / (1 + df)) + 1) * (x * x / (x * x + doubt * doubt)) for x, _, df in scored], np.float64)
        self.known: dict[str, tuple[int, ...]] = {}
        vectors = [self.vector(t) for _, t, _ in examples]
        rows = [i for i, v in enumerate(vectors) if len(v[0])]
        rest = [i for i, v in enumerate(vectors) if not len(v[0])]
        # similar vectors share blocks: the strongest term decides the place
        rows.sort(key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), examples[i][0], i))
        self.ids = [examples[i][0] for i in rows]
        self.labels, self.stands = y[rows], stands[rows]
        self.rank = np.argsort(np.argsort(np.array([f"{x!s:>20}" for x in self.ids]), kind="stable"), kind="stable") if rows else np.zeros(0, np.int64)
        self.bare = (float(y[rest] @ stands[rest]) + self.prior) / (float(stands[rest].sum()) + 1) if rest else self.prior
        self.blocks, tops = [], []
        for b in range(0, len(rows), block):
            dense = np.zeros((len(rows[b : b + block]), len(self.terms)), np.float64)
            for r, i in enumerate(rows[b : b + block]):
                dense[r, vectors[i][0]] = vectors[i][1]
            tops.append(dense.max(0))
            used = np.flatnonzero(tops[-1] > 0)
            place = np.full(len(self.terms), -1, np.int32)
            place[used] = np.arange(len(used))
            self.blocks.append((place, np.ascontiguousarray(dense[:, used].T)))
        self.tops = np.array(tops).T.copy() if tops else np.zeros((len(self.terms), 0))
        self.calibration = (0.0, 1.0)
        if rows and 0 < self.labels.sum() < len(rows):
            votes = np.array([self._vote(*self.nearest(*vectors[i], skip=j)) for j, i in enumerate(rows)])
            self.calibration = _platt(votes, self.labels, self.stands)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit TF-IDF weights of a whole text."""
        known = self.known
        found = []
        for w in _LETTERS.findall((text or "").lower()):
            got = known.get(w)
            if got is None:
                got = tuple(self.terms[t] for t in word_terms(w) if t in self.terms)
                if len(known) > 300_000:
                    known.clear()
                known[w] = got
            if got:
                found += got
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        which, count = np.unique(np.array(found, np.int64), return_counts=True)
        weight = (1 + np.log(count)) * self.idf[which]
        return which, weight / np.sqrt((weight**2).sum())

    def nearest(self, which: np.ndarray, weight: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0; ties go to the smaller id."""
        bounds = weight @ self.tops[which]
        best = np.zeros(0, np.int64)
        cos = np.zeros(0)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or (len(cos) >= self.k and bounds[b] < cos[self.k - 1] - 1e-12):
                break
            place, dense = self.blocks[b]
            at = place[which]
            own = at >= 0
            got = weight[own] @ dense[at[own]]
            if len(cos) >= self.k and got.max(initial=0.0) < cos[self.k - 1] - 1e-12:
                continue
            rows = np.arange(len(got)) + b * self.block
            keep = (got > 0) & (rows != skip)
            best, cos = np.concatenate((best, rows[keep])), np.concatenate((cos, got[keep]))
            order = np.lexsort((self.rank[best], -np.round(cos, 12)))[: self.k]
            best, cos = best[order], cos[order]
        return best, cos

    def _vote(self, best: np.ndarray, cos: np.ndarray) -> float:
        if not len(best):
            return self.bare
        w = self.stands[best] / (1.05 - np.minimum(cos, 1.0))
        return float((w @ self.labels[best] + self.prior) / (w.sum() + 1))

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """Calibrated score and the nearest examples; without any term, the rate of toxic examples without terms."""
        which, weight = self.vector(text)
        if not len(which) or not self.blocks:
            return min(1.0, max(0.0, self.bare)), []
        best, cos = self.nearest(which, weight)
        a, b = self.calibration
        raw = self._vote(best, cos)
        z = a + b * math.log(raw / (1 - raw)) if 0 < raw < 1 else (1e3 if raw >= 1 else -1e3)
        score = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
        return score, [{"example": self.ids[i], "label": int(self.labels[i]), "cosine": float(c)} for i, c in zip(best[:3].tolist(), cos[:3].tolist(), strict=True)]


def _platt(votes: np.ndarray, y: np.ndarray, stands: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic calibration of the votes' log-odds, slightly regularised towards none."""
    x = np.log(votes / (1 - votes))
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -50, 50)))
        off, w = stands * (p - y), stands * p * (1 - p) + 1e-9
        g = np.array([off.sum() + 0.1 * a, (off * x).sum() + 1.0 * (b - 1)])
        h = np.array([[w.sum() + 0.1, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1.0]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], max(0.05, b - step[1])
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score_table(docs: DataFrame, examples: list[tuple], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows ``(id, score, evidence)`` for every row: whole texts, no shuffle.

    ``examples`` are ``(id, text, label)``, bounded by the sample that the caller chose. Null, empty and unknown texts
    score as the examples without a chosen term do; without examples every score is 0.5.
    """
    kind = docs.schema[id_col].dataType
    near = pa.list_(pa.struct([("example", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))
    out = pa.schema([(id_col, _arrow(kind)), ("score", pa.float64()), ("evidence", near)])
    shared = docs.sparkSession.sparkContext.broadcast((tuple(examples), tuple(sorted(options.items()))))

    def run(batches):
        index = held(("toxicity", *shared.value), lambda: Index(list(shared.value[0]), **dict(shared.value[1])))
        for b in batches:
            got = [index.score(t.as_py()) for t in b.column(1)]
            yield batch({id_col: b.column(0), "score": [g[0] for g in got], "evidence": [[e | {"example": str(e["example"])} for e in g[1]] for g in got]}, out)

    ddl = f"{id_col} {kind.simpleString()}, score double, evidence array<struct<example:string,label:int,cosine:double>>"
    return docs.select(id_col, text_col).mapInArrow(run, ddl)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, per_class: int = 1500, max_chars: int = 20_000, **options) -> DataFrame:
    """Fit on at most ``per_class`` labelled rows of each label outside the held-out fold, score every row:
    ``(id, held_out, score, predicted, evidence)``."""
    fold = crc_mod(id_col, folds)
    learn = labels.where(fold != held_out)
    ids = labelled_ids(learn, id_col, label_col, per_class)
    share = learn.select(F.avg((F.col(label_col) == 1).cast("int"))).head()[0]
    options = {"share": share} | options
    scored = score_table(docs, texts_of(docs, ids, id_col, text_col, max_chars), id_col, text_col, **options)
    return scored.select(id_col, F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
