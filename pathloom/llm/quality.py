"""Document quality from a linear-chain conditional random field over lines (operator 8).

Every line is labelled good or bad. A line's features are its own shape (shares of character classes, repetition, length)
and the shapes of the lines before and after it; neighbouring labels are tied by transition weights. Forward-backward
gives each line's marginal; the marginals, weighted by line length, make the document's quality, which a logistic curve
turns into a score. Labels are known for documents only, so in fitting each line of a document carries its label.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.bpe import _arrow
from pathloom.llm.common import batch, crc_mod, held
from pathloom.llm.sampling import labelled_ids, texts_of

#: Character classes: lower or other letter, upper letter, digit, white space, sentence mark, other.
_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _OTHER = range(6)


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _LOWER, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        out[c] = _UPPER if x.isupper() else _LOWER if x.isalpha() else _DIGIT if x.isdigit() else _SPACE if x.isspace() else _MARK if x in ".,;:'\"()-?" else _OTHER
    return out


SHAPE = ("letters", "upper", "digits", "marks", "others", "repeated", "variety", "length", "word_length", "ends", "empty")


def line_shapes(lines: list[str]) -> np.ndarray:
    """One row of shape features for each line; an empty line is all zero but for the last feature."""
    n = len(lines)
    out = np.zeros((n, len(SHAPE)))
    if not n:
        return out
    joined = "\n".join(lines)
    classes = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    sizes = np.fromiter(map(len, lines), np.int64, n)
    begin = np.cumsum(sizes + 1) - sizes - 1
    safe = np.maximum(sizes, 1)
    counts = np.empty((6, n))
    for k in range(6):
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(classes == k)))
        counts[k] = total[begin + sizes] - total[begin]
    letters = counts[_LOWER] + counts[_UPPER]
    out[:, 0] = letters / safe
    out[:, 1] = counts[_UPPER] / np.maximum(letters, 1)
    out[:, 2] = counts[_DIGIT] / safe
    out[:, 3] = counts[_MARK] / safe
    out[:, 4] = counts[_OTHER] / safe
    words = [x.split() for x in lines]
    total = np.fromiter(map(len, words), np.int64, n)
    kinds = np.fromiter((len(set(w)) for w in words), np.int64, n)
    again = np.fromiter((sum(map(str.__eq__, w, w[1:])) if len(w) > k + 1 else 0 for w, k in zip(words, kinds.tolist(), strict=True)), np.int64, n)
    out[:, 5] = again / np.maximum(total - 1, 1)
    out[:, 6] = kinds / np.maximum(total, 1)
    out[:, 7] = np.log1p(total)
    out[:, 8] = np.minimum(sizes / np.maximum(total, 1), 40) / 10
    out[:, 9] = np.fromiter((x.rstrip()[-1:] in (".", "!", "?", ":", '"') and bool(x.strip()) for x in lines), np.float64, n)
    out[:, 10] = total == 0
    return out


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, lines of each text and the weight (length) of each line. A text has one line at least."""
    split = [(t or "").split("\n") for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    lines = [x for s in split for x in s]
    own = line_shapes(lines)
    start = np.cumsum(counts) - counts
    first = np.zeros(len(lines), bool)
    last = np.zeros(len(lines), bool)
    first[start] = True
    last[start + counts - 1] = True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first] = 0
    after[last] = 0
    mean = np.repeat(np.add.reduceat(own, start, 0) / counts[:, None], counts, 0) if len(lines) else own
    return np.hstack((own, np.square(own), before, after, mean, first[:, None], last[:, None], np.ones((len(lines), 1)))), counts, np.fromiter((len(x) + 1 for x in lines), np.float64, len(lines))


class Chain:
    """Two-label chain: ``weights`` give a line's log-odds of being good, ``ties`` the log-weights of neighbours."""

    def __init__(self, size: int):
        self.weights, self.ties = np.zeros(size), np.zeros((2, 2))
        self.middle, self.scale = np.zeros(size), np.ones(size)
        self.curve = (0.0, 1.0)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -6, 6) @ self.weights

    def marginals(self, odds: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(good) of every line by forward-backward, all texts at once; with ``pairs`` the expected neighbour counts too."""
        order = np.argsort(-counts, kind="stable")
        n = counts[order]
        start = (np.cumsum(counts) - counts)[order]
        node = np.stack((np.zeros(len(odds)), odds), 1)
        alpha, beta = np.zeros_like(node), np.zeros_like(node)
        longest = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t lines
        t = self.ties
        for k in range(longest):
            at = start[: live[k]] + k
            if k:
                a = alpha[at - 1]
                alpha[at] = node[at] + np.logaddexp(a[:, :1] + t[0], a[:, 1:] + t[1])
            else:
                alpha[at] = node[at]
        for k in range(longest - 2, -1, -1):
            at = start[: live[k + 1]] + k
            b = node[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(t[:, 0] + b[:, :1], t[:, 1] + b[:, 1:])
        both = alpha + beta
        norm = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - norm)
        if not pairs:
            return good
        has = np.ones(len(odds), bool)
        has[(np.cumsum(counts) - 1)] = False
        i = np.flatnonzero(has)
        joint = alpha[i][:, :, None] + t + (node[i + 1] + beta[i + 1])[:, None, :] - norm[i][:, None, None]
        return good, np.exp(joint), i

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 250, ridge: float = 1e-3, rate: float = 0.1) -> None:
        """Maximum likelihood of the line labels by full-batch Adam; deterministic. ``weight``: of each text."""
        self.middle, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        flat = x.std(0) < 1e-6
        self.middle[flat] = 0
        label = np.repeat(y, counts)
        share = np.repeat(weight / counts, counts)
        z = np.clip((x - self.middle) / self.scale, -6, 6)
        m = [np.zeros_like(self.weights), np.zeros_like(self.ties)]
        v = [np.zeros_like(self.weights), np.zeros_like(self.ties)]
        total = weight.sum()
        for step in range(1, steps + 1):
            good, joint, i = self.marginals(z @ self.weights, counts, pairs=True)
            g0 = (z * ((good - label) * share)[:, None]).sum(0) / total + ridge * self.weights
            seen = np.zeros((2, 2))
            np.add.at(seen, (label[i].astype(int), label[i + 1].astype(int)), share[i])
            g1 = ((joint * share[i][:, None, None]).sum(0) - seen) / total + ridge * self.ties
            for k, (p, g) in enumerate(((self.weights, g0), (self.ties, g1))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the good marginals of each text."""
        if not texts:
            return np.zeros(0)
        x, counts, length = features(texts)
        good = self.marginals(self.odds(x), counts)
        start = np.cumsum(counts) - counts
        return np.add.reduceat(good * length, start) / np.add.reduceat(length, start)

    def score(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * self.raw(texts), -50, 50)))


def fit(examples: list[tuple], share: float | None = None) -> Chain:
    """Fit on ``(id, text, label)``; ``share``: part of the labelled rows with label 1, where the sample is balanced."""
    chain = Chain(len(SHAPE) * 5 + 3)
    examples = [e for e in examples if e[1] is not None]
    y = np.array([float(e[2] == 1) for e in examples])
    if not len(y) or y.min() == y.max():
        p = share if share is not None else (float(y.mean()) if len(y) else 0.5)
        p = min(max(p, 0.01), 0.99)
        chain.curve = (float(np.log(p / (1 - p))), 0.0)
        return chain
    texts = [e[1] for e in examples]
    x, counts, _ = features(texts)
    real = share if share is not None and 0 < share < 1 else y.mean()
    weight = np.where(y > 0, real / y.mean(), (1 - real) / (1 - y.mean()))
    chain.fit(x, counts, y, weight)
    raw = chain.raw(texts)
    a, b = 0.0, 4.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * raw, -50, 50)))
        off, w = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.array([off.sum() + 0.01 * a, (off * raw).sum() + 0.01 * b])
        h = np.array([[w.sum() + 0.01, (w * raw).sum()], [(w * raw).sum(), (w * raw * raw).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    chain.curve = (float(a), float(b))
    return chain


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, per_class: int = 1000, max_chars: int = 20_000) -> Chain:
    """Fit on at most ``per_class`` labelled rows of each label outside the held-out fold, texts up to ``max_chars``."""
    rows = labels.where(crc_mod(id_col, folds) != held_out)
    ids = labelled_ids(rows, id_col, label_col, per_class)
    share = rows.select(F.avg((F.col(label_col) == 1).cast("int"))).head()[0]
    return fit(texts_of(docs, ids, id_col, text_col, max_chars), share)


def score_batches(chain: Chain, texts: list[str | None], chars: int = 1 << 19):
    """Scores of many texts, in groups of about ``chars`` characters."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= chars):
            size += len(texts[end] or "")
            end += 1
        out.append(chain.score(texts[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0)


def score_table(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, score)`` for every row: whole texts, no shuffle. Null counts as an empty text, which is one empty line."""
    kind = docs.schema[id_col].dataType
    out = pa.schema([(id_col, _arrow(kind)), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        held("quality", dict)
        for b in batches:
            yield batch({id_col: b.column(0), "score": score_batches(shared.value, b.column(1).to_pylist())}, out)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, threshold: float = 0.3, **options) -> DataFrame:
    """Fit and score: ``(id, held_out, score, predicted)`` for every row."""
    chain = learn(docs, labels, id_col, text_col, folds=folds, held_out=held_out, **options)
    return score_table(docs, chain, id_col, text_col).select(
        id_col, F.coalesce(crc_mod(id_col, folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows whose text scores at least ``threshold``, all columns kept; rows are filtered where they are read.

    Null and empty texts are scored as one empty line; a score equal to the threshold stays; repeated rows are all kept or
    all dropped; an empty table gives no rows; of columns only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index(text_col)

    def run(batches):
        held("quality", dict)
        for b in batches:
            yield b.filter(pa.array(score_batches(shared.value, b.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
