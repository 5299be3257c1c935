"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every word (and every word shape) has a sparse random index vector that follows from its hash. A word's context vector
is the sum of the index vectors of its neighbours in the fitting texts, weighted by distance; words are hashed to a
fixed number of rows, so the table has a fixed size. A document is the mean of its words' vectors beside the mean of
their index vectors. A network with one hidden layer, in numpy, is fitted on labelled rows; a temperature fitted on a
part that the network has not seen turns its output into calibrated probabilities.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, held_out, map_batches, share_of

_WORD = re.compile(WORD)
#: Rows of the word table, its width, non-zero entries of an index vector, neighbours on each side.
ROWS, WIDTH, NONZERO, REACH = 1 << 14, 48, 4, 2
#: The fit reads at most so many labelled rows, those with the smallest hash of their id.
FIT_ROWS = 6000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 64, 0.01, 1e-4


def _shape(word: str) -> str:
    """What a word looks like, not what it says: the kinds of all its characters with runs cut to two, of which the first
    and the last few stand for themselves and all count (a hash of mixed digits and letters has many)."""
    out: list[str] = []
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    if len(out) > 8:
        out = [*out[:4], "\1", *out[-3:], chr(len(out).bit_length())]
    return "\0" + "".join(out)


class _Rows(dict):
    """Table rows of a word and of its shape, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = (zlib.crc32(word.encode("utf-8", "surrogatepass")) % ROWS, zlib.crc32(_shape(word).encode("utf-8", "surrogatepass")) % ROWS)
        return out


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse random index vectors of all rows: ``NONZERO`` entries of +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, WIDTH), np.float32)
    where = np.argsort(rng.random((ROWS, WIDTH)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, where, rng.choice(np.array([-1, 1], np.float32), (ROWS, NONZERO)), 1)
    return out


def word_rows(text: str, known: _Rows) -> np.ndarray:
    """Rows of the words and of their shapes, one line for each word."""
    words = _WORD.findall(text)
    return np.fromiter((x for w in words for x in known[w]), np.int32, 2 * len(words)).reshape(-1, 2)


def context_vectors(texts: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors for each row of the table, scaled to length 1."""
    out = np.zeros((ROWS, WIDTH), np.float32)
    for rows in texts:
        words = rows[:, 0]
        for d in range(1, REACH + 1):
            if len(words) > d:
                np.add.at(out, words[d:], index[words[:-d]] / d)
                np.add.at(out, words[:-d], index[words[d:]] / d)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class QualityModel:
    """Word tables, network weights and temperature."""

    def __init__(self) -> None:
        self.index = index_vectors()
        self.context = np.zeros_like(self.index)
        self.mean, self.scale, self.layers, self.temperature = np.zeros(1), np.ones(1), None, 1.0

    def pool(self, rows: np.ndarray) -> np.ndarray:
        """The document's vector: means of context vectors, of word and of shape index vectors, and its spread."""
        if not len(rows):
            return np.zeros(3 * WIDTH + 3, np.float32)
        words, shapes = np.bincount(rows[:, 0], minlength=ROWS), np.bincount(rows[:, 1], minlength=ROWS)
        a, b = np.flatnonzero(words), np.flatnonzero(shapes)
        wa, wb, n = words[a] / len(rows), shapes[b] / len(rows), len(rows)
        tail = np.array([np.log1p(n) / 10, len(a) / n, -float(wb @ np.log(wb)) / 5], np.float32)
        return np.concatenate([wa @ self.context[a], wa @ self.index[a], wb @ self.index[b], tail]).astype(np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.zeros(len(x))
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))

    def fit(self, texts: list[str], labels: list[int], seed: int = 11) -> QualityModel:
        """Adam on the log-loss over four fifths of the rows; the temperature from the last fifth."""
        y = np.array(labels, float)
        if len(set(labels)) < 2:
            # nothing to learn: a constant, which the temperature leaves alone
            self.layers = (np.zeros((3 * WIDTH + 3, 1)), np.zeros(1), np.zeros(1), (4.0 if labels and labels[0] else -4.0) if labels else 0.0)
            return self
        known = _Rows()
        rows = [word_rows(t, known) for t in texts]
        self.context = context_vectors(rows, self.index)
        x = np.stack([self.pool(r) for r in rows]).astype(float)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        last, rest = order[:cut], order[cut:]
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        z = (x - self.mean) / self.scale
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(rest), max(1, len(rest) // BATCH)):
                h = np.tanh(z[at] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -60, 60))) - y[at]) / len(at)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [z[at].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], np.array([d.sum()])]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = (p[0], p[1], p[2], float(p[3][0]))
        logit = self.logit(x[last])
        loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(y[last] > 0, 1, -1) * logit / t)))
        self.temperature = min(np.geomspace(0.5, 8, 60), key=loss)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> QualityModel:
    """Fit on about ``rows`` labelled rows at most that are not held out; rows are picked by a hash of their id.

    Rows whose label or text is null are left out; repeated labels of a row count once, different ones each. Only the picked rows' texts are joined and reach the driver.
    """
    usable = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_y")).distinct()
    n = usable.count()
    if not n:
        return QualityModel()
    hashed = lambda df: df.where(share_of(F.col(id_col), rows, n))
    picked = hashed(docs.select(id_col, text_col).where(F.col(text_col).isNotNull())).join(hashed(usable), id_col)
    got = sorted(((r[0], r[1], r[2]) for r in picked.select(id_col, text_col, "_y").collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    return QualityModel().fit([r[1] for r in got], [r[2] for r in got])


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= threshold).

    Null and empty texts get the score of a text without words. Map only; repeated rows give repeated results;
    further columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, known = shipped.value, _Rows()

        def one(key, out, text):
            score = round(float(model.probability(model.pool(word_rows(text or "", known))[None].astype(float))[0]), 6)
            return key, out, score, int(score >= threshold)

        return one

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("_out"), text_col), make, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
