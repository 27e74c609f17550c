"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its quantile bins and some pairs of features have a two-way table.  They are learned
by cyclic boosting: round after round, every table in turn gets a shallow tree fitted to what the others leave
unexplained, scaled by a small rate, so no table takes credit that belongs to another.  A score is a sum of bin lookups.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import fold, map_batches, utf8

#: Labelled ids that the model is fitted on, at most.
FIT = 20_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 250, 120, 0.08, 6
#: Added to a leaf's weight; keeps small leaves from extreme values.
SMOOTH = 2.0
THRESHOLD = 0.3
NAMES = ["words", "word_length", "symbols", "upper", "digits", "marks", "shouts", "bars", "distinct", "top_word", "lines", "repeated_lines", "sentences", "wide"]

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>@^~_={}[]\\/"
_MARKS = b"!?.,;:"
_WIDE = bytes(range(128, 256))


def features(text: bytes | None) -> list[float]:
    """Measures of the whole text, one for each of ``NAMES``; an empty text has 0 of everything."""
    b = text or b""
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = sum(map(len, words))
    without = lambda x: (len(b) - len(b.translate(None, x))) / size
    often = Counter(words)
    lines = [x for x in b.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), size / n, without(_SYMBOLS), without(_UPPER), without(_DIGITS), without(_MARKS), b.count(b"!") / n, b.count(b" | ") / n,
        len(often) / n**0.9, max(often.values()) / n, len(lines) / n, 1 - len(set(lines)) / len(lines), b.count(b". ") / n, without(_WIDE),
    ]


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Values by bin of a tree over ordered bins, from the gradients' and hessians' sums; splits by the usual gain."""
    value = np.full(len(g), g.sum() / (h.sum() + SMOOTH))
    if not depth or len(g) < 2:
        return value
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + SMOOTH) + gr**2 / (hr + SMOOTH)
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= g.sum() ** 2 / (h.sum() + SMOOTH) + 1e-12:
        return value
    return np.concatenate((_leaves(g[:at], h[:at], depth - 1), _leaves(g[at:], h[at:], depth - 1)))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each axis of a two-way table: its gain and its values."""
    pad = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = pad(g), pad(h)
    best, most = None, -1.0
    rows, cols = g.shape
    i, j = np.arange(1, rows)[:, None], np.arange(1, cols)[None, :]
    parts = []
    for c in (cg, ch):
        a, top, left, full = c[i, j], c[i, cols], c[rows, j], c[rows, cols]
        parts.append((a, top - a, left - a, full - top - left + a))
    gain = sum(x**2 / (y + SMOOTH) for x, y in zip(*parts, strict=True))
    at = np.unravel_index(gain.argmax(), gain.shape)
    most = float(gain[at])
    vals = [float(x[at] / (y[at] + SMOOTH)) for x, y in zip(*parts, strict=True)]
    best = np.empty_like(g)
    r, c = at[0] + 1, at[1] + 1
    best[:r, :c], best[:r, c:], best[r:, :c], best[r:, c:] = vals
    return most, best


class Model:
    """Bin edges and lookup tables; ``score`` adds them up for a matrix of features."""

    def __init__(self, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]], base: float):
        self.edges, self.tables, self.pairs, self.base = edges, tables, pairs, base

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[_coarse(b[:, i], len(self.tables[i])), _coarse(b[:, j], len(self.tables[j]))]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _coarse(bins: np.ndarray, n: int) -> np.ndarray:
    return bins * min(COARSE, n) // n


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the logistic loss: first the single tables, then the pairs that explain most of the rest.

    With no rows or one class only, every score is the (smoothed) share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    d = len(NAMES)
    if len(y) < 2 or y.min() == y.max():
        return Model([np.empty(0)] * d, [np.zeros(1)] * d, [], base)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(d)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], base)
    b = model.bins(x)
    z = np.full(len(y), base)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            g, h = rest()
            step = RATE * _leaves(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), 2)
            t += step
            z += step[b[:, j]]
    coarse = [_coarse(b[:, j], len(t)) for j, t in enumerate(model.tables)]
    size = [min(COARSE, len(t)) for t in model.tables]

    def table(i: int, j: int) -> tuple[float, np.ndarray, np.ndarray]:
        g, h = rest()
        at = coarse[i] * size[j] + coarse[j]
        gain, values = _quadrants(*(np.bincount(at, v, size[i] * size[j]).reshape(size[i], size[j]) for v in (g, h)))
        return gain, values, at

    able = [(i, j) for i in range(d) for j in range(i) if size[i] > 1 and size[j] > 1]
    chosen = sorted(able, key=lambda ij: -table(*ij)[0])[:PAIRS]
    model.pairs = [(i, j, np.zeros((size[i], size[j]))) for i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            _, values, at = table(i, j)
            t += RATE * values
            z += RATE * values.ravel()[at]
    for k, t in enumerate(model.tables):  # centred tables: the base alone is the mean
        mean = float(t[b[:, k]].mean())
        t -= mean
        model.base += mean
    return model


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(NAMES))


def _below(share: float) -> Column:
    return F.xxhash64("doc_id", F.lit(3)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)) < share


def learn(docs: DataFrame, labels: DataFrame, fit: int = FIT) -> Model:
    """A model from the texts of ``docs`` that ``labels`` (rows to learn from) marks 0 or 1.

    At most ``fit`` labelled ids, the first by hash, are broadcast.  An id labelled both ways is good; of several texts of one
    id the one of the smallest features is taken.  Features are made on the executors.
    """
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    part = known.filter(_below(2 * fit / max(1, known.count()))).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(fit)
    rows = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(part), "doc_id").select("doc_id", "text", "y")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(b.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), b.column("y")], ["doc_id", "x", "y"])

    found = map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>, y int")
    found = found.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).select("x", "y").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(NAMES))
    y = found.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T))  # sums do not depend on where rows came from
    return train(x[order], y[order])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` for each row of ``docs``."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(_matrix(b.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", utf8().alias("text")), run, f"doc_id {kind}, score double, predicted int")


def op3_quality_model(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row of ``docs`` (``doc_id``, ``text``).

    Learned from labels outside the held-out fifth.  A null text is scored as an empty one, a very long text whole; labels
    that are null or of unknown ids are ignored; null ids and repeated rows pass through; an empty table gives none, and
    without labels of both kinds all scores are the share of label 1.
    """
    model = learn(docs.select("doc_id", "text"), labels.filter(fold("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
