"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples count as labelled; every other text is unlabelled, whatever its label says.  A linear
classifier over words is fitted with numpy under the risk estimator that corrects for the class prior ``pi``:

    pi * R+(positive)  +  max(0, R-(unlabelled) - pi * R-(positive))

with the sigmoid loss; where the second part would turn negative, the step goes the other way, so that a flexible
classifier cannot fit the unlabelled toxic texts as clean.  ``pi`` is estimated without any clean label: a share ``pi`` of
the unlabelled texts are like the confirmed ones, so a feature of the confirmed ones is at least ``pi`` times as frequent
among the unlabelled, and the least such ratio bounds ``pi`` and comes near it where features are peculiar to toxic texts.
Features are the presence of a word, and of one, two or three distinct words with a common beginning, which catches
inflected and compound forms.  They are made, counted and ranked on the executors; the driver gets the ``FEATURES`` best,
and which of them each sampled text has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import fold, map_batches, stored

#: The classifier is fitted on the texts of so many toxic ids at most, and on so many distinct unlabelled texts (expected number).
FIT_TOXIC, FIT_OTHER = 2_000, 3_000
#: Features that the classifier looks at, and lengths of beginnings.
FEATURES = 768
PREFIXES = (5, 6, 7)
SEED, ROUNDS, RATE, DECAY = 7, 600, 0.05, 1e-3
THRESHOLD = 0.7
_edges = re.compile(r"^\W+|\W+$")


def words(text: str | None) -> set[str]:
    """Distinct lower-case words of the whole text, stripped of what surrounds their letters."""
    if not text:
        return set()
    found = set(text.lower().split())
    return {w if w.isalnum() else _edges.sub("", w) for w in found} - {""}


def features(own: set[str]):
    """The features of a text's words: themselves, and each beginning with as many ``*`` as words share it, 1 to 3."""
    yield from own
    for n in PREFIXES:
        for p, c in Counter(map(itemgetter(slice(n)), own)).items():
            if len(p) == n:
                for k in range(1, min(c, 3) + 1):
                    yield p + "*" * k


class Classifier:
    """score = sigmoid(bias + sum of the weights of the known features that a text has)."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: float):
        self.weights = {w: float(weights[i]) for w, i in vocabulary.items()}
        self.bias = bias
        self.starts = {f.rstrip("*") for f in self.weights if f.endswith("*")}

    def _known(self, own: set[str]):
        yield from own & self.weights.keys()
        for n in PREFIXES:
            if found := {w[:n] for w in own if len(w) >= n} & self.starts:
                counts = Counter(w[:n] for w in own if len(w) >= n and w[:n] in found)
                for p, c in counts.items():
                    for k in range(1, min(c, 3) + 1):
                        if (f := p + "*" * k) in self.weights:
                            yield f

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(self.weights[f] for f in self._known(words(text)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _least(n: int) -> int:
    """In how many of ``n`` toxic texts a feature has to be."""
    return max(3, n // 150)


def choose(toxic: list[set], other: list[set], most: int = FEATURES) -> list[str]:
    """The features whose presence says most for confirmed toxic texts: chi-square of presence, rare ones left out."""
    p = Counter(f for d in toxic for f in features(d))
    p = Counter({f: n for f, n in p.items() if n >= _least(len(toxic))})
    u = Counter(f for d in other for f in set(features(d)) & p.keys())

    def gain(w: str) -> float:
        a, b = p[w] / max(1, len(toxic)), u[w] / max(1, len(other))
        both = (p[w] + u[w]) / (len(toxic) + len(other))
        return (a - b) ** 2 / (both * (1 - both) + 1e-9)

    kept = [w for w in p if p[w] * max(1, len(other)) > 2 * u[w] * len(toxic)]
    return sorted(kept, key=lambda w: (-gain(w), w))[:most]


def prior_of(xp: np.ndarray, xu: np.ndarray) -> float:
    """The estimate of ``pi`` from presence in toxic and unlabelled texts.

    Features are joined into events, one after another in the order of the ratio; of the events that at least half of the
    toxic texts have (or else of all features together) the least ratio counts, which single features would bias downward.
    """
    p, u = xp.mean(axis=0), (xu.sum(axis=0) + 1) / (len(xu) + 1)
    order = np.argsort(u / np.maximum(p, 1e-9), kind="stable")
    has = [np.maximum.accumulate(x[:, order] > 0, axis=1).mean(axis=0) for x in (xp, xu)]
    enough = has[0] >= min(0.5, has[0][-1])
    return float(np.clip((has[1][enough] / has[0][enough]).min(), 0.01, 0.5))


def train(toxic: list[set], other: list[set], prior: float | None = None, rounds: int = ROUNDS) -> Classifier:
    """``fit`` on texts that are given as sets of words."""
    names = choose(toxic, other) if toxic and other else []
    at = {w: i for i, w in enumerate(names)}

    def matrix(rows: list[set]) -> np.ndarray:
        x = np.zeros((len(rows), len(names)), np.float32)
        for r, d in enumerate(rows):
            x[r, [at[f] for f in features(d) if f in at]] = 1
        return x

    return fit(names, matrix(toxic), matrix(other), prior, rounds)


def fit(names: list[str], xp: np.ndarray, xu: np.ndarray, prior: float | None = None, rounds: int = ROUNDS) -> Classifier:
    """The non-negative risk minimised by Adam over all rows at once; without toxic examples or features every score is low."""
    if not names:
        return Classifier({}, np.empty(0), -4.0)
    prior = prior_of(xp, xu) if prior is None else prior
    lift = np.log((xp.mean(0) + 1e-3) / (xu.mean(0) + 1e-3)).astype(np.float32)
    w, b = 0.5 * lift, -2.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def loss(x: np.ndarray, y: int) -> tuple[float, np.ndarray, float]:
        """Mean sigmoid loss against y, with its gradients for weights and bias."""
        s = 1 / (1 + np.exp(np.clip(y * (x @ w + b), -60, 60)))
        g = -y * s * (1 - s) / len(x)
        return float(s.mean()), x.T @ g, float(g.sum())

    for t in range(1, rounds + 1):
        _, gp, bp = loss(xp, 1)
        ln, gn, bn = loss(xp, -1)
        lu, gu, bu = loss(xu, -1)
        if lu - prior * ln >= 0:
            g = np.append(prior * gp + gu - prior * gn, prior * bp + bu - prior * bn)
        else:
            g = -np.append(gu - prior * gn, bu - prior * bn)
        g[:-1] += DECAY * w / len(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return Classifier({f: i for i, f in enumerate(names)}, w, b)


def _below(share: float, *cols: str) -> Column:
    """True for about ``share`` of the rows, chosen by hash."""
    unit = F.xxhash64(*cols, F.lit(SEED)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return unit < share


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``words``, ``toxic``, ``other`` of the distinct texts to learn from, stored.

    At most ``FIT_TOXIC`` toxic ids, the first by hash, are broadcast: one pass over the texts, no shuffle of them.  Of the
    texts of one id the one of the fewest words, by order, is taken.  The unlabelled sample is drawn from all texts, as the
    estimator supposes, and copies count once.  Word sets are made on the executors.
    """
    toxic = labels.filter("toxic = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("t_id")).distinct()
    unit = F.xxhash64("t_id", F.lit(SEED))
    ids = toxic.filter(_below(2 * FIT_TOXIC / max(1, toxic.count()), "t_id")).orderBy(unit, "t_id").limit(FIT_TOXIC)
    other = _below(FIT_OTHER / max(1, docs.count()), "doc_id", "text")
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("t_id"), "left").select("text", "t_id", other.alias("other"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(words(t)) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), b.column("t_id"), b.column("other")], ["words", "t_id", "other"])

    found = stored(map_batches(rows.filter("t_id IS NOT NULL OR other"), run, f"words array<string>, t_id {kind}, other boolean"), "toxicity-words")
    of_id = found.filter("t_id IS NOT NULL").groupBy("t_id").agg(F.min(F.struct(F.size("words").alias("n"), "words")).alias("w")).select("w.words", F.lit(True).alias("toxic"), F.lit(False).alias("other"))
    others = found.filter("other").select("words", F.lit(False).alias("toxic"), F.lit(True).alias("other")).distinct()
    return stored(of_id.unionByName(others), "toxicity-sample")


def best(sample: DataFrame, n: int, m: int, most: int = FEATURES) -> list[str]:
    """What ``choose`` gives for ``n`` toxic and ``m`` other texts, counted batch by batch on the executors."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p, u = Counter(), Counter()
        for own, toxic in zip(b.column("words").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            (p if toxic else u).update(features(set(own)))
        names = list(p.keys() | u.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[w] for w in names], pa.int64()), pa.array([u[w] for w in names], pa.int64())], ["feature", "p", "u"])

    found = map_batches(sample, run, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    a, b, both = F.col("p") / n, F.col("u") / m, (F.col("p") + F.col("u")) / (n + m)
    found = found.filter((F.col("p") >= _least(n)) & (F.col("p") * m > 2 * F.col("u") * n))
    gain = (a - b) * (a - b) / (both * (1 - both) + 1e-9)
    return [r.feature for r in found.orderBy(F.desc(gain), "feature").limit(most).select("feature").collect()]


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier from texts of ``docs`` as unlabelled ones and those that ``labels`` (rows to learn from) calls toxic."""
    sample = sampled(docs, labels)
    counts = sample.agg(F.count_if("toxic").alias("n"), F.count_if("other").alias("m")).first()
    names = best(sample, counts.n, counts.m) if counts.n and counts.m else []
    at = {w: i for i, w in enumerate(names)}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(at[f] for f in features(set(own)) if f in at) for own in b.column("words").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column("toxic")], ["on", "toxic"])

    rows = sorted((tuple(r.on), r.toxic) for r in map_batches(sample, run, "on array<int>, toxic boolean").collect()) if names else []  # sums do not depend on where rows came from
    x = {kind: np.zeros((sum(t == kind for _, t in rows), len(names)), np.float32) for kind in (True, False)}
    for kind, own in x.items():
        for r, on in enumerate(o for o, t in rows if t == kind):
            own[r, list(on)] = 1
    return fit(names, x[True], x[False])


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` for each row of ``docs``."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array([model.score(t) for t in b.column("text").to_pylist()], np.float64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row of ``docs`` (``doc_id``, ``text``).

    Learned from labels outside the held-out third.  A null or empty text has no words and gets the score of none; a very
    long text counts whole; labels that are null or of unknown ids are ignored, and one of several for an id is enough; null
    ids and repeated rows pass through; an empty table gives none, and without toxic labels every score is low.
    """
    model = learn(docs.select("doc_id", "text").filter(fold("doc_id", 3) != 1), labels.filter(fold("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
