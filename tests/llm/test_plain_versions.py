"""Trained models and images against plain versions: scorers by loops, trainers on collected samples, PNG and cosines by definition."""

import bisect
import hashlib
import math
import re
import statistics
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.llm import media, quality_model, toxicity
from gridframe.llm.common import fold
from tests.conftest import DATA
from tests.llm import naive

LONG = "ein sehr langer Text ohne Ende " * 30_000
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (None, "vile words for no one")]


@pytest.fixture(scope="module")
def tables(spark):
    d = f"{DATA}/sf0.01"
    edge = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("doc_id", -F.col("doc_id"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").unionByName(edge), spark.read.parquet(f"{d}/labels.parquet")


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


# --- toxicity ---


def plain_features(text):
    words = {re.sub(r"^\W+|\W+$", "", w) for w in (text or "").lower().split()} - {""}
    found = set(words)
    for n in (5, 6, 7):
        for start, k in Counter(w[:n] for w in words if len(w) >= n).items():
            found |= {start + "*" * i for i in range(1, min(k, 3) + 1)}
    return found


def test_toxicity_is_the_plain_trainer_and_scorer(tables):
    docs, labels = tables
    learn_from = docs.filter(fold("doc_id", 3) != 1), labels.filter(fold("doc_id", 3) != 1)
    model = toxicity.learn(*learn_from)
    sample = toxicity.sampled(*learn_from).collect()
    key = lambda r: r.words
    toxic, other = ([set(r.words) for r in sorted(sample, key=key) if r[kind]] for kind in ("toxic", "other"))
    names = toxicity.choose(toxic, other)
    assert names == list(model.weights) and 0 < len(names) <= toxicity.FEATURES
    ids = {r.doc_id for r in learn_from[1].filter("toxic = 1").collect()} & {r.doc_id for r in learn_from[0].collect()}
    assert len(toxic) == len(ids)  # all of them, being fewer than the bound
    plain = toxicity.train(toxic, other)
    assert np.allclose([model.weights[f] for f in names], [plain.weights[f] for f in names], atol=1e-3) and abs(model.bias - plain.bias) < 1e-3
    out = toxicity.op7_toxicity(docs, labels).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        expected = sigmoid(model.bias + sum(model.weights.get(f, 0.0) for f in plain_features(texts[r.doc_id])))
        assert abs(r.score - expected) < 1e-5 and r.predicted == (r.score >= 0.7) and r.held_out == (naive.fold(r.doc_id, 3) == 1)
    nothing = sigmoid(model.bias)
    assert [abs(r.score - nothing) < 1e-9 for r in out if r.doc_id in (-1, -2, -3)] == [True] * 3 and nothing < 0.3


def test_toxicity_sample_is_bounded_where_rows_repeat(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_TOXIC", 20)
    rows = [(1, f"foul copy {k % 3}") for k in range(3000)] + [(i, f"foul text {i}") for i in range(2, 400)] + [(None, "same")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(1, 300).selectExpr("id AS doc_id", "1 AS toxic")
    sample = toxicity.sampled(docs, labels).collect()
    assert 0 < sum(r.toxic for r in sample) <= 20 and len(sample) <= 500
    assert all(0 < x < 0.5 for x in (toxicity.learn(docs, labels).score("clean"),))


def test_prior_is_estimated_without_clean_labels():
    rng = np.random.default_rng(2)
    toxic = rng.random((400, 30)) < np.append(np.full(4, 0.6), np.full(26, 0.2))
    clean = rng.random((3600, 30)) < np.append(np.zeros(4), np.full(26, 0.2))
    unlabelled = np.concatenate((rng.random((400, 30)) < np.append(np.full(4, 0.6), np.full(26, 0.2)), clean))
    assert abs(toxicity.prior_of(toxic.astype(np.float32), unlabelled.astype(np.float32)) - 0.1) < 0.03


# --- quality ---


def plain_measures(text):
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", b)
    if not words:
        return [0.0] * len(quality_model.NAMES)
    n, size = len(words), sum(map(len, words))
    share = lambda chars: sum(b.count(bytes([c])) for c in chars) / size
    lines = [x for x in b.split(b"\n") if re.search(rb"[^\x20\x09-\x0d]", x)]
    often = Counter(words)
    return [
        math.log1p(n), size / n, share(b"#*$%&|<>@^~_={}[]\\/"), share(range(65, 91)), share(b"0123456789"), share(b"!?.,;:"), b.count(b"!") / n, b.count(b" | ") / n,
        len(often) / n**0.9, max(often.values()) / n, len(lines) / n, 1 - len(set(lines)) / len(lines), b.count(b". ") / n, share(range(128, 256)),
    ]


def plain_score(model, x):
    at = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, x, strict=True)]
    z = model.base + sum(float(t[k]) for t, k in zip(model.tables, at, strict=True))
    for i, j, t in model.pairs:
        z += float(t[at[i] * t.shape[0] // len(model.tables[i]), at[j] * t.shape[1] // len(model.tables[j])])
    return sigmoid(z)


def test_quality_is_the_plain_scorer(tables):
    docs, labels = tables
    held = labels.filter(fold("doc_id", 5) != 0)
    model = quality_model.learn(docs, held)
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in held.filter("quality IS NOT NULL").collect() if r.doc_id in texts}
    x = np.array([plain_measures(texts[i]) for i in known])
    y = np.array(list(known.values()), float)
    order = np.lexsort((y, *x.T))
    plain = quality_model.train(x[order], y[order])
    out = quality_model.op3_quality_model(docs, labels).collect()
    for r in out:
        expected = plain_score(model, plain_measures(texts[r.doc_id]))
        assert abs(r.score - expected) < 1e-9 and r.predicted == (r.score >= 0.3) and r.held_out == (naive.fold(r.doc_id, 5) == 0)
    assert np.allclose(model.score(x), plain.score(x), atol=1e-6)
    empty = [r.score for r in out if r.doc_id in (-1, -2, -3)]
    assert len(set(empty)) == 1 and len([r for r in out if r.doc_id == -4]) == 2


def test_quality_learns_from_a_bounded_number_of_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c")] * 2000 + [(i, f"text {i}") for i in range(2, 300)], "doc_id long, text string")
    labels = spark.range(1, 300).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    seen = []
    monkeypatch.setattr(quality_model, "train", lambda x, y: seen.append(len(y)) or quality_model.Model([np.empty(0)] * 14, [np.zeros(1)] * 14, [], 0.0))
    quality_model.learn(docs, labels, fit=50)
    quality_model.learn(docs, labels)
    assert 0 < seen[0] <= 50 and seen[1] == 299


# --- images ---


def plain_png(payload):
    """A PNG of 64 three-byte pixels a row, every byte less the one of the pixel to its left."""
    raw = bytearray()
    for y in range(0, len(payload), 192):
        row = payload[y : y + 192]
        raw.append(1)
        raw += bytes((row[i] - (row[i - 3] if i >= 3 else 0)) % 256 for i in range(192))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = zlib.compress(bytes(raw), 1)
    assert len(data) < media.IDAT
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 192, 8, 2, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def plain_hash(payload):
    height = len(payload) // 192
    grey = [[sum(payload[y * 192 + 3 * x : y * 192 + 3 * x + 3]) / 3 for x in range(64)] for y in range(height)]
    stretch = lambda n, k: range(k * n // 32, (k + 1) * n // 32) if n >= 32 else [k * n // 32]
    small = [[statistics.fmean(grey[y][x] for y in stretch(height, r) for x in stretch(64, c)) for c in range(32)] for r in range(32)]
    wave = [[math.cos(math.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)]
    low = [round(sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    return low, middle


def test_media_is_the_plain_image(tables):
    docs, _ = tables
    some = docs.filter("length(text) < 4000 OR text IS NULL OR doc_id < 0").limit(60).collect() + docs.filter("doc_id < 0").collect()
    texts = {r.doc_id: (r.text or "").encode() for r in some}
    checked = 0
    for r in media.op5_media(docs).collect():
        if r.doc_id not in texts:
            continue
        b = texts[r.doc_id]
        payload = b + b" " * (-len(b) % 192 or 192 * (not b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        if len(payload) < 100_000:
            png = plain_png(payload)
            assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
            low, middle = plain_hash(payload)
            bits = bin(int("1" + r.feature, 16))[3:]
            assert all((x > middle) == (bit == "1") or abs(x - middle) < 1e-4 for x, bit in zip(low, bits, strict=True))
            checked += 1
    assert checked > 40


def test_damaged_images_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, "more"), (3, None), (None, "x"), (5, "y")], "doc_id long, text string")
    spoilt = F.when(F.col("doc_id") == 2, F.expr("overlay(media PLACING X'00' FROM 50)")).when(F.col("doc_id") == 5, F.expr("substring(media, 1, 30)")).when(F.col("doc_id") == 3, None).otherwise(F.col("media"))
    out = {r.doc_id: r for r in media.read_media(media.as_media(docs).withColumn("media", spoilt)).collect()}
    assert out[1].fault is None and out[None].fault is None and out[1].payload_bytes == 192 and len(out[1].hash) == 8
    assert out[2].fault and out[2].hash is None and out[5].fault and out[3].fault == "no image"
    assert media.read_media(media.as_media(docs).filter("false")).count() == 0
