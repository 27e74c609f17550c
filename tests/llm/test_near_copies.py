"""The pipeline's near-copy stage against a comparison of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from gridframe.llm import near_copies
from tests.conftest import DATA
from tests.llm import naive


def kept(rows):
    """The smallest id of each group, and the pairs of different sets that are linked."""
    of, pairs = naive.similar_groups([t for _, t in rows])
    best = {}
    for g, (k, _) in zip(of, rows, strict=True):
        best[g] = min(best.get(g, k), k)
    return sorted(best.values()), pairs


def test_tables(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    expected, near = kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    out = corpus_pipeline.near_duplicates(spark, docs, f"{DATA}/sf0.01")
    assert out.columns == docs.columns and near
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == expected


@pytest.mark.parametrize("block", [near_copies.BLOCK, 4_000])
def test_crowded_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    r = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    base, line = r.choices(words, k=200), r.choices(words, k=40)
    texts = []
    for _ in range(150):  # many copies with a few other words, of which some pairs are similar and some are not
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(200)] = r.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(line + r.choices(words, k=r.randint(5, 40))) for _ in range(100)]  # a common line
    texts += [" ".join(line), "", None, " \n", "two words", "Two  words"]
    rows = list(enumerate(texts))
    expected, near = kept(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(x.doc_id for x in near_copies.keep_first(df).collect()) == expected and len(near) > 1000
    twice = near_copies.keep_first(df.unionByName(df))
    assert sorted(x.doc_id for x in twice.collect()) == expected
    assert near_copies.keep_first(df.filter("false")).count() == 0


def test_tasks_cover_all_pairs_of_different_groups(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 300)
    rows = [(1, n, 0 if n < 40 else n) for n in range(60)] + [(2, n, n) for n in range(10)] + [(3, n, n % 2) for n in range(4)]
    left = spark.createDataFrame(rows, "shard long, node long, label long")
    weights = left.select("node").distinct().selectExpr("node", "CAST(64 AS BIGINT) AS weight")
    tasks = {}
    for t in near_copies.blocks(left, weights).collect():
        tasks.setdefault((t.shard, t.i, t.j), []).append(t)
    met = set()
    for (shard, i, _), own in tasks.items():
        assert len({t.node for t in own}) == len(own) < 30
        met |= {(shard, *sorted((a.node, b.node))) for a in own for b in own if a.home and a.node != b.node and (i == 0 or not b.home)}
    expected = {(s, a, b) for s, a, x in rows for z, b, y in rows if s == z and a < b and x != y}
    assert expected <= met and len({k[0] for k in tasks}) == 3


def test_compare_finds_all_similar_sets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(80, 120), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 25)).astype(np.uint64)))) for _ in range(300)]
    sets += [np.empty(0, np.uint64), np.array([7], np.uint64)]
    n = len(sets)
    ends = np.cumsum([0, *map(len, sets)])
    fp = np.array([near_copies.majority([s]) for s in sets], np.uint64)
    home = np.arange(n) % 3 > 0
    a, b = near_copies.compare(np.arange(n), np.arange(n), fp, home, True, np.concatenate(sets), ends)
    parent, full = np.arange(n), np.arange(n)
    near_copies._link(parent, a, b)
    for i in range(n):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if (home[i] or home[j]) and c and 9 * c >= 4 * (len(sets[i]) + len(sets[j])):
                near_copies._link(full, np.array([i]), np.array([j]))
    roots = [near_copies._roots(x, np.arange(n)) for x in (parent, full)]
    assert (roots[0] == roots[1]).all() and 1 < len(set(roots[0].tolist())) < n - 50
    for i, j in zip(a, b, strict=True):
        assert 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))
