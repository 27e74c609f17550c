"""SimHash near-duplicates found with vantage-point trees.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles.  Two texts are linked when their
fingerprints differ in at most ``radius`` bits; groups are the connected components of those links.

*Search.*  Fingerprints are made distinct first, so copies cost nothing.  With ``radius`` 2 and two 32-bit halves, two
linked fingerprints differ by at most one bit in one of the halves (pigeonhole), so one vantage-point tree is kept for
each half: its metric is the Hamming distance within that half, a search in it has radius 1, and fewer branches overlap
than in one tree over all 64 bits.  The top of each tree is fitted on a bounded sample (about ``SAMPLE << DEPTH``
fingerprints at most, chosen by hash) and splits every fingerprint into a home shard; by the triangle inequality only
shards whose boundary lies within the radius can hold a partner, and there the fingerprint is sent as a visitor.  A branch
whose fingerprints are alike in the half is split by all 64 bits.  In a shard the tree grows on: ``descend`` splits the home
points by a vantage point, lets queries enter only the sides that the bound allows, and compares exactly in the leaves.  A
task holds the home points of one shard; visitors, which are several times as many, stream past in blocks.  The sample only
balances the tree: no choice of vantage point can lose a link.

*Groups.*  A shard returns a spanning forest of its links (at most one edge a fingerprint), never all pairs, and the
forests are joined by alternating star contraction, each round checkpointed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import map_batches, prepare, scratch_dir, stored, utf8

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Sampled fingerprints for each shard, points that a shard should hold, and the most levels above the shards.
SAMPLE, SHARD, DEPTH = 32, 8_192, 15
LEAF = 128
#: Queries compared with a leaf at once, and visitors of a shard taken together; both bound memory.
BLOCK, VISITORS = 8_192, 65_536
_LANES = np.uint64(0x0101010101010101)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, k: int = SHINGLE):
    """Blocks of the XXH64 values of a text's ``k``-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        yield np.array([h(whole, SEED)], np.uint64)
        return
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(words) - k] + 1))
    ends = np.concatenate((gaps[k - 1 :], [len(whole)]))
    for i in range(0, len(starts), 1 << 16):
        part = zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)
        yield np.array([h(whole[a:b], SEED) for a, b in part], np.uint64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set; byte lanes add up to 255 values before they are widened."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 256):
        part = h[i : i + 255 * 256]
        part = np.concatenate((part, np.zeros(-len(part) % 255, np.uint64))).reshape(255, -1)
        for s in range(8):
            lanes = ((part >> np.uint64(s)) & _LANES).sum(axis=0, dtype=np.uint64)
            out[s::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """The 64-bit fingerprint; 0 for a null text or one without words."""
    return majority(shingle_hashes(text or b"", k))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes; 0 if there are none."""
    n, counts = 0, np.zeros(64, np.int64)
    for h in blocks:
        n += len(h)
        counts += _bit_counts(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, extra: dict | None = None) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a long) and the expressions of ``extra`` for every row of ``docs``."""
    extra = extra or {}
    cols = docs.select("doc_id", utf8().alias("text"), *[c.alias(n) for n, c in extra.items()])
    kinds, names = {f.name: f.dataType.simpleString() for f in cols.schema}, list(extra)  # the columns themselves stay here

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps), *[b.column(n) for n in names]], ["doc_id", "fp", *names])

    return map_batches(cols, run, ", ".join([f"doc_id {kinds['doc_id']}", "fp long", *[f"{n} {kinds[n]}" for n in names]]))


# --- vantage-point trees ---------------------------------------------------------------------------------------------


def _halves(radius: int) -> list[tuple[np.uint64, int]]:
    """(mask, search radius) of each tree: one of two halves holds at most half of the differing bits."""
    low = np.uint64(0xFFFFFFFF)
    return [(low, radius // 2), (~low, radius // 2)]


def _distance(x: np.ndarray, v: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ v) & mask).astype(np.int16)


def _split(points: np.ndarray, mask: np.uint64, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage point among ``points`` and a cut with points on both sides, the most even of a few tried; or None."""
    best = None
    for i in range(4):
        v = points[(seed * 7919 + i * 104729) % len(points)]
        d = _distance(points, v, mask)
        if d.min() == d.max():
            continue
        cut = min(int(np.median(d)), int(d.max()) - 1)
        uneven = abs(int((d <= cut).sum()) * 2 - len(d))
        if best is None or uneven < best[0]:
            best = uneven, v, cut
    return best and best[1:]


def grow(sample: np.ndarray, mask: np.uint64, depth: int) -> list[tuple[int, int, int, int, bool]]:
    """The top of a tree as rows (vantage point, cut, near child, far child, by all bits); a child below 0 is shard ``-child - 1``."""
    nodes: list[list[int]] = []
    shards = 0

    def build(points: np.ndarray, left: int, seed: int, m: np.uint64) -> int:
        nonlocal shards
        found = _split(points, m, seed) if left and len(points) >= 8 else None
        if found is None and left and len(points) >= 8 and m != _ALL:
            m = _ALL  # alike in this half
            found = _split(points, m, seed)
        if found is None:
            shards += 1
            return -shards
        v, cut = found
        near = _distance(points, v, m) <= cut
        at = len(nodes)
        nodes.append([int(v), cut, 0, 0, bool(m == _ALL)])
        nodes[at][2] = build(points[near], left - 1, 2 * seed + 1, m)
        nodes[at][3] = build(points[~near], left - 1, 2 * seed + 2, m)
        return at

    build(sample, depth, 1, mask)
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, tree: list, mask: np.uint64, reach: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, index of the point, is home): the home shard, and each other that the triangle bound cannot rule out."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    todo = [(0 if tree else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, idx, home = todo.pop()
        if not len(idx):
            continue
        if at < 0:
            out.append((-at - 1, idx, home))
            continue
        v, cut, near, far, whole = tree[at]
        d, r = (_distance(points[idx], np.uint64(v), _ALL), radius) if whole else (_distance(points[idx], np.uint64(v), mask), reach)
        a, b = d - r <= cut, d + r > cut
        todo.append((near, idx[a], home[a] & (d[a] <= cut)))
        todo.append((far, idx[b], home[b] & (d[b] > cut)))
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate([np.full(len(i), s, np.int32) for s, i, _ in out]), np.concatenate([i for _, i, _ in out]), np.concatenate([h for _, _, h in out])


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = up


def _link(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of i[k] and j[k] for all k; a smaller index stays root."""
    while len(i):
        i, j = _roots(parent, i), _roots(parent, j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def descend(points: np.ndarray, home: np.ndarray, visit: np.ndarray, mask: np.uint64, reach: int, radius: int, meet: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Call ``meet`` with every pair of a point of ``visit`` and one of ``home`` within ``radius``; all are indices into ``points``.

    A pair within ``radius`` has to be within ``reach`` in the bits of ``mask``, which is what the bounds use.
    """
    todo = [(home, visit, mask, reach, 1)]
    while todo:
        own, ask, m, r, seed = todo.pop()
        if not len(own) or not len(ask):
            continue
        found = _split(points[own], m, seed) if len(own) > LEAF else None
        if found is None and len(own) > LEAF and m != _ALL:
            todo.append((own, ask, _ALL, radius, seed))  # equal in this half: the tree goes on over all bits
            continue
        if found is None:
            mine = points[own]
            for k in range(0, len(ask), BLOCK):
                part = ask[k : k + BLOCK]
                for c in range(0, len(own), LEAF):
                    a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ mine[None, c : c + LEAF]) <= radius)
                    meet(part[a], own[c : c + LEAF][b])
            continue
        v, cut = found
        near = _distance(points[own], v, m) <= cut
        d = _distance(points[ask], v, m)
        todo.append((own[near], ask[d - r <= cut], m, r, 2 * seed + 1 & 0xFFFF))
        todo.append((own[~near], ask[d + r > cut], m, r, 2 * seed + 2 & 0xFFFF))


class Shard:
    """The home points of a shard and the components that are known of them; visitors are asked a block at a time."""

    def __init__(self, half: tuple[np.uint64, int], radius: int):
        self.half, self.radius = half, radius
        self.parts: list[np.ndarray] = []
        self.points: np.ndarray | None = None
        self.waiting: list[np.ndarray] = []

    def add(self, fps: np.ndarray, home: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Take rows, all home points before any visitor; gives edges where enough visitors wait."""
        if home.any():
            self.parts.append(fps[home])
        if not home.all():
            self.waiting.append(fps[~home])
        return self.answer() if sum(map(len, self.waiting)) >= VISITORS else []

    def answer(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Edges (fingerprint, root) that join what the waiting visitors, and at first the home points, link."""
        out = []
        if self.points is None:
            self.points = np.sort(np.concatenate([*self.parts, np.empty(0, np.uint64)]))
            self.parent, self.parts = np.arange(len(self.points)), []
            out.append(self._join(np.arange(len(self.points)), self.points))
        if self.waiting:
            n, asked = len(self.points), np.concatenate(self.waiting)
            self.waiting = []
            out.append(self._join(np.arange(n, n + len(asked)), np.concatenate((self.points, asked))))
        return out

    def _join(self, ask: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.points)
        parent = np.concatenate((self.parent, np.arange(n, len(points))))
        tops = np.flatnonzero(parent == np.arange(len(parent)))  # only these can get another root
        descend(points, np.arange(n), ask, *self.half, self.radius, lambda i, j: _link(parent, i, j))
        root = _roots(parent, tops)
        moved = root != tops
        self.parent = _roots(parent, np.arange(n))
        return points[tops[moved]], points[root[moved]]


def search(rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of each shard's links; ``rows`` (shard, fingerprint, is home) come sorted by shard, home points first."""
    halves, at, open_ = _halves(radius), None, None
    for shard, fps, home in rows:
        starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        for i, j in zip(starts, [*starts[1:], len(shard)], strict=True):
            if shard[i] != at:
                if open_:
                    yield from open_.answer()
                at, open_ = shard[i], Shard(halves[shard[i] % 2], radius)
            yield from open_.add(fps[i:j], home[i:j])
    if open_:
        yield from open_.answer()


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs of ``distinct.fp`` within ``radius`` do."""
    spark = distinct.sparkSession
    prepare(spark)
    depth = max(0, min(DEPTH, math.ceil(math.log2(max(1, n) / SHARD))))
    sample = np.empty(0, np.uint64)
    if depth:
        unit = F.xxhash64("fp").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
        part = distinct.filter(unit < (SAMPLE << depth) / n).select("fp").toArrow()
        sample = np.sort(part.column("fp").to_numpy()).view(np.uint64)
        sample = sample[np.argsort(sample * np.uint64(0x9E3779B97F4A7C15))]  # an order that has nothing to do with the bits compared
    halves = _halves(radius)
    trees = [grow(sample, mask, depth) if depth else [] for mask, _ in halves]

    def send(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = b.column("fp").to_numpy(zero_copy_only=False)
        parts = []
        for t, (mask, reach) in enumerate(halves):
            shard, idx, home = route(fps.view(np.uint64), trees[t], mask, reach, radius)
            parts.append((shard * 2 + t, fps[idx], home))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["shard", "fp", "home"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp", "home")] for b in batches if b.num_rows)
        for a, b in search(((s, f.view(np.uint64), h) for s, f, h in rows), radius):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

    sent = map_batches(distinct.select("fp"), send, "shard int, fp long, home boolean")
    return sent.repartition(2 << depth, "shard").sortWithinPartitions("shard", F.desc("home")).mapInArrow(found, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node reachable) for every node with an edge, by alternating large and small stars.

    A hub's edges meet its minimum in a join that AQE can split; the minimum itself is aggregated before the shuffle.
    """
    scratch_dir(edges.sparkSession)
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").filter("u != v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, extra: dict | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``fp``, ``component_id`` (smallest ``doc_id`` of the group),
    ``label`` (its smallest fingerprint, which tells groups apart even where ids repeat) and ``extra``.

    Needs ``doc_id`` and ``text``; other columns are ignored.  A null text, like an empty one, has fingerprint 0 and is
    linked like any other.  A null ``doc_id`` is a row of its own and never names a group that holds another id.
    Repeated rows give repeated results; an empty table gives none.
    """
    fps = stored(fingerprints(docs, extra), "simhash-fp")
    firsts = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    linked = components(links(firsts, firsts.count(), radius))
    named = linked.join(firsts, linked.node == firsts.fp)
    low = named.groupBy("label").agg(F.min("first").alias("low"))
    lows = named.join(low, "label").select("fp", "label", "low")
    groups = firsts.join(lows, "fp", "left").select("fp", F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id"), F.coalesce("label", "fp").alias("label"))
    groups = stored(groups, "simhash-groups")  # so that the join below is of two plain exchanges, which AQE can split
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id", "label", *(extra or {}))


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest ``doc_id``; all columns stay.

    Rows are told apart by hashes of id and text, so ids may be null or repeated; of equal rows one stays.  The texts are
    shuffled once, and sorted only if a row that stays is there twice, which is looked up first.
    """
    key = row_keys()
    return keep_rows(docs, stored(near_duplicates(docs, radius, key), "simhash-found"), key)


def row_keys() -> dict:
    """Hashes of id and text that tell rows apart."""
    return {"_gf_k1": F.xxhash64("doc_id", "text"), "_gf_k2": F.hash("text", "doc_id")}


def keep_rows(docs: DataFrame, found: DataFrame, key: dict) -> DataFrame:
    """The first row of ``docs`` of each ``label`` of ``found`` (``doc_id``, ``label`` and ``key``, a written table)."""
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_gf_k1", "_gf_k2")).alias("b"))
    keep = best.select("b._gf_k1", "b._gf_k2").distinct()
    out = docs.withColumns(key).join(keep.hint("shuffle_hash"), list(key))
    if not found.groupBy(*key).count().filter("count > 1").join(keep, list(key), "left_semi").isEmpty():
        out = out.withColumn("_gf_n", F.row_number().over(_same_rows(key))).filter("_gf_n = 1")
    return out.select(*[out[c] for c in docs.columns])


def _same_rows(key: dict):
    from pyspark.sql import Window

    return Window.partitionBy(*key).orderBy(*key)


def op1_simhash(docs: DataFrame) -> DataFrame:
    """The digest of ``near_duplicates``: ``doc_id``, ``fingerprint`` as 16 hex digits, ``component_id``."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
