"""SimHash near-duplicates of the pipeline: five-word shingles with a Jaccard similarity of at least 0.8.

``simhash`` has the fingerprints, the vantage-point tree and the components; this module gives them the shards and the exact
check that the wide setting needs.

*Shards.*  Two texts of similarity 0.8 differ by about 10 of 64 fingerprint bits and by up to 18, a radius at which triangle
bounds prune nothing between unrelated texts, whose distance is 32: a tree over the whole corpus would compare all with all.
So the shards of this setting are not cut by the tree itself.  Texts with equal sets of shingles are one node.  A node is in
``BANDS`` shards, each named by the hash of ``ROWS`` minima of its permuted shingle hashes; two nodes of similarity ``s``
share a shard with probability ``1 - (1 - s**ROWS)**BANDS``, 0.999997 at 0.8.  Shards with the same nodes are one.

*Search.*  In a shard all nodes are first compared with two of them, which joins a crowd of copies in work linear in its
size.  Where a shard still holds several groups, a vantage-point tree over its fingerprints finds every pair within
``RADIUS`` bits, and a pair of different groups is linked if its sets are similar enough by exact comparison.  The largest
group of a shard is never compared with itself.  Shards above ``BLOCK`` shingles are cut into blocks, of which each pair is a
task of its own, so that no task holds more than two blocks; the work of a shard is at most the product of the shingles in
its largest group and those outside of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import map_batches, prepare, stored, utf8
from gridframe.llm.simhash import _ALL, _link, _roots, components, descend, keep_rows, majority, row_keys, shingle_hashes

SHINGLE = 5
#: The least similarity as a fraction, and the most bits by which fingerprints of similar sets differ.
SIMILAR = (4, 5)
RADIUS = 24
BANDS, ROWS = 24, 4
#: Shingles that are permuted at once; bounds the memory of a long text.
PERMUTE = 4_096
#: Shingles in a block of a shard (a text counts ``LEAST`` at least, so that short texts do not crowd a block).
BLOCK, LEAST = 1_000_000, 64
_random = np.random.default_rng(42)
_XOR, _TIMES = _random.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(32)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; a text of fewer words is one shingle, one without words has none."""
    blocks = list(shingle_hashes(text or b"", SHINGLE))
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


def shards(found: np.ndarray) -> np.ndarray:
    """The ``BANDS`` shards of a set of shingles."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), PERMUTE):
        h = (found[None, i : i + PERMUTE] ^ _XOR) * _TIMES
        np.minimum(low, ((h ^ (h >> _SHIFT)) * _TIMES[::-1]).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def _signatures(docs: DataFrame, key: dict) -> DataFrame:
    """``doc_id``, the row keys, ``node`` (a hash of the set of shingles) and ``shards`` of every row."""
    cols = docs.select("doc_id", utf8().alias("text"), *[c.alias(n) for n, c in key.items()])
    kinds, names = {f.name: f.dataType.simpleString() for f in cols.schema}, ["doc_id", *key]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        nodes, bands = [], []
        for t in b.column("text"):
            s = shingles(t.as_py())
            nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SHINGLE))
            bands.append(shards(s))
        flat = pa.array(np.concatenate(bands).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
        return pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(np.array(nodes, np.uint64).view(np.int64)), lists], [*names, "node", "shards"])

    return map_batches(cols, run, ", ".join([*[f"{n} {kinds[n]}" for n in names], "node long, shards array<long>"]))


def _sets(texts: DataFrame) -> DataFrame:
    """``node``, ``fp`` (the fingerprint of the set), ``shingles`` of every row of ``texts`` (``node``, ``text``)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py()) for t in b.column("text")]
        fps = np.array([majority([s]) for s in sets], np.uint64).view(np.int64)
        lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([b.column("node"), pa.array(fps), lists], ["node", "fp", "shingles"])

    return map_batches(texts.select("node", utf8().alias("text")), run, "node long, fp long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar enough, by exact comparison."""
    p, q = SIMILAR
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(a, "a").join(b, "b").filter(common * (p + q) >= (F.size("s_a") + F.size("s_b")) * p).select("a", "b")


class Sets:
    """Sets of shingles, of which pairs are compared and joined."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, labels: np.ndarray):
        _, self.values = np.unique(values, return_inverse=True)
        self.starts, self.sizes = ends[:-1], np.diff(ends)
        self.mark = np.zeros(int(self.values.max(initial=0)) + 1, bool)
        self.parent = np.arange(len(labels))
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        _link(self.parent, self.parent.copy(), first[of])
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def _common(self, one: int, many: np.ndarray) -> np.ndarray:
        """Elements that set ``one`` has in common with each of ``many``, none of which is empty."""
        own = self.values[self.starts[one] : self.starts[one] + self.sizes[one]]
        self.mark[own] = True
        n = self.sizes[many]
        begins = np.cumsum(n) - n
        out = np.add.reduceat(self.mark[self.values[np.repeat(self.starts[many] - begins, n) + np.arange(n.sum())]], begins, dtype=np.int64)
        self.mark[own] = False
        return out

    def meet(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join those of the pairs that are similar enough; pairs that are joined already are not compared."""
        p, q = SIMILAR
        low, high = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        on = (low * q >= high * p) & (low > 0)
        i, j = i[on], j[on]
        apart = _roots(self.parent, i) != _roots(self.parent, j)
        i, j = i[apart], j[apart]
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        cuts = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1], [True]))) if len(j) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            one, many = int(j[a]), i[a:b]
            many = many[_roots(self.parent, many) != _roots(self.parent, j[a : a + 1])]
            if not len(many):
                continue
            many = many[self._common(one, many) * (p + q) >= (self.sizes[many] + self.sizes[one]) * p]
            if len(many):
                same = np.full(len(many), one)
                _link(self.parent, many, same)
                self.links.append((many, same))


def compare(node: np.ndarray, label: np.ndarray, fp: np.ndarray, home: np.ndarray, inner: bool, values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of nodes of one task: of those that are not ``home``, and if ``inner`` of the home nodes too, with home nodes."""
    sets = Sets(values, ends, label)
    mine, others = np.flatnonzero(home), np.flatnonzero(~home)
    descend(fp, mine, np.concatenate((others, mine)) if inner else others, _ALL, RADIUS, RADIUS, sets.meet)
    a, b = (np.concatenate([x[k] for x in sets.links]) if sets.links else np.empty(0, np.int64) for k in (0, 1))
    return node[a], node[b]


def _many(first: Column, n: Column) -> Column:
    """The ``n`` whole numbers from ``first`` on."""
    return F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<long>"))


def blocks(left: DataFrame, weights: DataFrame) -> DataFrame:
    """``shard``, ``node``, ``label``, ``i``, ``j``, ``home`` of every task (``shard``, ``i``, ``j``) that a member of ``left`` takes part in.

    Home nodes of a task are block ``j`` of the nodes outside the shard's largest group; the others are block ``i`` of the
    largest group or a later block outside of it.  ``i`` is 0 in the task that compares block ``j`` with itself.
    """
    rows = left.join(weights, "node")
    by = rows.groupBy("shard", "label").agg(F.sum("weight").alias("w"))
    by = by.groupBy("shard").agg(F.max(F.struct("w", "label")).alias("most"), F.sum("w").alias("w"))
    parts = lambda w: F.ceil(w / BLOCK).cast("long")
    by = by.select("shard", F.col("most.label").alias("main"), parts(F.col("most.w")).alias("p"), parts(F.col("w") - F.col("most.w")).alias("q"))
    rows = rows.join(by, "shard").withColumn("is_main", F.col("label") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("p")).otherwise(F.col("q"))))
    at = lambda i, j, home: F.struct(i.alias("i"), j.alias("j"), F.lit(home).alias("home"))
    own, p, q, zero = F.col("own"), F.col("p"), F.col("q"), F.lit(0).cast("long")
    main = F.transform(_many(zero, q), lambda j: at(own, j, False))
    homes = F.transform(F.concat(_many(zero, p), _many(p + own + 1, q - own - 1)), lambda i: at(i, own, True))
    visits = F.transform(_many(zero, own), lambda j: at(p + own, j, False))
    return rows.withColumn("t", F.explode(F.when(F.col("is_main"), main).otherwise(F.concat(homes, visits)))).select("shard", "node", "label", "t.i", "t.j", "t.home")


def searched(tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified edges (``a``, ``b``) of all tasks."""

    def run(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_numpy() for c in ("node", "label", "fp", "home")}
        lists = t.column("shingles").combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
        a, b = compare(cols["node"], cols["label"], cols["fp"].view(np.uint64), cols["home"], t.column("i")[0].as_py() == 0, values, ends - ends[0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    prepare(tasks.sparkSession)
    return tasks.join(sets, "node").groupBy("shard", "i", "j").applyInArrow(run, "a long, b long")


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) with the components of all similar pairs that share a shard; ``members`` has ``shard``, ``node``."""
    pivots = members.groupBy("shard").agg(F.min("node").alias("p0"), F.min_by("node", F.xxhash64("node")).alias("p1"))
    to = members.join(pivots, "shard").select("node", F.explode(F.array("p0", "p1")).alias("pivot")).filter("node != pivot")
    first = stored(similar(to.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), sets), "near-first")
    named = members.join(components(first).withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("shard", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("shard").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low != high AND size > 2")
    left = stored(named.join(mixed.select("shard"), "shard"), "near-left")
    weights = sets.select("node", F.greatest(F.size("shingles"), F.lit(LEAST)).cast("long").alias("weight"))
    return first.unionByName(searched(stored(blocks(left, weights), "near-tasks"), sets))


def _shared(nodes: DataFrame) -> DataFrame:
    """``shard``, ``node`` of shards of several nodes; of shards with the same nodes one."""
    every = nodes.select("node", F.explode("shards").alias("shard"))
    sums = [F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"d{k}") for k in (1, 2)]
    by = every.groupBy("shard").agg(F.count("*").alias("size"), *sums).filter("size > 1")
    return every.join(by.groupBy("size", "d1", "d2").agg(F.min("shard").alias("shard")).select("shard"), "shard").select("shard", "node")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest ``doc_id``; all columns stay.

    Groups are the connected components of the similar pairs.  Null texts are like empty ones, which are copies of each
    other; ids may be null or repeated, and of equal rows one stays; very long texts count whole; an empty table gives none.
    """
    key = row_keys()
    rows = stored(_signatures(docs, key), "near-signatures")
    nodes = rows.groupBy("node").agg(F.min(F.struct(*key, "shards")).alias("r"))
    nodes = stored(nodes.select("node", *[f"r.{k}" for k in key], "r.shards"), "near-nodes")
    members = stored(_shared(nodes), "near-members")
    chosen = stored(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", *key), "near-chosen")  # broadcast if it is small
    texts = docs.select("doc_id", "text").withColumns(key).join(chosen, list(key)).select("node", "text")
    sets = stored(_sets(texts).groupBy("node").agg(F.first(F.struct("fp", "shingles")).alias("s")).select("node", "s.*"), "near-sets")
    groups = stored(components(links(members, sets)).withColumnRenamed("node", "n"), "near-groups")
    found = rows.join(groups, F.col("node") == F.col("n"), "left").select("doc_id", *key, F.coalesce("label", "node").alias("label"))
    return keep_rows(docs, stored(found, "near-found"), key)
