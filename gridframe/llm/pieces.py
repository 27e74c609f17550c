"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a group of documents are concatenated, a word that occurs in several places once; a suffix array of that text
is made by prefix doubling; every piece of the vocabulary is binary-searched in it, which gives the range of its occurrences;
the occurrences are edges (start, length, piece), and sorting them by position gives the lattice of the text, which is then
relaxed word by word:

* a unigram model's best path is found by relaxing the edges from left to right;
* a BPE model's segmentation is not a best path, so its edges are relaxed in merge order: of all edges that join two
  neighbouring pieces the one of the highest score (the leftmost of equals) is taken until none is left.

Words can be relaxed alone because no piece of such a vocabulary has a space after another character (this is checked);
a word here is a run of spaces and the characters up to the next one.  A group has about ``GROUP`` characters, an index of
its words about ``INDEX`` bytes; both bound memory and change no result.  Nothing is kept from one group to the next.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import map_batches, map_parts

VOCABULARY = "piece_bpe_32k.model"
#: Characters of documents taken together, bytes of one index, and bytes whose edges are relaxed at once.
GROUP, INDEX, RELAX = 6_000_000, 400_000, 160_000
#: Words of at most so many characters are merged together, as rows of a matrix; longer ones use a heap.
ROWS = (6, 10, 16, 32)
SPACE = "▁"
# fixed values: numbers of piece types and model types in the model file
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_NONE = 1 << 30
_whole = itemgetter(0)  # the text of a match


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + n]
        at += n


class Vocabulary:
    """Pieces, scores and types of a model file, and what encoding needs of its settings."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.fallback, self.prefix, self.charsmap, self.trim = UNIGRAM, False, True, b"", True
        for n, v in _fields(model):
            if n == 1:
                f = dict(_fields(v))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif n == 2:
                f = dict(_fields(v))
                self.kind, self.fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif n == 3:
                f = dict(_fields(v))
                self.charsmap, self.prefix, self.trim = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        self._derive()

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, fallback: bool = False) -> Vocabulary:
        """A vocabulary given directly: (piece, score, type) in the order of ids."""
        self = cls.__new__(cls)
        self.pieces, self.scores, self.types = (list(x) for x in zip(*pieces, strict=True))
        self.kind, self.fallback, self.prefix, self.charsmap, self.trim = kind, fallback, True, b"", False
        self._derive()
        return self

    def _derive(self) -> None:
        if self.charsmap or self.trim or self.kind not in (UNIGRAM, BPE) or USER in self.types or UNUSED in self.types:
            raise ValueError("only unigram and BPE models without normalisation, user-defined or unused pieces are supported")
        if any(SPACE in p.lstrip(SPACE) for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL):
            raise ValueError("a piece has a space after another character")
        self.ids = np.array([i for i, t in enumerate(self.types) if t == NORMAL], np.int64)
        texts = [self.pieces[i].replace(SPACE, " ").encode() for i in self.ids]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.words = -(-self.longest // 8)  # 8-byte words of a padded piece
        padded = b"".join(t.ljust(8 * self.words, b"\0") for t in texts)
        self.keys = np.frombuffer(padded, ">u8").reshape(-1, self.words).astype(np.uint64)
        self.masks = np.frombuffer(b"".join((b"\xff" * len(t)).ljust(8 * self.words, b"\0") for t in texts), ">u8").reshape(-1, self.words).astype(np.uint64)
        # place among all scores, best first; equal scores share a place. Index 0 stands for no piece.
        order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids}, reverse=True))}
        self.place = np.array([_NONE] + [order[s] if t == NORMAL else _NONE for s, t in zip(self.scores, self.types, strict=True)], np.int32)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.lowest = min((self.scores[i] for i in self.ids), default=0.0) - 10.0  # score of a character without a piece
        self.plain = [self._plain(i) for i in range(len(self.pieces))]

    def _plain(self, i: int) -> bytes:
        t = self.types[i]
        if t == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()


def suffix_array(text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``text`` (bytes) in the order of their next ``8 * words`` bytes (at least), and the 8-byte keys by position."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8 * words + 8, np.uint8)))
    keys = np.zeros(n + 8 * words, np.uint64)
    for k in range(8):
        keys[:n] = (keys[:n] << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(keys[:n])  # ties have one rank, so their order is free
    rank, width = keys[:n], 8
    while width < 8 * words:
        own = rank[order]
        dense = np.empty(n + width, np.int64)
        dense[order] = np.cumsum(np.concatenate(([1], own[1:] != own[:-1])))
        dense[n:] = 0
        rank = dense[:n] * (n + 2) + dense[width:]
        order = np.argsort(rank)
        width *= 2
    return order, keys


def occurrences(v: Vocabulary, order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range [low, high) of the suffix array that begins with each piece, by binary search for all pieces at once.

    The first 8 bytes are searched in one sorted list of keys; longer pieces go on within the range that leaves.
    """
    first = keys[order]
    low = np.searchsorted(first, v.keys[:, 0], side="left")
    high = np.searchsorted(first, v.keys[:, 0] | ~v.masks[:, 0], side="right")
    long = np.flatnonzero((v.sizes > 8) & (low < high))
    want, mask = v.keys[long], v.masks[long]

    def bound(upper: bool) -> np.ndarray:
        a, b = low[long], high[long]
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            at = order[np.minimum(mid, len(order) - 1)]
            less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k in range(1, v.words):
                x = keys[at + 8 * k] & mask[:, k]
                less |= same & (x < want[:, k])
                same &= x == want[:, k]
            right = open_ & (less | same if upper else less)
            a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
        return a

    ends = bound(False), bound(True)
    low[long], high[long] = ends
    return low, high


def edges(v: Vocabulary, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of pieces in ``text`` as (start, length, id), sorted by position and length."""
    order, keys = suffix_array(text, v.words)
    low, high = occurrences(v, order, keys)
    del keys
    n, wide = high - low, v.longest + 1
    piece = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(piece))
    place += np.repeat(low - (np.cumsum(n) - n), n)
    # start, length and piece as one number, sorted in place; no two are equal
    key = order[place]
    del order, place
    key *= wide
    key += v.sizes[piece]
    key *= len(n)
    key += piece
    key.sort()
    piece = key % len(n)
    key //= len(n) * wide
    return key, v.sizes[piece], v.ids[piece]


class Encoder:
    """Encodes and decodes texts with a vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        # a run of spaces and what follows, or the start of a text without the added space
        self.cut = re.compile(r" +[^ ]*|[^ ]+").finditer

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts are held as numbers of words, since a string for each place of a word takes many times its text."""
        number: defaultdict[str, int] = defaultdict(count().__next__)
        cut = [np.fromiter(map(number.__getitem__, map(_whole, self.cut((" " if self.v.prefix and t else "") + t.replace(SPACE, " ")))), np.int32) for t in texts]
        words = list(number)
        del number
        of = list(map(self.segment(words).__getitem__, words)).__getitem__
        return [np.frombuffer(b"".join(map(of, memoryview(own))), np.int32) for own in cut]

    def segment(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each word, as bytes."""
        found: dict[str, bytes] = {}
        part: list[str] = []
        size = 0
        for w in words:
            part.append(w)
            size += len(w)
            if size > INDEX:
                self._index(part, found)
                part, size = [], 0
        if part:
            self._index(part, found)
        return found

    def _index(self, words: list[str], found: dict[str, bytes]) -> None:
        """Match all pieces in the text of ``words`` and relax its edges, ``RELAX`` bytes at a time."""
        coded = [w.encode("utf-8", "replace") for w in words]
        text = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8)
        starts, sizes, ids = edges(self.v, text)
        ends = np.cumsum([len(c) + 1 for c in coded]) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(ends, begins[i] + RELAX)))
            a, b = np.searchsorted(starts, (begins[i], ends[j - 1]))
            at = begins[i]
            self._relax(words[i:j], coded[i:j], text[at : ends[j - 1] + 1], begins[i:j] - at, ends[i:j] - at, (starts[a:b] - at, sizes[a:b], ids[a:b]), found)
            i = j

    def _relax(self, words: list[str], coded: list[bytes], text: np.ndarray, begins: np.ndarray, ends: np.ndarray, own: tuple, found: dict[str, bytes]) -> None:
        wide = self.v.longest + 1
        table = np.zeros(len(text) * wide, np.int32)  # id + 1 by start and length
        starts, sizes, ids = own
        table[starts * wide + sizes] = ids + 1
        chars = np.flatnonzero(text & 0xC0 != 0x80)
        low, high = np.searchsorted(chars, begins), np.searchsorted(chars, ends)
        view, size, done = memoryview(table), high - low, 0
        for most in ROWS if self.v.kind == BPE else ():
            rows = np.flatnonzero((size > done) & (size <= most))
            cuts = chars[np.minimum(low[rows, None] + np.arange(most + 1), high[rows, None])]
            for r, cut in self._merge(rows, cuts, table, wide):
                at = int(begins[r])
                found[words[r]] = cut if isinstance(cut, bytes) else np.array(self._ids(coded[r], at, cut, view, wide), np.int32).tobytes()
            done = most
        for r in np.flatnonzero(size > done).tolist():
            cuts = chars[low[r] : high[r] + 1].tolist()
            relax = self._merge_long if self.v.kind == BPE else self._best
            found[words[r]] = np.array(relax(coded[r], int(begins[r]), cuts, view, wide), np.int32).tobytes()

    def _none(self, char: bytes) -> list[int]:
        """Ids of a character without a piece."""
        return [self.v.bytes[b] for b in char] if self.v.fallback else [self.v.unknown]

    def _ids(self, c: bytes, at: int, cuts: list[int], table: memoryview, wide: int) -> list[int]:
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            i = table[a * wide + b - a] if b - a < wide else 0
            if i:
                out.append(i - 1)
            elif self.v.fallback or not out or out[-1] != self.v.unknown:  # unknown neighbours are one piece
                out += self._none(c[a - at : b - at])
        return out

    def _merge(self, rows: np.ndarray, cuts: np.ndarray, table: np.ndarray, wide: int):
        """BPE for many short words: in every round each row takes its best edge over two neighbouring pieces.

        ``cuts`` holds, row by row, where a word's pieces begin, filled up with its end.  Yields each row with its ids as
        bytes, or with its cuts where a character has no piece.
        """
        place = self.v.place

        def offers(c: np.ndarray) -> np.ndarray:
            a, n = c[0], c[2] - c[0]
            return np.where((c[2] > c[1]) & (n < wide), place[table[a * wide + np.minimum(n, wide - 1)]], _NONE)

        pairs = offers((cuts[:, :-2], cuts[:, 1:-1], cuts[:, 2:])) if cuts.shape[1] > 2 else np.full((len(cuts), 1), _NONE, np.int32)
        while len(rows):
            best = pairs.argmin(axis=1)
            going = pairs[np.arange(len(rows)), best] < _NONE
            if not going.all():
                yield from self._coded(rows[~going], cuts[~going], table, wide)
                rows, cuts, pairs, best = rows[going], cuts[going], pairs[going], best[going]
                if not len(rows):
                    return
            r, k = np.arange(len(rows)), best
            shift = np.arange(cuts.shape[1])[None, :] > k[:, None]
            cuts = np.where(shift, np.append(cuts[:, 1:], cuts[:, -1:], axis=1), cuts)
            shift = shift[:, : pairs.shape[1]]
            pairs = np.where(shift, np.append(pairs[:, 1:], np.full((len(r), 1), _NONE, pairs.dtype), axis=1), pairs)
            for j in (k - 1, k):
                on = (j >= 0) & (j < pairs.shape[1])
                q, i = r[on], j[on]
                pairs[q, i] = offers((cuts[q, i], cuts[q, i + 1], cuts[q, i + 2]))

    def _coded(self, rows: np.ndarray, cuts: np.ndarray, table: np.ndarray, wide: int):
        a, n = cuts[:, :-1], np.diff(cuts, axis=1)
        ids = np.where(n > 0, table[a * wide + np.minimum(n, wide - 1)] * (n < wide), -1)
        whole = ~(ids == 0).any(axis=1)
        flat = (ids[whole][ids[whole] > 0] - 1).astype(np.int32).tobytes()
        end = 0
        for r, k in zip(rows[whole].tolist(), (4 * (ids[whole] > 0).sum(axis=1)).tolist(), strict=True):
            yield r, flat[end : end + k]
            end += k
        for r, c in zip(rows[~whole].tolist(), cuts[~whole].tolist(), strict=True):
            yield r, sorted(set(c))

    def _merge_long(self, c: bytes, at: int, cuts: list[int], table: memoryview, wide: int) -> list[int]:
        """As ``_merge``, of one long word, with a heap of edges and linked pieces."""
        place, n = memoryview(self.v.place), len(cuts) - 1
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * (n + 1)
        heap: list[tuple[int, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                size = cuts[after[after[k]]] - cuts[k]
                if size < wide and (p := place[table[cuts[k] * wide + size]]) != _NONE:
                    heapq.heappush(heap, (p, k, size))

        for k in range(n):
            offer(k)
        while heap:
            _, k, size = heapq.heappop(heap)
            if not alive[k] or after[k] >= n or cuts[after[after[k]]] - cuts[k] != size:
                continue
            gone = after[k]
            alive[gone] = False
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        left = [cuts[k] for k in range(n) if alive[k]] + [cuts[n]]
        return self._ids(c, at, left, table, wide)

    def _best(self, c: bytes, at: int, cuts: list[int], table: memoryview, wide: int) -> list[int]:
        """Unigram: relax the edges from left to right; the best path ends at the word's end."""
        best, came = {at: 0.0}, {}
        for i, a in enumerate(cuts[:-1]):
            for b in cuts[i + 1 :]:
                if b - a >= wide:
                    break
                p = table[a * wide + b - a]
                if p and (b not in best or best[a] + self.v.scores[p - 1] > best[b]):
                    best[b], came[b] = best[a] + self.v.scores[p - 1], a
            b = cuts[i + 1]
            if (b - a >= wide or not table[a * wide + b - a]) and (b not in best or best[a] + self.v.lowest > best[b]):
                best[b], came[b] = best[a] + self.v.lowest, a
        path = [cuts[-1]]
        while path[-1] != at:
            path.append(came[path[-1]])
        return self._ids(c, at, path[::-1], table, wide)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, and the space that encoding added goes."""
        b = b"".join(map(self.v.plain.__getitem__, ids))
        return (b[1:] if self.v.prefix and b[:1] == b" " else b).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY) -> Encoder:
    """One encoder for each worker and model file, kept between tasks."""
    if name not in _encoders:
        import public_tokenizers

        with open(name if "/" in name else public_tokenizers.path(name), "rb") as f:
            _encoders[name] = Encoder(Vocabulary(f.read()))
    return _encoders[name]


def _groups(texts: pa.Array):
    """Texts in groups of about ``GROUP`` characters."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size > GROUP:
            yield part
            part, size = [], 0
    if part:
        yield part


def coded(b: pa.RecordBatch, vocabulary: str) -> Iterator[pa.RecordBatch]:
    """``doc_id``, ``ids`` of the rows of ``b``, a batch for each group, so that no more ids are held than those of a group."""
    at = 0
    for part in _groups(b.column("text")):
        ids = encoder(vocabulary).encode(part)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), lists], ["doc_id", "ids"])
        at += len(part)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``ids`` for each row of ``docs`` (``doc_id``, ``text``; others ignored).

    A null text, like an empty one, has no ids; null ids and repeated rows pass through; an empty table gives none.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return coded(b, vocabulary)

    return map_parts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``text`` for each row of ``coded`` (``doc_id``, ``ids``); null ids stand for none."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        of = encoder(vocabulary).decode
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([of(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return map_batches(coded.select("doc_id", "ids"), run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, text string")


def op8_sentencepiece(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The digest of ``encode`` and ``decode``: ``doc_id``, ``n_bytes``, ``n_ids``, ``ids_crc32`` (of the ids as little-endian 32-bit integers), ``round_trip``.

    ``round_trip`` says whether decoding gives the text back; only texts that hold the space mark U+2581 itself differ.
    A null text counts as empty: no bytes, no ids, checksum 0.  Very long texts count whole; null ids and repeated rows pass
    through, a row each; other columns are ignored; an empty table gives none.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        import zlib

        e = encoder(vocabulary)
        rows = []
        for part in _groups(b.column("text")):
            for t, ids in zip(part, e.encode(part), strict=True):
                rows.append((len(t.encode()), len(ids), zlib.crc32(ids.astype("<i4").tobytes()), e.decode(ids.tolist()) == t))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_ids", "ids_crc32", "round_trip"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_ids long, ids_crc32 long, round_trip boolean")


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pipeline's last stage: ``doc_id``, ``ids``, ``n_ids`` (0 for a null or empty text) of each row, repeated ones too; an empty table gives none."""
    return encode(docs, vocabulary).withColumn("n_ids", F.size("ids").cast("long"))
