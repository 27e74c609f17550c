"""What encoding holds at a time: words by number, and the ids of one group of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from gridframe.llm import pieces


def peak(run):
    """What ``run`` gives, and the most bytes that were held on the way."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_repeated_words_are_held_as_numbers():
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(500)]
    texts = [" ".join(words[(i * 7 + j * 3) % 500] for j in range(300)) for i in range(1000)] + [" ".join(words * 400)]
    places = 300 * 1000 + 500 * 400
    e = pieces.encoder()
    e.encode(texts[:1])
    found, most = peak(lambda: e.encode(texts))
    assert [x.tolist() for x in found[::250]] == [e.encode([t])[0].tolist() for t in texts[::250]]
    assert most < 70 * places


def test_edges_are_sorted_in_place():
    v = pieces.encoder().v
    text = np.frombuffer(b"the rain in the hills is not so much of a worry to us " * 4000, np.uint8)
    (starts, sizes, ids), most = peak(lambda: pieces.edges(v, text))
    assert (np.diff(starts * (v.longest + 1) + sizes) > 0).all()
    assert most < 48 * len(ids)


def test_ids_are_given_group_by_group(monkeypatch):
    texts = ["a cat sat", None, "", "on the mat " * 30, "the end", "naïve 漢字", "x" * 400, "last"]
    b = pa.RecordBatch.from_arrays([pa.array([3, None, 5, 5, 7, 8, 9, 10], pa.int64()), pa.array(texts)], ["doc_id", "text"])
    whole = pa.Table.from_batches(pieces.coded(b, pieces.VOCABULARY)).to_pylist()
    monkeypatch.setattr(pieces, "GROUP", 100)
    parts = list(pieces.coded(b, pieces.VOCABULARY))
    assert [p.num_rows for p in parts] == [4, 3, 1]
    assert pa.Table.from_batches(parts).to_pylist() == whole
    assert [r["doc_id"] for r in whole] == b.column("doc_id").to_pylist()
    assert [len(r["ids"]) for r in whole][1:3] == [0, 0]
