"""Token counts: pieces counted once for each distinct pre-token and joined to the documents' pre-token frequencies.

*Counting.*  Every batch of documents is cut into pre-tokens; their frequencies are added up over all batches, first in the
batch and then by a grouping, which leaves the table of distinct pre-tokens of the corpus.  Each of these is tokenized once,
and only the number of its pieces is stored.

*Joining.*  A document's tokens are the sum, over its distinct pre-tokens, of frequency times pieces.  Pre-token frequencies
are very uneven, and a shuffle of all (document, pre-token) pairs would move several times the corpus; so the join is split
by frequency.  The ``HOT`` most frequent pre-tokens of at most ``HOT_BYTES`` bytes, a table of at most
``HOT * (HOT_BYTES + 8)`` bytes whatever the input, are broadcast and joined where the documents are read; a document leaves
that scan as one row with its sum so far and the pre-tokens that are not in that table, which are joined by a shuffle on the
pre-token and added up by document.  No ids are kept.
"""

from __future__ import annotations

import json
import os
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import map_batches, stored

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: The table that is broadcast has at most so many pre-tokens of so many bytes each.
HOT, HOT_BYTES = 200_000, 48
#: Pre-tokens that are tokenized at once.
ENCODE = 20_000
#: Fixed value: the pattern by which a byte-level pre-tokenizer cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _place(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class PreTokenizer:
    """Cuts texts as the library's tokenizer in ``file`` does, and counts the pieces of pre-tokens."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{file}: only byte-level tokenizers without a normalizer or prefix space are counted by pre-token")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{file}: added tokens that take their surroundings are not supported")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cut = regex.compile(PATTERN).findall
        self.file, self.tokenizer = file, None

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies, and the number of added tokens."""
        if self.added is None or not (specials := len(self.added.findall(text))):
            return Counter(self.cut(text)), 0
        found = Counter()
        for part in self.added.split(text):
            found.update(self.cut(part))
        return found, specials

    def pieces(self, tokens: list[str]) -> list[int]:
        """How many pieces each pre-token has."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.file)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        return [len(e) for i in range(0, len(tokens), ENCODE) for e in self.tokenizer.encode_batch_fast(tokens[i : i + ENCODE], add_special_tokens=False)]


_made: dict[str, PreTokenizer] = {}


def pre_tokenizer(vocabulary: str) -> PreTokenizer:
    """One for each worker and file, kept between tasks; it holds no texts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    file = _place(vocabulary)
    if file not in _made:
        _made[file] = PreTokenizer(file)
    return _made[file]


def _strings(found: list[str]) -> pa.Array:
    return pa.array(found, pa.string())


def frequencies(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``token``, ``times`` of every distinct pre-token of ``docs.text``; added tokens are not among them."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cut, found = pre_tokenizer(vocabulary), Counter()
        for t in b.column("text"):
            found.update(cut.frequencies(t.as_py() or "")[0])
        return pa.RecordBatch.from_arrays([_strings(list(found)), pa.array(list(found.values()), pa.int64())], ["token", "times"])

    return map_batches(docs.select("text"), run, "token string, times long").groupBy("token").agg(F.sum("times").alias("times"))


def counted(found: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``found`` (``token``, ``times``) with ``pieces``; every pre-token goes to the tokenizer once."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = pre_tokenizer(vocabulary).pieces(b.column("token").to_pylist())
        return pa.RecordBatch.from_arrays([b.column("token"), b.column("times"), pa.array(n, pa.int64())], ["token", "times", "pieces"])

    return map_batches(found.select("token", "times"), run, "token string, times long, pieces long")


def frequent(pieces: DataFrame, most: int) -> DataFrame:
    """``token``, ``pieces`` of the most frequent short pre-tokens, at most ``most``: those above a frequency found by a histogram, not by a sort."""
    level = F.floor(F.log2("times") * 16)
    short = pieces.filter(F.octet_length("token") <= HOT_BYTES)
    least, n = None, 0
    for r in short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a row a level, about a thousand
        n += r["count"]
        if n > most:
            break
        least = r["level"]
    return short.filter("false" if least is None else level >= least).select("token", "pieces")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, hot: int | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row of ``docs`` (``doc_id``, ``text``; others ignored).

    ``vocabulary`` names a file of the public tokenizers or is a path that all workers have.  ``hot`` bounds the table that
    is broadcast (``HOT``) and changes no result.  A null text counts as empty (0 bytes, 0 tokens); null ids and repeated
    rows pass through, a row each; very long texts are counted whole; an empty table gives none.
    """
    hot = HOT if hot is None else hot
    pieces = stored(counted(frequencies(docs, vocabulary), vocabulary), "token-pieces")
    table = frequent(pieces, hot).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((table.column("token").to_pylist(), table.column("pieces").to_numpy()))
    tables: dict[int, dict] = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cut = pre_tokenizer(vocabulary)
        known = tables.get(0)
        if known is None:
            known = tables[0] = dict(zip(shared.value[0], shared.value[1].tolist(), strict=True))
        sizes, sums, tokens, times, ends = [], [], [], [], [0]
        for t in b.column("text"):
            text = t.as_py() or ""
            own, n = cut.frequencies(text)
            for p, k in own.items():
                if (c := known.get(p)) is None:
                    tokens.append(p)
                    times.append(k)
                else:
                    n += k * c
            sizes.append(len(text.encode()))
            sums.append(n)
            ends.append(len(tokens))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (_strings(tokens), pa.array(times, pa.int64()))]
        return pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), *lists], ["row", "doc_id", "n_bytes", "known", "tokens", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = stored(map_batches(rows, run, f"row long, doc_id {kind}, n_bytes long, known long, tokens array<string>, times array<long>"), "token-rows")
    rest = rows.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("e")).select("row", F.col("e.tokens").alias("token"), F.col("e.times").alias("n"))
    rest = rest.join(pieces.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest"))
    n = F.col("known") + F.coalesce("rest", F.lit(0))
    return rows.select("row", "doc_id", "n_bytes", "known").join(rest, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op9_token_counts(docs: DataFrame) -> DataFrame:
    """The production query: ``byte_bpe_50k.json`` and 1024 tokens; odd rows as ``token_counts`` states."""
    return token_counts(docs)
