"""Language ID by rank-order profiles.

A profile is the list of a text's most frequent n-grams (one to three letters, words padded with a space) in order of
frequency.  A document gets the language whose profile is nearest by the out-of-place distance: the sum, over the
document's n-grams, of how far their ranks differ, n-grams unknown to the language counting as the profile's length.
Profiles are learned from at most about ``FIT`` documents a language (rows below a hash bound computed from the
language's row count); their n-gram counts are added up by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import fold, map_batches, stored

PROFILE = 300
#: Documents of a language that profiles are learned from (expected number).
FIT = 2_000
UNKNOWN = "und"
#: Characters whose n-grams are counted at once; bounds memory on very long texts.
CHUNK = 1 << 20

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their number (or the sum of their counts)."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts, starts)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text, packed 21 bits a letter, in key order, and how often each occurs."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not text:
        return none
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    own = _is_letter()[a]
    if not own.any():
        return none
    keep = own.copy()
    keep[1:] |= own[:-1]  # the gap after a word is one space
    c = np.where(own, a, np.uint32(32))[keep].astype(np.uint64)
    c = np.concatenate((c[:0] if not own[0] and c[0] == 32 else np.array([32], np.uint64), c, np.array([32] if c[-1] != 32 else [], np.uint64)))
    found = []
    for i in range(0, len(c), CHUNK):
        x = c[i : i + CHUNK + 2]
        n = min(CHUNK, len(x))
        two = (x[: min(n, len(x) - 1)] << np.uint64(21)) | x[1:][:n]
        m = min(n, len(x) - 2)
        three = ((two[:m] << np.uint64(21)) | x[2:][:m])[x[1:][:m] != 32] if m > 0 else x[:0]
        one = x[:n]
        found.append(_runs(np.concatenate((one[one != 32], two, three))))
    if len(found) == 1:
        return found[0]
    return _runs(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))


def ranked(text: str | None) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, ties by key."""
    keys, counts = ngrams(text)
    return keys[np.argsort(-counts, kind="stable")[:PROFILE]]


class Profiles:
    """Ranks of n-grams by language, as one table for all languages."""

    def __init__(self, ranks: dict[str, list[int]]):
        self.langs = sorted(ranks)
        self.keys = np.unique(np.array([k for r in ranks.values() for k in r], np.uint64))
        self.table = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)
        for j, lang in enumerate(self.langs):
            own = np.array(ranks[lang], np.uint64)
            self.table[np.searchsorted(self.keys, own), j] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 minus its share of the greatest distance; ``und`` and 0 without letters."""
        grams = ranked(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, grams)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != grams)] = len(self.keys)
        ranks = self.table[at]
        far = np.where(ranks < 0, PROFILE, abs(ranks - np.arange(len(grams))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (PROFILE * len(grams)))


def learn(docs: DataFrame, fit: int = FIT) -> Profiles:
    """Profiles from rows of ``docs`` with a ``lang`` and letters in their ``text``; rows may be filtered beforehand."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    share = known.groupBy(F.col("lang").alias("l_lang")).agg(F.least(F.lit(1.0), F.lit(float(fit)) / F.count("*")).alias("share"))
    share = stored(share, "language-shares")  # a row a language, whose size Spark then knows: the texts are not shuffled to meet it
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.col("text").cast("binary")))).cast("binary"))
    unit = F.conv(F.substring(key, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))
    part = known.join(share, F.col("lang") == F.col("l_lang")).filter(unit < F.col("share")).select("lang", "text")

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        langs, keys, counts = [], [], []
        own: dict[str, list] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            own.setdefault(lang, []).append(ngrams(text))
        for lang, found in own.items():
            k = np.concatenate([x for x, _ in found])
            if len(k):
                k, c = _runs(k, np.concatenate([c for _, c in found]))
                langs += [lang] * len(k)
                keys.append(k.view(np.int64))
                counts.append(c)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(keys) if keys else [], pa.int64()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], ["lang", "gram", "n"])

    grams = map_batches(part, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("r", rank).filter(F.col("r") <= PROFILE).orderBy("lang", "r")
    ranks: dict[str, list[int]] = {}
    for r in top.toLocalIterator():
        ranks.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranks)


def predict(docs: DataFrame, profiles: Profiles, min_score: float | None = None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` for each row; with ``min_score`` instead the rows of ``docs``, all columns, that are told to be of a language with at least that score."""
    cols = docs.columns if min_score is not None else ["doc_id", "text"]
    found = docs.select(*cols)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [profiles.predict(t.as_py()) for t in b.column("text")]
        if min_score is not None:
            return b.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in out]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = found.schema if min_score is not None else f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return map_batches(found, run, schema)


#: Between the scores of texts in languages that were learned (0.36 at least over 51,282 documents, of which the shortest have
#: one word) and those of random Latin letters or of Latin-script languages that were not (about 0.14 to 0.23).
MIN_SCORE = 0.3


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is of a language learned from ``docs`` itself; texts that are null, without letters or far from all languages go."""
    return predict(docs, learn(docs.filter(fold("doc_id", 4) != 2)), min_score)


def op4_language_id(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for each row of ``docs`` (``doc_id``, ``text``, ``lang``).

    Learned from rows with a language outside the held-out quarter.  A null text, or one without letters, is ``und`` with
    score 0; ties go to the first language by name; null ids and repeated rows pass through; an empty table gives none.
    """
    rows = docs.select("doc_id", "text", "lang")
    profiles = learn(rows.filter(fold("doc_id", 4) != 2))
    return predict(rows, profiles).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


_CRC = """xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda crc, b: list_reduce([xor(crc, b)] || CAST(range(8) AS BIGINT[]), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

#: The same profiles and distances by joins. Ids are taken to be distinct, as the table's are.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, lang, text, {_CRC} % 4 = 2 AS held, trim(regexp_replace(lower(coalesce(text, '')), '\P{{L}}+', ' ', 'g')) AS t,
  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-' || md5(text))), 1, 13) AS BIGINT) AS DOUBLE) / {float(1 << 52)} AS unit FROM documents),
share AS (SELECT lang, least(1.0, {float(FIT)} / count(*)) AS share FROM d WHERE NOT held AND lang IS NOT NULL AND text IS NOT NULL GROUP BY lang),
p AS (SELECT doc_id, ' ' || t || ' ' AS p FROM d WHERE t <> ''),
place AS (SELECT doc_id, p, unnest(range(1, length(p) + 1)) AS i FROM p),
g AS (SELECT doc_id, g, count(*) AS n FROM (
  SELECT doc_id, substr(p, i, 1) AS g FROM place WHERE substr(p, i, 1) <> ' ' UNION ALL
  SELECT doc_id, substr(p, i, 2) FROM place WHERE i < length(p) UNION ALL
  SELECT doc_id, substr(p, i, 3) FROM place WHERE i < length(p) - 1 AND substr(p, i + 1, 1) <> ' ') GROUP BY ALL),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r FROM g QUALIFY r < {PROFILE}),
profile AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS r FROM g JOIN d USING (doc_id) JOIN share USING (lang)
  WHERE NOT held AND unit < share GROUP BY lang, g QUALIFY r < {PROFILE}),
far AS (SELECT own.doc_id, l.lang, sum(coalesce(abs(profile.r - own.r), {PROFILE})) AS far, count(*) AS n
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile ON profile.lang = l.lang AND profile.g = own.g GROUP BY ALL),
best AS (SELECT doc_id, lang, 1 - CAST(far AS DOUBLE) / CAST({PROFILE} * n AS DOUBLE) AS score FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1)
SELECT d.doc_id, d.held AS held_out, coalesce(best.lang, '{UNKNOWN}') AS lang_pred, coalesce(best.score, 0) AS score FROM d LEFT JOIN best USING (doc_id)
"""
