"""Quality rules: a threshold table compiled into one Spark projection.

Nothing leaves the JVM: every measure is a built-in expression over the whole text, the words are split once and bound
to a lambda variable, and a rule is a comparison of two measures.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import GAP_RE, SPACES

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Very frequent words of the four languages, any of which marks running text.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "a", "le", "la", "de", "et", "les", "des", "en", "un", "der", "die", "und", "in", "den", "von", "zu", "das", "el", "que", "y", "los", "se", "del", "una", "por"]


class Rule(NamedTuple):
    """``measure`` must lie in [least, most] per hundred of ``per``; texts of fewer than ``from_words`` words pass."""

    name: str
    measure: str
    per: str
    least: float
    most: float
    from_words: int = 0


#: The production table. Bounds are wide: ordinary prose lies far inside.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", 0, 30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0, 50),
    Rule("shouting", "n_shouts", "n_words", 0, 30),
    Rule("stop_words", "n_stop_words", "n_words", 1, 100, 100),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _length(c: Column) -> Column:
    return F.length(c).cast("long")


def words(text: Column) -> Column:
    """The words of ``text``."""
    return F.filter(F.split(text, GAP_RE), lambda w: w != "")


def repeat_words(ws: Column) -> Column:
    """Words inside a ``WINDOW``-word window whose text occurs at least twice.

    Windows are first told apart by 64-bit hashes: where none repeats (the usual case) no text repeats, and the answer is
    0. Else the windows are joined strings, compared exactly: sorting brings equal ones together, and each repeated start
    adds the words up to the next one.
    """
    n = F.size(ws)

    def counted(wins: Column) -> Column:
        def spread(by: Column) -> Column:
            at = F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.size(by) - 1), lambda k: F.when(
                (F.get(by, k)["w"] == F.get(by, k - 1)["w"]) | (F.get(by, k)["w"] == F.get(by, k + 1)["w"]), F.get(by, k)["i"])), lambda x: x.isNotNull()))
            step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("n"), (i + WINDOW).alias("end"))
            return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])

        return _let(F.array_sort(F.transform(wins, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), spread)

    def told_apart(hs: Column) -> Column:
        wins = F.transform(F.slice(hs, F.lit(1), n - WINDOW + 1), lambda h, i: F.xxhash64(h, *[F.get(hs, i + k) for k in range(1, WINDOW)]))
        return _let(wins, lambda x: F.size(F.array_distinct(x)) == F.size(x))

    wins = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.array_join(F.slice(ws, i, WINDOW), " "))
    none = _let(F.transform(ws, lambda w: F.xxhash64(w)), told_apart)
    return F.when(n <= WINDOW, F.lit(0)).when(none, F.lit(0)).otherwise(_let(wins, counted)).cast("long")


def _of_words(ws: Column) -> Column:
    stop = sorted(set(STOP_WORDS))
    return F.struct(
        F.size(ws).cast("long").alias("n_words"),
        repeat_words(ws).alias("n_repeat_words"),
        F.size(F.filter(ws, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
    )


def _of_lines(lines: Column) -> Column:
    full = F.filter(lines, lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return _let(full, lambda own: F.struct(F.size(own).cast("long").alias("n_lines"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines")))


def _joined(parts: Column, rules: tuple[Rule, ...]) -> Column:
    """All measures and both verdicts, from the structs of ``measures``."""
    m = {n: parts[at][n] for at, names in _PARTS.items() for n in names}
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    kept = ~failed
    for r in rules:
        x, per = 100 * m[r.measure], m[r.per]
        kept &= (m["n_words"] < r.from_words) | ((x >= r.least * per) & (x <= r.most * per))
    return F.struct(*[c.alias(n) for n, c in m.items()], failed.alias("base_failed"), kept.alias("kept"))


_PARTS = {
    "words": ["n_words", "n_repeat_words", "n_stop_words"],
    "lines": ["n_lines", "n_dup_lines"],
    "chars": ["word_chars", "n_symbols", "n_shouts"],
}


def measures(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table compiled into one struct: every measure, ``base_failed`` and ``kept``; null is an empty text.

    A rule whose denominator is 0 passes.
    """
    text = F.coalesce(text, F.lit(""))
    chars = F.struct(
        _length(F.translate(text, SPACES, "")).alias("word_chars"),
        (_length(text) - _length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        (_length(text) - _length(F.replace(text, F.lit("!!"), F.lit("!")))).alias("n_shouts"),
    )
    parts = F.struct(_let(words(text), _of_words).alias("words"), _let(F.split(text, "\n"), _of_lines).alias("lines"), chars.alias("chars"))
    return _let(parts, lambda p: _joined(p, rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that keep; all columns stay. A null or empty text has no words and goes."""
    return docs.filter(measures(F.col("text"), rules)["kept"])


def op2_quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``; others ignored): the base measures and the verdict.

    Null or empty texts have 0 of everything and fail the base rule; null ids and repeated rows pass through.
    """
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = docs.select("doc_id", measures(F.col("text")).alias("m"))
    return found.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in cols])


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


def _rule_sql(r: Rule) -> str:
    return f"(n_words < {r.from_words} OR (100 * {r.measure} >= {r.least} * {r.per} AND 100 * {r.measure} <= {r.most} * {r.per}))"


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT *, CASE WHEN len(ws) > {WINDOW} THEN [array_to_string(ws[i:i + {WINDOW - 1}], ' ') FOR i IN range(1, len(ws) - {WINDOW} + 2)] ELSE [] END AS wins FROM d),
e AS (SELECT rowid_, i, win, count(*) OVER (PARTITION BY rowid_, win) AS c FROM (
  SELECT doc_id AS rowid_, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS i FROM w)),
r AS (SELECT rowid_, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY rowid_ ORDER BY i) AS nxt FROM e WHERE c > 1) GROUP BY rowid_),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  length(text) - length(replace(text, '!!', '!')) AS n_shouts, len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop_words
  FROM w LEFT JOIN r ON r.rowid_ = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_rule_sql(r) for r in RULES)} AS kept FROM b
"""
