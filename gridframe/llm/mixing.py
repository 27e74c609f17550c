"""Mixing sources to target weights by hash-random keys, prefix sums and a cut at each source's budget.

Every document gets a random key, the MD5 of its id, so a source's documents in key order are a random permutation.  The
leading hex digits split that order into key ranges; their word totals, added up before the shuffle, give each source's
prefix sums without moving a document.  The range in which a source's budget ends is found twice, first among 256 ranges
and then among the 4096 within it, and only that one small range is sorted, with rows of one id and size counted first:
documents in earlier ranges are taken, those in later ones are not, and in it the running sum decides.  Whole epochs come
first where a target exceeds its source.  All decisions are made on thin rows, whose words are counted once; the texts
themselves meet only tables of a row a source and a row an id of the cut range.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import GAP_RE, stored

WEIGHTS = (1, 2, 3)
#: A source is never repeated beyond this many epochs.
CAP = 3
#: Hex digits of the key that name a range, level by level.
LEVELS = (2, 5)


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, GAP_RE), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def key_of() -> Column:
    """The random key. Rows without an id are told apart by their text."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.col("text"))), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target`` for each source of ``sizes`` (``source``, ``_gf_size``).

    Reshared excess settles where every source has the smaller of its cap and the same level times its weight.  In the
    order of cap / weight the capped sources come first, so one pass of running sums finds the level.  Sources, not
    documents, meet in one task here.
    """
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by = sizes.groupBy("source").agg(F.sum("_gf_size").alias("source_size")).withColumn("w", w).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    c, v = F.coalesce(F.sum("most").over(before), F.lit(0)), F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    by = by.withColumn("total", total).withColumn("capped", F.col("most") * v <= F.col("w") * (total - c))
    c, v = (F.sum(F.when(F.col("capped") == on, F.col(x)).otherwise(0)).over(everything) for on, x in ((True, "most"), (False, "w")))
    level = (F.col("w") * (F.col("total") - c)).cast("double") / v.cast("double")
    return by.select("source", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(level).alias("target"))


def cuts(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each source: ``t_source``, its size and target, whole ``epochs``, the ``rest`` that is left, the key range ``cut`` in which that ends, and the words ``before`` the range."""
    t = targets(sizes, weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.select(F.col("source").alias("t_source"), "source_size", "target", epochs.alias("epochs"))
    t = t.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("cut", F.lit("")).withColumn("before", F.lit(0).cast("long"))
    for digits in LEVELS:
        t = stored(t, "mixing-cuts")  # a row a source, whose size Spark then knows: small ones are broadcast, large ones are not
        own = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).filter(F.col("_gf_key").startswith(F.col("cut")))
        ranges = own.groupBy("t_source", F.substring("_gf_key", 1, digits).alias("range")).agg(F.sum("_gf_size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        run = Window.partitionBy("t_source").orderBy("range")
        upto = F.col("before") + F.sum("words").over(run)
        ranges = ranges.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        found = ranges.groupBy("t_source").agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"))).alias("f"))
        found = found.select(F.col("t_source").alias("f_source"), F.col("f.range").alias("f_cut"), F.col("f.before").alias("f_before"))
        t = t.join(found, F.col("t_source").eqNullSafe(F.col("f_source")), "left").select(
            "t_source", "source_size", "target", "epochs", "rest", F.coalesce("f_cut", F.lit("g")).alias("cut"), F.coalesce("f_before", "before").alias("before"))
    return stored(t, "mixing-cuts")


def at_cut(sizes: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of the cut ranges, a row for each source, key, id and size (``c_...``), with how many there are (``c_all``) and how many of them are taken (``c_take``).

    A document is taken if at least half of it lies within the budget, which leaves the nearest sum of whole documents; in
    the order of the keys those taken come first.
    """
    near = sizes.join(found, F.col("source").eqNullSafe(F.col("t_source"))).filter(_place() == F.col("cut"))
    rows = near.groupBy("t_source", "_gf_key", "doc_id", "_gf_size", "rest", "before").agg(F.count("*").alias("n"))
    run = Window.partitionBy("t_source").orderBy("_gf_key", "doc_id", "_gf_size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("_gf_size")).over(run), F.lit(0))
    size = F.col("_gf_size")
    most = F.when(size > 0, F.floor((2 * left + size) / (2 * size)).cast("long")).when(left >= 0, F.col("n")).otherwise(0)
    take = F.greatest(F.lit(0).cast("long"), F.least(most, F.col("n")))
    return rows.select(F.col("t_source").alias("c_source"), F.col("_gf_key").alias("c_key"), F.col("doc_id").alias("c_id"), size.alias("c_size"), F.col("n").alias("c_all"), take.alias("c_take"))


def _place() -> Column:
    return F.substring("_gf_key", 1, LEVELS[-1])


def decided(rows: DataFrame, size: Column, found: DataFrame, near: DataFrame) -> DataFrame:
    """``rows`` (with ``source``, ``doc_id`` and ``_gf_key``) with ``_gf_times``, how often each document is taken, and the columns of ``found``, marked.

    ``size`` is only evaluated in the cut ranges.  Of rows alike in id and size of which a part is taken, any will do: they
    are numbered by their partitions, so that no task has to hold them.  Sources without a cut (``g`` follows all hex
    digits) are taken whole or not at all.
    """
    both = rows.join(found.select(*[F.col(c).alias(f"_gf_{c}") for c in found.columns]), F.col("source").eqNullSafe(F.col("_gf_t_source")))
    both = both.withColumn("_gf_at", F.when(_place() == F.col("_gf_cut"), size))
    near = near.select(*[F.col(c).alias(f"_gf_{c}") for c in near.columns])
    same = (F.col("_gf_at") == F.col("_gf_c_size")) & (F.col("_gf_key") == F.col("_gf_c_key")) & F.col("doc_id").eqNullSafe(F.col("_gf_c_id")) & F.col("source").eqNullSafe(F.col("_gf_c_source"))
    both = both.join(near, same, "left")
    part = F.coalesce((F.col("_gf_c_take") > 0) & (F.col("_gf_c_take") < F.col("_gf_c_all")), F.lit(False))
    inside = F.when(F.col("_gf_at").isNull(), _place() < F.col("_gf_cut")).otherwise(F.col("_gf_c_take") > 0)
    out = both.filter(~part).withColumn("_gf_times", F.col("_gf_epochs") + inside.cast("long"))
    if near.filter("_gf_c_take > 0 AND _gf_c_take < _gf_c_all").isEmpty():
        return out
    split = stored(both.filter(part).withColumn("_gf_row", F.monotonically_increasing_id()), "mixing-split").withColumn("_gf_part", F.shiftright("_gf_row", 33))
    counts = split.groupBy(F.col("_gf_t_source").alias("_gf_p_source"), F.col("_gf_part").alias("_gf_p_part")).agg(F.count("*").alias("_gf_p_n"))
    before = counts.withColumn("_gf_p_before", F.sum("_gf_p_n").over(Window.partitionBy("_gf_p_source").orderBy("_gf_p_part")) - F.col("_gf_p_n"))
    number = F.col("_gf_p_before") + F.row_number().over(Window.partitionBy("_gf_t_source", "_gf_part").orderBy("_gf_row"))
    split = split.join(before, F.col("_gf_t_source").eqNullSafe(F.col("_gf_p_source")) & (F.col("_gf_part") == F.col("_gf_p_part")))
    split = split.withColumn("_gf_times", F.col("_gf_epochs") + (number <= F.col("_gf_c_take")).cast("long"))
    return out.unionByName(split.select(*out.columns))


def sized(docs: DataFrame) -> DataFrame:
    """Thin rows of ``docs``: id, source, size and key, stored once so that texts are read once."""
    return stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("_gf_size"), key_of().alias("_gf_key")), "mixing-sizes")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``, ``source``; others ignored) with the words the mix takes.

    A null or empty text has size 0; null sources are one source, the last; null ids are told apart by their text; repeated
    rows are separate documents, of which any may be the one that is taken; very long texts count whole; an empty table
    gives none.
    """
    sizes = sized(docs)
    found = cuts(sizes, weights, cap)
    out = decided(sizes, F.col("_gf_size"), found, stored(at_cut(sizes, found), "mixing-near"))
    return out.select("doc_id", F.col("_gf_size").alias("size"), F.col("_gf_source_size").alias("source_size"), F.col("_gf_target").alias("target"), (F.col("_gf_size") * F.col("_gf_times")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as the mix takes them, all columns kept; odd rows as in ``mixture``."""
    sizes = sized(docs)
    found = cuts(sizes, weights, cap)
    taken = decided(docs.withColumn("_gf_key", key_of()), size_of(F.col("text")), found, stored(at_cut(sizes, found), "mixing-near")).filter("_gf_times > 0")
    return taken.withColumn("_gf_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_gf_times")))).select(*docs.columns)


def op6_mixing(docs: DataFrame) -> DataFrame:
    """The production query: weights 1, 2, 3 and at most 3 epochs; rows as ``mixture`` says."""
    return mixture(docs)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '-' || md5(text), '')) AS k,
  coalesce(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
a AS (SELECT *, 3 * source_size AS most, CAST(sum(source_size) OVER () AS BIGINT) AS total,
  CAST(coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c,
  CAST(sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS v FROM s),
b AS (SELECT *, most * v <= w * (total - c) AS capped FROM a),
l AS (SELECT *, CAST(sum(CASE WHEN capped THEN most ELSE 0 END) OVER () AS BIGINT) AS held, CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS BIGINT) AS free FROM b),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE CAST(w * (total - held) AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN 2 * done + size <= 2 * rest THEN 1 ELSE 0 END) AS taken FROM r
"""
