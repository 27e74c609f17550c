"""WARC: a Merkle fixity audit of replicas.

Pages become WARC records; about ``FILE`` consecutive records are an archive file, and each record has its ordinal, byte
offset, length and SHA-256.  Over a file's records stands a tree: a leaf hashes the entries (offset, length, digest) of
``FAN`` consecutive records in order, a node hashes ``FAN`` nodes below it, and levels are added until one node is left,
the root.  A file is bounded, so its whole tree is one row with an array a level, made in one grouping and stored.  An
audit joins the trees of two replicas by file, drops those with equal roots, and in the others goes down only through
nodes whose hashes differ; records are read only where leaves differ.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import stored

FAN = 8
FILE = 512
#: File numbers: ids divided by ``FILE``; this one for records without an id, numbers below twice this for dealt files.
NO_ID = -(1 << 55)
#: Fixed value: the date in every record's header, so that records depend on nothing but the page.
DATE = "2000-01-01T00:00:00Z"
_RECORDS = ["page_id", "file", "ordinal", "record_offset", "length", "sha256"]


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as the bytes of a WARC resource record; nulls are empty."""
    text = F.coalesce(html, F.lit(""))
    head = ["WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", F.coalesce(page_id.cast("string"), F.lit("")), ">\r\nWARC-Target-URI: ", F.coalesce(url, F.lit("")), f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(text).cast("string"), "\r\n\r\n", text, "\r\n\r\n"]
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head]).cast("binary")


def _base() -> Column:
    return F.coalesce(F.floor(F.col("page_id") / FILE), F.lit(NO_ID)).cast("long")


def crowded(pages: DataFrame) -> DataFrame:
    """``l_base``, ``parts``: ranges of ids that hold more than twice ``FILE`` records (ids that repeat, or none), and into how many files they are dealt."""
    n = pages.groupBy(_base().alias("l_base")).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") > 2 * FILE).select("l_base", F.ceil(F.col("n") / FILE).cast("long").alias("parts"))


def archives(pages: DataFrame, *copies: Column) -> DataFrame:
    """Records of ``pages`` and of replicas of them in one table: ``page_id``, ``file``, ``ordinal``, and an array
    ``copies`` of (``record_offset``, ``length``, ``sha256``), first of the pages themselves, then with each of ``copies``
    for ``html``.

    Needs ``page_id``, ``url``, ``html``.  A file holds the ids of a range of ``FILE``, or those without an id, in the order
    of page id, digest and length; a repeated id is a record each time.  Crowded ranges are dealt to files by digest, equal
    records ``FILE`` at a time, so that no task gathers them.  Replicas keep files and order; rows leave the scan as digests.
    """
    sides = [record(F.col("page_id"), F.col("url"), c) for c in (F.col("html"), *copies)]
    thin = pages.select("page_id", F.array(*[F.struct(F.octet_length(r).cast("long").alias("length"), F.sha2(r, 256).alias("sha256")) for r in sides]).alias("sides"))
    equal = thin.groupBy("page_id", "sides").agg(F.count("*").alias("times")).withColumn("base", _base())
    each = equal.join(stored(crowded(pages), "warc-layout"), F.col("base") == F.col("l_base"), "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    slot = F.xxhash64("base", F.pmod(F.xxhash64(F.col("sides")[0]["sha256"], F.floor(F.col("copy") / FILE)), F.col("parts"))).bitwiseAND(F.lit((1 << 61) - 1))
    each = each.withColumn("file", F.when(F.col("parts") > 1, 2 * NO_ID - slot).otherwise(F.col("base")))
    order = Window.partitionBy("file").orderBy("page_id", F.col("sides")[0]["sha256"], F.col("sides")[0]["length"], "copy")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = [F.struct(F.coalesce(F.sum(F.col("sides")[k]["length"]).over(before), F.lit(0)).alias("record_offset"), F.col("sides")[k]["length"].alias("length"), F.col("sides")[k]["sha256"].alias("sha256")) for k in range(len(sides))]
    return each.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("ordinal"), F.array(*placed).alias("copies"))


def replica(records: DataFrame, k: int) -> DataFrame:
    """One of the replicas in ``archives``: ``page_id``, ``file``, ``ordinal``, ``record_offset``, ``length``, ``sha256``."""
    return records.select("page_id", "file", "ordinal", *[F.col("copies")[k][c].alias(c) for c in _RECORDS[3:]])


def archive(pages: DataFrame) -> DataFrame:
    """The records of an archive of ``pages``."""
    return replica(archives(pages), 0)


def _above(below: Column) -> Column:
    """The hashes of every ``FAN`` consecutive texts."""
    starts = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(below, i * FAN + 1, FAN), "\n").cast("binary"), 256))


def levels_of(*replicas: DataFrame) -> int:
    """Levels until one node is left in the largest file."""
    most = max((r.agg(F.max("ordinal")).first()[0] or 0) for r in replicas) + 1
    n = 1
    while FAN**n < most:
        n += 1
    return n


def tree(records: DataFrame, levels: int) -> DataFrame:
    """``file``, ``file_root`` and the levels ``l1`` (leaves) to ``l<levels>`` (one node), arrays of hashes; a row a file, none for no records."""
    entry = F.struct("ordinal", F.concat_ws(":", "record_offset", "length", "sha256").alias("e"))
    out = records.groupBy("file").agg(F.array_sort(F.collect_list(entry)).alias("e")).select("file", F.transform("e", lambda x: x["e"]).alias("l0"))
    for k in range(levels):
        out = out.withColumn(f"l{k + 1}", _above(F.col(f"l{k}")))
    return out.select("file", F.col(f"l{levels}")[0].alias("file_root"), *[f"l{k + 1}" for k in range(levels)])


def _unequal(at: Column, mine: Column, other: Column) -> Column:
    return F.filter(at, lambda i: ~F.get(mine, i).eqNullSafe(F.get(other, i)))


def differing(ours: DataFrame, theirs: DataFrame, levels: int) -> DataFrame:
    """``file``, ``leaf`` of leaves that differ or that one side lacks, found from the roots downward."""
    a, b = (t.select("file", *[F.col(c).alias(f"{side}{c}") for c in t.columns[1:]]) for t, side in ((ours, "a_"), (theirs, "b_")))
    both = a.join(b, "file", "full").filter(~F.col("a_file_root").eqNullSafe(F.col("b_file_root"))).withColumn("bad", F.array(F.lit(0)))
    for k in range(levels - 1, 0, -1):
        mine, other = (F.coalesce(f"{side}_l{k}", F.array().cast("array<string>")) for side in "ab")
        below = F.flatten(F.transform("bad", lambda i: F.sequence(i * FAN, i * FAN + FAN - 1)))
        both = both.withColumn("bad", _unequal(below, mine, other))
    return both.select("file", F.explode("bad").alias("leaf"))


def audit(ours: DataFrame, theirs: DataFrame, trees: tuple[DataFrame, DataFrame] | None = None, levels: int | None = None) -> DataFrame:
    """Where replica ``theirs`` differs: ``page_id``, ``file``, ``ordinal`` (in theirs for extra records), ``record_offset`` and ``status``.

    Both have the columns of ``archive``.  Within a file, records that are alike in place and bytes are left out; of the rest,
    equal bytes under one id pair in order of offset (``moved``), then what is left of an id pairs in that order
    (``damaged``), and what is left then is ``missing`` (only in ours) or ``extra`` (only in theirs).  A record in another
    file is missing in the one and extra in the other.  Null ids are alike.  Equal replicas give no rows, nor do empty ones.
    """
    levels = levels or levels_of(ours, theirs)
    bad = differing(*(trees or (tree(ours, levels), tree(theirs, levels))), levels)
    at = bad.select(F.col("file").alias("d_file"), "leaf")
    sides = [x.join(at, (x["file"] == at["d_file"]) & (F.floor(x["ordinal"] / FAN) == at["leaf"]), "left_semi").select(*_RECORDS, F.lit(side).alias("side")) for x, side in ((ours, 0), (theirs, 1))]
    place = lambda side, c: F.max(F.when(F.col("side") == side, F.struct("ordinal", "record_offset"))).alias(c)
    same = ["file", "page_id", "sha256", "length"]
    rows = sides[0].unionByName(sides[1]).repartition("file")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*same, "record_offset"))).filter("n = 1")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*same, "side").orderBy("record_offset")))
    rows = rows.groupBy(*same, "k").agg(place(0, "a"), place(1, "b"))
    left = (F.col("a").isNull() | F.col("b").isNull()).alias("left")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("file", "page_id", F.col("a").isNull(), F.col("b").isNull()).orderBy(F.coalesce("a", "b"))))
    rows = rows.groupBy("file", "page_id", left, "k", F.when(~left, F.col("a")).alias("moved")).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    status = F.when(~F.col("left"), "moved").when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("damaged")
    found = F.coalesce("a", "b")
    return rows.select("page_id", "file", found["ordinal"].alias("ordinal"), found["record_offset"].alias("record_offset"), status.alias("status"))


#: Pages whose address has an MD5 below this are damaged in the replica that the query audits: one in 512.
DAMAGE = "008"


def damaged() -> Column:
    """The text of a page as a failing disk might return it: some (``DAMAGE``) end in another character."""
    hit = (F.md5(F.coalesce(F.col("url"), F.lit("")).cast("binary")) < DAMAGE) & (F.length("html") > 0)
    return F.when(hit, F.concat(F.expr("left(html, length(html) - 1)"), F.lit("?"))).otherwise(F.col("html"))


def op10_warc(pages: DataFrame) -> DataFrame:
    """Every record of the archive of ``pages`` with what the audit of its damaged replica says.

    ``page_id``, ``file``, ``record_offset``, ``length``, ``sha256``, ``file_root``, ``status`` (``ok`` where the audit
    did not report the record).  Null urls and texts are empty; null ids share files; repeated rows are records each; an
    empty table gives none.  Other columns are ignored.
    """
    records = stored(archives(pages.select("page_id", "url", "html"), damaged()), "warc-records")
    ours, theirs = replica(records, 0), replica(records, 1)
    levels = levels_of(ours)
    trees = tuple(stored(tree(x, levels), "warc-tree") for x in (ours, theirs))
    found = audit(ours, theirs, trees, levels).filter("status <> 'extra'").select(F.col("file").alias("f_file"), F.col("ordinal").alias("f_ordinal"), "status")
    out = ours.join(trees[0].select("file", "file_root"), "file").join(found, (F.col("file") == F.col("f_file")) & (F.col("ordinal") == F.col("f_ordinal")), "left")
    return out.select("page_id", "file", "record_offset", "length", "sha256", "file_root", F.coalesce("status", F.lit("ok")).alias("status"))


_TEXT = """'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || nl
   || 'WARC-Target-URI: ' || coalesce(url, '') || nl || 'WARC-Date: {date}' || nl || 'Content-Type: text/html' || nl || 'Content-Length: '
   || CAST(octet_length(encode({body})) AS VARCHAR) || nl || nl || {body} || nl || nl"""

#: What is known of the damage without an audit: a record whose bytes were changed is damaged, one behind a change of length is moved.
ORACLE_SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce(html, '') AS good, CASE WHEN md5(coalesce(url, '')) < '{DAMAGE}' AND length(html) > 0 THEN left(html, length(html) - 1) || '?' ELSE coalesce(html, '') END AS worse,
  chr(13) || chr(10) AS nl, coalesce(CAST(floor(page_id / {FILE}) AS BIGINT), {NO_ID}) AS file FROM pages),
t AS (SELECT page_id, file, {_TEXT.format(date=DATE, body="good")} AS r, {_TEXT.format(date=DATE, body="worse")} AS w FROM p),
d AS (SELECT page_id, file, sha256(r) AS sha256, sha256(w) AS other, CAST(octet_length(encode(r)) AS BIGINT) AS length, CAST(octet_length(encode(w)) AS BIGINT) AS o_length FROM t),
a AS (SELECT *, row_number() OVER w - 1 AS ordinal, CAST(sum(length) OVER w - length AS BIGINT) AS record_offset, CAST(sum(o_length) OVER w - o_length AS BIGINT) AS o_offset
  FROM d WINDOW w AS (PARTITION BY file ORDER BY page_id, sha256, length, other ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
depth AS (SELECT greatest(1, CAST(ceil(round(log(max(ordinal) + 1) / log({FAN}), 9)) AS INTEGER)) AS most FROM a),
up(level, file, node, hash) AS (
  SELECT 0, file, ordinal, record_offset || ':' || length || ':' || sha256 FROM a
  UNION ALL
  SELECT * FROM (SELECT any_value(level) + 1, file, node // {FAN}, sha256(string_agg(hash, chr(10) ORDER BY node)) FROM up, depth WHERE level < most GROUP BY file, node // {FAN}))
SELECT a.page_id, a.file, record_offset, length, sha256, hash AS file_root,
  CASE WHEN sha256 <> other THEN 'damaged' WHEN record_offset <> o_offset THEN 'moved' ELSE 'ok' END AS status
FROM a JOIN up ON a.file = up.file JOIN depth ON up.level = depth.most
"""
