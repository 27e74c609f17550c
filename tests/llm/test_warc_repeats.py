"""The audit where ids repeat or are null over more than one leaf, and roots of long files."""

import hashlib
from itertools import count, islice

import duckdb
from pyspark.sql import functions as F

from gridframe.llm import warc
from tests.conftest import cells


def _urls(hit, n):
    found = (f"http://h/{i}" for i in count() if (hashlib.md5(f"http://h/{i}".encode()).hexdigest() < warc.DAMAGE) == hit)
    return list(islice(found, n))


def test_status_of_repeats_over_several_leaves(spark):
    ok, bad = _urls(False, 300), _urls(True, 3)
    rows = [(None, u, f"page {k}") for k, u in enumerate(ok[:100])] + [(None, bad[0], "page of no id")]
    rows += [(5, u, f"copy {k}") for k, u in enumerate(ok[100:230])] + [(5, bad[1], "a copy"), (6, bad[2], "single")]
    rows += [(k, u, "x" * k) for k, u in enumerate(ok[230:], 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.op10_warc(pages).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert cells(got) == cells(con.execute(warc.ORACLE_SQL).df())
    assert {None if i != i else i for i in got[got.status == "damaged"].page_id} >= {None, 5, 6}


def _plain_root(entries):
    """The root over texts, by lists."""
    level = entries
    while len(level) > 1 or level is entries:
        level = [hashlib.sha256("\n".join(level[i : i + warc.FAN]).encode()).hexdigest() for i in range(0, len(level), warc.FAN)]
    return level[0]


def test_root_depends_on_every_record_of_a_long_file(spark):
    rows = [(None, "http://h/0", f"page {k}") for k in range(1020)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    records = [r.asDict() for r in warc.archive(pages).collect()]
    assert len({r["file"] for r in records}) == 1 and warc.levels_of(warc.archive(pages)) == 4
    records.sort(key=lambda r: r["ordinal"])
    roots = {_plain_root([f"{r['record_offset']}:{r['length']}:{r['sha256']}" for r in records])}
    assert {r[0] for r in warc.op10_warc(pages).select("file_root").distinct().collect()} == roots
    for at in (0, 511, 512, 1000, 1019):
        own = [dict(r, sha256="0") if k == at else r for k, r in enumerate(records)]
        changed = spark.createDataFrame([tuple(r.values()) for r in own], ", ".join(f"{c} {t}" for c, t in warc.archive(pages).dtypes))
        roots.add(warc.tree(changed, 4).first().file_root)
    assert len(roots) == 6


def test_three_of_seven_hundred_repeats_are_damaged(spark):
    rows = [(9, f"http://h/{k}", f"page {k}") for k in range(700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    hit = F.col("url").isin("http://h/3", "http://h/333", "http://h/650")
    both = warc.archives(pages, F.when(hit, F.translate("html", "page", "PAGE")).otherwise(F.col("html"))).persist()
    found = warc.audit(warc.replica(both, 0), warc.replica(both, 1)).collect()
    wrong = {r.ordinal for r in both.filter(F.col("copies")[0]["sha256"] != F.col("copies")[1]["sha256"]).collect()}
    assert {r.ordinal for r in found} == wrong and len(found) == 3 and {r.status for r in found} == {"damaged"}
    # other order, as a replica that sorts its own bytes has it: moved records are not called damaged
    own = warc.archive(pages.withColumn("html", F.when(hit, F.translate("html", "page", "PAGE")).otherwise(F.col("html"))))
    kinds = [r.status for r in warc.audit(warc.replica(both, 0), own).collect()]
    assert kinds.count("damaged") == 3 and set(kinds) <= {"damaged", "moved"}


def test_equal_records_in_part_damaged_or_gone(spark):
    names = "page_id long, file long, ordinal long, record_offset long, length long, sha256 string"
    ours = spark.createDataFrame([(1, 0, k, 10 * k, 10, "a") for k in range(40)], names)
    theirs = spark.createDataFrame([(1, 0, k, 10 * k, 10, "b" if k in (3, 30) else "a") for k in range(39)], names)
    found = sorted((r.ordinal, r.status) for r in warc.audit(ours, theirs).collect())
    assert found == [(3, "damaged"), (30, "damaged"), (39, "missing")]
    assert warc.audit(ours, ours).count() == 0 and warc.audit(ours.filter("false"), ours).filter("status = 'extra'").count() == 40
    assert warc.audit(ours.filter("false"), ours.filter("false")).count() == 0
