"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing, tokens.

Every stage takes what its predecessor kept; ``run`` writes each stage's rows to the shared folder and reads them back.  In
every stage columns besides those of ``documents`` pass through, but for the last; null ids and sources, ties and very long
texts are like any other; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridframe.llm import language_id, mixing, near_copies, pieces, quality_rules
from gridframe.llm.common import stored, tables
from gridframe.session import discard, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the corpus itself teaches; texts that are null, without letters or far from every language go. Repeated rows are judged alike."""
    return language_id.keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; null and empty texts do not. Repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles with a similarity of 0.8 or more.

    Of repeated rows one stays; null and empty texts are copies of each other; a null id is the largest.
    """
    return near_copies.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; a document of a second epoch is a second row. Null sources are one source."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, ``n_ids`` of each row; a null or empty text has no ids."""
    return pieces.encode_corpus(docs)


STAGES = [("language ID", language), ("quality rules", quality), ("near-duplicates", near_duplicates), ("mixing", mixture), ("tokens", tokens)]

#: Trained profiles and fingerprints are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage stored is deleted once its rows are written. An empty table gives no rows."""
    docs, kept = tables(spark, sf_dir, "documents"), written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
            discard(spark, since=kept, keep=1)
    return docs
