"""The corpus pipeline against a plain version of all its stages."""

from collections import Counter

import corpus_pipeline
from gridframe.llm import language_id, quality_rules
from tests.conftest import DATA
from tests.llm import naive


def plain(rows):
    """Stages over (doc_id, text, lang, source); the last gives (doc_id, ids)."""
    import public_tokenizers
    import sentencepiece

    profiles = naive.languages((t, x) for i, t, x, _ in rows if naive.fold(i, 4) != 2)
    told = [naive.language(t, profiles) for _, t, _, _ in rows]
    rows = [r for r, (x, s) in zip(rows, told, strict=True) if x != "und" and s >= language_id.MIN_SCORE]
    yield rows
    rows = [r for r in rows if naive.keeps(r[1], quality_rules.RULES)]
    yield rows
    of, _ = naive.similar_groups([t for _, t, _, _ in rows])
    best = {}
    for r, g in zip(rows, of, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: x[0])
    rows = list(best.values())
    yield rows
    *_, times = naive.mixture([(i, t, s) for i, t, _, s in rows])
    rows = [r for r, n in zip(rows, times, strict=True) for _ in range(n)]
    yield rows
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    yield [(i, tuple(sp.encode(t))) for i, t, _, _ in rows]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    columns = docs.columns
    for k, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, plain(rows), strict=True)):
        docs = stage(spark, docs, f"{DATA}/sf0.001")
        if k < 4:
            assert docs.columns == columns, name
            docs = docs.persist()
            assert Counter((r.doc_id, r.text, r.lang, r.source) for r in docs.collect()) == Counter(expected), name
            assert 0 < len(expected)
        else:
            assert Counter((r.doc_id, tuple(r.ids)) for r in docs.collect()) == Counter(expected)
            assert all(r.n_ids == len(r.ids) for r in docs.collect())


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "123 !!!", None, "a", 7)]
    rows += [(i, f"the cat number {chr(97 + i)} sat on the old mat of the {'wise' * (i % 3)} man in town {i}", "en", "ab"[i % 2], 9) for i in range(3, 23)]
    rows += [rows[5], rows[6]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "n_ids"] and 0 < out.count()
    df.filter("false").write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "near-duplicates", "mixing", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    good = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").filter("quality = 1")
    n = docs.join(good, "doc_id", "left_semi").filter("n_chars > 60").count()
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, f"{DATA}/sf0.01")
    assert docs.join(good, "doc_id", "left_semi").filter("n_chars > 60").count() >= 0.97 * n
