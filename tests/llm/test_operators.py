"""Each operator against its plain version, on odd inputs and on the smallest tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridframe.llm import language_id, media, mixing, pieces, quality_model, quality_rules, queries, simhash, token_counts, toxicity, warc
from tests.conftest import DATA, cells
from tests.llm import naive

LONG = "le mot est répété sans cesse " * 40_000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "a"),
    (2, "the quick BROWN fox jumps over the lazy dog and runs away from it", "en", "a"),
    (2, "the quick BROWN fox jumps over the lazy dog and runs away from it", "en", "a"),
    (None, "the quick brown fox jumps over the lazy dog and runs away from it", None, None),
    (None, None, None, None), (5, None, "fr", "b"), (6, "", "fr", "b"), (7, " \t\n\x0b\x0c\r ", None, "b"),
    (8, "12 34 !!! ??", "de", "b"), (9, "eins", "de", "é"), (10, "a b", "de", "é"), (11, "a b c", None, "é"), (12, "a b c d", None, "c"),
    (13, LONG, "fr", "c"), (14, "<|endoftext|> x<|endoftext|>", "en", "c"), (15, "▁漢字 🎉 \x00 é é", "en", "c"),
    (16, "x y z w v\n" * 30, "en", "c"), (17, "Buy now!! " * 20, "en", None), (7, "another text with the same id as one before it", "en", "a"),
    (18, "A" * 5000, "en", "d"), (19, "der die das und nicht ein eine mit von zu " * 3, "de", "d"), (20, "漢" * 300, None, "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns whose names clash with what operators add."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    extra = ["fp", "score", "size", "label", "component_id", "ids", "kept", "target", "taken", "predicted", "n_words", "words", "held_out"]
    return df.withColumns({c: F.lit("x") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def by_rows(rows):
    return sorted(rows, key=repr)


# --- 1 ---


def test_simhash_odd(odd, none):
    fps = [naive.fingerprint(t) for _, t, _, _ in ODD]
    of = naive.groups(fps)
    low = {g: min((i for (i, *_), h in zip(ODD, of, strict=True) if h == g and i is not None), default=None) for g in of}
    expected = [(i, f"{f:016x}", low[g]) for (i, *_), f, g in zip(ODD, fps, of, strict=True)]
    assert got(simhash.op1_simhash(odd), "doc_id", "fingerprint", "component_id") == by_rows(expected)
    assert simhash.op1_simhash(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    best = {g: min(((i is None, i or 0, t) for (i, t, *_), h in zip(ODD, of, strict=True) if h == g), key=lambda x: x[:2]) for g in of}
    assert by_rows(r.doc_id for r in kept.collect()) == by_rows(None if n else i for n, i, _ in best.values())
    assert simhash.keep_first(none).count() == 0


def test_simhash_tables(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [naive.fingerprint(r.text) for r in rows]
    of = naive.groups(fps)
    low = {g: min(r.doc_id for r, h in zip(rows, of, strict=True) if h == g) for g in set(of)}
    expected = [(r.doc_id, f"{f:016x}", low[g]) for r, f, g in zip(rows, fps, of, strict=True)]
    assert got(queries.QUERIES["op1_simhash"](spark, f"{DATA}/sf0.001"), "doc_id", "fingerprint", "component_id") == by_rows(expected)


def _spread(rng, n, near):
    base = [rng.getrandbits(64) for _ in range(n)]
    close = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base[:near] for _ in range(3)]
    ball = [base[0] ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)]  # all within four bits of each other
    return np.unique(np.array(base + close + ball, np.uint64))


def _all_links(points):
    """Component of each point, by comparing all pairs."""
    parent = np.arange(len(points))
    for i, x in enumerate(points):
        js = np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ x) <= 2) + i + 1
        simhash._link(parent, np.full(len(js), i), js)
    return simhash._roots(parent, np.arange(len(points)))


@pytest.mark.parametrize("seed", range(4))
def test_trees_lose_no_link(seed, monkeypatch):
    monkeypatch.setattr(simhash, "VISITORS", 300)
    rng = random.Random(seed)
    points = _spread(rng, 3000, 400)
    if seed == 3:  # nearly all alike in one half
        points = np.unique((points & np.uint64(0xFFFFFFFF)) | np.uint64(77 << 32))
    parent = np.arange(len(points))
    at = {int(p): i for i, p in enumerate(points)}
    for mask, reach in simhash._halves(2):
        tree = simhash.grow(points[::7], mask, 4)
        shard, idx, home = simhash.route(points, tree, mask, reach, 2)
        assert sorted(idx[home].tolist()) == list(range(len(points)))
        order = np.lexsort((~home, shard))
        half = int(mask != simhash._halves(2)[0][0])
        rows = (shard[order] * 2 + half, points[idx[order]], home[order])
        for a, b in simhash.search((tuple(x[i : i + 700] for x in rows) for i in range(0, len(order), 700)), 2):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                simhash._link(parent, np.array([at[x]]), np.array([at[y]]))
    assert (simhash._roots(parent, np.arange(len(points))) == _all_links(points)).all()


def test_half_alike_is_split_and_bounded():
    """A million fingerprints alike in one half go to many shards of bounded size."""
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(0, 1 << 32, 1_000_000, np.uint64)) | np.uint64(9 << 32)
    mask, reach = simhash._halves(2)[1]
    shard, idx, home = simhash.route(points, simhash.grow(points[::100], mask, 7), mask, reach, 2)
    sizes = np.bincount(shard[home])
    assert home.sum() == len(points) and len(sizes) > 100 and sizes.max() < len(points) / 20


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, k) for k in range(1001, 1200)]
    out = dict(got(simhash.components(spark.createDataFrame(chain + hub + [(5, 5)], "a long, b long").repartition(4)), "node", "label"))
    assert out == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1200)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_by_shards(spark):
    points = _spread(random.Random(9), 30_000, 300)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    a = {r.node: r.label for r in simhash.components(simhash.links(df, len(points))).collect()}
    of = _all_links(points)
    signed = points.view(np.int64)
    low = {}
    for r, x in zip(of.tolist(), signed.tolist(), strict=True):
        low[r] = min(low.get(r, x), x)
    often = Counter(of.tolist())
    assert a == {x: low[r] for r, x in zip(of.tolist(), signed.tolist(), strict=True) if often[r] > 1} and len(a) > 500


# --- 2 ---


def test_quality_rules(odd, none, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        expected = [(r.doc_id, *naive.quality(r.text), naive.keeps(r.text, quality_rules.RULES)) for r in rows]
        out = quality_rules.op2_quality_rules(df)
        assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == by_rows(expected)
        kept = quality_rules.keep_good(df)
        assert kept.columns == df.columns and kept.count() == sum(e[-1] for e in expected)
    assert quality_rules.op2_quality_rules(none).count() == 0


def test_repeated_windows_at_every_offset(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert got(quality_rules.op2_quality_rules(df), "doc_id", "n_repeat_words") == by_rows((i, naive.quality(t)[4]) for i, t in enumerate(texts))


def test_no_python_in_the_native_plans(odd):
    for df in (quality_rules.op2_quality_rules(odd), mixing.op6_mixing(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


# --- 3 and 7 ---


def _labels(spark):
    return spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")


@pytest.mark.parametrize(("op", "label", "n", "held", "least"), [(quality_model.op3_quality_model, "quality", 5, 0, 0.97), (toxicity.op7_toxicity, "toxic", 3, 1, 0.8)])
def test_classifiers_on_held_out_labels(spark, odd, none, op, label, n, held, least):
    many = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in op(many, _labels(spark)).collect()}
    assert len(found) == many.count() and all(0 <= r.score <= 1 and r.held_out == (naive.fold(r.doc_id, n) == held) for r in found.values())
    truth = [(r[label], found[r.doc_id].predicted, found[r.doc_id].score) for r in _labels(spark).collect() if found[r.doc_id].held_out]
    assert sum(y == p for y, p, _ in truth) / len(truth) > 0.95
    ones = [s for y, _, s in truth if y == 1]
    zeros = [s for y, _, s in truth if y == 0]
    assert sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros)) > least  # area under the curve
    again = {r.doc_id: r.score for r in op(many.repartition(5), _labels(spark)).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in found.items())
    small = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (6, None), (999, 1)], f"doc_id long, {label} int")
    assert op(odd, small).count() == len(ODD)
    assert op(odd, small.filter("false")).count() == len(ODD)
    assert op(none, small).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_model.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.train(x[:3000], y[:3000])
    assert (1, 0) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] == 1)).mean() > 0.95
    z = np.full(3, model.base)
    b = model.bins(x[:3])
    for j, t in enumerate(model.tables):
        z += t[b[:, j]]
    for i, j, t in model.pairs:
        z += t[[k * t.shape[0] // len(model.tables[i]) for k in b[:, i]], [k * t.shape[1] // len(model.tables[j]) for k in b[:, j]]]
    assert np.allclose(model.score(x[:3]), 1 / (1 + np.exp(-z)))


def test_risk_does_not_follow_unlabelled_positives():
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 400)}"
    clean = [{word() for _ in range(30)} for _ in range(900)]
    bad = [{word() for _ in range(30)} | {rng.choice(["vile", "nasty", "foul"])} for _ in range(200)]
    model = toxicity.train(bad[:100], clean[:700] + bad[100:150], 0.07)  # positives among the unlabelled
    assert sum(model.score(" ".join(d)) >= 0.7 for d in bad[150:]) >= 48
    assert sum(model.score(" ".join(d)) >= 0.7 for d in clean[700:]) <= 3


# --- 4 ---


def test_language_id(odd, none, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text", "lang").collect()
        profiles = naive.languages((r.text, r.lang) for r in rows if naive.fold(r.doc_id, 4) != 2)
        expected = [(r.doc_id, naive.fold(r.doc_id, 4) == 2, *naive.language(r.text, profiles)) for r in rows]
        out = [(i, h, x, round(s, 9)) for i, h, x, s in got(language_id.op4_language_id(df), "doc_id", "held_out", "lang_pred", "score")]
        assert by_rows(out) == by_rows((i, h, x, round(s, 9)) for i, h, x, s in expected)
    assert language_id.op4_language_id(none).count() == 0
    kept = language_id.keep_known(odd)
    assert kept.columns == odd.columns and {None, 5, 6, 7, 8} & {r.doc_id for r in kept.filter("text IS NULL OR text RLIKE '^[0-9 !?]*$'").collect()} == set()


def test_languages_held_out(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = language_id.op4_language_id(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98


def test_ngrams_in_chunks(monkeypatch):
    text = "Äpfel, und ç'est 漢字 b" * 50 + "!"
    whole = language_id.ngrams(text)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    parts = language_id.ngrams(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert int(whole[1].sum()) == sum(naive.grams(text).values())


# --- 5 ---


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    for shape in ((1, 1, 1), (5, 7, 3), (9, 4, 4), (3, 8, 2)):
        p = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode(p, kind)) == p).all()


def test_png_damage_is_found():
    png = media.encode(np.zeros((4, 4, 3), np.uint8))
    for bad in (png[:-1], png[:20] + bytes([png[20] ^ 1]) + png[21:], b"x" + png[1:], png[:45], png[:-12]):
        with pytest.raises(ValueError):
            media.decode(bad)
    wide = b"IHDR" + (4).to_bytes(4, "big") * 2 + bytes([16, 2, 0, 0, 0])
    with pytest.raises(ValueError):
        media.decode(media.SIGNATURE + (13).to_bytes(4, "big") + wide + zlib.crc32(wide).to_bytes(4, "big") + media._chunk(b"IEND", b""))


def test_mixed_filters_as_other_writers_use_them():
    rng = np.random.default_rng(5)
    p = rng.integers(0, 256, (10, 6, 3), dtype=np.uint8)
    kinds = np.array([4, 1, 1, 2, 2, 3, 4, 0, 2, 3], np.uint8)
    lines = np.stack([media._filtered(p.reshape(10, 18), 3, int(k))[y] for y, k in enumerate(kinds)])
    assert (media._unfiltered(kinds, lines, 3).reshape(p.shape) == p).all()


def test_media(odd, none, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        expected = []
        for r in rows:
            b = (r.text or "").encode()
            p = b + b" " * (-len(b) % 192 or 192 * (not b))
            expected.append((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
        out = media.op5_media(df)
        assert got(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == by_rows(expected)
        assert out.filter("media_bytes <= 0 OR length(feature) <> 16 OR length(media_sha256) <> 64").count() == 0
    assert media.op5_media(none).count() == 0


def test_cosine_hash():
    rng = np.random.default_rng(0)
    waves = np.cos(np.pi * (2 * np.arange(96) + 1)[None, :] * np.arange(8)[:, None] / 192)
    smooth = waves.T @ rng.normal(0, 20, (8, 8)) @ waves
    image = lambda a: np.repeat(np.clip(a + 128, 0, 255).astype(np.uint8)[:, :, None], 3, axis=2)
    far = lambda a, b: sum((i ^ j).bit_count() for i, j in zip(a, b, strict=True))
    a, b, c = (media.dct_hash(image(v)) for v in (smooth / 4, smooth / 4 + rng.normal(0, 3, smooth.shape), smooth[::-1, ::-1] / 4))
    assert far(a, b) <= 6 and far(a, c) >= 16
    flat = media.dct_hash(np.full((1, 64, 3), 32, np.uint8))
    assert flat == media.dct_hash(np.full((1, 64, 3), 32, np.uint8)) and len(flat) == 8


# --- 6 ---


def test_mixing(odd, none, docs):
    for df in (odd, docs, docs.withColumn("source", F.when(F.col("doc_id") % 3 != 0, "one").when(F.col("doc_id") < 60, "tiny"))):
        rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
        size, by, goal, times = naive.mixture(rows)
        expected = by_rows((i, n, by[s], round(float(goal[s]), 6), n * t) for (i, _, s), n, t in zip(rows, size, times, strict=True))
        out = mixing.op6_mixing(df)
        assert by_rows((i, n, b, round(t, 6), k) for i, n, b, t, k in got(out, "doc_id", "size", "source_size", "target", "taken")) == expected
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == sum(times)
    assert mixing.op6_mixing(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_of_a_hot_id(spark):
    """Rows of one id, and rows without one and of equal text, of which a part is taken."""
    kind = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    df = spark.range(600).select(kind.alias("doc_id"), F.when(F.col("id") % 6 == 0, "a b c d e").otherwise("x y z").alias("text"), F.when(F.col("id") % 3 == 1, "b").when(F.col("id") < 500, "a").alias("source")).repartition(5)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    size, by, goal, times = naive.mixture(rows)
    assert got(mixing.op6_mixing(df), "doc_id", "size", "taken") == by_rows((i, n, n * t) for (i, _, _), n, t in zip(rows, size, times, strict=True))
    sizes = mixing.sized(df)
    near = mixing.at_cut(sizes, mixing.cuts(sizes)).collect()
    assert any(0 < r.c_take < r.c_all for r in near)
    expected = Counter()
    for r, t in zip(rows, times, strict=True):
        expected[r] += t
    assert Counter((r.doc_id, r.text, r.source) for r in mixing.mix(df).collect()) == +expected


def test_mixing_is_near_its_targets_and_repeats_itself(spark, docs):
    out = mixing.op6_mixing(docs)
    for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most
    assert got(out, *out.columns) == got(mixing.op6_mixing(docs.repartition(7)), *out.columns)
    assert out.filter("taken > 3 * size").count() == 0


# --- 8 and 9 ---


def test_sentencepiece_matches_the_library(odd, none, docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.VOCABULARY))
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        coded = pieces.encode(df)
        assert by_rows((r.doc_id, list(r.ids)) for r in coded.collect()) == by_rows((r.doc_id, sp.encode(r.text or "")) for r in rows)
        assert by_rows((r.doc_id, r.text) for r in pieces.decode(coded).collect()) == by_rows((r.doc_id, sp.decode(sp.encode(r.text or ""))) for r in rows)
        digest = [(r.doc_id, len((r.text or "").encode()), len(i := sp.encode(r.text or "")), zlib.crc32(np.array(i, "<i4").tobytes()), "▁" not in (r.text or "")) for r in rows]
        assert got(pieces.op8_sentencepiece(df), "doc_id", "n_bytes", "n_ids", "ids_crc32", "round_trip") == by_rows(digest)
    assert pieces.op8_sentencepiece(none).count() == 0


def test_word_shapes_match_the_library():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.VOCABULARY))
    rng = random.Random(2)
    alphabet = "aabbccdeetinors  .,éñü漢字\n\t0123🎉ыж"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(800)] + [" " * n for n in range(40)] + ["ab" * n for n in (5, 16, 17, 33, 400)]
    encoder = pieces.Encoder(pieces.encoder().v)
    assert [x.tolist() for x in encoder.encode(texts)] == sp.encode(texts)


def test_unigram_paths_are_the_best():
    import itertools

    vocabulary = [("<unk>", 0.0, pieces.UNKNOWN)] + [(p, s, pieces.NORMAL) for p, s in (("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -3.5), ("ba", -4.6), ("aba", -5.2), ("▁ab", -5.0))]
    v = pieces.Vocabulary.of(vocabulary, pieces.UNIGRAM)
    score = {p: s for p, s, _ in vocabulary}
    e = pieces.Encoder(v)
    for text in ("ab", "aba", "abab", "babaab", "a b ab", "bbbb", "abaabba"):
        full = "▁" + text.replace(" ", "▁")

        def cost(cuts, full=full):
            parts = [full[i:j] for i, j in itertools.pairwise([0, *cuts, len(full)])]
            return sum(score.get(p, -1e9) for p in parts)

        best = max(cost(c) for k in range(len(full)) for c in itertools.combinations(range(1, len(full)), k))
        assert sum(v.scores[i] for i in e.encode([text])[0]) == pytest.approx(best)
    assert e.encode(["axxb"])[0].tolist() == [5, 0, 3]  # neighbouring unknown characters are one piece


def test_occurrences_of_pieces():
    v = pieces.encoder().v
    text = "the cat  sat on the mat; naïve 漢字 \x00 the end".encode()
    found = set(zip(*(x.tolist() for x in pieces.edges(v, np.frombuffer(text, np.uint8))), strict=True))
    expected = set()
    for i in v.ids.tolist():
        p = v.pieces[i].replace("▁", " ").encode()
        at = text.find(p)
        while at >= 0:
            expected.add((at, len(p), i))
            at = text.find(p, at + 1)
    assert found == expected


def test_token_counts(odd, none, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts._place(token_counts.VOCABULARY))
    for df, hot in ((odd, None), (odd, 0), (docs, None), (docs, 40)):
        rows = df.select("doc_id", "text").collect()
        n = [len(t.encode(r.text or "", add_special_tokens=False).ids) for r in rows]
        expected = [(r.doc_id, len((r.text or "").encode()), k, k > 1024) for r, k in zip(rows, n, strict=True)]
        assert got(token_counts.token_counts(df, hot=hot), "doc_id", "n_bytes", "n_tokens", "over_limit") == by_rows(expected)
    assert token_counts.op9_token_counts(none).count() == 0


def test_every_pre_token_is_counted_once(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts._place(token_counts.VOCABULARY))
    cut = token_counts.pre_tokenizer(token_counts.VOCABULARY)
    found = token_counts.counted(token_counts.frequencies(docs)).collect()
    expected = Counter(p for r in docs.select("text").collect() for p in cut.frequencies(r.text or "")[0].elements())
    assert {r.token: r.times for r in found} == expected and len(found) == len(expected)
    assert all(r.pieces == len(t.encode(r.token, add_special_tokens=False).ids) for r in found[:2000])


def test_pre_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts._place(token_counts.VOCABULARY))
    cut = token_counts.pre_tokenizer(token_counts.VOCABULARY)
    for x in ["it's  a\t\ttest ", "\r\n a", "I'll 漢字", " ", "it's", "<|endoftext|> x<|endoftext|>", ""]:
        own, specials = cut.frequencies(x)
        assert specials + sum(n * k for n, k in zip(own.values(), cut.pieces(list(own)), strict=True)) == len(t.encode(x).ids)


# --- 10 ---


def test_warc_audit_finds_every_kind_of_difference(spark):
    ours = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(1200)] + [(None, None, None), (7, "http://x/7b", "again")], "page_id long, url string, html string")
    assert warc.audit(warc.archive(ours), warc.archive(ours.repartition(5))).count() == 0
    changed = F.when(F.col("page_id") == 601, F.lit("<p>X01</p>")).otherwise(F.col("html"))
    theirs = ours.withColumn("html", changed).filter("page_id IS NULL OR page_id <> 1100").unionAll(spark.createDataFrame([(5000, "u", "h")], ours.schema))
    found = warc.audit(warc.archive(ours), warc.archive(theirs))
    kinds = {(r.page_id, r.status) for r in found.collect()}
    assert {(1100, "missing"), (5000, "extra")} <= kinds and {s for p, s in kinds if p not in (601, 1100, 5000)} == {"moved"}
    assert (601, "damaged") in kinds and {p for p, s in kinds if s == "moved"} == set(range(1101, 1200))
    same_size = ours.withColumn("html", F.when(F.col("page_id") == 601, F.lit("<p>601<!p>")).otherwise(F.col("html")))
    assert [(r.page_id, r.status) for r in warc.audit(warc.archive(ours), warc.archive(same_size)).collect()] == [(601, "damaged")]


def test_warc_offsets_and_digests(spark):
    pages = spark.createDataFrame([(2, "u2", "é"), (1, "u1", "a"), (1, "u1", "a"), (3, None, None)], "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    records = sorted(warc.archive(pages).collect(), key=lambda r: r.ordinal)
    raw = [pages.filter(F.col("page_id") == r.page_id).select(warc.record(F.col("page_id"), F.col("url"), F.col("html"))).first()[0] for r in records]
    at = 0
    for r, b in zip(records, raw, strict=True):
        assert (r.record_offset, r.length, r.sha256) == (at, len(b), hashlib.sha256(b).hexdigest())
        at += len(b)
    assert b"Content-Length: 2\r\n" in raw[2] and raw[2].endswith("é\r\n\r\n".encode())
    assert warc.op10_warc(pages).count() == 4 and warc.op10_warc(pages.filter("false")).count() == 0


def test_crowded_ids_are_dealt_to_files(spark):
    pages = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, 7).alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 9 == 2, "equal").otherwise(F.col("id").cast("string")).alias("html"))
    assert {r.l_base for r in warc.crowded(pages).collect()} == {warc.NO_ID, 0}
    both = warc.archives(pages, F.when(F.col("html") == "4000", "x").otherwise(F.col("html"))).persist()
    assert both.groupBy("file").count().agg(F.max("count")).first()[0] < 3 * warc.FILE and both.count() == 9000
    ours, theirs = warc.replica(both, 0), warc.replica(both, 1)
    found = Counter(r.status for r in warc.audit(ours, theirs).collect())
    assert found["damaged"] == 1 and found.keys() <= {"damaged", "moved"}
    gone = theirs.filter(F.col("ordinal") != 3)
    found = Counter(r.status for r in warc.audit(ours, gone).collect())
    assert found["missing"] == theirs.select("file").distinct().count() and found["damaged"] == 1
    assert warc.audit(ours, warc.archive(pages.repartition(3))).count() == 0


def test_descent_reads_only_differing_branches(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    ours, theirs = warc.archive(pages), warc.archive(pages.withColumn("html", F.when(F.col("page_id") == 77, "xx").otherwise(F.col("html"))))
    levels = warc.levels_of(ours, theirs)
    assert levels == 3
    a, b = (warc.tree(x, levels).persist() for x in (ours, theirs))
    assert [tuple(r) for r in warc.differing(a, b, levels).collect()] == [(0, 77 // warc.FAN)]
    # leaves under nodes that are equal are never looked at
    spoilt = b.withColumn("l1", F.transform("l1", lambda h, i: F.when(F.floor(i / 8) == 1, h).otherwise("other")))
    assert {r.leaf for r in warc.differing(a, spoilt, levels).collect()} == {9} and a.filter("file_root IS NULL").count() == 0


# --- queries ---


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):
    assert cells(queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()) == cells(duck.execute(queries.ORACLES[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
