"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F
from tessera.llm import ann, langid, licenses, merkle, mixing, nearjoin, packing, pii, quality, tokenbin
import public_tokenizers

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the cat sat on the mat and looked at one bird after another. " * 4000
ROWS = [
    (5, "a small text of some seven words here", "en", "s1", 37), (5, "a small text of some seven words here", "en", "s1", 37),
    (1, None, "en", None, None), (2, "", None, "s1", 0), (3, " \n\t ", "en", "s2", 4), (4, LONG, "en", "s1", len(LONG)),
    (6, "ein kleiner deutscher Satz mit Wörtern über das Wetter", "de", "s3", None), (7, "123 456 !!", None, None, 10),
    (None, "no id but a text of its own", "en", "s2", 5), (8, "a small text of some seven words here", "en", "s9", 37),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clash(docs):
    """Columns that operators add themselves."""
    names = ["digest", "license_id", "notice_ids", "score", "predicted", "lang_pred", "ambiguous", "n_email", "spans", "base_sha256", "size", "taken", "draws", "target", "source_size", "copy", "node", "key", "component", "start", "piece", "length", "range", "held_out", "shard"]
    return docs.withColumns({n: F.lit("x") for n in names})


def test_licenses(spark, docs, none, clash):
    known = licenses.known(spark, licenses.LICENSES, licenses.DIGESTS)
    for df in (docs, clash):
        rows = licenses.scan(df, known, licenses.notices()).collect()
        assert len(rows) == 10 and all(r.license_id is None and r.notice_ids == "" and len(r.digest) == 64 for r in rows)
    assert licenses.scan(none, known, licenses.notices()).count() == 0
    assert licenses.scan(docs, known, []).count() == 10


def test_quality(spark, docs, none, clash):
    labels = spark.createDataFrame([(5, 1), (6, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    for df in (docs, clash):
        model = quality.learn(df, labels)
        rows = quality.score(df, model).collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert quality.learn(none, labels) is None
    assert quality.score(none, None).count() == 0
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_token_files(spark, docs, none, clash, tmp_path):
    for k, df in enumerate((docs, clash)):
        tokenbin.write(df, str(tmp_path / str(k)), BPE, 1)
        rows = tokenbin.read(spark, str(tmp_path / str(k))).orderBy("start").collect()
        assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
        assert [r.n_tokens for r in rows][1:4] == [1, 1, 1]
        assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    tokenbin.write(none, str(tmp_path / "none"), BPE, 1)
    assert tokenbin.read(spark, str(tmp_path / "none")).count() == 0


def test_packing(docs, none, clash):
    for df in (docs, clash):
        rows = packing.pack(df, BPE, capacity=64).collect()
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in by.values():
            s.sort()
            assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(s[-1]) <= 64
        assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert packing.pack(none, BPE).count() == 0


def test_mixing(spark, docs, none, clash):
    for df in (docs, clash):
        rows = mixing.mix(mixing.sized(df), shards=3).collect()
        assert len(rows) == 10 and all(r.taken <= 2 * r.size for r in rows)
        for source in {r.source for r in rows}:
            own = [r for r in rows if r.source == source]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 2
    assert mixing.mix(mixing.sized(none)).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r.size, r.target, r.taken) for r in mixing.mix(mixing.sized(blank)).collect()} == {(0, 0.0, 0)}


def test_fingerprints(spark, docs, none, clash):
    for df in (docs, clash):
        rows = {(r.doc_id, r.n_chars): r for r in merkle.compare(df).collect()}
        assert merkle.compare(df).count() == 10
        assert rows[(1, 0)].near_next == 1.0  # two empty texts
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())
    assert merkle.compare(none).count() == 0
    one = merkle.compare(spark.createDataFrame(ROWS[:1], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_search(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [1.0, float("inf")]), (8, [1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (40, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x")).withColumn("h1", F.lit(1))
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 20] == [(1, 1), (2, 9), (3, 2), (4, 40)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id = 20").limit(1), F.col("vec_id") % 20 == 0).count() == 0


def test_languages(docs, none, clash):
    for df in (docs, clash):
        rows = langid.identify(df, langid.learn(df)).collect()
        assert len(rows) == 10
        assert all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in rows)
    assert langid.learn(none) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(none, None).count() == 0


def test_personal_data(docs, none, clash):
    for df in (docs, clash):
        rows = pii.detect(df.select(*[c for c in df.columns]), redact=False).collect()
        assert len(rows) == 10 and all(r.spans == "" and r.n_email == 0 for r in rows)
        assert pii.detect(df, redact=True).columns == df.columns
    assert pii.detect(none).count() == 0


def test_near_join(spark, docs, none, clash):
    for df in (docs, clash):
        rows = nearjoin.join(df).collect()
        assert len(rows) == 10
        same = [r for r in rows if r.doc_id in (5, 8)]
        assert all(r.class_id == 5 and r.n_links == 2 and r.n_class == 3 for r in same)
        assert all(r.n_links == 0 and r.class_id == r.doc_id for r in rows if r.doc_id in (1, 2, 3, 4, 6))
    assert nearjoin.join(none).count() == 0


@pytest.mark.parametrize("stage", [langid.stage, nearjoin.stage, pii.stage, mixing.stage, packing.stage])
def test_stages(spark, docs, none, stage):
    out = stage(spark, docs, "")
    if stage is not packing.stage:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, none, "").count() == 0
