"""Whole jobs of the library's operators: no word and no replicate is left out."""

import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.functions import vectors
from tessera.operators import agreement, grams, linalg, ordered, resample, textq, tfidf
from tessera.plans import catalog
from tessera.sources import tables


def test_search_by_rare_words(spark):
    many = " ".join(f"word{i} word{i}" for i in range(5001))
    rows = spark.createDataFrame([(1, many), (2, "needle in hay"), (3, "hay and straw")], "id long, t string")
    asked = spark.createDataFrame([(0, "needle"), (1, "straw hay")], "query int, t string")
    got = {(r.query, r["rank"]): r.id for r in tfidf.search(rows, "id", "t", asked).collect()}
    assert got == {(0, 1): 2, (1, 1): 3, (1, 2): 2}


def test_cross_validation_has_all_splits_and_components(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(linalg, "cross_validated_cca", lambda df, *names, splits=10, components=10: asked.update(splits=splits, components=components) or [(0, 0.0)])
    catalog.QUERIES["cross_validated_cca"](spark, "/root/testdata/sf0.001")
    assert asked == {"splits": 10, "components": 10}


def test_interval_is_that_of_repeated_units(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), str(rng.choice(list("aab"))) if rng.random() > 0.1 else None) for u in rng.integers(0, 40, 160)]
    df = spark.createDataFrame(rows, "u int, l string")
    got = resample.bootstrap_nominal(df, "u", "l", 25, 5).first()
    units = [u for u, n in Counter(u for u, _ in rows).items() if n >= 2]
    w, alphas = resample.times(5, 25, units), []
    for b in range(25):
        own = [(f"{u}-{k}", l) for j, u in enumerate(units) for k in range(w[j, b]) for v, l in rows if v == u]
        counts, m = Counter(own), Counter(x for x, _ in own)
        n, pool = len(own), Counter(l for _, l in own)
        apart = sum((m[x] * (m[x] - 1) - sum(c * (c - 1) for (y, _), c in counts.items() if y == x)) / (m[x] - 1) for x in m)
        alphas.append(1 - (apart / n) / ((n * (n - 1) - sum(c * (c - 1) for c in pool.values())) / (n * (n - 1))))
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(alphas, [2.5, 97.5]))) and got.reps == 25
    each = {r.b: r.alpha for r in resample.bootstrap_nominal_by(df.withColumn("g", F.lit("x")), "u", "l", "g", 25, 5).collect()}
    assert len(each) == 25


def test_vector_interval_is_that_of_repeated_units(spark):
    rng = np.random.default_rng(4)
    x, unit = rng.standard_normal((45, 5)), np.arange(45) // 3
    df = spark.createDataFrame([(int(u), v.tolist()) for u, v in zip(unit, x)], "u int, v array<double>")
    got = resample.bootstrap_semantic(df, "u", "v", 20, 2).first()
    x /= np.linalg.norm(x, axis=1)[:, None]
    d, w, alphas = (1 - x @ x.T) ** 2, resample.times(2, 20, range(15)), []
    for b in range(20):
        k = w[unit, b].astype(float)
        n, inside = k.sum(), unit[:, None] == unit[None]
        alphas.append(1 - ((k[:, None] * d * inside).sum() / 2 / n) / ((k[:, None] * k[None] * d).sum() / (n * (n - 1))))
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(alphas, [2.5, 97.5])))


def test_counts_of_units_are_poisson():
    w = resample.times(1, 200, range(500))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def test_places_and_mid_ranks_over_ranges(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 300, 2000)
    df = spark.createDataFrame([(k, int(x), "ab"[k % 2]) for k, x in enumerate(v)], "id int, v int, g string")
    got = ordered.ranked(df, [-F.col("v"), F.col("id")], "r").toPandas().sort_values("r")
    assert got.r.tolist() == list(range(1, 2001)) and got.id.tolist() == sorted(range(2000), key=lambda k: (-v[k], k))
    got = textq.midranks(df, "v", by="g").toPandas()
    assert (got["rank"] == got.groupby("g").v.rank()).all()


def test_truncation_by_all_prefixes_and_a_dictionary(spark):
    words = ["walking", "walker", "walks"] * 9 + ["wal", "tab", "table", "tables"] + ["tables"] * 20 + ["x" * 50_000]
    texts = [f"say {w}." for w in words] + ["go wal", "a tab", "one table", "no stop walking", "", "???", "go on.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    count = Counter(re.findall("[a-z]+", " ".join(t or "" for t in texts).lower()))

    def cut(t, known=()):
        last = (re.findall("[a-z]+", (t or "").lower()) or [None])[-1]
        longer = sum(c for w, c in count.items() if last and w != last and w.startswith(last))
        return bool(last) and t[-1] not in ".!?" and count[last] <= 2 and longer >= 20 and not (len(last) >= 4 and last in known)

    assert [r.truncated for r in textq.flag_truncated(df, "t").orderBy("id").collect()] == [cut(t) for t in texts]
    known = spark.createDataFrame([("table",), ("tab",)], "word string")
    got = [r.truncated for r in textq.flag_truncated(df, "t", known).orderBy("id").collect()]
    assert got == [cut(t, ("table", "tab")) for t in texts] and sum(got) == 2


def test_rank_and_correlations_of_the_embeddings(spark):
    d = "/root/testdata/sf0.001"
    x = np.stack(pd.read_parquet(f"{d}/embeddings.parquet").embedding).astype(float)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s / s.sum()
    assert catalog.QUERIES["effective_rank"](spark, d).first()[0] == pytest.approx(np.exp(-(p * np.log(p)).sum()), abs=1e-6)
    c = np.cov(x.T)

    def root(m):
        w, v = np.linalg.eigh(m + 1e-4 * np.eye(32))
        return v / np.sqrt(w) @ v.T

    want = np.linalg.svd(root(c[:32, :32]) @ c[:32, 32:] @ root(c[32:, 32:]), compute_uv=False)[:10]
    assert [r.correlation for r in catalog.QUERIES["cca_views"](spark, d).orderBy("component").collect()] == pytest.approx(list(want), abs=1e-6)


def test_word_lists_and_json(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Walk\n walk \n\nTable\n")
    assert sorted(r.word for r in tables.read_words(spark, str(tmp_path / "words.txt")).collect()) == ["table", "walk"]
    tables.write_json(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("a", "b").collect()] == [(1, "é")]


def test_all_pairs_in_blocks(spark):
    rng = np.random.default_rng(6)
    units = [None if u > 20 else int(u) for u in rng.integers(0, 25, 90)]
    rows = [(i // 2 if i < 8 else None if i == 9 else i, u, None if i == 11 else rng.standard_normal(5).tolist()) for i, u in enumerate(units)]
    df = spark.createDataFrame(rows, "id int, u int, x array<double>")
    slow = agreement.alpha_by_pairs(df.withColumn("x", vectors.unit("x")), "u", lambda a, b: vectors.squared_cosine_distance(a["x"], b["x"]), "id").first()
    for block in (7, 200):
        assert tuple(agreement.alpha_by_blocks(df, "u", "x", "id", block).first()) == pytest.approx(tuple(slow), abs=1e-10)


def test_naive_alpha_has_no_limit_of_rows(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"vec_id": np.arange(20_101), "embedding": list(rng.standard_normal((20_101, 4))), "label": 0})
    rows.to_parquet(tmp_path / "embeddings.parquet")
    naive, closed = (catalog.QUERIES[q](spark, str(tmp_path)).first() for q in ("alpha_naive_triples", "alpha_semantic_triples"))
    assert tuple(naive) == pytest.approx(tuple(closed), abs=1e-7) and naive.n_pairable == 20_100


def test_character_grams_of_odd_texts_equal_sql(spark, tmp_path):
    odd = [None, "", "ab", "abc", "a \t\n b", "a\x0b\x0bb c", "\u0130\u03a3\u03a3 \u1e9e", "\U0001f600\U0001f601 \U0001f600", "nul\x00nul\x00 ", "  Lead  ", "x" * 300]
    more = ["".join(map(chr, 0x4E00 + np.random.default_rng(8).permutation(4500)[:4300])), "Some words and SOME words" * 9]
    keys = [*range(len(odd)), 3, 3, None, None, 50, 51]
    texts = [*odd, "abcd", "xabc", "abc abc", "abc", *more]
    pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    got = Counter(map(tuple, catalog.QUERIES["tfidf_char_grams"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
        asked = db.execute(catalog.ORACLES["tfidf_char_grams"]).fetchall()
    near = {(k, t): w for k, t, w in asked}
    assert sum(got.values()) == len(asked) == len(near) > 4000
    assert all(near[k, t] == pytest.approx(w, abs=1.1e-8) for k, t, w in got)


@pytest.mark.parametrize("dense", [1 << 23, 1])
def test_character_grams_by_counting(monkeypatch, dense):
    monkeypatch.setattr(grams, "DENSE", dense)
    monkeypatch.setattr(grams, "WAITING", 50)
    monkeypatch.setattr(grams, "HELD", 40)
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abc d"), rng.integers(0, 60))) for _ in range(40)] + [None]
    plain = [re.sub(" +", " ", t or "") for t in texts]
    each = [Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for t in plain]
    batch = pa.record_batch([pa.array(texts, pa.string())], ["t"])
    totals = Counter()
    for b in grams.total_counts(2, 4)(iter([batch])):
        for t, c in zip(b["token"].to_pylist(), b["total"].to_pylist()):
            totals[t] += c
    assert totals == sum(each, Counter())
    kept = [t for t, _ in totals.most_common(60)]
    found = grams.finder(kept, 2, 4)
    for _, points, sizes in grams.slices(batch):
        row, i, c = found(points, sizes)
        assert {(r, kept[j]): n for r, j, n in zip(row, i, c)} == {(r, t): n for r, own in enumerate(each) for t, n in own.items() if t in kept}
