"""What grows with the data: samples of any table size, texts of any shape in linear time, ids of any letter."""

import random
import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tessera.llm import common, pii
from tessera.llm.tokens import WordTokenizer

BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("total", [1, 3000, 10**6, 3 * 10**9, 5 * 10**10, 10**13])
def test_samples_of_any_table_have_rows(total):
    share = 1.1 * 3000 / total
    assert ((common.hash_bound(share) + 2**63) / 2**64 - min(share, 1)) <= 1e-15
    assert common.hash_bound(share) == 2**63 - 1 if share >= 1 else common.hash_bound(share) > -(2**63) + 10**6


def test_a_small_bound_draws_its_share(spark):
    rows = spark.range(2_000_000).select(F.xxhash64(F.lit(7), "id").alias("h"))
    assert 20 < rows.where(F.col("h") <= common.hash_bound(50 / 2_000_000)).count() < 100


N = 1_000_000
LONG = {
    "letters and a sign": "a" * N + "@ b", "digits and a stop": "1" * N + ".", "dotted parts": "mail me @ home. Chapter " + "a." * 2000 + " 7",
    "dotted parts with signs": "".join(f"{'p.' * 40}q @ " for _ in range(1000)), "versions": "x @ y " + "1." * (N // 2), "spaces": "a" + " " * N + "@ b at c.d",
    "dashes": "one " + "-" * N + "a", "loose dashes": "one " + "- - " * (N // 4) + "x", "dots": "a dot " * (N // 6) + " at b.c", "blanks": " at" + " " * N,
    "signs": "a @ " * (N // 4), "brackets": "[ " * (N // 2) + "@ x", "plus": "+1" + " " * N, "look-alikes": "о" * N, "many finds": "a@b.co " * (N // 7) + "jоe",
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_a_megabyte_of_anything_takes_seconds(name):
    began = time.time()
    base, every = pii.spans(LONG[name])
    assert time.time() - began < 20 and set(base) <= set(every)


def test_base_spans_are_those_of_the_plain_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    draw = random.Random(2)
    for _ in range(20_000):
        t = "".join(draw.choices("ab.@@_-%1 ", k=draw.randint(1, 16)))
        assert [x[1:] for x in pii.identifiers(t) if x[0] == 0] == [m.span() for m in email.finditer(t)]
        t = "".join(draw.choices("12...a", k=draw.randint(1, 22)))
        assert [x[1:] for x in pii.identifiers(t) if x[0] == 1] == [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]


def same_ids(words: WordTokenizer, texts: list[str]) -> None:
    got, at = words.encode(pa.array(texts), 1)
    for k, want in enumerate(words.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert got[at[k] : at[k + 1]].tolist() == [*want.ids, 1], texts[k]


def test_ids_after_every_letter_are_the_library_s():
    words = WordTokenizer(BPE)
    letters = [c for c in map(chr, range(0x3000)) if unicodedata.category(c)[0] in "LMN"]
    same_ids(words, [x for c in letters for x in (c + ".", f"b{c}, x", f"{c}̇.a")])


def test_ids_of_odd_mixtures_are_the_library_s():
    draw, words = random.Random(3), WordTokenizer(BPE, known_words=50)
    for _ in range(8):
        same_ids(words, ["".join(draw.choices("abIİiΣς.,'ſ’̇́éÉ Ǆǅ12½ \n　<|>स़क़ﬁ", k=draw.randint(1, 14))) for _ in range(1500)])


def test_a_part_of_many_ids_and_what_is_remembered():
    words = WordTokenizer(BPE, known_words=2000)
    long = "7" * 300_000
    got, at = words.encode(pa.array([f"a {long} b", "c"]), 1)
    assert np.diff(at).tolist() == [300_003, 2]
    words.encode(pa.array(["d"]), 1)
    words.encode(pa.array(["e"]), 1)
    words.encode(pa.array(["f"]), 1)
    assert words.held < 10 and long not in words.new


def test_spellings_are_of_whole_words(spark):
    from tessera.llm import licenses

    rows = spark.createDataFrame([(1, "While still programmed by the programmer in centred organisms"), (2, "Licence licence\nLICENCE; whilst organisations, organised")], "k int, t string")
    got = [r[0] for r in rows.orderBy("k").select(licenses._one_line(licenses._folded(F.col("t")))).collect()]
    assert got == ["while still programmed by the programmer in centred organisms", "license license license while organizations organized"]


def test_whole_licences_among_many_texts(spark):
    import os

    from tessera.llm import licenses

    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    planted = [(want, open(f"{folder}/{f}", encoding="utf8").read()) for f, want in files.items() if os.path.exists(f"{folder}/{f}")] + [(k, "Copyright 2021 X\n\n" + t) for k, t in licenses.LICENSES]
    docs = spark.range(3000).select("id", F.concat(F.lit("some prose of row "), "id").alias("text")).union(spark.createDataFrame([(10_000 + k, t.replace(" ", "  ").replace("organization", "organisation")) for k, (_, t) in enumerate(planted)], "id long, text string"))
    got = {r.id: r.license_id for r in licenses.scan(docs, licenses.known(spark, licenses.LICENSES, licenses.DIGESTS), licenses.notices()).collect()}
    assert len(got) == 3000 + len(planted) and all(v is None for k, v in got.items() if k < 10_000)
    assert [got[10_000 + k] for k in range(len(planted))] == [want for want, _ in planted]


def test_stops_shorten_with_the_least_similarity():
    from tessera.llm import nearjoin

    sizes = range(1, 65)
    brute = [min(c / (n + m - c) for m in range(1, 90) for c in range(1, min(n, m) + 1) if c / (n + m - c) >= 0.8 - 1e-12) for n in sizes]
    assert [nearjoin.least_similarity(n, 0.8) for n in sizes] == pytest.approx(brute)
    at = nearjoin.stops(0.8, 0.999)
    assert at[1] == nearjoin.DEPTH and at[7] == 5 and at[6] == 4 and at[4] == at[-1] == 3


def test_pairs_meet_in_one_tree_and_often_enough():
    from tessera.llm import nearjoin

    draw = np.random.default_rng(5)
    width = nearjoin.TREES * nearjoin.DEPTH
    x = draw.integers(0, 2**32, (4000, width), dtype=np.uint32)
    y = np.where(draw.random((4000, width)) < 0.8, x, draw.integers(0, 2**32, (4000, width), dtype=np.uint32))
    need = np.full(4000, 3, np.uint8)
    times = sum(nearjoin._meet(x, y, need, np.full(4000, t), 0.0).astype(int) for t in range(nearjoin.TREES))
    assert times.max() == 1 and times.mean() > 0.999


def test_short_texts_and_copies_against_all_pairs(spark):
    from tessera.llm import nearjoin
    from test_results import check_join

    draw = np.random.default_rng(8)
    texts = [" ".join(draw.choice(list("abc"), draw.integers(0, 14))) for _ in range(700)]
    wrong, links = check_join(nearjoin.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_words > 0 or n_links >= 0").collect(), list(range(700)), texts)
    assert links > 300 and wrong == 0


def test_what_is_taken_is_what_shards_draw(spark, monkeypatch):
    from tessera.llm import mixing

    docs = mixing.sized(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).drop("text")
    kept = mixing.splitting_tree
    rows = mixing.mix(docs, shards=5, block_words=64).collect()
    assert all(r.taken == sum(x.words for x in r.draws) for r in rows) and {x["shard"] for r in rows for x in r.draws} == set(range(5))
    other = mixing.mix(docs, shards=5, block_words=64, seed=12).collect()
    assert {r.doc_id: r.taken for r in rows} != {r.doc_id: r.taken for r in other}
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, shards, seed, room=None: kept(q, shards, seed, room) * (room is None or np.arange(shards)[:, None] > 0))
    less = mixing.mix(docs, shards=5, block_words=64).collect()  # a tree that gives the first shard nothing
    assert sum(r.taken for r in less) < 0.9 * sum(r.taken for r in rows)


def test_many_sources_are_split_in_groups(spark, monkeypatch):
    from tessera.llm import mixing

    monkeypatch.setattr(mixing, "GROUPS", 3)
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.expr("CASE WHEN id < 3000 THEN 0 ELSE id % 2500 END")).alias("source"), F.expr("10 + id % 7").cast("long").alias("size"))
    rows = mixing.mix(docs, shards=6, block_words=20).toPandas()
    words = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (words.taken - words.target).abs().max() <= 0.5 + 1e-6 and (rows.taken <= 2 * rows["size"]).all()
    by_shard = rows.explode("draws").dropna(subset="draws").draws.map(lambda x: (x["shard"], x["words"]))
    totals = np.bincount([s for s, _ in by_shard], [w for _, w in by_shard])
    assert len(totals) == 6 and totals.min() > 0.8 * totals.max()


def test_groups_of_sources_are_drawn_as_if_at_once():
    from tessera.llm import mixing

    quotas, draws = np.array([6, 2, 4]), []
    for seed in range(1500):
        room = mixing.splitting_tree(np.array([8, 4]), 2, seed)
        within = mixing.splitting_tree(quotas[:2], 2, seed + 10**6, room[:, 0])
        assert within.sum(0).tolist() == [6, 2] and within.sum(1).tolist() == room[:, 0].tolist()
        draws.append(within[0])
    # hypergeometric: means of 6 * 6/12 and 2 * 6/12; variance of the first n K/N (N-K)/N (N-n)/(N-1)
    assert np.allclose(np.mean(draws, 0), [3, 1], atol=0.1) and abs(np.var([d[0] for d in draws]) - 6 * 0.25 * 6 / 11) < 0.1


def merkle_by_hand(text: str) -> tuple[str, list[str]]:
    """The root and the leaves' short digests, from the tree's definition: sentences, paragraphs, sections, root."""
    from hashlib import blake2b

    digest = lambda *parts: blake2b(b"".join(parts), digest_size=16).digest()
    paragraphs, leaves = [], []
    for line in text.split("\n"):
        sentences = [digest(x.encode()) for x in line.split(". ")]
        paragraphs.append(digest(*sentences))
        leaves += [x.hex()[:8] for x in sentences] if len(sentences) > 1 else [paragraphs[-1].hex()[:8]]
    sections, open_ = [], []
    for p in paragraphs:
        open_.append(p)
        if p[0] < 32:
            sections.append(digest(*open_))
            open_ = []
    sections += [digest(*open_)] if open_ else []
    return digest(*sections).hex(), leaves


def test_fingerprints_and_likeness_by_hand(spark):
    from collections import Counter

    import pandas as pd
    from tessera.llm import merkle, queries

    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").sort_values("doc_id").text.fillna("").tolist()
    for k, r in enumerate(queries.QUERIES["op6_merkle_fingerprint"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        trees = [merkle_by_hand(x) for x in (t, t[: len(t) - len(t) // 2] + following[: len(t) // 2], following)]
        assert r.fingerprint.startswith(trees[0][0]) and r.edited_fingerprint.startswith(trees[1][0])
        for near, (root, leaves) in ((r.near_edited, trees[1]), (r.near_next, trees[2])):
            a, b = Counter(trees[0][1]), Counter(leaves)
            assert near == pytest.approx(1.0 if root == trees[0][0] else (a & b).total() / (a | b).total())


def test_successors_of_null_and_equal_ids(spark):
    from tessera.llm import merkle

    rows = [(None, f"text {k % 50}") for k in range(400)] + [(k // 3, f"row {k}") for k in range(300)] + [(None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    ordered = sorted(((d is not None, d or 0, tie[t or ""], t or "") for d, t in rows))
    want = [(x[1] if x[0] else None, merkle.fingerprint(x[3]), merkle.likeness(merkle.fingerprint(x[3]), merkle.fingerprint(ordered[(k + 1) % len(ordered)][3]))) for k, x in enumerate(ordered)]
    got = [(r.doc_id, r.fingerprint, r.near_next) for r in merkle.compare(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def naive_counts(text, dims, orders, letters_only):
    data = (text or "").lower().encode()
    data = bytes(c if c > 127 or chr(c).isalpha() or not letters_only else 32 for c in data)
    out = np.zeros(dims * len(orders))
    for j, order in enumerate(orders):
        for at in range(len(data) - order + 1):
            key = 0
            for c in data[at : at + order]:
                key = (key * 257 + c) % 2**32
            out[j * dims + ((key * 2654435761 % 2**32) >> 8) % dims] += 1
    return out


def test_languages_by_naive_decoding(spark):
    from tessera.llm import langid

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    languages, code, w, b, bit = model = langid.learn(docs)
    for r in langid.identify(docs.where("length(text) < 3000"), model).collect():
        counts = naive_counts(r.text, langid.DIMS, langid.ORDERS, True)
        margin = np.sqrt(counts / max(counts[: langid.DIMS].sum(), 1)) @ w + b
        loss = [sum(bit[k] * np.log1p(np.exp(-margin[k] * row[k])) for k in range(len(row))) for row in code]
        if any(c.isalpha() for c in r.text):
            assert loss[languages.index(r.lang_pred)] == pytest.approx(min(loss), abs=1e-5)
            assert r.score == pytest.approx(1 / sum(np.exp((min(loss) - x) * code.shape[1]) for x in loss), abs=1e-4)
        else:
            assert (r.lang_pred, r.score) == ("und", 0)


def test_quality_by_naive_features_and_risk(spark):
    import zlib

    from tessera.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    w, b, prior = model = quality.learn(docs, labels)
    scored = {r.doc_id: r for r in quality.score(docs, model).collect()}
    grams = quality.DIMS * len(quality.ORDERS)
    x, rows = [], docs.orderBy("doc_id").collect()
    for r in rows:
        counts, t = naive_counts(r.text, quality.DIMS, quality.ORDERS, False), (r.text or "")
        data, words = t.encode(), re.findall(r"[^\t-\r ]+", t.lower())
        n, m = max(len(data), 1), max(len(words), 1)
        letter, digit = sum(chr(c).isalpha() or c > 127 for c in data), sum(48 <= c <= 57 for c in data)
        white = sum(c in (10, 32) for c in data)
        shape = [letter / n, digit / n, (len(data) - letter - digit - white) / n, 10 * data.count(10) / n, white / n, sum(p == q for p, q in zip(words, words[1:])) / m, len(set(words)) / m, n / m / 10, np.log1p(n) / 10, sum(65 <= c <= 90 for c in data) / n, sum(c in (44, 46) for c in data) / n, min(len(words), 50) / 50]
        x.append(np.concatenate([np.sqrt(counts / max(counts[: quality.DIMS].sum(), 1)), shape]))
        assert scored[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-(x[-1] @ w + b))), abs=2e-3) and len(x[-1]) == grams + quality.SHAPES
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    x, keep = np.array(x), np.array([zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in rows])
    positive = x[keep & np.array([r.doc_id in good for r in rows])]

    def risk(w, b):
        p, u = positive @ w + b, x[keep] @ w + b
        return prior * np.logaddexp(0, -p).mean() + max(0.0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    assert risk(w, b) < 0.6 * risk(0 * w, 0.0)
