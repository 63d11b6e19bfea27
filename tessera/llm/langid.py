"""Language identification by error-correcting output codes over hashed letter n-grams.

Each language has a codeword of bits; for each bit a logistic classifier of n-gram shares tells the languages
whose bit is 1 from the others. A text's language is the one whose codeword has the least loss, bits weighted
by how well their classifiers do; a text is ambiguous if the runner-up's loss is close to the least.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bound, held_out, slices, table, trimmed, tuned
from .words import ngram_counts

DIMS, ORDERS = 512, (1, 2, 3)
_LETTER = re.compile(r"[^\W\d_]")


def features(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed letter n-grams in each whole text. [texts, features]"""
    counts = ngram_counts(column, DIMS, ORDERS, letters_only=True)
    return np.sqrt(counts / np.maximum(counts[:, :DIMS].sum(1, keepdims=True), 1))


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """One row of -1 and 1 for each of k languages.

    Up to 5: all distinct ways to part them (2^(k-1) - 1 bits). More: of 200 random codes of 10 log2(k) bits,
    the one whose closest rows are furthest apart.
    """
    if k <= 5:
        rows = [[1 if (bit >> j) & 1 else -1 for bit in range(1, 2 ** max(k - 1, 0))] for j in range(k)]
        return np.array(rows, float).reshape(k, -1) if k > 1 else np.ones((k, 1))
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, max(15, math.ceil(10 * math.log2(k)))))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = (code.shape[1] - code @ code.T) / 2 + 1e9 * np.eye(k)
        best = max(best, (apart.min(), code.tolist()), key=lambda x: x[0])
    return np.array(best[1])


def fit_bits(x: np.ndarray, bits: np.ndarray, steps: int = 250, rate: float = 0.3, ridge: float = 1e-5):
    """Weights, biases and accuracies of one logistic classifier for each column of bits (Adam, together)."""
    w = np.zeros((x.shape[1] + 1, bits.shape[1]), np.float32)
    bits = bits.astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        pull = -bits / (1 + np.exp(np.clip(bits * (x @ w[:-1] + w[-1]), -30, 30))) / len(x)
        g = np.concatenate([x.T @ pull, pull.sum(0, keepdims=True)]) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    right = (np.sign(x @ w[:-1] + w[-1]) == bits).mean(0)
    return w[:-1].astype(np.float64), w[-1].astype(np.float64), right


def learn(docs: DataFrame, rows: int = 4000, seed: int = 17):
    """(languages, codewords, weights, biases, bit weights) from text and lang of rows that aren't held out.

    At most `rows` rows are used, as many of each language as there are, up to an even share, drawn by a hash;
    that bounds what reaches the driver. Rows without lang, or whose text has no letter, teach nothing; without
    any row there is no model (None).
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return None
    each = max(1, rows // len(counts))
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, hash_bound(1.2 * each / n))])
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    some = known.where(draw <= F.element_at(chance, F.col("lang"))).select("lang", "text", draw.alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"))
                yield pa.record_batch({"lang": part.column("lang"), "draw": part.column("draw"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    drawn = sorted((r.lang, r.draw, bytes(r.x)) for r in some.mapInArrow(trimmed(run), "lang string, draw long, x binary").limit(2 * rows).collect())
    if not drawn:
        raise RuntimeError(f"no row drawn from {sum(counts.values())}")
    got, taken = [], dict.fromkeys(counts, 0)
    for lang, draw_, x in drawn:
        x = np.frombuffer(x, np.float32)
        if taken[lang] < each and x.any():
            taken[lang] += 1
            got.append((lang, x))
    languages = sorted({lang for lang, _ in got})
    if not languages:
        return None
    code = codewords(len(languages))
    y = code[np.searchsorted(languages, [lang for lang, _ in got])]
    w, b, right = fit_bits(np.stack([x for _, x in got]), y)
    return languages, code, w, b, np.maximum(right - 0.5, 1e-3) / np.maximum(right - 0.5, 1e-3).sum()


def identify(docs: DataFrame, model, tie: float = 0.02, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous.

    lang_pred: the language of least loss (ties: the first by name); `und`, with score 0, if the text is null,
    empty or has no letter, or if there is no model. score: share of that language in exp(-losses), 0 to 1.
    ambiguous: the runner-up's loss is within `tie` of the least. All of a text is read; each row for itself,
    so repeated rows repeat. Columns of docs with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                n = part.num_rows
                told = np.array([bool(t and _LETTER.search(t)) for t in part.column(text).to_pylist()], bool)
                pred, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
                if model is not None:
                    languages, code, w, b, bit = model
                    margin = features(part.column(text)) @ w + b
                    loss = np.stack([np.logaddexp(0, -margin * row) @ bit for row in code], 1)
                    best = loss.argmin(1)
                    # losses are means over bits; as sums they are log-likelihoods
                    share = np.exp(-(loss - loss.min(1, keepdims=True)) * code.shape[1])
                    pred = np.where(told, np.array(languages, object)[best], "und")
                    score = np.where(told, share.max(1) / share.sum(1), 0)
                    ranked = np.sort(loss, 1)
                    unsure = told & (ranked[:, 1] - ranked[:, 0] < tie) if len(languages) > 1 else unsure
                columns = {c: part.column(c) for c in names}
                yield pa.record_batch(columns | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(unsure)})

    return docs.mapInArrow(trimmed(run), docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; `und` (null, empty, no letter) go. A null lang gets the predicted one."""
    tuned(spark)
    out = identify(docs, learn(docs)).where("lang_pred <> 'und'")
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)
