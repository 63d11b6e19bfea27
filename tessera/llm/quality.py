"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text are drawn in bounded samples; the share of good text (the class
prior) is estimated from scores of both; then a logistic model of hashed n-grams and shape statistics of
whole texts minimises  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bound, held_out, slices, strings, table, trimmed, utf8
from .words import ngram_counts, word_hashes

DIMS, ORDERS, SHAPES = 512, (1, 2), 12


def features(column: pa.Array) -> np.ndarray:
    """Square roots of n-gram shares, and shape statistics, of each whole text. [texts, features]"""
    column = strings(column)
    counts = ngram_counts(column, DIMS, ORDERS, letters_only=False)
    total = np.maximum(counts[:, :DIMS].sum(1, keepdims=True), 1)
    data, offsets = utf8(column)
    n, size = len(column), np.maximum(np.diff(offsets), 1)
    doc = np.repeat(np.arange(n), np.diff(offsets))

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n) / size

    words, at = word_hashes(column)
    n_words = np.diff(at)
    word_doc = np.repeat(np.arange(n), n_words)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (word_doc[1:] == word_doc[:-1])
    order = np.lexsort((words, word_doc)) if len(words) else np.empty(0, np.int64)
    first = np.ones(len(words), bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
    distinct = np.bincount(word_doc[order][first], minlength=n)
    some = np.maximum(n_words, 1)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    digit, white = (data >= 48) & (data <= 57), (data == 32) | (data == 10)
    shape = np.stack([
        share(letter), share(digit), share(~(letter | digit | white)), share(data == 10) * 10, share(white),
        np.bincount(word_doc[again], minlength=n) / some, distinct / some, size / some / 10, np.log1p(size) / 10,
        share((data >= 65) & (data <= 90)), share((data == 46) | (data == 44)), np.minimum(n_words, 50) / 50,
    ], 1)
    return np.concatenate([np.sqrt(counts / total), shape], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled, from scores of rows a model wasn't fitted on.

    Best bin estimation: the top bin for which the upper bound of (share of unlabelled in it / share of
    positives in it) is least; that ratio is the estimate.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(positive)) + np.sqrt(np.log(4 / delta) / 2 / len(unlabelled))
    fine = p > 0
    best = np.argmin((u[fine] + (1 + gamma) * slack) / p[fine])
    return float(np.clip(u[fine][best] / p[fine][best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4):
    """Weights and bias that minimise the non-negative risk with the logistic loss (Adam, all rows a step)."""
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n
    square = (np.einsum("ij,ij->j", positive, positive, dtype=np.float64) + np.einsum("ij,ij->j", unlabelled, unlabelled, dtype=np.float64)) / n
    scale = np.sqrt(np.maximum(square - mean**2, 0)) + 0.01
    xp, xu = ((x - mean.astype(np.float32)) / scale.astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(len(mean), np.float32), 0.0
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
        minus = np.logaddexp(0, xu @ w + b).mean() - prior * np.logaddexp(0, xp @ w + b).mean()
        gu, gp = su / len(su), prior * sp / len(sp)  # of the risk of being negative
        up = -prior * (1 - sp) / len(sp)  # of the risk of being positive
        if minus >= 0:
            at_p, at_u = up - gp, gu
        else:  # the negative part's estimate fell below what a risk can be: undo it
            at_p, at_u = gp, -gu
        g = np.concatenate([at_p @ xp + at_u @ xu + ridge * w, [at_p.sum() + at_u.sum()]]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w / scale, b - float((mean / scale) @ w)


def _sample(docs: DataFrame, rows: int, seed: int) -> np.ndarray:
    """Features of about `rows` rows, never more, drawn by a hash of the id and text; a table with rows gives some."""
    total = docs.count()
    if not total:
        return np.zeros((0, DIMS * len(ORDERS) + SHAPES), np.float32)
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    some = docs.where(draw <= hash_bound(1.1 * rows / total)).select("text", draw.alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"))
                yield pa.record_batch({"draw": part.column("draw"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = sorted((r.draw, bytes(r.x)) for r in some.mapInArrow(trimmed(run), "draw long, x binary").limit(2 * rows).collect())[:rows]
    if not got:
        raise RuntimeError(f"no row drawn from {total}")
    return np.stack([np.frombuffer(x, np.float32) for _, x in got])


def learn(docs: DataFrame, labels: DataFrame, rows: int = 3000, prior: float | None = None, seed: int = 7):
    """(weights, bias, prior) from rows that aren't held out.

    docs: doc_id, text. labels: doc_id, quality (1: good). At most `rows` positives and `rows` unlabelled
    texts are used, which bounds what reaches the driver. Returns None if there are no positives.
    """
    docs = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    good = labels.where("quality = 1").select("doc_id").distinct()
    xp, xu = _sample(docs.join(good, "doc_id", "left_semi"), rows, seed), _sample(docs, rows, seed + 1)
    if not len(xp) or not len(xu):
        return None
    if prior is None:
        half_p, half_u = len(xp) // 2, len(xu) // 2
        if min(half_p, half_u) < 20:
            prior = 0.5
        else:
            w, b = fit(xp[:half_p], xu[:half_u], 0.5, steps=200)
            prior = estimate_prior(xp[half_p:] @ w + b, xu[half_u:] @ w + b)
    w, b = fit(xp, xu, prior)
    return w, b, prior


def score(docs: DataFrame, model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: good likelier) and predicted (1 if score >= threshold).

    Null texts count as empty, and empty texts have a score too; without a model every score is 0.5.
    Each row is scored for itself, so repeated rows repeat. Columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    w, b = (np.zeros(DIMS * len(ORDERS) + SHAPES), 0.0) if model is None else model[:2]
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                y = _sigmoid(features(part.column(text)) @ w + b)
                columns = {c: part.column(c) for c in names}
                yield pa.record_batch(columns | {"score": pa.array(y, pa.float64()), "predicted": pa.array((y >= threshold).astype(np.int32))})

    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(trimmed(run), schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.lit(None if model is None else float(model[2])).cast("double").alias("prior"))
