"""TF-IDF of character n-grams in Arrow batches: texts are code points in NumPy, never a row for each n-gram.

The commonest n-grams come from sorted integer keys of the longest ones, whose prefixes are the shorter; then a trie
of those that are kept is followed from every place of a text at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes (a longer text makes its own slice).
SLICE_BYTES = 1 << 17
#: So many keys wait to be sorted, and so many different ones are held in a task, before they go on.
WAITING, HELD = 1 << 22, 1 << 22
#: A slice's counts are an array of rows x tokens, and a trie's steps one of states x letters, up to so many entries.
DENSE = 1 << 23


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batch, their texts' code points (column t, in lower case, spaces made single) in a row, and how many
    each text has."""
    size = pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size, dtype=np.int64) - size) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            texts = [t or "" for t in batch.column("t").slice(a, b - a).to_pylist()]
            yield batch.slice(a, b - a), *single_spaced(texts)


@cache
def lower() -> np.ndarray:
    r"""The lower case of each code point, one code point as in SQL; a space for all of \s."""
    table = np.array([ord(chr(i).lower()[0]) for i in range(0x110000)])
    table[[9, 10, 12, 13]] = 32
    return table


def single_spaced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = lower().take(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
    sizes = np.array([len(t) for t in texts])
    space = points == 32
    again = np.append(False, space[1:] & space[:-1])[: len(points)]
    starts = np.cumsum(sizes) - sizes
    again[starts[sizes > 0]] = False
    if not again.any():
        return points, sizes
    gone = np.bincount(np.repeat(np.arange(len(texts)), sizes)[again], minlength=len(texts))
    return points[~again], sizes - gone


def spread(codes: np.ndarray, sizes: np.ndarray, gap: int) -> np.ndarray:
    """codes with `gap` zeros after each text."""
    at = np.arange(len(codes)) + gap * np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(codes) + gap * len(sizes), codes.dtype)
    out[at] = codes
    return out


def total_counts(least: int, most: int) -> Callable:
    """A function for mapInArrow: (t) to (token, total), each token once or a few times a task."""
    bits = 63 // most
    mask = (1 << bits) - 1

    def written(tokens: list[str], totals) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(tokens), 1 << 16):
            yield pa.record_batch([pa.array(tokens[a : a + (1 << 16)], pa.string()), pa.array(totals[a : a + (1 << 16)], pa.int64())], ["token", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, letters = np.zeros(0x110000, np.int64), [0]  # codes are given as letters come, from 1
        waiting, keys, totals = [], np.empty(0, np.int64), np.empty(0, np.int64)

        def merge() -> None:
            nonlocal keys, totals
            new, counts = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            both, counts = np.concatenate([keys, new]), np.concatenate([totals, counts])
            order = np.argsort(both, kind="stable")
            both = both[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            keys, totals = both[first], np.add.reduceat(counts[order], first)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, totals
            if waiting:
                merge()
            points = np.array(letters, np.uint32)
            for n in range(least, most + 1):
                own = keys >> (bits * (most - n))
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
                sums = np.add.reduceat(totals, first) if len(first) else totals
                own = own[first]
                full = (own & mask) > 0  # else a text ended before its n-th letter
                own, sums = own[full], sums[full]
                for a in range(0, len(own), 1 << 18):
                    part = own[a : a + (1 << 18)]
                    text = points[(part[:, None] >> (bits * np.arange(n - 1, -1, -1))) & mask].tobytes().decode("utf-32-le")
                    yield from written([text[i : i + n] for i in range(0, len(text), n)], sums[a : a + (1 << 18)])
            keys, totals = keys[:0], totals[:0]
            code[letters] = 0
            del letters[1:]

        def took(points: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
            codes = code.take(points)
            new = np.unique(points[codes == 0])
            if len(letters) + len(new) > mask + 1:
                yield from flush()
                new = np.unique(points)
            if len(new) > mask:
                if len(sizes) == 1:  # more letters than a key can tell apart
                    text = points.astype(np.uint32).tobytes().decode("utf-32-le")
                    found = Counter(text[i : i + n] for n in range(least, most + 1) for i in range(len(text) - n + 1))
                    yield from written(list(found), list(found.values()))
                    return
                half, cut = len(sizes) // 2, int(sizes[: len(sizes) // 2].sum())
                yield from took(points[:cut], sizes[:half])
                yield from took(points[cut:], sizes[half:])
                return
            if len(new):
                code[new] = np.arange(len(letters), len(letters) + len(new))
                letters.extend(new.tolist())
                codes = code.take(points)
            codes = spread(codes, sizes, most)
            places = len(codes) - most
            key = codes[:places].copy()
            for j in range(1, most):
                key <<= bits
                key |= codes[j : places + j]
            key = key[codes[:places] > 0]
            waiting.append(key)
            if sum(map(len, waiting)) > WAITING:
                merge()
                if len(keys) > HELD:
                    yield from flush()

        for batch in batches:
            for _, points, sizes in slices(batch):
                yield from took(points, sizes)
        yield from flush()

    return run


def finder(tokens: list[str], least: int, most: int) -> Callable:
    """A function from code points and sizes of texts to (row, token, count) of all tokens in each text, in order of
    row and token."""
    letters = sorted({ord(c) for t in tokens for c in t})
    wide = len(letters) + 1
    code = np.zeros(0x110000, np.int64)
    code[letters] = np.arange(1, wide)
    states: dict[str, int] = {}
    for t in tokens:
        for n in range(1, len(t) + 1):
            states.setdefault(t[:n], len(states) + 1)
    first, token = np.zeros(wide, np.int64), np.full(len(states) + 1, len(tokens))  # state 0: no token begins so
    token[[states[t] for t in tokens]] = np.arange(len(tokens))  # where no token ends: len(tokens)
    steps = {}
    for p, to in states.items():
        if len(p) == 1:
            first[code[ord(p)]] = to
        else:
            steps[states[p[:-1]] * wide + int(code[ord(p[-1])])] = to
    dense = (len(states) + 1) * wide <= DENSE
    if dense:
        table = np.zeros((len(states) + 1) * wide, np.int64)
        table[list(steps)] = list(steps.values())
    else:
        froms = np.array(sorted(steps))
        tos = np.array([steps[x] for x in froms.tolist()])

    def step(x: np.ndarray) -> np.ndarray:
        if dense:
            return table.take(x)
        i = np.minimum(np.searchsorted(froms, x), len(froms) - 1)
        return np.where(froms[i] == x, tos[i], 0)

    def found(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, columns = spread(code.take(points), sizes, most), len(tokens) + 1
        places = max(0, len(codes) - most)
        row = np.repeat(np.arange(len(sizes)) * columns, sizes + most)[:places]
        state, hits = None, []
        for j in range(most):
            state = step(state * wide + codes[j : places + j]) if j else first.take(codes[:places])
            if j + 1 >= least:
                hits.append(row + token.take(state))
        hits = np.concatenate(hits)
        if len(sizes) * columns <= DENSE:
            counts = np.bincount(hits, minlength=len(sizes) * columns)
            counts[len(tokens) :: columns] = 0
            pairs = np.flatnonzero(counts > 0)
            counts = counts[pairs]
        else:
            pairs, counts = np.unique(hits[hits % columns < len(tokens)], return_counts=True)
        return pairs // columns, pairs % columns, counts

    return found


def tfidf_chars(df: DataFrame, key: str, text: str, least: int = 3, most: int = 5, max_features: int = 5000, digits: int | None = None) -> DataFrame:
    """tfidf.tfidf of the runs of least to most characters of texts in lower case, spaces made single; w is rounded
    to `digits` places, if given.

    Three passes over the texts: totals of all runs (a task shuffles its different runs), how many keys have each of
    those that are kept (max_features rows to the driver), and the weights, a text at a time. Only rows of keys that
    several rows share are summed by a shuffle.
    """
    n = df.count()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    totals = rows.select("t").mapInArrow(total_counts(least, most), "token string, total long").groupBy("token").agg(F.sum("total").alias("total"))
    tokens = [r.token for r in totals.orderBy(F.desc("total"), "token").limit(max_features).collect()]
    counts = rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select(F.col("k").alias("__k"))
    several = bool(counts.limit(1).count())
    same = F.col("k").eqNullSafe(F.col("__k"))
    single = rows.join(counts, same, "left_anti") if several else rows

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums = finder(tokens, least, most), np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, points, sizes in slices(batch):
                sums += np.bincount(found(points, sizes)[1], minlength=len(tokens))
        yield pa.record_batch([pa.array(np.arange(len(tokens)), pa.int32()), pa.array(sums, pa.int64())], ["i", "df"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = finder(tokens, least, most)
        for batch in batches:
            for part, points, sizes in slices(batch):
                row, i, c = found(points, sizes)
                yield pa.record_batch([part.column("k").take(pa.array(row)), pa.array(i, pa.int32()), pa.array(c, pa.int64())], ["k", "i", "tf"])

    each = single.select("t").mapInArrow(having, "i int, df long")
    if several:
        tf = rows.join(counts, same, "left_semi").mapInArrow(counted, f"k {kind}, i int, tf long").groupBy("k", "i").agg(F.sum("tf").cast("double").alias("tf"))
        each = each.union(tf.groupBy("i").agg(F.count("*").alias("df")))
    having_it = np.zeros(len(tokens))
    for r in each.groupBy("i").agg(F.sum("df").alias("df")).collect():
        having_it[r.i] = r.df
    idf = np.log((1 + n) / (1 + having_it)) + 1

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names = finder(tokens, least, most), pa.array(tokens, pa.string())
        for batch in batches:
            for part, points, sizes in slices(batch):
                row, i, c = found(points, sizes)
                w = c * idf[i]
                w /= np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
                if digits is not None:
                    w = np.floor(w * 10.0**digits + 0.5) / 10.0**digits
                yield pa.record_batch([part.column("k").take(pa.array(row)), names.take(pa.array(i)), pa.array(w)], ["k", "token", "w"])

    out = single.mapInArrow(weighed, f"k {kind}, token string, w double")
    if several:
        known = df.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(len(tokens), dtype=np.int32), "token": tokens, "idf": idf}), "i int, token string, idf double")
        w = tf.join(F.broadcast(known), "i").withColumn("w", F.col("tf") * F.col("idf"))
        w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy("k"))))
        out = out.union(w.select("k", "token", F.round("w", digits).alias("w") if digits is not None else "w"))
    return out.withColumnRenamed("k", key)
