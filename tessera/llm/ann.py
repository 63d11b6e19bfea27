"""Nearest neighbours by low-dimensional stable projections in a kd-tree, with a chi-square stopping test.

Largest inner products are least distances once each vector has one more coordinate that makes all vectors
equally long (0 for queries). Vectors are projected to a few dimensions by Gaussian rows, which are 2-stable:
projected distance squared / distance squared is chi-square with that many degrees. A kd-tree over
projections, fitted on a bounded sample, gives cells, and its upper levels branches of cells. A query first searches
its own branch; that bounds the distance r of its k-th neighbour. It then visits the cells of other branches whose box
isn't further, in projection, than r * sqrt(c), where a chi-square variable is below c with the wanted confidence.
In a branch, candidates of the visited cells come by rising projected distance and are verified on whole vectors until
the same test holds for the next; a branch answers with its k best.

Equal vectors are searched once: their k + 1 least ids stand for them, which is all that a result can hold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_bound, keep, table

DIMS, CELL_ROWS, SAMPLE, CONFIDENCE = 24, 1024, 16_384, 0.93
#: A task compares a branch of about so many vectors with so many queries.
PART_ROWS, QUERY_ROWS = 16_384, 8_192


def chi_square_quantile(p: float, degrees: int) -> float:
    """For even degrees: 1 - exp(-x/2) * sum((x/2)^j / j!, j < degrees/2) = p, solved by halving."""
    low, high = 0.0, 40.0 * degrees
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(degrees // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return low


class Tree:
    """Projection and kd-tree; node i has children 2i+1 and 2i+2, cells are the leaves from left to right."""

    def __init__(self, sample: np.ndarray, square: float, depth: int, seed: int):
        self.square, self.depth = square, depth
        self.gauss = np.random.default_rng(seed).standard_normal((sample.shape[1] + 1, DIMS))
        self.axis, self.cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        rows = {0: self.project(sample)}
        for i in range(2**depth - 1):
            y = rows.pop(i)
            self.axis[i] = a = int(np.argmax(y.var(0))) if len(y) else 0
            self.cut[i] = np.median(y[:, a]) if len(y) else 0
            left = y[:, a] < self.cut[i]
            rows[2 * i + 1], rows[2 * i + 2] = y[left], y[~left]

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))
        return x @ self.gauss[:-1] + last[:, None] * self.gauss[-1]

    def cell(self, y: np.ndarray) -> np.ndarray:
        at = np.zeros(len(y), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (y[np.arange(len(y)), self.axis[at]] >= self.cut[at])
        return at - (2**self.depth - 1)


def _found(x: np.ndarray, ids: list, y: np.ndarray, box: np.ndarray, open_: np.ndarray, q: np.ndarray, z: np.ndarray, radius: float, tree: Tree, wide: float, k: int):
    """The k best (score, id) among candidates x whose box is open, verified by rising projected distance till the test
    holds; the distance squared that bounds others; how many boxes were visited, and candidates verified."""
    some = np.flatnonzero(open_[box])
    projected = ((y[some] - z) ** 2).sum(1)
    fits = projected <= radius * wide * (1 + 1e-9) + 1e-12
    some, projected = some[fits], projected[fits]
    order = np.argsort(projected, kind="stable")
    limit, base = radius, tree.square + float(q @ q)
    score, done, step = np.zeros(len(projected)), 0, 4 * k
    while done < len(order) and projected[order[done]] <= limit * wide * (1 + 1e-9) + 1e-12:
        next_ = order[done : done + step]
        score[next_] = x[some[next_]] @ q
        done += len(next_)
        if done >= k:
            best = np.partition(score[order[:done]], done - k)[done - k]
            limit = min(limit, max(base - 2 * best, 0.0))
        step *= 2
    seen = order[:done]
    if len(seen) > k:
        least = np.partition(score[seen], len(seen) - k)[len(seen) - k]
        seen = seen[score[seen] >= least]
    rows = sorted((-score[i], j) for i in seen for j in ids[some[i]])[:k]
    return [(-s, j) for s, j in rows], limit, int(open_[np.unique(box)].sum()), done


def search(vectors: DataFrame, queries: F.Column, k: int = 20, confidence: float = CONFIDENCE, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of vectors for which `queries` holds; and what
    the query cost: cells it visited and vectors that were verified.

    vectors: vec_id, embedding. Rows with a null id, or a vector that is null, zero, holds null or non-finite
    components, or has another length than most have, take no part. Ties go to smaller ids; a row isn't its own
    neighbour; rows that repeat an id count as one query. Fewer than k others: all of them are returned. An
    empty table gives no rows. Other columns are left out.

    The tree is fitted on at most SAMPLE vectors, so it has at most SAMPLE / 16 cells, whose boxes alone reach the
    driver; every vector is indexed and can be found. Branches of many vectors, and visits of many queries to one,
    are searched in parts, so none has to fit one task.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, cells long, verified long")
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return empty
    rows = rows.where(F.size(v) == length.d).withColumn("embedding", v.cast("array<double>"))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(seed), "embedding"))
    key = ["h1", "h2"]
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = keep(least.groupBy(*key).agg(F.min_by("embedding", "vec_id").alias("x"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), *key).distinct()
    about = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b)).alias("square")).first()
    sample_rows = max(256, min(SAMPLE, 8_000_000 // length.d))
    drawn = classes.where(F.col("h1") <= hash_bound(1.1 * sample_rows / about.n)).select("h1", "x").limit(2 * sample_rows).collect()
    if not drawn:
        raise RuntimeError(f"no vector drawn from {about.n}")
    sample = np.array([r.x for r in sorted(drawn, key=lambda r: r.h1)[:sample_rows]]).reshape(-1, length.d)
    depth = max(0, min(math.ceil(math.log2(max(1, about.n / CELL_ROWS))), int(math.log2(max(1, len(sample) / 16)))))
    tree, wide, top = Tree(sample, about.square * (1 + 1e-12), depth, seed), chi_square_quantile(confidence, DIMS), k + 1

    def placed(batches):
        for b in batches:
            b["cell"] = tree.cell(tree.project(np.stack(b.x))).astype(np.int32) if len(b) else np.zeros(0, np.int32)
            yield b

    index = keep(classes.mapInPandas(placed, "h1 long, h2 long, x array<double>, ids array<long>, cell int"))

    def boxes(batches):
        held: dict = {}
        for b in batches:
            if len(b):
                y, cells = tree.project(np.stack(b.x)), b.cell.to_numpy()
                for c in np.unique(cells):
                    own = y[cells == c]
                    low, high, n = held.get(c, (np.inf, -np.inf, 0))
                    held[c] = np.minimum(low, own.min(0)), np.maximum(high, own.max(0)), n + len(own)
        yield pd.DataFrame([(c, *x) for c, x in held.items()], columns=["cell", "low", "high", "n"])

    def united(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [b.cell.iloc[0]], "low": [np.stack(b.low).min(0)], "high": [np.stack(b.high).max(0)], "n": [b.n.sum()]})

    box = "cell int, low array<double>, high array<double>, n long"
    box = index.select("cell", "x").mapInPandas(boxes, box).groupBy("cell").applyInPandas(united, box).toPandas().sort_values("cell")
    low, high, cells = np.stack(box.low), np.stack(box.high), box.cell.to_numpy()
    below = depth - max(0, min(depth, math.ceil(math.log2(max(1, about.n / PART_ROWS)))))
    branches = cells >> below
    sizes = {int(c): -(-int(box.n[branches == c].sum()) // (2 * PART_ROWS)) for c in np.unique(branches)}
    many = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("branch")).cast("int")
    index = index.withColumn("branch", F.shiftright("cell", below)).withColumn("part", F.pmod("h2", many).cast("int"))
    answer = "q1 long, q2 long, limit double, scores array<double>, ids array<long>, cells long, verified long"

    def apart(z: np.ndarray) -> np.ndarray:
        return (np.maximum(np.maximum(low - z, z - high), 0) ** 2).sum(1)

    def near_boxes(z: np.ndarray, radius: float) -> np.ndarray:
        return apart(z) <= radius * wide * (1 + 1e-9) + 1e-12

    def in_branch(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(q):
            return pd.DataFrame([], columns=["q1", "q2", "limit", "scores", "ids", "cells", "verified"], dtype=object)
        x, ids, own = np.stack(b.x), b.ids.tolist(), np.searchsorted(cells, b.cell)
        y, qx = tree.project(x), np.stack(q.x)
        z = tree.project(qx, query=True)
        here, out = np.unique(own), []
        for i, r in enumerate(q["limit"]):
            if np.isinf(r):  # the nearest cell bounds the others
                nearest = np.zeros(len(cells), bool)
                nearest[here[np.argmin(apart(z[i])[here])]] = True
                found, bound, *_ = _found(x, ids, y, own, nearest, qx[i], z[i], r, tree, wide, top)
                r = bound if len(found) == top else r
            out.append(_found(x, ids, y, own, near_boxes(z[i], r), qx[i], z[i], r, tree, wide, top))
        lists = {"scores": [[s for s, _ in f[0]] for f in out], "ids": [[j for _, j in f[0]] for f in out]}
        return pd.DataFrame({"q1": q.h1, "q2": q.h2, "limit": [f[1] for f in out]} | lists | {"cells": [f[2] for f in out], "verified": [f[3] for f in out]})

    def home(batches):
        for b in batches:
            own = tree.cell(tree.project(np.stack(b.x), query=True)) >> below if len(b) else np.zeros(0, np.int64)
            b["branch"] = np.where(np.isin(own, branches), own, branches[0]).astype(np.int32)
            b["limit"] = np.full(len(b), np.inf)
            yield b

    def others(batches):
        for b in batches:
            got = []
            for h1, h2, x, c, r, f in zip(b.h1, b.h2, b.x, b.home, b["limit"], b.n):
                r = r if f >= top else np.inf
                z = tree.project(x[None, :], query=True)[0]
                got += [(h1, h2, x, c, i, r) for i in np.unique(branches[near_boxes(z, r)])]
            yield pd.DataFrame(got, columns=["h1", "h2", "x", "home", "branch", "limit"])

    who = keep(classes.join(asked.select(*key).distinct(), key, "left_semi").select("h1", "h2", "x").mapInPandas(home, "h1 long, h2 long, x array<double>, branch int, limit double"))
    asking = max(1, -(-who.count() // QUERY_ROWS))

    def near(q: DataFrame) -> DataFrame:
        base = index.withColumn("some", F.explode(F.sequence(F.lit(0), F.lit(asking - 1))))
        q = q.withColumn("some", F.pmod("h1", F.lit(asking)).cast("int"))
        return base.groupBy("branch", "part", "some").cogroup(q.groupBy("branch", "part", "some")).applyInPandas(in_branch, answer)

    first = keep(near(who.withColumn("part", F.lit(0))))
    bound = first.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), F.col("limit").alias("r"), F.size("ids").alias("n"))
    rest = who.drop("limit").withColumnRenamed("branch", "home").join(bound, key, "left")
    rest = rest.withColumn("limit", F.coalesce("r", F.lit(float("inf")))).withColumn("n", F.coalesce("n", F.lit(0))).drop("r")
    rest = rest.mapInPandas(others, "h1 long, h2 long, x array<double>, home int, branch int, limit double")
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).where("not (branch = home and part = 0)")
    answers = keep(first.unionByName(near(rest)))
    cost = answers.groupBy("q1", "q2").agg(F.sum("cells").alias("cells"), F.sum("verified").alias("verified"))
    every = answers.select("q1", "q2", F.explode(F.arrays_zip("scores", "ids")).alias("f"))
    every = every.select("q1", "q2", F.col("f.scores").alias("score"), F.col("f.ids").alias("vec_id"))
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    best = every.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).drop("n").join(cost, ["q1", "q2"])
    out = asked.join(best, (asked.h1 == best.q1) & (asked.h2 == best.q2)).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "cells", "verified")


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
