"""Exact nearest neighbours by cosine or inner product, and what is read off the neighbour graph.

The graph is a table (id, rank, nbr, sim). It is made in blocks: rows of the base and of the queries are cut by
hashes into blocks of bounded size, each pair of blocks is one matrix product that keeps its k best a query,
and these are merged. Nothing of the size of all pairs is written.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import snap, unit
from .pooling import pool

BASE_ROWS, QUERY_ROWS = 16_384, 2_048


def neighbours(base: DataFrame, key: str, vec: str, k: int, queries: DataFrame | None = None, exclude_self: bool = True, cosine: bool = True) -> DataFrame:
    """id, rank (from 1), nbr, sim: the k best of base for each query row, ties to the least nbr.

    queries: rows of the same columns; else base itself. ValueError unless 1 <= k (< rows of base, if rows
    exclude themselves).
    """
    n = base.count()
    if k < 1 or (exclude_self and queries is None and k >= n):
        raise ValueError("k must lie in [1, number of rows)")
    own = F.col(vec).cast("array<double>") if not cosine else unit(vec)
    b = base.select(F.col(key).cast("long").alias("id"), own.alias("x"))
    q = b if queries is None else queries.select(F.col(key).cast("long").alias("id"), own.alias("x"))
    nb = max(1, math.ceil(n / BASE_ROWS))
    nq = max(1, math.ceil((n if queries is None else q.count()) / QUERY_ROWS))

    def block(n_own: int, n_other: int, own_name: str, other_name: str, df: DataFrame) -> DataFrame:
        df = df.withColumn(own_name, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int"))
        return df.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    b, q = block(nb, nq, "i", "j", b), block(nq, nb, "j", "i", q)

    def best(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(bs):
            return pd.DataFrame({"id": [], "nbr": [], "sim": []})
        ids = bs.id.to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], np.stack(bs.x)[order]
        sims = np.stack(qs.x) @ x.T
        if exclude_self:
            sims[qs.id.to_numpy()[:, None] == ids[None, :]] = -np.inf
        top = np.argsort(-sims, 1, kind="stable")[:, :k]
        rows = np.arange(len(qs))[:, None]
        out = pd.DataFrame({"id": np.repeat(qs.id.to_numpy(), top.shape[1]), "nbr": ids[top].ravel(), "sim": sims[rows, top].ravel()})
        return out[np.isfinite(out.sim)]

    found = q.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(best, "id long, nbr long, sim double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "nbr", "sim")


def purity_curve(graph: DataFrame, rows: DataFrame, key: str, label: str, ks: list[int]) -> DataFrame:
    """k, purity, sd (ddof 1), all_same, none_same, chance, ratio: share of neighbours with the row's label."""
    lab = rows.select(F.col(key).alias("id"), F.col(label).alias("l"))
    same = graph.join(lab, "id").join(lab.select(F.col("id").alias("nbr"), F.col("l").alias("ln")), "nbr")
    same = same.select("id", "rank", (F.col("l") == F.col("ln")).cast("double").alias("s"))
    each = same.select("id", "rank", "s", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k").groupBy("k", "id").agg(F.avg("s").alias("p"))
    out = each.groupBy("k").agg(F.avg("p").alias("purity"), F.stddev_samp("p").alias("sd"), F.avg((F.col("p") == 1).cast("double")).alias("all_same"), F.avg((F.col("p") == 0).cast("double")).alias("none_same"))
    return out.crossJoin(chance_purity(rows, label)).withColumn("ratio", F.try_divide("purity", "chance"))


def chance_purity(rows: DataFrame, label: str) -> DataFrame:
    c = rows.groupBy(label).agg(F.count("*").cast("double").alias("n"))
    return c.agg((F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("chance"))


def tie_group_sizes(rows: DataFrame, label: str, k: int = 10) -> DataFrame:
    """least, median, mean, most sizes of label groups, the mean over rows, and the mean of min(1, k / (size - 1))."""
    g = rows.groupBy(label).agg(F.count("*").cast("double").alias("n"))
    fill = F.when(F.col("n") > 1, F.least(F.lit(1.0), F.try_divide(F.lit(float(k)), F.col("n") - 1))).otherwise(1.0)
    return g.agg(
        F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most"),
        (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("row_mean"), (F.sum(F.col("n") * fill) / F.sum("n")).alias("filled"),
    )


def disagreement(graph: DataFrame, labels: DataFrame, key: str, vec: str, snapped: bool = False) -> DataFrame:
    """id, score: 1 - mean cosine between a row's label vector and its neighbours', 0 to 2."""
    v = labels.select(F.col(key).alias("id"), unit(vec).alias("x"))
    pairs = graph.join(v, "id").join(v.select(F.col("id").alias("nbr"), F.col("x").alias("y")), "nbr")
    cos = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    out = pairs.groupBy("id").agg((1 - F.avg(cos)).alias("score"))
    return out.withColumn("score", snap(F.col("score"))) if snapped else out


def nearest_labels(rows: DataFrame, label: str, vec: str) -> DataFrame:
    """label, other: the other label whose mean unit vector is nearest (ties: least label). Labels are few next to rows."""
    means = pool(rows, label, vec)
    return neighbours(means, "unit", "x", 1).select(*[F.col(c).cast(rows.schema[label].dataType).alias(n) for c, n in (("id", "label"), ("nbr", "other"))])


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, jaccard of the two graphs' neighbour sets, which have the same k."""
    both = a.select("id", "nbr").join(b.select("id", "nbr"), ["id", "nbr"], "left_semi").groupBy("id").agg(F.count("*").alias("c"))
    k = a.groupBy("id").agg(F.count("*").alias("k"))
    return k.join(both, "id", "left").select("id", F.coalesce(F.col("c") / (2 * F.col("k") - F.col("c")), F.lit(0.0)).alias("jaccard"))


def summary(df: DataFrame, value: str) -> DataFrame:
    """mean, median, sd (ddof 1), most, share of zeros."""
    return df.agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("sd"), F.max(value).alias("most"), F.avg((F.col(value) == 0).cast("double")).alias("zero"))


def pairwise(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """da, db: cosine distances in two views for each pair of rows, for samples of a stated size."""
    x = rows.select(F.col(key).alias("k"), unit(a).alias("a"), unit(b).alias("b"))
    y = x.select(*[F.col(c).alias(f"{c}2") for c in x.columns])
    d = lambda p, q: 1 - F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    return x.join(y, F.col("k") < F.col("k2")).select(d("a", "a2").alias("da"), d("b", "b2").alias("db"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """rho, n: Pearson correlation of mid-ranks."""
    from .textq import midranks

    ranked = midranks(midranks(df.select(a, b), a, "ra"), b, "rb")
    return ranked.agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


def ksg(df: DataFrame, x: list[Column], y: list[Column], key: str, k: int = 5) -> DataFrame:
    """mi, n: Kraskov mutual information (variant 1) of two sets of columns.

    digamma of integers is a harmonic number less a constant that cancels. Points are compared by maximum norm, in
    blocks of bounded size; what leaves a pair of blocks are the k least distances, or two counts, of each point.
    Duplicate points are refused, as they have no radius.
    """
    p = df.select(F.col(key).cast("long").alias("id"), F.array(*x).cast("array<double>").alias("x"), F.array(*y).cast("array<double>").alias("y"))
    n = p.count()
    if not 1 <= k < n:
        raise ValueError("k must lie in [1, number of rows)")
    if p.select("x", "y").distinct().count() < n:
        raise ValueError("duplicate points have no neighbour radius")
    blocks = max(1, math.ceil(n / QUERY_ROWS))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    base = p.withColumn("j", own).select(*[F.col(c).alias(f"b{c}") for c in p.columns], "j").withColumn("i", every)

    def apart(a: pd.Series, b: pd.Series) -> np.ndarray:
        a, b = np.stack(a), np.stack(b)
        out = np.zeros((len(a), len(b)))
        for d in range(a.shape[1]):
            np.maximum(out, np.abs(a[:, None, d] - b[None, :, d]), out=out)
        return out

    def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"id": [], "d": []})
        far = np.maximum(apart(q.x, b.bx), apart(q.y, b.by))
        far[q.id.to_numpy()[:, None] == b.bid.to_numpy()[None]] = np.inf
        least = np.sort(far, 1)[:, :k]
        out = pd.DataFrame({"id": np.repeat(q.id.to_numpy(), least.shape[1]), "d": least.ravel()})
        return out[np.isfinite(out.d)]

    def inside(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"id": [], "nx": [], "ny": []})
        other, eps = q.id.to_numpy()[:, None] != b.bid.to_numpy()[None], q.eps.to_numpy()[:, None] - 1e-12
        return pd.DataFrame({"id": q.id, "nx": ((apart(q.x, b.bx) < eps) & other).sum(1), "ny": ((apart(q.y, b.by) < eps) & other).sum(1)})

    def met(rows: DataFrame, f, schema: str) -> DataFrame:
        q = rows.withColumn("i", own).withColumn("j", every)
        return q.groupBy("i", "j").cogroup(base.groupBy("i", "j")).applyInPandas(f, schema)

    nth = F.row_number().over(Window.partitionBy("id").orderBy("d"))
    eps = met(p, nearest, "id long, d double").withColumn("r", nth).where(F.col("r") == k).select("id", F.col("d").alias("eps"))
    counts = met(p.join(eps, "id"), inside, "id long, nx long, ny long").groupBy("id").agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny"))
    # harmonic numbers of the counts that there are
    some = counts.select(F.explode(F.array("nx", "ny")).alias("m")).groupBy("m").agg(F.count("*").alias("c"))
    h = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("m")), F.lit(0.0), lambda s, i: s + F.when(i > 0, 1.0 / F.greatest(i, F.lit(1).cast("long"))).otherwise(0.0))
    const = sum(1 / i for i in range(1, k)) + sum(1 / i for i in range(1, n))
    return some.agg(F.greatest(F.lit(0.0), F.lit(const) - F.sum(h * F.col("c")) / n).alias("mi"), (F.sum("c") / 2).cast("long").alias("n"))
