"""Statistics of covariance blocks: effective rank and canonical correlations.

Executors add up outer products; only matrices of the vectors' dimension reach the driver, where they are
factored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ranked
from .resample import by_hash


def moments(df: DataFrame, vec: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and centred sum of outer products of the vectors; a row of the sum is one row of a shuffle."""

    def partial(batches):
        total = None
        for b in batches:
            if len(b):
                x = np.concatenate([np.stack(b.x), np.ones((len(b), 1))], 1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [g.i.iloc[0]], "row": [g.row.sum()]})

    rows = df.select(F.col(vec).cast("array<double>").alias("x")).mapInPandas(partial, "i int, row array<double>")
    got = sorted((r.i, r.row) for r in rows.groupBy("i").applyInPandas(add, "i int, row array<double>").collect())
    if not got:
        raise ValueError("no rows")
    full = np.array([row for _, row in got])
    n, mean = int(full[-1, -1]), full[-1, :-1] / full[-1, -1]
    return n, mean, full[:-1, :-1] - n * np.outer(mean, mean)


def effective_rank(df: DataFrame, vec: str) -> float:
    """exp of the entropy of the centred matrix's singular values, taken as shares."""
    _, _, gram = moments(df, vec)
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(gram), 0))
    p = s[s > 1e-12 * s.max()] / s.sum()
    return float(np.exp(-(p * np.log(p)).sum()))


def cca(df: DataFrame, a: str, b: str, components: int = 10, reg: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Correlations (0 to 1, falling), directions of either side, and means; covariances get a ridge."""
    da = len(df.select(a).first()[0])
    n, mean, gram = moments(df.select(F.concat(F.col(a).cast("array<double>"), F.col(b).cast("array<double>")).alias("x")), "x")
    c = gram / (n - 1)

    def whiten(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(m + reg * np.eye(len(m)))
        return v / np.sqrt(np.maximum(w, 1e-12)) @ v.T

    wa, wb = whiten(c[:da, :da]), whiten(c[da:, da:])
    u, s, vt = np.linalg.svd(wa @ c[:da, da:] @ wb)
    k = min(components, da, len(c) - da, n - 1)
    return np.clip(s[:k], 0, 1), wa @ u[:, :k], wb @ vt[:k].T, mean[:da], mean[da:]


def gaussian_mi(correlations) -> float:
    r = np.clip(np.asarray(correlations, float), 0, 1 - 1e-9)
    return float(-0.5 * np.log1p(-r * r).sum())


def cross_validated_cca(df: DataFrame, key: str, a: str, b: str, splits: int = 10, components: int = 10, reg: float = 1e-4, seed: int = 0) -> pd.DataFrame:
    """split, component, fitted, in_sample, held_out, mi, difference: for each split into halves (of equal size, by a
    hash), the correlations found on one half, those of its variates there and on the other half, the information of
    the latter, and how far fitted ones are from those of all rows."""
    out, n = [], df.count()
    whole = cca(df, a, b, components, reg)[0]
    for s in range(splits):
        half = ranked(df.withColumn("__x", by_hash(seed, s, F.col(key))), [F.col("__x"), F.col(key)], "__r")
        half = half.withColumn("__h", (F.col("__r") > n // 2).cast("int"))
        r, u, v, ma, mb = cca(half.where("__h = 0"), a, b, components, reg)
        k = len(r)

        def project(batches, u=u, v=v, ma=ma, mb=mb):
            for x in batches:
                if len(x):
                    both = pd.DataFrame(np.concatenate([(np.stack(x.a) - ma) @ u, (np.stack(x.b) - mb) @ v], 1), columns=[f"c{i}" for i in range(u.shape[1] * 2)])
                    both.insert(0, "h", x.h.to_numpy())
                    yield both

        plain = half.select(F.col("__h").alias("h"), F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b"))
        variates = plain.mapInPandas(project, "h int, " + ", ".join(f"c{i} double" for i in range(2 * k)))
        own, test = variates.groupBy("h").agg(*[F.corr(f"c{i}", f"c{i + k}").alias(f"r{i}") for i in range(k)]).orderBy("h").collect()
        out += [(s, i, float(r[i]), own[f"r{i}"], test[f"r{i}"], gaussian_mi([abs(test[f"r{i}"])]), float(abs(r[i] - whole[i]))) for i in range(min(k, len(whole)))]
    return pd.DataFrame(out, columns=["split", "component", "fitted", "in_sample", "held_out", "mi", "difference"])
