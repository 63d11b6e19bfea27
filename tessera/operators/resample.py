"""Seeded draws that any engine can repeat: everything random comes from md5 of a seed and an id."""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .agreement import alpha, label_counts
from .ordered import ranked

#: Of 2^32, the numbers below which a Poisson variable with mean 1 is at most 0, 1, 2, ...
CUTS = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def draw(seed, *parts) -> Column:
    """An integer in [0, 2^32) that depends on the seed and the parts alone."""
    key = F.concat_ws("|", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in (seed, *parts)])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def by_hash(seed, *parts) -> Column:
    return F.md5(F.concat_ws("|", *[(F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in (seed, *parts)]).cast("binary"))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: the least hashes."""
    return df.orderBy(by_hash(seed, F.col(key)), key).limit(n)


def times(seed, reps: int, units) -> np.ndarray:
    """How often each unit counts in each replicate, [units, reps]: Poisson with mean 1, the limit of drawing as many
    units as there are with replacement. A replicate's number is 32 bits of sha256 of seed, unit and eighth."""
    eighths = range(-(-reps // 8))
    drawn = b"".join([sha256(f"{seed}|{u}|{k}".encode()).digest() for u in units for k in eighths])
    return np.searchsorted(CUTS, np.frombuffer(drawn, ">u4"), side="right").astype(np.uint8).reshape(len(units), -1)[:, :reps]


def _replicated(rows: DataFrame, unit, sums: dict[str, Column], reps: int, seed, by: Sequence[str] = (), label: Column | None = None) -> DataFrame:
    """by, b and the sums over rows, each times its unit's count in replicate b; with label, also `same`: the sum of
    t (t - 1) over the totals t of the first sum by label.

    A task adds its rows to one array of replicates for each group and label, so what is shuffled are such arrays.
    """
    by, names = list(by), list(sums)
    tag = F.lit("") if label is None else F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit("0"))
    own = F.concat_ws("|", *by, unit) if by else unit.cast("string")
    flat = rows.select(*by, F.coalesce(own, F.lit("")).alias("__u"), tag.alias("tag"), *[v.cast("double").alias(f"__{n}") for n, v in sums.items()])

    def written(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*key, list(x)) for key, x in held.items()], columns=[*by, "tag", "x"])

    def run(batches):
        held: dict = {}
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                code, unit = pd.factorize(part["__u"])
                w = times(seed, reps, unit)[code].astype(np.float64)
                for key, at_key in part.groupby([*by, "tag"], dropna=False, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    total = part.iloc[at_key][[f"__{n}" for n in names]].to_numpy().T @ w[at_key]
                    held[key] = held[key] + total.ravel() if key in held else total.ravel()
            if len(held) > 2000:
                yield written(held)
                held = {}
        yield written(held)

    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in flat.select(*by).schema) if by else ""
    parts = flat.mapInPandas(run, f"{plain}tag string, x array<double>").select(*by, "tag", F.posexplode("x").alias("p", "v"))
    each = parts.groupBy(*by, "tag", F.pmod("p", F.lit(reps)).alias("b")).agg(*[F.sum(F.when(F.floor(F.col("p") / reps) == k, F.col("v"))).alias(n) for k, n in enumerate(names)])
    same = [F.sum(F.col(names[0]) * (F.col(names[0]) - 1)).alias("same")] if label is not None else []
    return each.groupBy(*by, "b").agg(*[F.sum(n).alias(n) for n in names], *same)


def _interval(each: DataFrame, value: str, level: float) -> DataFrame:
    return each.agg(F.percentile(value, F.lit(level / 2)).alias("low"), F.percentile(value, F.lit(1 - level / 2)).alias("high"), F.count(value).alias("reps"))


def _nominal_replicates(c: DataFrame, reps: int, seed, by: Sequence[str]) -> DataFrame:
    # of a unit's m rows, c of a label: sums over labels of c, and of what makes m (m - 1) - sum c (c - 1), by m - 1
    sums = {"n": F.col("c"), "apart": F.col("c") - F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)}
    n = F.col("n")
    each = _replicated(c, F.col("unit"), sums, reps, seed, by, F.col("label")).where("n > 1")
    return each.select(*by, "b", alpha(F.col("apart") / n, (n * (n - 1) - F.col("same")) / (n * (n - 1))).alias("alpha"))


def bootstrap_nominal(df: DataFrame, unit_col: str, label: str, reps: int, seed: int = 0, level: float = 0.05) -> DataFrame:
    """low, high, reps: percentile interval of nominal alpha under resampling of units (see times()).

    A unit that counts twice is two units. Replicates without two rows are left out. ValueError if fewer than two
    units have two rows.
    """
    c = label_counts(df, unit_col, label)
    if c.select("unit").distinct().limit(2).count() < 2:
        raise ValueError("a bootstrap needs at least two pairable units")
    return _interval(_nominal_replicates(c, reps, seed, []), "alpha", level)


def bootstrap_nominal_by(df: DataFrame, unit_col: str, label: str, by: str, reps: int, seed: int = 0) -> DataFrame:
    """by, b, alpha: nominal alpha of each group under reps resamplings of the group's units. Groups with fewer than
    two pairable units are left out."""
    c = label_counts(df, unit_col, label, [by])
    several = c.groupBy(by).agg((F.min("unit") < F.max("unit")).alias("__two")).where("__two").select(by)
    return _nominal_replicates(c, reps, seed, [by]).join(several, by, "left_semi")


def bootstrap_mean(df: DataFrame, key: str, values: list[str], reps: int, seed: int = 0, level: float = 0.05) -> DataFrame:
    """value, low, high: percentile interval of the mean of each column under resampling of rows, told apart by key."""
    sums = {"w": F.lit(1)} | {f"s{k}": F.col(v) for k, v in enumerate(values)}
    each = _replicated(df, F.col(key), sums, reps, seed).where("w > 0")
    long = each.select("w", F.explode(F.array(*[F.struct(F.lit(v).alias("value"), (F.col(f"s{k}") / F.col("w")).alias("m")) for k, v in enumerate(values)])).alias("x"))
    return _interval(long.select("x.*").groupBy("value"), "m", level).drop("reps")


def bootstrap_semantic(df: DataFrame, unit_col: str, vec: str, reps: int, seed: int = 0, level: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Like bootstrap_nominal, for squared cosine distance; by: groups of units, each with its interval.

    Units' own sums are made once. A task adds its vectors' outer products, times their units' counts, to one matrix
    for each replicate, some replicates a pass where vectors are long, and vectors aren't shuffled for it.
    """
    from .agreement import _distances, _unit_vectors

    by = list(by)
    x = _unit_vectors(df, unit_col, vec, by)
    units = _distances(x, by)
    if units.limit(2).count() < 2:
        raise ValueError("a bootstrap needs at least two pairable units")
    obs = _replicated(units, F.col("unit"), {"n": F.col("m"), "apart": F.col("total") / (F.col("m") - 1)}, reps, seed, by).where("n > 1")
    d = x.select(F.size("x")).first()[0]
    own = F.coalesce(F.concat_ws("|", *by, "unit") if by else F.col("unit").cast("string"), F.lit("")).alias("__u")
    flat = x.select(*by, own, "x")
    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in flat.select(*by).schema) if by else ""
    at_once, cut = max(1, 4_000_000 // (d + 1) ** 2), 8192

    def matrices(first: int, last: int):
        def written(held: dict) -> pd.DataFrame:
            rows = [(*key, first + b, k, m.ravel()[k : k + cut]) for key, a in held.items() for b, m in enumerate(a) for k in range(0, (d + 1) ** 2, cut)]
            return pd.DataFrame(rows, columns=[*by, "b", "k", "row"])

        def run(batches):
            held: dict = {}
            for batch in batches:
                for key, g in batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]:
                    if not len(g):
                        continue
                    code, unit = pd.factorize(g["__u"])
                    w = times(seed, reps, unit)[code, first:last].astype(np.float64)
                    v = np.concatenate([np.stack(g.x), np.ones((len(g), 1))], 1)
                    a = held.setdefault(key, np.zeros((last - first, d + 1, d + 1)))
                    for b in range(last - first):
                        a[b] += (v * w[:, b, None]).T @ v
                if len(held) > 8:
                    yield written(held)
                    held = {}
            yield written(held)

        return (flat.sortWithinPartitions(*by) if by else flat).mapInPandas(run, f"{plain}b int, k int, row array<double>")

    def add(g: pd.DataFrame) -> pd.DataFrame:
        row = np.sum(np.stack(g.row), 0)
        i, j = np.divmod(int(g.k.iloc[0]) + np.arange(len(row)), d + 1)
        square, linear = (row[(i < d) & (j < d)] ** 2).sum(), (row[(i == d) & (j < d)] ** 2).sum()
        return pd.DataFrame([[*(g[c].iloc[0] for c in [*by, "b"]), square - 2 * linear]], columns=[*by, "b", "part"])

    parts = None
    for first in range(0, reps, at_once):
        some = matrices(first, min(reps, first + at_once))
        parts = some if parts is None else parts.union(some)
    pool = parts.groupBy(*by, "b", "k").applyInPandas(add, f"{plain}b int, part double").groupBy(*by, "b").agg(F.sum("part").alias("part"))
    n = F.col("n")
    both = obs.withColumn("b", F.col("b").cast("int")).join(pool, [*by, "b"])
    each = both.select(*by, alpha(F.col("apart") / n, (n * n + F.col("part")) / (n * (n - 1))).alias("alpha"))
    return _interval(each.groupBy(*by) if by else each, "alpha", level)


def noisy_subset(df: DataFrame, key: str, rate: float, seed: int, even: bool = False) -> tuple[DataFrame, int]:
    """df with r: the rank of the row in the drawn subset of round-half-even(rate * n) rows, null outside it."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    m = round(rate * df.count())
    m -= m % 2 if even else 0
    places = ranked(df.select(key, by_hash(seed, F.col(key)).alias("__h")), [F.col("__h"), F.col(key)], "r").withColumn("r", F.col("r") - 1)
    return df.join(places.where(F.col("r") < m).select(key, "r"), key, "left"), m


def inject_label_noise(df: DataFrame, key: str, label: str, rate: float, mode: str, seed: int = 0, nearest: DataFrame | None = None) -> DataFrame:
    """df with new_label and changed.

    shuffle: the subset's labels rotate by another hash order; swap: first half of the subset trades with the
    second; paraphrase: each takes the label `nearest` (label, other) gives. rate 0 changes nothing.
    """
    if mode not in ("shuffle", "swap", "paraphrase"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "paraphrase" and nearest is None:
        raise ValueError("paraphrase needs embeddings: pass the nearest other label of each label")
    rows, m = noisy_subset(df, key, rate, seed, even=mode == "swap")
    if mode == "paraphrase":
        other = nearest.select(F.col("label").alias(label), F.col("other").alias("__o"))
        out = rows.join(other, label, "left").withColumn("new_label", F.when(F.col("r").isNotNull(), F.coalesce("__o", label)).otherwise(F.col(label))).drop("__o")
    else:
        chosen = rows.where("r is not null").select("r", F.col(label).alias("__l"), F.col(key).alias("__k"))
        if mode == "swap":
            giver = chosen.select(F.pmod(F.col("r") + m // 2, F.lit(max(m, 1))).alias("r"), "__l")
        else:
            shuffled = chosen.withColumn("__h", by_hash(seed + 1, F.col("__k"))).drop("r")
            shuffled = ranked(shuffled, [F.col("__h"), F.col("__k")], "r").withColumn("r", F.col("r") - 1)
            giver = shuffled.select("r", "__l")
        out = rows.join(giver, "r", "left").withColumn("new_label", F.when(F.col("r").isNotNull(), F.col("__l")).otherwise(F.col(label))).drop("__l")
    return out.drop("r").withColumn("changed", F.col("new_label") != F.col(label))


def derange_tasks(df: DataFrame, key: str, task: str, n_swap: int, seed: int = 0) -> DataFrame:
    """df with new_task: the tasks of n_swap drawn rows permuted so that none keeps its own.

    The subset in task order is shifted by its largest task's size. ValueError where that task holds over half.
    """
    picked = df.select(key, task).orderBy(by_hash(seed, F.col(key)), key).limit(n_swap)
    top = picked.groupBy(task).count().agg(F.max("count")).first()[0] or 0
    if 2 * top > n_swap:
        raise ValueError("no derangement: one task holds more than half of the subset")
    ranked = picked.withColumn("r", F.row_number().over(Window.orderBy(task, key)) - 1)
    giver = ranked.select(F.pmod(F.col("r") + top, F.lit(max(n_swap, 1))).alias("r"), F.col(task).alias("new_task"))
    return df.join(ranked.select(key, "r").join(giver, "r").drop("r"), key, "left").withColumn("new_task", F.coalesce("new_task", task))
