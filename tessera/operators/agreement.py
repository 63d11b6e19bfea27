"""Chance-corrected agreement within units: nominal, semantic and Fleiss' kappa, and per-unit disagreement.

Every function takes `by`, columns that split the input into groups, all done in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm, unit

#: Units of more rows than this use sums of outer products in place of pairs.
PAIR_ROWS = 512
#: alpha_by_pairs takes so many rows at most.
PAIRS_MOST = 20_000
#: alpha_by_blocks: rows of a block, and of the tiles in which two blocks are compared.
BLOCK_ROWS, TILE_ROWS = 8_192, 512
#: A task holds at most about so many groups' sums of outer products at a time.
MATRICES = 64


def alpha(observed: Column, expected: Column) -> Column:
    """1 - observed / expected; 1 where nothing could disagree."""
    return F.when(expected == 0, F.lit(1.0)).otherwise(1 - F.try_divide(observed, expected))




def label_counts(df: DataFrame, unit_col: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """by, unit, label, c, m of units with two rows or more; only (unit, label) counts are shuffled."""
    c = df.groupBy(*by, F.col(unit_col).alias("unit"), F.col(label).alias("label")).agg(F.count("*").alias("c"))
    return c.withColumn("m", F.sum("c").over(Window.partitionBy(*by, "unit"))).where("m >= 2")


def alpha_nominal(df: DataFrame, unit_col: str, label: str, by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """by, alpha, observed, expected, n_units, n_pairable. Null labels are a label of their own.

    Without any unit of two rows: no row (with by, for that group), or ValueError if strict.
    """
    c = label_counts(df, unit_col, label, by)
    if strict and not c.limit(1).count():
        raise ValueError("no pairable unit: every unit has fewer than two annotations")
    units = c.groupBy(*by, "unit").agg(F.max("m").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    o = units.groupBy(*by).agg(F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("apart"), F.sum("m").alias("n"), F.count("*").alias("n_units"))
    pool = c.groupBy(*by, "label").agg(F.sum("c").alias("c")).groupBy(*by).agg(F.sum(F.col("c") * (F.col("c") - 1)).cast("double").alias("same"))
    both = o.join(pool, list(by)) if by else o.crossJoin(pool)  # one row each without by
    n = F.col("n").cast("double")
    both = both.where("n is not null").withColumn("observed", F.col("apart") / n).withColumn("expected", (n * (n - 1) - F.col("same")) / (n * (n - 1)))
    return both.select(*by, alpha(F.col("observed"), F.col("expected")).alias("alpha"), "observed", "expected", "n_units", F.col("n").alias("n_pairable"))


def _unit_vectors(df: DataFrame, unit_col: str, vec: str, by: Sequence[str]) -> DataFrame:
    x = df.select(*by, F.col(unit_col).alias("unit"), unit(vec).alias("x"))
    return x.withColumn("m", F.count("*").over(Window.partitionBy(*by, "unit"))).where("m >= 2")


def _distances(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, unit, m, total: sum of squared cosine distances over ordered pairs of a unit. df: of _unit_vectors, which
    leaves the rows of a unit in one partition.

    Small units multiply their rows with each other; of large ones, tasks add up outer products, whose squares
    give the same sum, so a unit that holds much of the table is split over tasks.
    """
    keys = [*by, "unit"]

    def pairs(batches):
        """Units come whole, one after the other: the last of a batch waits for the next. Rows meet those some places on."""
        rest = None
        for b in chain(batches, [None]):
            now = rest if b is None else b if rest is None else pd.concat([rest, b], ignore_index=True)
            if now is None or not len(now):
                continue
            h = now["__h"].to_numpy()
            cut = len(h) if b is None else int(np.append(0, np.flatnonzero(h[1:] != h[:-1]) + 1)[-1])
            rest, now, h = now.iloc[cut:], now.iloc[:cut], h[:cut]
            if not cut:
                continue
            first = np.append(0, np.flatnonzero(h[1:] != h[:-1]) + 1)
            x, unit = np.stack(now.x), np.repeat(np.arange(len(first)), np.diff(np.append(first, cut)))
            total, at, shift = np.zeros(len(first)), np.arange(cut), 1
            while True:
                at = at[at < cut - shift]
                at = at[unit[at] == unit[at + shift]]
                if not len(at):
                    break
                total += 2 * np.bincount(unit[at], (1 - np.einsum("ij,ij->i", x[at], x[at + shift])) ** 2, len(first))
                shift += 1
            out = now.iloc[first][[*keys, "m"]].copy()
            out["total"] = total
            yield out

    def partial(batches):
        for b in batches:
            if len(b):
                out = []
                for key, g in b.groupby(keys, dropna=False, sort=False):
                    x = np.stack(g.x)
                    out.append([*key, len(x), x.sum(0), (x.T @ x).ravel()])
                yield pd.DataFrame(out, columns=[*keys, "m", "s", "g"])

    def reduced(g: pd.DataFrame) -> pd.DataFrame:
        n, s, gram = int(g.m.sum()), g.s.sum(), g.g.sum()
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), n, float(n * n - 2 * (s @ s) + (gram @ gram))]], columns=[*keys, "m", "total"])

    types = df.select(*keys).schema
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)
    small = df.where(F.col("m") <= PAIR_ROWS).withColumn("__h", F.xxhash64(*keys)).sortWithinPartitions(*keys)
    small = small.select(*keys, "m", "x", "__h").mapInPandas(pairs, f"{plain}, m long, total double")
    large = df.where(F.col("m") > PAIR_ROWS).select(*keys, "x").mapInPandas(partial, f"{plain}, m long, s array<double>, g array<double>")
    return small.union(large.groupBy(*keys).applyInPandas(reduced, f"{plain}, m long, total double"))


def pooled(df: DataFrame, vec: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """by, n, total: sum of squared cosine distances over all ordered pairs of the group's unit vectors.

    n^2 - 2 |sum x|^2 + |X'X|^2: one pass, a row of X'X a task and dimension, never a pair of rows. weight: how
    many times a row counts.
    """
    by = list(by)

    def partial(batches):
        sums: dict = {}
        for b in batches:
            groups = b.groupby(by, dropna=False, sort=False) if by else [((), b)]
            for key, g in groups:
                if len(g):
                    x = np.stack(g.x)
                    full = np.concatenate([x, np.ones((len(x), 1))], 1)
                    gram = (full * g.w.to_numpy()[:, None]).T @ full
                    sums[key] = sums[key] + gram if key in sums else gram
            if len(sums) > MATRICES:
                yield written(sums)
                sums = {}
        yield written(sums)

    def written(sums: dict) -> pd.DataFrame:
        rows = [[*key, i, row] for key, gram in sums.items() for i, row in enumerate(gram)]
        return pd.DataFrame(rows, columns=[*by, "i", "row"])

    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema) if by else ""

    def add(g: pd.DataFrame) -> pd.DataFrame:
        row = g.row.sum()
        return pd.DataFrame([[*(g[k].iloc[0] for k in by), g.i.iloc[0], float(row[:-1] @ row[:-1]), row[-1], len(row)]], columns=[*by, "i", "square", "last", "d"])

    times = (F.col(weight) if weight else F.lit(1)).cast("double").alias("w")
    flat = df.select(*by, F.col(vec).alias("x"), times)
    rows = (flat.sortWithinPartitions(*by) if by else flat).mapInPandas(partial, f"{plain}i int, row array<double>")
    rows = rows.groupBy(*by, "i").applyInPandas(add, f"{plain}i int, square double, last double, d int")
    own = F.col("i") < F.col("d") - 1
    n = F.max(F.when(~own, F.col("last")))
    return rows.groupBy(*by).agg(n.cast("long").alias("n"), (n * n - 2 * F.sum(F.when(own, F.col("last") ** 2)) + F.sum(F.when(own, F.col("square")))).alias("total"))


def alpha_semantic(df: DataFrame, unit_col: str, vec: str, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Like alpha_nominal, with squared cosine distance, in closed form. Zero vectors: ValueError if strict."""
    x = _unit_vectors(df, unit_col, vec, by)
    if strict:
        sizes = df.groupBy(*by, unit_col).agg(F.count("*").alias("c"), F.min(F.coalesce(norm(vec), F.lit(0.0))).alias("least"))
        facts = sizes.agg(F.max("c").alias("c"), F.min("least").alias("least")).first()
        if facts.least == 0:
            raise ValueError(f"{vec} holds a zero-norm vector")
        if (facts.c or 0) < 2:
            raise ValueError("no pairable unit: every unit has fewer than two annotations")
    units = _distances(x, by).groupBy(*by).agg(F.sum(F.col("total") / (F.col("m") - 1)).alias("apart"), F.count("*").alias("n_units"))
    pool = pooled(x, "x", by)
    both = units.join(pool, list(by)) if by else units.crossJoin(pool)
    n = F.col("n").cast("double")
    both = both.withColumn("observed", F.col("apart") / n).withColumn("expected", F.col("total") / (n * (n - 1)))
    return both.select(*by, alpha(F.col("observed"), F.col("expected")).alias("alpha"), "observed", "expected", "n_units", F.col("n").alias("n_pairable"))


def alpha_excluding(df: DataFrame, unit_col: str, vec: str, classes: dict[str, Column]) -> DataFrame:
    """class, alpha, delta, n_units, units_lost, half_lost: semantic alpha of all rows (class `all`) and without the
    rows of each class (a flag; null: not of it), what that changes, and whether over half of the units went."""
    kept = F.array_compact(F.array(F.lit("all"), *[F.when(~F.coalesce(flag, F.lit(False)), F.lit(name)) for name, flag in classes.items()]))
    each = alpha_semantic(df.withColumn("class", F.explode(kept)), unit_col, vec, ["class"])
    base = each.where("class = 'all'").select(F.col("alpha").alias("__a"), F.col("n_units").alias("__n"))
    lost = F.col("__n") - F.col("n_units")
    return each.crossJoin(F.broadcast(base)).select("class", "alpha", (F.col("alpha") - F.col("__a")).alias("delta"), "n_units", lost.alias("units_lost"), (2 * lost > F.col("__n")).alias("half_lost"))


def alpha_by_pairs(df: DataFrame, unit_col: str, distance, key: str) -> DataFrame:
    """alpha for any distance: distance(a, b) is a column of two struct columns of a row's fields.

    For small tables: all pairs of pairable rows are joined; over PAIRS_MOST rows ValueError. It is what the closed
    forms are held against.
    """
    if df.limit(PAIRS_MOST + 1).count() > PAIRS_MOST:
        raise ValueError(f"pairs of over {PAIRS_MOST} rows: use alpha_by_blocks or a closed form")
    rows = df.withColumn("m", F.count("*").over(Window.partitionBy(unit_col))).where("m >= 2")
    rows = rows.select(F.col(unit_col).alias("u"), F.col(key).alias("k"), "m", F.struct(*df.columns).alias("r"))
    a, b = (rows.select(*[F.col(c).alias(f"{c}_{s}") for c in rows.columns]) for s in "ab")
    d = distance(F.col("r_a"), F.col("r_b"))
    pairs = a.join(b, F.col("k_a") != F.col("k_b"))
    sums = pairs.agg(F.sum(F.when(F.col("u_a") == F.col("u_b"), d / (F.col("m_a") - 1))).alias("apart"), F.sum(d).alias("total"))
    sizes = rows.agg(F.count("*").cast("double").alias("n"), F.countDistinct("u").alias("n_units"))
    out = sums.crossJoin(sizes).withColumn("observed", F.col("apart") / F.col("n")).withColumn("expected", F.col("total") / (F.col("n") * (F.col("n") - 1)))
    return out.select(alpha(F.col("observed"), F.col("expected")).alias("alpha"), "observed", "expected", "n_units", F.col("n").cast("long").alias("n_pairable"))


def alpha_by_blocks(df: DataFrame, unit_col: str, vec: str, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """alpha_by_pairs with squared cosine distance, for tables of any size: every pair of rows is compared.

    Pairs of blocks of rows are matrix products, of which only two sums leave a task; the work grows with the square
    of the rows, what is shuffled with that square over block_rows. Pairs of equal or null keys or of null vectors
    count nothing; pairs of null units only in the total.
    """
    rows = df.select(F.col(unit_col).alias("u"), F.col(key).alias("k"), unit(vec).alias("x"))
    rows = rows.withColumn("m", F.count("*").over(Window.partitionBy("u"))).where("m >= 2")
    sizes = rows.agg(F.count("*").cast("double").alias("n"), F.countDistinct("u").alias("n_units"))
    part = rows.where(F.col("k").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda e: e.isNull()))
    blocks = max(1, math.ceil(df.count() / block_rows))
    # a row of block b meets those of all blocks: as the first of the two where b is the lesser
    part = part.withColumn("b", F.pmod(F.xxhash64("k", "u", "x"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    part = part.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") <= F.col("o")).alias("first"), "u", "k", "m", "x")

    def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a and b of all pairs of equal codes; b is sorted, codes below 0 equal none."""
        low, high = np.searchsorted(b, a), np.searchsorted(b, a, "right")
        many = np.where(a < 0, 0, high - low)
        start = np.repeat(low - np.cumsum(many) + many, many)
        return np.repeat(np.arange(len(a)), many), start + np.arange(many.sum())

    def compared(g: pd.DataFrame) -> pd.DataFrame:
        u, k = pd.factorize(g.u)[0], pd.factorize(g.k)[0]
        x, m, first, own = np.stack(g.x), g.m.to_numpy(), g["first"].to_numpy(), g.i.iloc[0] == g.j.iloc[0]
        order = np.argsort(u, kind="stable")  # rows of a unit lie in few tiles
        a, b = order[first[order]], order if own else order[~first[order]]
        apart = total = 0.0
        for at in range(0, len(a), TILE_ROWS):
            p = a[at : at + TILE_ROWS]
            for to in range(0, len(b), TILE_ROWS):
                q = b[to : to + TILE_ROWS]
                d = (1 - x[p] @ x[q].T) ** 2
                by_key = np.argsort(k[q], kind="stable")
                same, there = alike(k[p], k[q][by_key])
                d[same, by_key[there]] = 0
                total += d.sum()
                same, there = alike(u[p], u[q])
                apart += (d[same, there] / (m[p][same] - 1)).sum()
        return pd.DataFrame({"apart": [apart if own else 2 * apart], "total": [total if own else 2 * total]})

    sums = part.groupBy("i", "j").applyInPandas(compared, "apart double, total double").agg(F.sum("apart").alias("apart"), F.sum("total").alias("total"))
    out = sums.crossJoin(sizes).withColumn("observed", F.col("apart") / F.col("n")).withColumn("expected", F.col("total") / (F.col("n") * (F.col("n") - 1)))
    return out.select(alpha(F.col("observed"), F.col("expected")).alias("alpha"), "observed", "expected", "n_units", F.col("n").cast("long").alias("n_pairable"))


def per_unit_disagreement(df: DataFrame, unit_col: str, vec: str) -> DataFrame:
    """unit, m, disagreement: mean squared cosine distance between rows of a unit; single rows are left out."""
    d = _distances(_unit_vectors(df, unit_col, vec, ()), ())
    return d.select("unit", "m", (F.col("total") / (F.col("m") * (F.col("m") - 1))).alias("disagreement"))


def fleiss_kappa(df: DataFrame, subject: str, category: str) -> DataFrame:
    """kappa, n_subjects, n_raters. ValueError if subjects differ in raters, have one, or agreement is certain."""
    c = df.groupBy(F.col(subject).alias("s"), F.col(category).alias("c")).agg(F.count("*").cast("double").alias("k"))
    per = c.groupBy("s").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq"))
    spread = per.agg(F.min("n"), F.max("n")).first()
    if spread[0] is None or spread[0] != spread[1]:
        raise ValueError("subjects must have equal numbers of raters")
    n = spread[0]
    if n < 2:
        raise ValueError("at least two raters are needed")
    p = per.agg(F.avg((F.col("sq") - n) / (n * (n - 1))).alias("p"), F.count("*").alias("n_subjects"))
    total = Window.partitionBy(F.lit(0))
    shares = c.groupBy("c").agg(F.sum("k").alias("k")).withColumn("share", F.col("k") / F.sum("k").over(total))
    e = shares.agg(F.sum(F.col("share") ** 2).alias("e"))
    if abs(e.first().e - 1) < 1e-12:
        raise ValueError("expected agreement is 1: kappa is undefined")
    return p.crossJoin(e).select(((F.col("p") - F.col("e")) / (1 - F.col("e"))).alias("kappa"), "n_subjects", F.lit(int(n)).cast("long").alias("n_raters"))


def unit_sizes(df: DataFrame, unit_col: str) -> DataFrame:
    """k, units: how many units have k rows."""
    return df.groupBy(unit_col).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("units"))


def worst_units(df: DataFrame, unit_col: str, vec: str, text: str, k: int = 15) -> DataFrame:
    """The k units of most disagreement (ties: least unit) with their texts, sorted."""
    top = per_unit_disagreement(df, unit_col, vec).orderBy(F.desc(F.bround("disagreement", 12)), "unit").limit(k)
    rows = df.select(F.col(unit_col).alias("unit"), F.col(text).cast("string").alias("t")).join(F.broadcast(top), "unit")
    return rows.groupBy("unit", "m", "disagreement").agg(F.array_join(F.array_sort(F.collect_list("t")), "|").alias("texts"))


