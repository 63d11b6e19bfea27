"""Vector expressions on ARRAY columns, in double precision, inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v, least: float = 0.0) -> Column:
    """v / |v|; with least, norms are clamped to it, so a zero vector stays at the origin.

    The norm is a field beside the vector, so it is taken once a row, not once a component.
    """
    long = F.greatest(norm(v), F.lit(least)) if least else norm(v)
    held = F.array(F.struct(doubles(v).alias("v"), long.alias("n")))
    return F.transform(held, lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def cosine(a, b) -> Column:
    """Of unit vectors."""
    return dot(a, b)


def squared_cosine_distance(a, b, clip: bool = True) -> Column:
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))) if clip else dot(a, b)
    return (1 - c) * (1 - c)


def snap(x) -> Column:
    """Rounded to 12 decimals, without negative zero."""
    return F.bround(x, 12) + F.lit(0.0)


def check_norms(df: DataFrame, v: str) -> DataFrame:
    """df, or ValueError if a vector is zero or null: one eager aggregate."""
    if df.where(F.coalesce(norm(v), F.lit(0.0)) == 0).limit(1).count():
        raise ValueError(f"{v} holds a zero-norm vector")
    return df
