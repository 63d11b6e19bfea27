"""From frames to one vector an episode, and checks of frame tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import check_norms, unit


def pool(df: DataFrame, group: str, vec: str) -> DataFrame:
    """group, x: unit frames averaged, made unit again; ValueError on a zero frame."""
    parts = check_norms(df, vec).select(F.col(group).alias("g"), F.posexplode(unit(vec)))
    mean = parts.groupBy("g", "pos").agg(F.avg("col").alias("v"))
    x = mean.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("x"))
    return x.select(F.col("g").alias("unit"), unit("x").alias("x"))


def concat_views(df: DataFrame, *vecs: str) -> DataFrame:
    """df with x: unit views laid end to end, made unit again."""
    return df.withColumn("x", unit(F.concat(*[unit(v) for v in vecs])))


def waypoints(df: DataFrame, group: str, order: list[str], value: str, fractions=(0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """group, n, mean, sd (ddof 0), least, most, and the value at round-half-even(fraction * (n - 1))."""
    seq = df.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda s: s["__v"]).alias("s"),
    )
    at = lambda f: F.element_at("s", (F.bround(F.lit(f) * (F.col("n") - 1)) + 1).cast("int"))
    return seq.select(group, "n", "mean", "sd", "least", "most", *[at(f).alias(f"w{round(100 * f)}") for f in fractions])


STATS = ("mean", "sd", "least", "most", "w0", "w25", "w50", "w75", "w100")


def action_view(df: DataFrame, group: str, order: list[str], channels: list[str]) -> DataFrame:
    """group, n, and for each channel c the nine columns c_mean .. c_w100 of waypoints(), standardised over all groups."""
    at = [0.0, 0.25, 0.5, 0.75, 1.0]
    aggregates = [f(c).alias(f"{c}_{name}") for c in channels for name, f in zip(STATS, (F.avg, F.stddev_pop, F.min, F.max))]
    rows = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in channels]))).alias("s")
    seq = df.groupBy(group).agg(F.count("*").alias("n"), *aggregates, rows)
    # the five rows are picked once, then read by all channels
    picked = F.array(*[F.element_at("s", (F.bround(F.lit(f) * (F.col("n") - 1)) + 1).cast("int")) for f in at])
    seq = seq.withColumn("s", picked)
    points = [F.get("s", F.lit(k))[f"__{c}"].alias(f"{c}_{name}") for c in channels for k, name in enumerate(STATS[4:])]
    wide = seq.select(group, "n", *[f"{c}_{name}" for c in channels for name in STATS[:4]], *points)
    return zscore(wide, [f"{c}_{name}" for c in channels for name in STATS])


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns standardised over all rows (ddof 0); constant columns become 0."""
    stats = df.agg(*[F.avg(c).alias(f"{c}__m") for c in columns], *[F.stddev_pop(c).alias(f"{c}__s") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    own = {c: F.when(F.col(f"{c}__s") > 0, F.try_divide(F.col(c) - F.col(f"{c}__m"), F.col(f"{c}__s"))).otherwise(0.0).alias(c) for c in columns}
    return out.select(*[own.get(c, F.col(c)) for c in df.columns])


def constant_in_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, least, most, consistent: whether value is the same in all rows of a group."""
    return df.groupBy(group).agg(F.min(value).alias("least"), F.max(value).alias("most")).withColumn("consistent", F.col("least") == F.col("most"))


def file_plan(df: DataFrame, file: str, order: str, length: str) -> DataFrame:
    """df with first, last: the rows of each episode within its file, episodes back to back."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("last", F.sum(length).over(w) - 1).withColumn("first", F.col("last") - F.col(length) + 1)


def frame_plan(df: DataFrame, key: str, length: str, picks: int = 9) -> DataFrame:
    """key, pick, frame: evenly spread frames, rounded half to even."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(picks - 1))).alias("pick")
    return df.select(key, length, spread).select(key, "pick", F.bround(F.col("pick") * (F.col(length) - 1) / (picks - 1)).cast("long").alias("frame"))


def layout_check(df: DataFrame, file: str, order: str, first: str, last: str, length: str) -> DataFrame:
    """file, episodes, rows, intact: whether stated ranges start at 0, follow back to back and have their lengths."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(length).over(w), F.lit(0))
    good = (F.col(first) == before) & (F.col(last) == before + F.col(length) - 1)
    return df.select(file, length, F.coalesce(good, F.lit(False)).alias("good")).groupBy(file).agg(F.count("*").alias("episodes"), F.sum(length).alias("rows"), F.bool_and("good").alias("intact"))
