"""A corpus with known faults: tasks, a vision view and a language view of each episode, some labels wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..operators.resample import draw


def _normal(*parts):
    """A standard normal from hashes, by Box and Muller, the same on any partitioning."""
    u, v = ((draw(*parts, s) + 1) / 4294967297.0 for s in ("u", "v"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v)


def corpus(spark: SparkSession, episodes: int = 600, tasks: int = 12, dim: int = 48, noise: float = 0.2, spread: float = 0.3, seed: int = 0) -> DataFrame:
    """episode, task (the true one), label (wrong for a share `noise` of episodes), vision, language: the task's
    latent direction plus noise; language follows the label, vision the task."""
    vector = lambda kind, own: unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _normal(seed, "task", own, i) + spread * _normal(seed, kind, F.col("episode"), i)))
    rows = spark.range(episodes).select(F.col("id").alias("episode"), F.pmod(draw(seed, "pick", F.col("id")), F.lit(tasks)).alias("task"))
    wrong = draw(seed, "wrong", F.col("episode")) < noise * 4294967296.0
    moved = F.pmod(F.col("task") + 1 + F.pmod(draw(seed, "to", F.col("episode")), F.lit(max(tasks - 1, 1))), F.lit(tasks))
    rows = rows.withColumn("label", F.when(wrong, moved).otherwise(F.col("task")))
    return rows.select("*", vector("vision", F.col("task")).alias("vision"), vector("language", F.col("label")).alias("language"))
