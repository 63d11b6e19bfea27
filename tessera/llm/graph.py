"""Connected components by alternating large-star and small-star steps; edges never leave the executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, remove, shared_dir


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of an edge list (a, b), a <> b, of longs.

    Each round is cut off from the last by a written table, and rounds end when no edge changes; each at
    least halves the height of what remains. Hub nodes are aggregated before they are shuffled. Tables of
    earlier rounds are deleted.
    """
    spark, at = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/{uuid.uuid4().hex}"
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{at}/0")
    round_ = 0
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join has two plain sides and Spark can split a hub's rows over tasks
        least = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{at}/least-{round_}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least).where("a <> b")
        edges = keep(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{at}/{round_ + 1}")
        now = _state(edges)
        remove(spark, f"{at}/{round_}")
        remove(spark, f"{at}/least-{round_}")
        round_ += 1
        if now == state:
            break
        state = now
    linked = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return linked.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
