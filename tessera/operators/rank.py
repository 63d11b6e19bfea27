"""Ranks, ensembles, worklists and detection metrics over score tables (id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import t_two_sided
from .knn import spearman
from .ordered import ranked
from .resample import by_hash
from .textq import midranks


def ensemble(scores: DataFrame) -> DataFrame:
    """id, score: minus the mean over encoders of the row's falling mid-rank. scores: encoder, id, score."""
    return midranks(scores, "score", descending=True, by="encoder").groupBy("id").agg((-F.avg("rank")).alias("score"))


def places(scores: DataFrame, seed: int = 0) -> DataFrame:
    """id, score, rank of all rows by falling score, ties in an order that the seed draws."""
    return ranked(scores.withColumn("__h", by_hash(seed, F.col("id"))), [-F.col("score"), F.col("__h"), F.col("id")], "rank").drop("__h")


def top(scores: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """id, score, rank of the k largest scores, ties in an order that the seed draws."""
    first = scores.orderBy(F.desc("score"), by_hash(seed, F.col("id")), "id").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), by_hash(seed, F.col("id")), "id")))


def detection(scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (50, 200), seed: int = 0) -> DataFrame:
    """auc, and for each k precision, recall and the ceiling of precision. truth: id of the positives."""
    marked = scores.join(truth.select("id").distinct().withColumn("t", F.lit(1)), "id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    ranked = midranks(marked, "score")
    auc = ranked.agg(F.sum("t").alias("p"), F.sum(1 - F.col("t")).alias("n"), F.sum(F.col("t") * F.col("rank")).alias("r"))
    out = auc.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"), F.col("p").alias("positives"))
    for k in ks:
        hits = top(marked.drop("t"), k, seed).join(marked.select("id", "t"), "id").agg(F.sum("t").alias(f"h{k}"))
        out = out.crossJoin(hits).withColumn(f"precision_{k}", F.col(f"h{k}") / k).withColumn(f"recall_{k}", F.try_divide(f"h{k}", "positives")).withColumn(f"ceiling_{k}", F.least(F.lit(1.0), F.col("positives") / k)).drop(f"h{k}")
    return out


def lift(scores: DataFrame, truth: DataFrame, fractions=(0.1, 0.2, 0.3), seed: int = 0) -> DataFrame:
    """fraction, precision, recall, lift among the top fractions of rows."""
    marked = scores.join(truth.select("id").distinct().withColumn("t", F.lit(1)), "id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    n, p = marked.agg(F.count("*"), F.sum("t")).first()
    parts = None
    for f in fractions:
        k = max(1, int(f * n))
        row = top(marked.drop("t"), k, seed).join(marked.select("id", "t"), "id").agg((F.sum("t") / k).alias("precision"), F.try_divide(F.sum("t"), F.lit(p)).alias("recall"))
        row = row.select(F.lit(f).alias("fraction"), "precision", "recall", F.try_divide(F.col("precision"), F.lit(p / n)).alias("lift"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


def agreement_of_tops(a: DataFrame, b: DataFrame, k: int, wide: int, seed: int = 0) -> DataFrame:
    """Shares of the k top rows that two encoders have in common, or that are in the other's `wide` top rows."""
    # seeds differ so that ties aren't broken alike
    ta, tb, wa, wb = top(a, k, seed), top(b, k, seed + 1), top(a, wide, seed), top(b, wide, seed + 1)
    count = lambda x, y, name: x.join(y.select("id"), "id", "left_semi").agg((F.count("*") / k).alias(name))
    return count(ta, tb, "common").crossJoin(count(ta, wb, "a_in_b")).crossJoin(count(tb, wa, "b_in_a"))


def agreement_of_tails(a: DataFrame, b: DataFrame) -> DataFrame:
    """positive_a, positive_b, jaccard of the rows scored above 0, and Spearman's rho over their union."""
    both = a.select("id", F.col("score").alias("a")).join(b.select("id", F.col("score").alias("b")), "id").where("a > 0 or b > 0")
    counts = both.agg(F.count_if(F.col("a") > 0).alias("positive_a"), F.count_if(F.col("b") > 0).alias("positive_b"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("common"), F.count("*").alias("n"))
    return counts.crossJoin(spearman(both, "a", "b").select("rho")).select("positive_a", "positive_b", F.try_divide("common", "n").alias("jaccard"), "rho")


def distribution(scores: DataFrame) -> DataFrame:
    """mean, sd (ddof 1), nine percentiles and distinct values at 12 decimals."""
    at = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    p = scores.agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.percentile("score", F.array(*map(F.lit, at))).alias("p"), F.countDistinct(F.bround("score", 12)).alias("distinct_scores"))
    return p.select("mean", "sd", *[F.element_at("p", k + 1).alias(f"q{round(100 * q)}") for k, q in enumerate(at)], "distinct_scores")


def specificity(scores: DataFrame, k: int = 50, seed: int = 0) -> DataFrame:
    """Mean of the top k against the rest, the gap in sds, scores at k and k + 1, ties at the boundary."""
    head = top(scores, k + 1, seed)
    edge = head.agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("at_k"), F.max(F.when(F.col("rank") == k + 1, F.col("score"))).alias("after_k"), F.sum(F.when(F.col("rank") <= k, F.col("score"))).alias("s"))
    all_ = scores.crossJoin(edge).agg(
        F.max("at_k").alias("at_k"), F.max("after_k").alias("after_k"), F.max("s").alias("s"), F.sum("score").alias("t"), F.count("*").alias("n"), F.stddev_samp("score").alias("sd"),
        F.sum((F.col("score") == F.col("at_k")).cast("long")).alias("ties"), F.sum((F.col("score") > F.col("at_k")).cast("long")).alias("above"),
        F.percentile("score", F.lit(0.5)).alias("median"), F.max("score").alias("most"), F.sum((F.col("score") > 0).cast("long")).alias("positive"),
    )
    out = all_.withColumn("top_mean", F.col("s") / k).withColumn("rest_mean", F.try_divide(F.col("t") - F.col("s"), F.col("n") - k))
    return out.select("top_mean", "rest_mean", F.try_divide(F.col("top_mean") - F.col("rest_mean"), F.col("sd")).alias("gap_sd"), "at_k", "after_k", (F.col("at_k") - F.col("after_k")).alias("drop"), "median", "most", "positive", "ties", "above")


def fit_line(points: DataFrame, x: str = "rate", y: str = "score") -> DataFrame:
    """slope, intercept, r, stderr, n, p of least squares; ValueError under three points."""
    s = points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.count("*").alias("n"))
    found = s.first()
    if found.n < 3:
        raise ValueError("a line needs at least three points")
    t_stderr = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r") ** 2) * F.col("syy") / F.col("sxx") / (F.col("n") - 2))
    stderr = (max(0.0, 1 - found.r**2) * found.syy / found.sxx / (found.n - 2)) ** 0.5
    p = 0.0 if stderr == 0 else t_two_sided(found.slope / stderr, found.n - 2)
    return s.select("slope", "intercept", "r", t_stderr.alias("stderr"), "n", F.lit(p).alias("p"))


def predicted_cost(slope: float, rate: float) -> float:
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in [0, 1]")
    return -slope * rate


def swap_calibration(rows: DataFrame, graphs: dict[str, DataFrame], key: str, label: str, sizes: list[int], seeds: int) -> DataFrame:
    """arm, n_swap, auc, sd, seeds: how well rows whose labels were deranged stand out from their neighbours.

    All replicates are one table (size, seed, id); the neighbour graphs are made once and joined with it. An arm's score
    is the share of neighbours in its graph with another label; the arm `ensemble` has the mean of all arms' mid-ranks.
    """
    spark = rows.sparkSession
    grid = spark.createDataFrame([(s, k) for s in sizes for k in range(seeds)], "n_swap int, seed int")
    own = ["n_swap", "seed"]
    x = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("l"))
    w = Window.partitionBy(*own)
    h = by_hash(F.col("seed"), F.col("id"))
    # the drawn rows of a replicate are of a stated number
    picked = x.crossJoin(F.broadcast(grid)).withColumn("h", F.row_number().over(w.orderBy(h, "id"))).where("h <= n_swap").withColumn("r", F.row_number().over(w.orderBy("l", "id")) - 1)
    shift = picked.groupBy(*own, "l").agg(F.count("*").alias("t")).groupBy(*own).agg(F.max("t").alias("t"))
    giver = picked.join(F.broadcast(shift), own).select(*own, F.pmod(F.col("r") + F.col("t"), F.col("n_swap")).alias("r"), F.col("l").alias("nl"))
    moved = F.broadcast(picked.select(*own, "id", "r").join(giver, [*own, "r"]).select(*own, "id", "nl"))
    now = x.crossJoin(F.broadcast(grid)).join(moved, [*own, "id"], "left").select(*own, "id", F.coalesce("nl", "l").alias("l"), F.col("nl").isNotNull().cast("int").alias("y"))
    edges = None
    for arm, graph in graphs.items():
        some = graph.select(F.lit(arm).alias("arm"), "id", "nbr")
        edges = some if edges is None else edges.union(some)
    pairs = now.join(edges, "id").join(now.select(*own, F.col("id").alias("nbr"), F.col("l").alias("ln")), [*own, "nbr"])
    scores = pairs.groupBy("arm", *own, "id").agg(F.max("y").alias("y"), F.avg((F.col("l") != F.col("ln")).cast("double")).alias("score"))
    each = ["arm", *own]

    def mid(scores: DataFrame) -> DataFrame:
        ties = scores.groupBy(*each, "score").agg(F.count("*").alias("k"))
        ties = ties.withColumn("mid", F.sum("k").over(Window.partitionBy(*each).orderBy("score")) - (F.col("k") - 1) / 2)
        return scores.join(ties.drop("k"), [*each, "score"])

    ranked_ = mid(scores)
    both = ranked_.groupBy(*own, "id").agg(F.max("y").alias("y"), F.avg("mid").alias("score")).select(F.lit("ensemble").alias("arm"), *own, "id", "y", "score")
    every = ranked_.select(*each, "y", "mid").union(mid(both).select(*each, "y", "mid"))
    auc = every.groupBy(*each).agg(F.sum(F.col("y") * F.col("mid")).alias("r"), F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    auc = auc.withColumn("auc", F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")))
    return auc.groupBy("arm", "n_swap").agg(F.avg("auc").alias("auc"), F.stddev_samp("auc").alias("sd"), F.count("*").alias("seeds"))
