"""Vector index in cells (inverted lists): centroids, a cell column, and searches that open the nearest cells."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.vectors import dot, unit
from .agreement import per_unit_disagreement
from .knn import neighbours


def build(rows: DataFrame, key: str, vec: str, cells: int, seed: int = 0, train_rows: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(index, centroids): rows with x (unit vector) and cell; centroids (cell, c). k-means sees about `train_rows`
    rows, or all if there are fewer; every row is indexed. Centroids, of a stated number, are held in the plan."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = rows.withColumn("x", unit(vec))
    n = x.count()
    bound = min(int(1.1 * train_rows / max(n, 1) * 2**64), 2**64 - 1) - 2**63  # of all 64-bit hashes, a share
    train = x.where(F.xxhash64(key) <= bound)
    train = train.select(array_to_vector("x").alias("f")).persist()  # read once an iteration
    model = KMeans(k=cells, seed=seed, maxIter=10, initSteps=1, featuresCol="f").fit(train)
    train.unpersist()
    centres = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = rows.sparkSession.createDataFrame(centres, "cell int, c array<double>").withColumn("c", unit("c", 1e-12))
    directions = np.array([c for _, c in centres])
    directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-12)

    def assign(batches):
        for b in batches:
            held = b.column("x").is_valid().to_numpy(zero_copy_only=False)
            cells = np.zeros(len(held), np.int32)
            if held.any():
                flat = b.column("x").flatten().to_numpy(zero_copy_only=False)
                cells[held] = np.argmax(flat.reshape(held.sum(), -1) @ directions.T, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, mask=~held)], names=[*b.schema.names, "cell"])

    return x.mapInArrow(assign, StructType([*x.schema.fields, StructField("cell", IntegerType())])), centroids


def search(index: DataFrame, centroids: DataFrame, queries: DataFrame, key: str, k: int, probes: int) -> DataFrame:
    """id, rank, nbr, sim from the `probes` nearest cells of each query; fewer than k if the cells hold fewer.
    The join is on the cell, so a cell column that partitions a table prunes its files."""
    q = queries.select(F.col(key).alias("id"), F.col("x").alias("q")).crossJoin(F.broadcast(centroids))
    order = Window.partitionBy("id").orderBy(F.desc(dot("q", "c")), "cell")
    visits = q.withColumn("n", F.row_number().over(order)).where(F.col("n") <= probes).select("id", "q", "cell")
    found = visits.join(index.select(F.col(key).alias("nbr"), "x", "cell"), "cell").where("id <> nbr").withColumn("sim", dot("q", "x"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "nbr", "sim")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """recall, queries: mean share of a query's exact neighbours that were found."""
    hits = exact.join(found.select("id", "nbr"), ["id", "nbr"], "left_semi").groupBy("id").agg(F.count("*").alias("h"))
    each = exact.groupBy("id").agg(F.count("*").alias("k")).join(hits, "id", "left")
    return each.agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("k")).alias("recall"), F.count("*").alias("queries"))


def similar_units(rows: DataFrame, unit_col: str, key: str, vec: str, target, k: int) -> DataFrame:
    """unit, nbr, sim, rank: the k other units whose best row is nearest the mean vector of `target`'s rows."""
    own = rows.where(F.col(unit_col) == target).select(F.posexplode(unit(vec))).groupBy("pos").agg(F.avg("col").alias("v"))
    mean = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("m")).select(unit("m", 1e-12).alias("m"))
    others = rows.where(F.col(unit_col) != target).select(F.col(unit_col).alias("unit"), F.col(key).alias("nbr"), unit(vec).alias("x"))
    scored = others.crossJoin(F.broadcast(mean)).select("unit", "nbr", dot("x", "m").alias("sim"))
    best = scored.groupBy("unit").agg(F.max_by(F.struct("nbr", "sim"), F.struct("sim", (-F.col("nbr")).alias("n"))).alias("b")).select("unit", "b.*")
    first = best.orderBy(F.desc("sim"), "unit").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sim"), "unit")))


def exact_search(rows: DataFrame, queries: DataFrame, key: str, vec: str, k: int, exclude_self: bool = True) -> DataFrame:
    return neighbours(rows, key, vec, k, queries, exclude_self=exclude_self)


def described(found: DataFrame, rows: DataFrame, key: str, unit_col: str, vec: str, labels: list[str]) -> DataFrame:
    """What a search found (id, rank, nbr, sim) with each neighbour's labels, its unit, and the unit's disagreement (null
    for units of one row)."""
    facts = rows.select(F.col(key).alias("nbr"), F.col(unit_col).alias("unit"), *labels)
    of = per_unit_disagreement(rows, unit_col, vec).select("unit", "disagreement")
    return found.join(facts, "nbr").join(of, "unit", "left").select("id", "rank", "nbr", "sim", "unit", *labels, "disagreement")


def write(index: DataFrame, centroids: DataFrame, path: str, **facts) -> None:
    """Three tables under path: vectors (a folder a cell, so that searches prune files), centroids, and facts as JSON."""
    index.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    one = index.sparkSession.range(1).select(*[F.lit(v).alias(n) for n, v in facts.items()]) if facts else centroids.agg(F.count("*").alias("cells"))
    one.write.mode("overwrite").json(f"{path}/facts")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, centroids, facts) as write left them."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids"), spark.read.json(f"{path}/facts")


def latency(searches: list) -> dict[str, float]:
    """median and p95 seconds of calls that each return a DataFrame, timed to the last row."""
    took = []
    for call in searches:
        began = time.perf_counter()
        call().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return {"median": float(np.percentile(took, 50)), "p95": float(np.percentile(took, 95))}
