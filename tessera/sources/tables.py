"""Reading and writing: tables, annotation documents, word lists, vectors, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.textq import normalise
from .shipping import ship

ANNOTATIONS = "map<string,map<string,string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def read_annotations(spark: SparkSession, path: str, slots: tuple[str, ...] = ("language_instruction1", "language_instruction2", "language_instruction3"), limit: int = 0) -> DataFrame:
    """unit_id, slot (from 1), text from JSON documents {unit: {slot name: text}}: white space made single spaces,
    empty and missing slots left out. limit: number of units, least ids first (0: all)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", ANNOTATIONS).alias("d"))
    units = raw.select(F.explode(F.map_entries("d")).alias("e")).select("e.key", "e.value")
    units = units.orderBy("key").limit(limit) if limit else units
    named = F.array(*[F.struct(F.lit(i).alias("slot"), F.try_element_at("value", F.lit(s)).alias("text")) for i, s in enumerate(slots, 1)])
    rows = units.select(F.col("key").alias("unit_id"), F.explode(named).alias("s")).select("unit_id", "s.*")
    return rows.withColumn("text", normalise("text")).where(F.length("text") > 0)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """word: the distinct lines of a word list, trimmed, in lower case."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def write_vectors(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Vectors keyed by id, as Parquet; partition (an index's cell) becomes a folder level that searches prune."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_worklist(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_worklist(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def corpus_tag(df: DataFrame, text: str, model: str = "") -> DataFrame:
    """tag, rows: a digest of a corpus whatever its order, from digests of rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(model), F.col(text)).cast("binary")), 1, 15), 16, 10).cast("long")
    return df.agg(F.bit_xor(h).alias("tag"), F.count("*").alias("rows"))
