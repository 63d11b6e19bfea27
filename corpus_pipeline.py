"""A corpus pipeline: documents in, packed training sequences out. Each stage's rows are written, then read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, mixing, nearjoin, packing, pii
from tessera.llm.common import shared_dir

STAGES = [
    ("language_id", langid.stage),
    ("jaccard_join", nearjoin.stage),
    ("pii", pii.stage),
    ("mix_sources", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: MinHash, tokens and random draws aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is a Parquet table in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
