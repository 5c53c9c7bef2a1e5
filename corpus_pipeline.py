"""A corpus pipeline: toxicity, exact dedup, near dedup, source mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wallframe.llm import golay_simhash, mix_tree, radix_dedup, swap_packing, toxic_neighbours
from wallframe.llm.common import ready, table, unused
from wallframe.llm.queries import tokenizer_path
from wallframe.store import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes do not call toxic (score under 0.7)."""
    ready(spark)
    model = toxic_neighbours.fit(docs, toxic_neighbours.learnable(table(spark, sf_dir, "labels")))
    (score,) = unused(docs, "score")
    scored = docs.withColumn(score, toxic_neighbours.scored_struct(model).getField("score"))
    return scored.filter(F.col(score) < 0.7).drop(score)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts: the one with the largest id."""
    ready(spark)
    return radix_dedup.drop_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id."""
    ready(spark)
    return golay_simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    ready(spark)
    return mix_tree.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048."""
    ready(spark)
    return swap_packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix), ("packing", pack)]
# Learning, SimHash, seeded draws and packing have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/wallframe/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
