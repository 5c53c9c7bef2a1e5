"""Lineage cuts through the cluster's shared checkpoint folder.

Iterative operators write each round as a table below ``spark.checkpoint.dir`` and read it
back.  A lost executor then costs a re-read of files, never a replay of earlier rounds, and
the file sizes give the optimiser a measured basis for its join strategy.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach; a private one only for local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="wallframe-")
    return _LOCAL_DIRS[context.applicationId]


def materialize(df: DataFrame) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder in one job; return the stored table and its row count."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wallframe/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored, int(seen.get["rows"])


def discard(stored: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(stored, "stored_at", None)
    if path:
        jvm = stored.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def until_empty(
    frontier: DataFrame,
    decide: Callable[[DataFrame], DataFrame],
    shrink: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame | None:
    """Repeat ``decide(frontier)`` and ``shrink(frontier, decided)`` until the frontier is empty.

    Returns the decided rows of all rounds, or None if there was nothing to decide.  ``shrink``
    must drop at least one row; the number of rounds is not limited.
    """
    rounds = []
    frontier, left = materialize(frontier)
    while left:
        decided, _ = materialize(decide(frontier))
        rounds.append(decided)
        frontier, left = materialize(shrink(frontier, decided))
    return union_all(rounds)


def union_all(tables: list[DataFrame]) -> DataFrame | None:
    merged = None
    for table in tables:
        merged = table if merged is None else merged.unionByName(table)
    return merged
