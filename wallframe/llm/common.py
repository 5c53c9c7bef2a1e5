"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import prepare

# Texts may be very long, so batches to Python are bounded by bytes, not by rows alone.
ARROW_LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of this subpackage: adaptive plans and Arrow batches bounded in bytes."""
    for key, value in ARROW_LIMITS.items():
        spark.conf.set(key, value)
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def release() -> None:
    """Give freed memory back to the system: Python workers are reused, and keep what the task before took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(rows: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]):
    """``rows`` for ``mapInPandas``, with freed memory given back before and after each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        yield from rows(batches)
        release()

    return run


def per_text(function, schema: str):
    """An Arrow-batched column function; ``function()`` is called once per task and gives ``bytes -> value``.

    With several fields in ``schema`` the value is a tuple and the result a struct.
    """
    parts = [part.split() for part in schema.split(", ")]
    if len(parts[0]) == 1:

        @pandas_udf(schema)
        def column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            release()
            run = function()
            for texts in batches:
                yield pd.Series([run(raw) for raw in texts], dtype=object)
            del run
            release()

        return column
    fields = [name for name, *_ in parts]

    @pandas_udf(schema)
    def struct(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        run = function()
        for texts in batches:
            yield pd.DataFrame([run(raw) for raw in texts], columns=fields)
        del run
        release()

    return struct


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have, so helper columns never clash."""
    taken, out = {name.lower() for name in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
