"""Ordered and joined work over groups of any size.

A group (image, run, condition) may hold a large share of all rows, so no helper here hands a
whole group to one task: ranks and running values are computed on range-partitioned chunks and
corrected by a per-chunk offset; joins on a hot key spread that key over several salts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

MAX_HOT_KEYS = 1000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = 200_000) -> DataFrame:
    """At most ``MAX_HOT_KEYS`` keys with more rows than one task should take, with a part count.

    Any key outside the list holds less than 1/``MAX_HOT_KEYS`` of the table, so the list has a
    fixed size bound and can be broadcast.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return (
        sizes.filter(F.col("_rows") > rows_per_task)
        .orderBy(F.desc("_rows"), *keys)
        .limit(MAX_HOT_KEYS)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_parts"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    *,
    hot: DataFrame | None = None,
    rows_per_task: int = 200_000,
) -> DataFrame:
    """Equi-join whose hot keys are split: left rows get a salt from ``spread``, right rows a copy per salt.

    ``hot`` is a result of ``hot_keys`` to reuse; by default the keys of ``left`` are counted.
    Right-preserving joins are not supported, since right rows are copied.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"unsupported join type for a salted join: {how}")
    keys = list(keys)
    hot = F.broadcast(hot_keys(left, keys, rows_per_task) if hot is None else hot)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), parts).cast("int"))
        .drop("_parts")
    )
    copies = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def chunked(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by (group, order) and fix each row's chunk number in a stored table."""
    placed = df.repartitionByRange(*[F.col(name) for name in group], *order)
    return materialize(placed.withColumn("_chunk", F.spark_partition_id()))[0]


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where null meets null; keys are kept from ``left``."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_right_{key}")) for key in keys]
    return left.join(renamed, same).drop(*[f"_right_{key}" for key in keys])


def _offsets(chunks: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """Sum of ``value`` over the earlier chunks of a group: one row per group and chunk."""
    totals = chunks.groupBy(*group, "_chunk").agg(value.alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *group, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    )


def row_numbers(chunks: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of each row of a ``chunked`` table within its group."""
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    local = chunks.withColumn("_position", F.row_number().over(inside))
    return (
        _null_safe(local, _offsets(chunks, group, F.count(F.lit(1))), [*group, "_chunk"])
        .withColumn(name, (F.col("_position") + F.col("_before")).cast("bigint"))
        .drop("_position", "_before")
    )


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Like ``row_number`` over (group, order) without holding a group in one task.

    ``order`` must be a total order within the group.
    """
    return row_numbers(chunked(df, group, order), group, order, name).drop("_chunk")


def running_sum(
    chunks: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` along the order of a ``chunked`` table."""
    inside = (
        Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = chunks.withColumn("_local", F.sum(value).over(inside))
    return (
        _null_safe(local, _offsets(chunks, group, F.sum(value)), [*group, "_chunk"])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before")
    )


def suffix_max(
    chunks: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Maximum of ``value`` over this row and all later rows of a ``chunked`` table."""
    peaks = chunks.groupBy(*group, "_chunk").agg(F.max(value).alias("_peak"))
    later = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    peaks = peaks.select(*group, "_chunk", F.max("_peak").over(later).alias("_later"))
    inside = Window.partitionBy(*group, "_chunk")
    # Walking backwards keeps a running maximum; a frame that starts at each row would rescan the rest.
    backwards = inside.orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
    placed = chunks.withColumn("_place", F.row_number().over(inside.orderBy(*order)))
    local = placed.withColumn("_local", F.max(value).over(backwards))
    return (
        _null_safe(local, peaks, [*group, "_chunk"])
        .withColumn(name, F.greatest("_local", "_later"))
        .drop("_local", "_later", "_place")
    )


def differences(chunks: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``value`` minus that of the row before, the first row of a group against 0, along a ``chunked`` table."""
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    local = chunks.withColumn("_value", value).withColumn("_place", F.row_number().over(inside))
    lasts = local.groupBy(*group, "_chunk").agg(F.max_by("_value", "_place").alias("_last"))
    earlier = Window.partitionBy(*group).orderBy("_chunk")
    lasts = lasts.select(*group, "_chunk", F.lag("_last").over(earlier).alias("_before"))
    joined = _null_safe(local.withColumn("_lag", F.lag("_value").over(inside)), lasts, [*group, "_chunk"])
    before = F.coalesce("_lag", "_before", F.lit(0))
    return joined.withColumn(name, F.col("_value") - before).drop("_value", "_place", "_lag", "_before")
