"""Flat metric rows, summaries, files and comparisons across conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = ["run_id", "target", "condition", "case_id", "image_id", "source_id", "split", "status", "metric", "value"]


def _melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(ids), list(metrics), "metric", "value").filter(F.col("value").isNotNull())


def metric_rows(
    cases: DataFrame,
    aggregates: DataFrame,
    *,
    run_id: str,
    target: str,
    case_metrics: Sequence[str],
    aggregate_metrics: Sequence[str],
) -> DataFrame:
    """One row per case metric and one per aggregate, the latter with null ids."""
    ids = ["condition", "case_id", "image_id", "source_id", "split", "status"]
    rows = _melt(cases, ids, case_metrics)
    blank = aggregates.withColumns(
        {c: F.lit(None).cast(cases.schema[c].dataType) for c in ("case_id", "image_id", "source_id", "split")}
    ).withColumn("status", F.lit("aggregate"))
    merged = rows.unionByName(_melt(blank, ids, aggregate_metrics))
    return merged.select(F.lit(run_id).alias("run_id"), F.lit(target).alias("target"), *ROW[2:])


def summarize_cases(cases: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Status counts and the mean of every metric over evaluated cases, as (metric, value)."""
    done = cases.filter(F.col("status") == "evaluated")
    means = _melt(done, ["case_id"], metrics).groupBy("metric").agg(F.avg("value").alias("value"))
    counts = cases.agg(
        F.count(F.lit(1)).alias("case_count"),
        *[
            F.count_if(F.col("status") == s).alias(f"{s}_case_count")
            for s in ("evaluated", "unevaluable", "error")
        ],
    )
    names = ["case_count", "evaluated_case_count", "unevaluable_case_count", "error_case_count"]
    return _melt(counts, [], names).unionByName(means)


def clean_vs_distorted(cases: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metric change of every derived case against the clean case of its source."""
    long = _melt(cases, ["condition", "image_id", "source_id"], metrics)
    side = lambda name: long.filter(F.col("condition") == name)
    clean = side("clean").select("source_id", "metric", F.col("value").alias("clean_value"))
    return (
        side("distorted")
        .join(clean, ["source_id", "metric"])
        .select("source_id", "image_id", "metric", "clean_value", F.col("value").alias("distorted_value"),
                (F.col("value") - F.col("clean_value")).alias("delta"))
    )


def merge_blocks(clean: DataFrame, distorted: DataFrame, key: str = "implementation_id") -> DataFrame:
    """Clean block of one run with the distorted block of another; ``record_count`` is their sum per key."""
    both = clean.filter(F.col("condition") == "clean").unionByName(
        distorted.filter(F.col("condition") == "distorted")
    )
    return both.join(both.groupBy(key).agg(F.sum("case_count").alias("record_count")), key)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text per row with keys in order; NaN or infinity stops the job."""
    guarded = df
    for field in df.schema.fields:
        if field.dataType.typeName() in {"double", "float"}:
            value = F.col(field.name)
            bad = F.isnan(value) | (F.abs(value) == float("inf"))
            guarded = guarded.withColumn(
                field.name,
                F.when(bad, F.raise_error(F.lit(f"{field.name} is not finite"))).otherwise(value),
            )
    return guarded.select(F.to_json(F.struct(*sorted(df.columns))).alias("json"))


def write_report(df: DataFrame, path: str) -> None:
    report_json(df).write.mode("overwrite").text(path)


def write_combinations(df: DataFrame, path: str) -> DataFrame:
    """One folder per detector and grouper, replaced as a whole; returns the manifest."""
    df.write.mode("overwrite").partitionBy("detector", "grouper").json(path)
    return df.groupBy("detector", "grouper").agg(
        F.count(F.lit(1)).alias("cases"), F.lit("completed").alias("status")
    )


def pending_work(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(missing artifacts, one-row status): expected minus present."""
    missing = expected.join(done, list(keys), "left_anti")
    status = missing.agg(F.count(F.lit(1)).alias("missing_count")).withColumn(
        "status", F.when(F.col("missing_count") == 0, "complete").otherwise("incomplete")
    )
    return missing, status
