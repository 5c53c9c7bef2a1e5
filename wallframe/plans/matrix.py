"""Detector x grouper evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import match_greedy
from ..operators.transfer import transfer_labels
from ..operators.validate import route_eligible
from ..registry import get_grouper, run_groupers, slug
from ..store import materialize
from .detection import each
from .routes import clustering_metrics, condition_aggregates, contingency, route_cases


def components(detectors: Sequence[str], groupers: Sequence[str], spark) -> DataFrame:
    """Every configured combination with both conditions; the lists are run configuration."""
    base = spark.range(1).select(each(detectors).alias("detector"))
    return base.withColumn("grouper", each(groupers)).withColumn("condition", each(("clean", "distorted")))


def two_stage(holds: DataFrame, features: DataFrame, grouper: str, config: dict) -> DataFrame:
    """Detect, then group: the detected holds' features go to one grouper."""
    chosen = features.join(holds.select("image_id", "hold_index"), ["image_id", "hold_index"], "left_semi")
    return get_grouper(grouper)(chosen, config)


def evaluation_matrix(
    images: DataFrame,
    predictions: DataFrame,
    annotations: DataFrame,
    iou: DataFrame,
    features: DataFrame,
    detectors: Sequence[str],
    specs: Sequence[tuple[str, dict]],
    threshold: float = 0.5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, aggregates, errors) over all detectors and groupers.

    Predictions inherit the route of the annotation they match at ``threshold``; those with a route
    are grouped.  Detector and image form one unit key, so every grouper runs once for all detectors.
    predictions: implementation_id, image_id, hold_index, hold_type.  iou: implementation_id, image_id,
    pred_idx, ann_idx, iou.  features: image_id, hold_index, embedding, lab, rgb, and implementation_id
    where detectors share hold indices (refused without it).  A grouper that fails leaves its cases as ``error``.
    """
    matches = match_greedy(iou, threshold, ["implementation_id", "image_id"])
    labelled = route_eligible(transfer_labels(predictions, matches, annotations))
    unit = F.concat_ws("|", "implementation_id", F.col("image_id").cast("string"))
    truth, _ = materialize(
        labelled.select(unit.alias("unit"), "implementation_id", "image_id", "hold_index", "route_id")
    )
    if "implementation_id" not in features.columns:
        shared = truth.groupBy("image_id", "hold_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not shared.isEmpty():
            raise ValueError("detectors share hold indices: features need implementation_id")
    ready, _ = materialize(
        features.join(truth, [k for k in ("implementation_id", "image_id", "hold_index") if k in features.columns])
        .drop("image_id", "implementation_id")
        .withColumnRenamed("unit", "image_id")
    )
    groups, errors = run_groupers(ready, specs)
    names = [slug(n, {k: v for k, v in c.items() if k != "weights"}) for n, c in specs]
    truth_units = truth.select(F.col("unit").alias("image_id"), "hold_index", "route_id")
    cells, _ = materialize(contingency(groups, truth_units, ["grouper", "image_id"]))
    metrics = (
        clustering_metrics(cells, ["grouper", "image_id"])
        .withColumn("_split", F.split("image_id", r"\|", 2))
        .withColumns({"detector": F.col("_split")[0], "image_id": F.col("_split")[1]})
        .drop("_split")
    )
    text_images = images.withColumn("image_id", F.col("image_id").cast("string"))
    per_detector = truth.select(
        F.col("implementation_id").alias("detector"), F.col("image_id").cast("string").alias("image_id")
    )
    extra = {"detector": list(detectors), "grouper": names}
    cases = route_cases(text_images, per_detector, metrics, extra)
    failed = errors.select(F.col("slug").alias("grouper"), F.lit(True).alias("_failed")).distinct()
    cases = cases.join(failed, "grouper", "left").withColumn("status", F.when(F.col("_failed"), "error").otherwise(F.col("status"))).drop("_failed")
    return cases, condition_aggregates(cases, extra), errors
