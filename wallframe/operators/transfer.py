"""Joins that carry labels and groups between predictions, annotations and source holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transfer_labels(predictions: DataFrame, matches: DataFrame, annotations: DataFrame) -> DataFrame:
    """Matched predictions inherit the annotation's integer ``route_id``; others keep their own.

    predictions: image_id, hold_index[, route_id]; matches: image_id, pred_idx, ann_idx;
    annotations: image_id, hold_index, route_id.
    """
    keys = [c for c in ("implementation_id",) if c in predictions.columns and c in matches.columns]
    links = matches.select(*keys, "image_id", F.col("pred_idx").alias("hold_index"), "ann_idx")
    truth = annotations.select(
        "image_id", F.col("hold_index").alias("ann_idx"), F.col("route_id").alias("_route")
    )
    found = links.join(truth, ["image_id", "ann_idx"], "left").drop("ann_idx")
    joined = predictions.join(found, [*keys, "image_id", "hold_index"], "left")
    own = F.col("route_id") if "route_id" in predictions.columns else F.lit(None).cast("bigint")
    return joined.withColumn("route_id", F.coalesce(F.col("_route"), own)).drop("_route")


def map_back(groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Grouped output mapped to source holds by polygon.

    groups: image_id, route_id, polygon.  sources: image_id, hold_index, polygon.  A polygon stands
    for its last source hold, each hold is used once (lowest route first), unknown polygons and
    routes left without members vanish.
    """
    known = sources.groupBy("image_id", "polygon").agg(F.max("hold_index").alias("hold_index"))
    return (
        groups.join(known, ["image_id", "polygon"])
        .groupBy("image_id", "hold_index")
        .agg(F.min("route_id").alias("route_id"))
    )
