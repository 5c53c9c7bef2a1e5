"""Detection evaluation: counts, average precision, case and condition reports.

All detectors and conditions are evaluated in one plan; ``implementation_id`` and ``condition``
are ordinary key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.matching import assign_by_confidence
from ..skew import ranked, row_numbers, suffix_max
from ..store import materialize

# The IoU levels of the AP sweep.
IOU_THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
TARGET = ["implementation_id", "condition"]
# Ranks of one chunk of a precision curve.
CHUNK_RANKS = 1 << 16


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(precision * 2.0 * recall, precision + recall)


def reported_condition(condition: Column) -> Column:
    """Reports call every condition other than clean ``distorted``."""
    return F.when(condition == "clean", "clean").otherwise("distorted")


def detection_metrics(
    predictions: DataFrame, annotations: DataFrame, matches: DataFrame, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """Counts, precision, recall, F1 and mean matched IoU per ``keys``."""
    keys = list(keys)
    zero = F.lit(0).cast("bigint")
    tally = (
        predictions.select(*keys, F.lit(1).alias("p"), zero.alias("a"), zero.alias("m"), F.lit(0.0).alias("iou"))
        .unionByName(annotations.select(*keys, zero.alias("p"), F.lit(1).alias("a"), zero.alias("m"), F.lit(0.0).alias("iou")))
        .unionByName(matches.select(*keys, zero.alias("p"), zero.alias("a"), F.lit(1).alias("m"), "iou"))
        .groupBy(*keys)
        .agg(F.sum("p").alias("p"), F.sum("a").alias("a"), F.sum("m").alias("m"), F.sum("iou").alias("iou"))
    )
    counted = tally.withColumns(
        {"precision": ratio(F.col("m"), F.col("p")), "recall": ratio(F.col("m"), F.col("a"))}
    )
    return counted.select(
        *keys,
        F.col("m").alias("true_positives"),
        (F.col("p") - F.col("m")).alias("false_positives"),
        (F.col("a") - F.col("m")).alias("false_negatives"),
        "precision",
        "recall",
        f1(F.col("precision"), F.col("recall")).alias("f1"),
        ratio(F.col("iou"), F.col("m")).alias("mean_matched_iou"),
    )


def detection_ranks(predictions: DataFrame, group: Sequence[str] = TARGET) -> DataFrame:
    """Pooled rank of every detection by (confidence desc, case, pred_idx): ``rank``.

    Cases stand in order of ``case_index``, if there is such a column, and then of image_id.
    """
    case = [F.col("case_index")] if "case_index" in predictions.columns else []
    order = [F.col("confidence").desc(), *case, F.col("image_id"), F.col("pred_idx")]
    return ranked(predictions, group, order, "rank")


def precision_recall(
    predictions: DataFrame,
    annotations: DataFrame,
    iou: DataFrame,
    thresholds: Sequence[float] = IOU_THRESHOLDS,
    group: Sequence[str] = TARGET,
) -> DataFrame:
    """Every true positive with its running count ``tp``, pooled ``rank``, precision and envelope.

    Precision only falls between true positives, so these rows carry the whole curve.
    """
    group = list(group)
    case = [c for c in ("case_index",) if c in predictions.columns]
    detection = [*group, "image_id", "pred_idx"]
    ranks = detection_ranks(predictions.select(*detection, "confidence", *case), group)
    edges = iou.select(*detection, "ann_idx", "iou").join(ranks.select(*detection, "confidence", "rank"), detection)
    hits = assign_by_confidence(edges, thresholds, [*group, "image_id"], ["rank"])
    curve = [*group, "threshold"]
    order = [F.col("rank")]
    # Ranks are dense, so equal parts of them bound the chunks without another sort.
    chunk = F.floor(F.col("rank") / CHUNK_RANKS)
    chunks, _ = materialize(hits.select(*curve, "rank", chunk.alias("_chunk")))
    counted = row_numbers(chunks, curve, order, "tp").withColumn("precision", F.col("tp") / F.col("rank"))
    return suffix_max(counted, curve, order, F.col("precision"), "envelope").drop("_chunk")


def average_precision(
    predictions: DataFrame,
    annotations: DataFrame,
    iou: DataFrame,
    thresholds: Sequence[float] = IOU_THRESHOLDS,
    group: Sequence[str] = TARGET,
    expected: DataFrame | None = None,
) -> DataFrame:
    """AP per group and threshold, 0 where nothing was found.

    ``expected`` lists the groups to report, by default those that have predictions.

    predictions: group, image_id, pred_idx, confidence and, where equal confidences follow the given
    order of the cases, case_index.  annotations: condition, image_id, ann_idx.
    iou: group, image_id, pred_idx, ann_idx, iou.  Images without truths do not take part.
    """
    group = list(group)
    shared = [c for c in group if c in annotations.columns]
    usable = predictions.join(annotations.select(*shared, "image_id").distinct(), [*shared, "image_id"], "left_semi")
    truths = annotations.groupBy(*shared).agg(F.count(F.lit(1)).alias("truths"))
    curve = precision_recall(usable, annotations, iou, thresholds, group)
    area = curve.groupBy(*group, "threshold").agg(F.sum("envelope").alias("area"))
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    expected = (predictions if expected is None else expected).select(*group).distinct().select(*group, levels)
    return (
        expected.join(area, [*group, "threshold"], "left")
        .join(truths, shared, "left")
        .select(*group, "threshold", F.coalesce(F.col("area") / F.col("truths"), F.lit(0.0)).alias("ap"))
    )


def map_report(ap: DataFrame, group: Sequence[str] = TARGET) -> DataFrame:
    """mAP, AP50 and AP75 per group."""
    at = lambda t: F.coalesce(F.max(F.when(F.col("threshold") == t, F.col("ap"))), F.lit(0.0))
    return ap.groupBy(*group).agg(F.avg("ap").alias("mAP"), at(0.5).alias("AP50"), at(0.75).alias("AP75"))


def case_status(truth_count: Column, error: Column | None = None) -> Column:
    status = F.when(truth_count > 0, "evaluated").otherwise("unevaluable")
    return status if error is None else F.when(error.isNotNull(), "error").otherwise(status)


def each(values: Sequence[str]) -> Column:
    """One row per configured name."""
    return F.explode(F.array(*[F.lit(v) for v in values]))


def detection_cases(
    images: DataFrame,
    predictions: DataFrame,
    annotations: DataFrame,
    detectors: Sequence[str],
    rejected: DataFrame | None = None,
) -> DataFrame:
    """One row per detector and image with counts, confidence origins, status and error.

    ``rejected`` holds rows a validator refused (implementation_id, image_id, reason): their case is an
    error, named after the first reason.
    """
    per_image = predictions.groupBy("implementation_id", "image_id").agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.count_if(F.col("confidence_source") == "attribute").alias("confidence_attribute_count"),
        F.count_if(F.col("confidence_source") == "fallback").alias("confidence_fallback_count"),
    )
    truths = annotations.groupBy("image_id").agg(F.count(F.lit(1)).alias("ground_truth_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    cases = (
        images.withColumn("implementation_id", each(detectors))
        .join(per_image, ["implementation_id", "image_id"], "left")
        .join(truths, "image_id", "left")
    )
    if rejected is None:
        cases = cases.withColumn("error", F.lit(None).cast("string"))
    else:
        errors = rejected.groupBy("implementation_id", "image_id").agg(F.min("reason").alias("error"))
        cases = cases.join(errors, ["implementation_id", "image_id"], "left")
    return cases.select(
        "implementation_id",
        reported_condition(F.col("condition")).alias("condition"),
        F.col("image_id").alias("case_id"),
        "image_id",
        F.coalesce("source_id", "image_id").alias("source_id"),
        "split",
        "parent_image_id",
        case_status(F.coalesce(F.col("ground_truth_count"), F.lit(0)), F.col("error")).alias("status"),
        "error",
        zero("prediction_count"),
        zero("ground_truth_count"),
        zero("confidence_attribute_count"),
        zero("confidence_fallback_count"),
    )


def status_counts() -> list[Column]:
    return [
        F.count("status").alias("case_count"),
        *[
            F.count_if(F.col("status") == name).alias(f"{name}_case_count")
            for name in ("evaluated", "unevaluable", "error")
        ],
    ]


def evaluate_detections(
    images: DataFrame,
    predictions: DataFrame,
    annotations: DataFrame,
    iou: DataFrame,
    detectors: Sequence[str],
    thresholds: Sequence[float] = IOU_THRESHOLDS,
    rejected: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(cases, aggregates) of all detectors.

    ``rejected`` (implementation_id, image_id, reason) makes cases errors; neither their predictions nor their
    truths count for that detector.

    images: image_id, condition, split, source_id, parent_image_id and, if given, case_index.  predictions: implementation_id,
    image_id, pred_idx, confidence, confidence_source.  annotations: image_id, ann_idx, volumes
    removed.  iou: implementation_id, image_id, pred_idx, ann_idx, iou.
    """
    labelled = images.select("image_id", reported_condition(F.col("condition")).alias("condition"))
    cases = detection_cases(images, predictions, annotations, detectors, rejected)
    truths = annotations.join(labelled, "image_id")
    if rejected is not None:
        case = ["implementation_id", "image_id"]
        broken = rejected.select(*case).distinct()
        predictions, iou = predictions.join(broken, case, "left_anti"), iou.join(broken, case, "left_anti")
        truths = truths.withColumn("implementation_id", each(detectors)).join(broken, case, "left_anti")
    case = [c for c in ("case_index",) if c in images.columns]
    ap = average_precision(
        predictions.drop(*case).join(images.select("image_id", reported_condition(F.col("condition")).alias("condition"), *case), "image_id"),
        truths,
        iou.join(labelled, "image_id"),
        thresholds,
        # A detector without predictions has AP 0 in every condition that has truths.
        expected=truths.select("condition").distinct().withColumn("implementation_id", each(detectors)),
    )
    per_level = ap.groupBy(*TARGET).agg(
        *[
            F.max(F.when(F.col("threshold") == t, F.col("ap"))).alias(f"AP{t:.2f}".replace(".", "_"))
            for t in thresholds
        ]
    )
    counted = cases.groupBy(*TARGET).agg(
        *status_counts(),
        F.sum(F.when(F.col("status") == "evaluated", F.col("ground_truth_count"))).alias("ground_truth_count"),
        F.sum(F.when(F.col("status") == "evaluated", F.col("prediction_count"))).alias("prediction_count"),
    )
    blocks = images.sparkSession.range(1).select(each(detectors).alias("implementation_id"))
    blocks = blocks.withColumn("condition", each(("clean", "distorted")))
    merged = blocks.join(counted, TARGET, "left").join(map_report(ap), TARGET, "left").join(per_level, TARGET, "left")
    return cases, merged.fillna(
        0, ["case_count", "evaluated_case_count", "unevaluable_case_count", "error_case_count"]
    ).fillna(0.0, ["mAP"])
