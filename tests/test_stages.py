"""Staged runs, error cases and keys of the matrix."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wallframe.plans import detection, matrix
from wallframe.plans.stages import StagedRun


def files_of(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_finished_stages_are_read_again(spark, tmp_path):
    root, built = str(tmp_path / "run"), []

    def build(name, fails=False):
        built.append(name)
        return spark.range(3).select(F.raise_error(F.lit("broken")).alias("id") if fails else F.col("id"))

    expected = [("dark", "detector", "a"), ("dark", "matrix", "b"), ("bright", "matrix", "b")]
    run = StagedRun(spark, root)
    assert run.stage("dark", "detector", "a", lambda: build("a")).count() == 3
    assert run.stage("dark", "matrix", "b", lambda: build("b", fails=True)) is None
    manifest = {r.arm: r for r in run.consolidate(expected).collect()}
    assert (manifest["dark"].status, manifest["dark"].completed, manifest["dark"].failed) == ("incomplete", 1, ["matrix/b"])
    assert (manifest["bright"].status, manifest["bright"].missing) == ("incomplete", ["matrix/b"])

    # A folder without a completion row, as a stopped run leaves it, is never read.
    spark.range(9).write.parquet(f"{root}/data/bright/matrix/b/half")
    before = files_of(tmp_path / "run" / "data" / "dark" / "detector")
    again = StagedRun(spark, root)
    assert again.stage("dark", "detector", "a", lambda: build("a")).count() == 3
    assert again.stage("dark", "matrix", "b", lambda: build("b")).count() == 3
    assert again.stage("bright", "matrix", "b", lambda: build("c")).count() == 3
    assert built == ["a", "b", "b", "c"] and files_of(tmp_path / "run" / "data" / "dark" / "detector") == before
    stages = {(r.arm, r.stage): (r.attempts, r.rows, r.status, r.error) for r in again.stages(expected).collect()}
    assert stages == {("dark", "detector"): (1, 3, "completed", None), ("dark", "matrix"): (2, 3, "completed", None), ("bright", "matrix"): (1, 3, "completed", None)}
    assert {r.status for r in again.consolidate(expected).collect()} == {"complete"}
    assert spark.read.text(f"{root}/manifest").count() == 2


def test_errors_leave_the_averages(spark):
    """An image whose prediction was rejected is an error for that detector and counts for nothing in its AP."""
    images = spark.createDataFrame([(k, "clean", "test", k, None) for k in (1, 2)], "image_id int, condition string, split string, source_id int, parent_image_id int")
    preds = [("d", 1, 0, 0.9), ("d", 2, 0, 0.8), ("e", 1, 0, 0.9), ("e", 2, 0, 0.8)]
    predictions = spark.createDataFrame(preds, "implementation_id string, image_id int, pred_idx int, confidence double").withColumn("confidence_source", F.lit("attribute"))
    truths = spark.createDataFrame([(1, 0), (2, 0)], "image_id int, ann_idx int")
    iou = spark.createDataFrame([("d", 1, 0, 0, 0.9), ("e", 1, 0, 0, 0.9)], "implementation_id string, image_id int, pred_idx int, ann_idx int, iou double")
    rejected = spark.createDataFrame([("d", 2, "polygon")], "implementation_id string, image_id int, reason string")
    cases, totals = detection.evaluate_detections(images, predictions, truths, iou, ["d", "e"], (0.5,), rejected)
    assert {(r.implementation_id, r.image_id): (r.status, r.error) for r in cases.collect()} == {
        ("d", 1): ("evaluated", None), ("d", 2): ("error", "polygon"), ("e", 1): ("evaluated", None), ("e", 2): ("evaluated", None),
    }
    found = {r.implementation_id: (r.error_case_count, r.ground_truth_count, r.mAP) for r in totals.filter("condition = 'clean'").collect()}
    assert found == {"d": (1, 1, 1.0), "e": (0, 2, 0.5)}


def test_matrix_refuses_features_without_a_detector(spark):
    images = spark.createDataFrame([(1, "clean", "test", 1, None)], "image_id int, condition string, split string, source_id int, parent_image_id int")
    held = spark.createDataFrame([(d, 1, 0, 5) for d in ("d", "e")], "implementation_id string, image_id int, hold_index int, route_id int").withColumn("hold_type", F.lit(None).cast("string"))
    truths = spark.createDataFrame([(1, 0, 5)], "image_id int, hold_index int, route_id int")
    iou = spark.createDataFrame([], "implementation_id string, image_id int, pred_idx int, ann_idx int, iou double")
    features = spark.createDataFrame([(1, 0, [1.0, 0.0])], "image_id int, hold_index int, embedding array<double>")
    with pytest.raises(ValueError, match="implementation_id"):
        matrix.evaluation_matrix(images, held, truths, iou, features, ["d", "e"], [("annotated", {})])
