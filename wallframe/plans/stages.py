"""Runs over several arms in stages that a restart picks up.

Every stage (arm, stage, component) writes its rows to a folder of its own attempt and then appends a
completion row; only folders named by a completion row are ever read.  A run that stopped leaves at
most an unnamed folder, and the next one reads all finished stages as they are.  A stage that fails leaves
an error row, does not end the run, and is tried again by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import match_greedy
from ..operators.transfer import transfer_labels
from ..operators.validate import route_eligible
from ..registry import get_grouper, slug
from .detection import IOU_THRESHOLDS, evaluate_detections
from .reports import write_report
from .routes import evaluate_groupings

DONE = "arm string, stage string, component string, path string, rows bigint, status string, error string, at timestamp"
NAMES = ["arm", "stage", "component"]


class StagedRun:
    """The finished stages below ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.finished = {(r["arm"], r["stage"], r["component"]): r["path"] for r in self.log().filter("status = 'completed'").orderBy("at").collect()}

    def log(self) -> DataFrame:
        """All completion and error rows."""
        path = f"{self.root}/done"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], DONE)
        return self.spark.read.schema(DONE).parquet(path)

    def _append(self, key: tuple[str, str, str], path: str | None, rows: int | None, error: str | None) -> None:
        row = [(*key, path, rows, "completed" if error is None else "error", error)]
        named = self.spark.createDataFrame(row, "arm string, stage string, component string, path string, rows bigint, status string, error string")
        named.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/done")

    def stage(self, arm: str, stage: str, component: str, build: Callable[[], DataFrame]) -> DataFrame | None:
        """Stored rows of a stage, built only if it has not finished; None if it fails."""
        key = (arm, stage, component)
        if key not in self.finished:
            path = f"{self.root}/data/{arm}/{stage}/{component}/{uuid.uuid4().hex}"
            seen = Observation()
            try:
                build().observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
            except Exception as error:  # noqa: BLE001 - one bad component must not end the run
                self._append(key, None, None, f"{type(error).__name__}: {error}".splitlines()[0])
                return None
            self._append(key, path, int(seen.get["rows"]), None)
            self.finished[key] = path
        return self.spark.read.parquet(self.finished[key])

    def stages(self, expected: Sequence[tuple[str, str, str]]) -> DataFrame:
        """One row per expected stage: attempts, rows, status (completed, error or missing), error, path."""
        listed = self.spark.createDataFrame([tuple(e) for e in expected], "arm string, stage string, component string")
        last = F.max_by(F.struct("path", "rows", "status", "error"), F.struct(F.col("status") == "completed", F.col("at")))
        log = self.log().groupBy(*NAMES).agg(F.count(F.lit(1)).alias("attempts"), last.alias("last"))
        return listed.join(log, NAMES, "left").select(
            *NAMES,
            F.coalesce("attempts", F.lit(0)).cast("bigint").alias("attempts"),
            "last.rows",
            F.coalesce("last.status", F.lit("missing")).alias("status"),
            "last.error",
            "last.path",
        )

    def consolidate(self, expected: Sequence[tuple[str, str, str]]) -> DataFrame:
        """Manifest, one row per arm, written as JSON below ``root``: counts, missing and failed stages, status."""
        name = F.concat_ws("/", "stage", "component")
        where = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, name)))
        manifest = self.stages(expected).groupBy("arm").agg(
            F.count(F.lit(1)).alias("expected"),
            F.count_if(F.col("status") == "completed").alias("completed"),
            where("missing").alias("missing"),
            where("error").alias("failed"),
        )
        complete = F.col("expected") == F.col("completed")
        manifest = manifest.withColumn("status", F.when(complete, "complete").otherwise("incomplete"))
        write_report(manifest, f"{self.root}/manifest")
        return manifest


def expected_stages(arms: Sequence[str], detectors: Sequence[str], specs: Sequence[tuple[str, dict]]) -> list[tuple[str, str, str]]:
    """All stages of ``evaluate_arms``."""
    names = [slug(*spec) for spec in specs]
    out = [(condition, "detector", d) for condition in ("clean", *arms) for d in detectors]
    for arm in arms:
        out += [(arm, "report", d) for d in detectors]
        out += [(arm, "matrix", f"{d}__{name}") for d in detectors for name in names]
        out += [(arm, "routes", name) for name in names]
    return out


def evaluate_arms(
    run: StagedRun,
    images: DataFrame,
    predictions: DataFrame,
    annotations: DataFrame,
    iou: DataFrame,
    features: DataFrame,
    arms: Sequence[str],
    detectors: Sequence[str],
    specs: Sequence[tuple[str, dict]],
    threshold: float = 0.5,
    thresholds: Sequence[float] = IOU_THRESHOLDS,
) -> DataFrame:
    """Manifest of the evaluation of every arm next to the clean images.

    An arm is a value of ``images.condition``.  Detector stages relabel the predictions of one condition, so the
    clean ones are shared by all arms; then each arm has detection reports, one grouping evaluation per detector and
    grouper, and one per grouper on the annotated holds.  predictions: implementation_id, image_id, hold_index,
    pred_idx, confidence, confidence_source and labels.  iou: implementation_id, image_id, pred_idx, ann_idx, iou.
    annotations: image_id, hold_index, ann_idx, route_id.  features: image_id, hold_index and what groupers read.
    """
    keys = ["image_id", "hold_index"]

    def part(table: DataFrame, conditions: Sequence[str]) -> DataFrame:
        return table.join(images.filter(F.col("condition").isin(list(conditions))).select("image_id"), "image_id", "left_semi")

    def relabelled(condition: str, detector: str) -> DataFrame:
        chosen = lambda table: part(table.filter(F.col("implementation_id") == detector), [condition])
        matches = match_greedy(chosen(iou), threshold, ["implementation_id", "image_id"])
        return route_eligible(transfer_labels(chosen(predictions), matches, annotations)).select(*keys, "route_id")

    def grouped(arm: str, truth: DataFrame, spec: tuple[str, dict]) -> DataFrame:
        ready = part(features, ["clean", arm]).join(truth, keys)
        groups = get_grouper(spec[0])(ready, spec[1])
        return evaluate_groupings(images.filter(F.col("condition").isin(["clean", arm])), groups, truth)[0]

    for condition in ("clean", *arms):
        for d in detectors:
            run.stage(condition, "detector", d, lambda condition=condition, d=d: relabelled(condition, d))
    for arm in arms:
        both = images.filter(F.col("condition").isin(["clean", arm]))
        for d in detectors:
            chosen = lambda table, arm=arm, d=d: part(table.filter(F.col("implementation_id") == d), ["clean", arm])
            run.stage(arm, "report", d, lambda: evaluate_detections(both, chosen(predictions), part(annotations, ["clean", arm]), chosen(iou), [d], thresholds)[1])  # noqa: B023
        truths = {d: [run.finished.get((c, "detector", d)) for c in ("clean", arm)] for d in detectors}
        for spec in specs:
            name = slug(*spec)
            for d, paths in truths.items():
                # Without its detector stages a combination stays missing.
                if all(paths):
                    run.stage(arm, "matrix", f"{d}__{name}", lambda: grouped(arm, run.spark.read.parquet(*paths), spec))  # noqa: B023
            annotated = route_eligible(annotations).select(*keys, "route_id")
            run.stage(arm, "routes", name, lambda: grouped(arm, part(annotated, ["clean", arm]), spec))  # noqa: B023
    return run.consolidate(expected_stages(arms, detectors, specs))
