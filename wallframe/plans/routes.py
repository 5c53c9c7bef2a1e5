"""Grouping evaluation: contingency, clustering metrics, route matching, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.matching import greedy
from .detection import case_status, each, f1, ratio, reported_condition, status_counts

CASE = ["image_id"]
METRICS = (
    "hold_count",
    "predicted_route_count",
    "ground_truth_route_count",
    "pairwise_precision",
    "pairwise_recall",
    "pairwise_f1",
    "purity",
    "adjusted_rand_index",
    "normalized_mutual_information",
)


def contingency(predicted: DataFrame, truth: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    """keys, predicted, truth, n over holds labelled on both sides.

    Both inputs: keys (or those of them they have), hold_index, route_id.
    """
    shared = [c for c in keys if c in truth.columns]
    return (
        predicted.select(*keys, "hold_index", F.col("route_id").alias("predicted"))
        .join(truth.select(*shared, "hold_index", F.col("route_id").alias("truth")), [*shared, "hold_index"])
        .filter(F.col("predicted").isNotNull() & F.col("truth").isNotNull())
        .groupBy(*keys, "predicted", "truth")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2.0


def _margin(cells: DataFrame, keys: Sequence[str], side: str, mark: str) -> DataFrame:
    """Per case: pair count, entropy terms and size of one margin."""
    size = F.col("size")
    return (
        cells.groupBy(*keys, side)
        .agg(F.sum("n").alias("size"), F.max("n").alias("largest"))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias(f"{mark}_groups"),
            F.sum(choose2(size)).alias(f"{mark}_pairs"),
            F.sum(size * F.ln(size.cast("double"))).alias(f"{mark}_log"),
            F.sum("largest").alias(f"{mark}_largest"),
        )
    )


def clustering_metrics(cells: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    """Pairwise precision, recall and F1, purity, adjusted Rand index and NMI per case.

    All of them follow from sums over the cells and the two margins, so the plan is three
    aggregations and two joins of one row per case.
    """
    keys = list(keys)
    n = F.col("n")
    joint = cells.groupBy(*keys).agg(
        F.sum(n).alias("hold_count"),
        F.sum(choose2(n)).alias("same"),
        F.sum(n * F.ln(n.cast("double"))).alias("joint_log"),
    )
    table = joint.join(_margin(cells, keys, "predicted", "p"), keys).join(_margin(cells, keys, "truth", "t"), keys)
    total = F.col("hold_count").cast("double")
    p, t, same = F.col("p_pairs"), F.col("t_pairs"), F.col("same")

    def share(pairs: Column, other: Column) -> Column:
        return F.when(pairs > 0, same / pairs).when(other > 0, F.lit(0.0)).otherwise(F.lit(1.0))

    expected = F.when(choose2(total) > 0, p * t / choose2(total)).otherwise(F.lit(0.0))
    maximum = (p + t) / 2.0
    table = table.withColumns(
        {
            "pairwise_precision": share(p, t),
            "pairwise_recall": share(t, p),
            "purity": F.col("p_largest") / total,
            "adjusted_rand_index": F.when(
                maximum != expected, (same - expected) / (maximum - expected)
            ).otherwise(F.lit(1.0)),
            # One group has entropy 0; testing the group count avoids a rounding residue.
            "_hp": F.when(F.col("p_groups") == 1, F.lit(0.0)).otherwise(F.ln(total) - F.col("p_log") / total),
            "_ht": F.when(F.col("t_groups") == 1, F.lit(0.0)).otherwise(F.ln(total) - F.col("t_log") / total),
        }
    )
    shared = F.ln(total) + (F.col("joint_log") - F.col("p_log") - F.col("t_log")) / total
    nmi = F.when((F.col("_hp") > 0) & (F.col("_ht") > 0), shared / F.sqrt(F.col("_hp") * F.col("_ht"))).otherwise(
        F.when(F.col("_hp") == F.col("_ht"), F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return table.select(
        *keys,
        "hold_count",
        F.col("p_groups").alias("predicted_route_count"),
        F.col("t_groups").alias("ground_truth_route_count"),
        "pairwise_precision",
        "pairwise_recall",
        f1(F.col("pairwise_precision"), F.col("pairwise_recall")).alias("pairwise_f1"),
        "purity",
        "adjusted_rand_index",
        nmi.alias("normalized_mutual_information"),
    )


def route_candidates(predicted: DataFrame, truth: DataFrame, matches: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Dice score of every predicted/annotated route pair sharing matched holds.

    predicted: group, image_id, hold_index (the prediction's), route_id; matches: group, image_id,
    pred_idx, ann_idx; truth: image_id, hold_index, route_id.  ``group`` names what numbers its own
    predictions, such as a detector.
    """
    unit = [*group, "image_id"]
    mapped = predicted.withColumnsRenamed({"hold_index": "pred_idx", "route_id": "pred_route"}).join(
        matches.select(*unit, "pred_idx", "ann_idx"), [*unit, "pred_idx"]
    )
    sizes_p = mapped.groupBy(*unit, "pred_route").agg(F.count(F.lit(1)).alias("p"))
    sizes_t = truth.groupBy("image_id", F.col("route_id").alias("ann_route")).agg(F.count(F.lit(1)).alias("a"))
    shared = (
        mapped.join(truth.withColumnsRenamed({"hold_index": "ann_idx", "route_id": "ann_route"}), ["image_id", "ann_idx"])
        .groupBy(*unit, "pred_route", "ann_route")
        .agg(F.count(F.lit(1)).alias("both"))
    )
    return (
        shared.join(sizes_p, [*unit, "pred_route"])
        .join(sizes_t, ["image_id", "ann_route"])
        .select(*unit, "pred_route", "ann_route", (F.col("both") * 2.0 / (F.col("p") + F.col("a"))).alias("dice"))
    )


def route_match_metrics(
    images: DataFrame, predicted: DataFrame, truth: DataFrame, matches: DataFrame, groups: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Greedy one-to-one route matching by Dice, with precision, recall, F1 and mean Dice.

    One row per image and value of every key of ``groups`` (such as the configured detectors).
    """
    groups = groups or {}
    unit = [*groups, "image_id"]
    order = [F.col("dice"), F.col("pred_route"), F.col("ann_route")]
    taken = greedy(route_candidates(predicted, truth, matches, list(groups)), unit, "pred_route", "ann_route", order, ["dice"])
    count = lambda df, keys, name: df.groupBy(*keys).agg(F.count_distinct("route_id").alias(name))
    scored = taken.groupBy(*unit).agg(F.count(F.lit(1)).alias("matched_routes"), F.avg("dice").alias("mean"))
    cases = images.select("image_id")
    for name, values in groups.items():
        cases = cases.withColumn(name, each(values))
    table = (
        cases.join(count(predicted, unit, "predicted_routes"), unit, "left")
        .join(count(truth, ["image_id"], "annotated_routes"), "image_id", "left")
        .join(scored, unit, "left")
        .fillna(0)
    )
    table = table.withColumns(
        {
            "precision": ratio(F.col("matched_routes"), F.col("predicted_routes")),
            "recall": ratio(F.col("matched_routes"), F.col("annotated_routes")),
        }
    )
    return table.select(
        *unit,
        "matched_routes",
        "predicted_routes",
        "annotated_routes",
        "precision",
        "recall",
        f1(F.col("precision"), F.col("recall")).alias("f1"),
        F.coalesce("mean", F.lit(0.0)).alias("mean_matched_route_f1"),
    )


def route_cases(
    images: DataFrame, truth: DataFrame, metrics: DataFrame, extra: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """One case per image and value of every ``extra`` key; metrics stay null where no truth exists."""
    extra = extra or {}
    keys = [*[c for c in extra if c in truth.columns], "image_id"]
    holds = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("_truths"))
    cases = images
    for name, values in extra.items():
        cases = cases.withColumn(name, each(values))
    return cases.join(holds, keys, "left").join(metrics, [*extra, "image_id"], "left").select(
        *extra,
        reported_condition(F.col("condition")).alias("condition"),
        F.col("image_id").alias("case_id"),
        "image_id",
        F.coalesce("source_id", "image_id").alias("source_id"),
        "split",
        "parent_image_id",
        case_status(F.coalesce(F.col("_truths"), F.lit(0))).alias("status"),
        *METRICS,
    )


def condition_aggregates(cases: DataFrame, extra: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Macro means over evaluated cases and status counts; both conditions always get a row."""
    extra = extra or {}
    means = [F.avg(F.when(F.col("status") == "evaluated", F.col(m))).alias(m) for m in METRICS]
    counted = cases.groupBy(*extra, "condition").agg(*status_counts(), *means)
    blocks = cases.sparkSession.range(1).select(each(("clean", "distorted")).alias("condition"))
    for name, values in extra.items():
        blocks = blocks.withColumn(name, each(values))
    return blocks.join(counted, [*extra, "condition"], "left").fillna(
        0, ["case_count", "evaluated_case_count", "unevaluable_case_count", "error_case_count"]
    )


def evaluate_groupings(
    images: DataFrame, predicted: DataFrame, truth: DataFrame, extra: dict[str, Sequence[str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(cases, aggregates) of one or many groupings against annotated routes."""
    keys = [*(extra or {}), "image_id"]
    cells = contingency(predicted, truth, keys)
    cases = route_cases(images, truth, clustering_metrics(cells, keys), extra)
    return cases, condition_aggregates(cases, extra)


def result_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("hold_count"), F.count_distinct("route_id").alias("route_count")
    )


def pair_metrics(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Loss, accuracy and F1 of pair logits.  ``scored``: keys, logit, label (0/1)."""
    z, y = F.col("logit"), F.col("label")
    positive = z >= 0
    # log(1 + e^-|z|) + max(z, 0) - z*y: the overflow-safe form of binary cross entropy.
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    hits = scored.groupBy(*keys).agg(
        F.avg(loss).alias("loss"),
        F.avg((positive == (y == 1)).cast("double")).alias("accuracy"),
        F.count_if(positive & (y == 1)).alias("tp"),
        F.count_if(positive & (y == 0)).alias("fp"),
        F.count_if(~positive & (y == 1)).alias("fn"),
    )
    return hits.select(
        *keys,
        "loss",
        "accuracy",
        ratio(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"),
    )
