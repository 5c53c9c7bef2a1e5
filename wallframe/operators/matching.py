"""Greedy one-to-one matching.

Groups, or components of a large group, of bounded size take one pass over their sorted edges.
What is larger goes through rounds of mutually best edges: with a strict total order on edges, an
edge that is the best of both its ends is taken by the sequential pass; taking all such edges,
deleting what they touch and repeating gives the same matching.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import until_empty
from .passes import ordered_pass, take_free


def greedy(
    edges: DataFrame, group: Sequence[str], left: str, right: str, order: Sequence[Column], carry: Sequence[str] = ()
) -> DataFrame:
    """Matched edges (group, left, right, carry).  ``order``: larger tuples are taken first."""
    group = list(group)
    ranked = edges.select(
        *group,
        left,
        right,
        F.struct(
            *[c.alias(f"k{n}") for n, c in enumerate(order)],
            F.col(left).alias("left"),
            F.col(right).alias("right"),
            *carry,
        ).alias("edge"),
    )

    def decide(frontier: DataFrame) -> DataFrame:
        of_left = frontier.groupBy(*group, left).agg(F.max("edge").alias("edge"))
        of_right = frontier.groupBy(*group, right).agg(F.max("edge").alias("edge"))
        both = of_left.select(*group, left, F.col("edge.right").alias(right), "edge").join(
            of_right.select(*group, F.col("edge.left").alias(left), right), [*group, left, right]
        )
        return both.select(*group, left, right, *[F.col(f"edge.{c}").alias(c) for c in carry])

    def shrink(frontier: DataFrame, matched: DataFrame) -> DataFrame:
        rest = frontier.join(matched.select(*group, left), [*group, left], "left_anti")
        return rest.join(matched.select(*group, right), [*group, right], "left_anti")

    taken, large = ordered_pass(ranked, group, left, right, [F.col("edge").desc()], take_free, two_sided=True)
    matched = taken.select(*group, left, right, *[F.col(f"edge.{c}").alias(c) for c in carry])
    more = None if large is None else until_empty(large, decide, shrink)
    return matched if more is None else matched.unionByName(more)


def match_greedy(iou: DataFrame, threshold: float = 0.5, group: Sequence[str] = ("image_id",)) -> DataFrame:
    """One-to-one prediction/annotation matches by descending (iou, pred_idx, ann_idx)."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    order = [F.col("iou"), F.col("pred_idx"), F.col("ann_idx")]
    return greedy(iou.filter(F.col("iou") >= threshold), group, "pred_idx", "ann_idx", order, ["iou"])


def assign_by_confidence(
    iou: DataFrame, thresholds: Sequence[float], group: Sequence[str] = ("image_id",), carry: Sequence[str] = ()
) -> DataFrame:
    """True-positive assignments for every IoU threshold at once.

    Detections of an image are served by descending confidence, then ``pred_idx``; each takes its
    best free annotation by (iou, ann_idx).  ``iou`` carries the prediction's ``confidence``; columns
    ``carry`` of it come back.
    """
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    edges = iou.withColumn(
        "threshold", F.explode(F.filter(levels, lambda t: (F.col("iou") >= t) & (F.col("iou") > 0)))
    )
    order = [F.col("confidence"), -F.col("pred_idx"), F.col("iou"), F.col("ann_idx")]
    return greedy(edges, [*group, "threshold"], "pred_idx", "ann_idx", order, ["iou", *carry])
