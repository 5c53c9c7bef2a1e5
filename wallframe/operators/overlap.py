"""Mask overlap: sparse IoU by tile joins, two-polygon IoU, suppression of near duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import geometry as geo
from ..functions.raster import common_area, with_filled
from ..store import until_empty
from .masks import tile_runs
from .passes import drop_weaker, ordered_pass
from .shapes import TILE

# Masks of one run; the run's number stands above these bits.
RUN_SHIFT = 40


def _bounds(runs: Column) -> dict[str, Column]:
    side = lambda name: F.transform(runs, lambda r: r[name])
    return {
        "top": F.array_min(side("y0")),
        "bottom": F.array_max(side("y1")),
        "left": F.array_min(side("x0")),
        "right": F.array_max(side("x1")),
    }


def _prepared(masks: DataFrame, group: list[str], index: str, mark: str, tile: int, carry: Sequence[str] = ()) -> DataFrame:
    """One row per mask and tile of its bounds: the runs cut at the tile's borders, and their bounds."""
    bounds = _bounds(F.col("runs"))
    cut = tile_runs(
        masks.select(
            *group,
            F.col(index).alias(f"{mark}_index"),
            "runs",
            F.col("area").alias(f"{mark}_area"),
            *[F.col(name).alias(f"{mark}_carry_{name}") for name in carry],
            *[value.alias(f"{mark}_{name}") for name, value in bounds.items()],
        ),
        *[f"{mark}_{name}" for name in bounds],
        tile,
    )
    ends = _bounds(F.col("runs"))
    near = {f"{mark}_{name}": ends[side] for name, side in (("y0", "top"), ("y1", "bottom"), ("x0", "left"), ("x1", "right"))}
    # Spark knows the size of the runs neither before nor after they are cut, so it must not broadcast them.
    return cut.withColumns(near).withColumnRenamed("runs", f"{mark}_runs").hint("merge")


def _length(low: str, high: str) -> Column:
    return F.least(f"p_{high}", f"a_{high}") - F.greatest(f"p_{low}", f"a_{low}") + 1


def _with_common(pairs: DataFrame) -> DataFrame:
    """Pairs of cut masks with ``_shared``, the pixels that both hold; only pairs that are not two rectangles go to the merge of runs."""
    # One condition on both sides stays above the join, so that both parts read the same shuffled masks.
    runs = F.size("p_runs") + F.size("a_runs")
    boxes = pairs.filter(runs == 2).withColumn("_shared", (_length("y0", "y1") * _length("x0", "x1")).cast("bigint"))
    others = pairs.filter(runs > 2).withColumn("_shared", arrow_udf(common_area, "bigint")(F.col("p_runs"), F.col("a_runs")))
    return boxes.drop("p_runs", "a_runs").unionByName(others.drop("p_runs", "a_runs"))


def span_iou(
    predictions: DataFrame,
    annotations: DataFrame,
    *,
    min_iou: float = 0.0,
    group: tuple[str, ...] = ("image_id",),
    tile: int = TILE,
    ordered_pairs: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Exact IoU of all mask pairs that overlap: group, pred_idx, ann_idx, iou and the columns ``carry`` of the prediction.

    Both inputs carry ``runs`` and ``area``.  Masks are cut at tile borders, joined on (group, tile)
    where their bounds meet, and the runs of a pair are merged in its tile, so an image of any size is
    spread over its tiles and no pair of runs is a row.  With ``min_iou`` pairs that cannot reach it are dropped inside the
    join: with intersection i <= area of the common bounding box, IoU >= t needs
    i * (1 + t) >= t * (a1 + a2).  ``ordered_pairs`` keeps only pred_idx < ann_idx.
    """
    keys = list(group)
    p = _prepared(predictions, keys, "hold_index", "p", tile, carry)
    a = _prepared(annotations, keys, "hold_index", "a", tile)
    meet = (_length("y0", "y1") > 0) & (_length("x0", "x1") > 0)
    if min_iou > 0:
        common = _length("top", "bottom").cast("double") * _length("left", "right")
        sizes = F.col("p_area") + F.col("a_area")
        # The slack keeps rounding from dropping a pair that sits exactly on the threshold.
        meet &= common * (1.0 + min_iou) >= min_iou * sizes - 1e-6
    if ordered_pairs:
        meet &= F.col("p_index") < F.col("a_index")
    union = F.col("p_area") + F.col("a_area") - F.col("_common")
    return (
        _with_common(p.join(a, [*keys, "ty", "tx"]).filter(meet))
        .groupBy(*keys, F.col("p_index").alias("pred_idx"), F.col("a_index").alias("ann_idx"))
        .agg(
            F.sum("_shared").alias("_common"),
            F.first("p_area").alias("p_area"),
            F.first("a_area").alias("a_area"),
            *[F.first(f"p_carry_{name}").alias(name) for name in carry],
        )
        .select(*keys, "pred_idx", "ann_idx", (F.col("_common") / union).alias("iou"), *carry)
        .filter((F.col("iou") > 0) & (F.col("iou") >= min_iou))
    )


def polygon_iou(pairs: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """IoU of two polygons of one row on an unbounded canvas, without any shuffle."""
    filled = with_filled(pairs, _a=F.col(first), _b=F.col(second))
    measured = filled.withColumn("_common", arrow_udf(common_area, "bigint")(F.col("_a"), F.col("_b")))
    union = geo.runs_area(F.col("_a")) + geo.runs_area(F.col("_b")) - F.col("_common")
    return measured.withColumn(
        "iou", F.when(union > 0, F.col("_common") / union).otherwise(F.lit(0.0))
    ).drop("_a", "_b", "_common")


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Predictions of several exemplar runs as one table.

    Runs number their masks from 0, so ``hold_index`` becomes unique by the run's number in its upper
    bits, which orders masks by run and then by index; the index within the run is ``run_index``.
    """
    merged = None
    for number, holds in enumerate(runs):
        index = F.col("hold_index").cast("bigint")
        part = holds.withColumn("exemplar_run", F.lit(number)).withColumn("run_index", index)
        part = part.withColumn("hold_index", index + F.lit(number << RUN_SHIFT))
        merged = part if merged is None else merged.unionByName(part)
    return merged


def nms(masks: DataFrame, threshold: float = 0.85, group: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Keep a mask if its IoU with every kept, more confident mask is below ``threshold``.

    Order: confidence descending, then ``hold_index``.  Images or components of bounded size take
    one pass over their edges.  In what is larger, a round keeps all masks that no undecided
    stronger neighbour can suppress and drops their weaker neighbours; the rounds end in the
    sequential result.
    """
    keys = list(group)
    close = span_iou(masks, masks, min_iou=threshold, group=group, ordered_pairs=True)
    rank = masks.select(*keys, "hold_index", "confidence")
    edges = (
        close.join(rank.withColumnsRenamed({"hold_index": "pred_idx", "confidence": "_cp"}), [*keys, "pred_idx"])
        .join(rank.withColumnsRenamed({"hold_index": "ann_idx", "confidence": "_ca"}), [*keys, "ann_idx"])
        .select(
            *keys,
            F.when(F.col("_cp") >= F.col("_ca"), F.col("pred_idx")).otherwise(F.col("ann_idx")).alias("strong"),
            F.when(F.col("_cp") >= F.col("_ca"), F.col("ann_idx")).otherwise(F.col("pred_idx")).alias("weak"),
            F.greatest("_cp", "_ca").alias("_confidence"),
        )
    )

    def decide(frontier: DataFrame) -> DataFrame:
        threatened = frontier.select(*keys, F.col("weak").alias("strong"))
        free = frontier.join(threatened, [*keys, "strong"], "left_anti")
        return free.select(*keys, F.col("weak").alias("hold_index")).distinct()

    def shrink(frontier: DataFrame, dropped: DataFrame) -> DataFrame:
        rest = frontier
        for end in ("strong", "weak"):
            rest = rest.join(dropped.withColumnRenamed("hold_index", end), [*keys, end], "left_anti")
        return rest

    order = [F.col("_confidence").desc(), F.col("strong"), F.col("weak")]
    drops, large = ordered_pass(edges, keys, "strong", "weak", order, drop_weaker, two_sided=False)
    suppressed = drops.select(*keys, F.col("weak").alias("hold_index")).distinct()
    more = None if large is None else until_empty(large, decide, shrink)
    suppressed = suppressed if more is None else suppressed.unionByName(more)
    return masks.join(suppressed, [*keys, "hold_index"], "left_anti")
