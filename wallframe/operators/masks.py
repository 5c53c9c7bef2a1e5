"""Masks as runs: every mask is an array of rectangles on its hold row, so no step here shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import geometry as geo
from ..functions.raster import column_counts, patch_shares, with_filled
from .shapes import TILE


def with_runs(holds: DataFrame, images: DataFrame | None = None, *, use_mask: bool = False) -> DataFrame:
    """Add ``runs`` and ``area``.

    With ``images`` the runs are clipped to the image.  With ``use_mask`` a stored ``mask_runs``
    wins over the polygon if ``mask_width`` x ``mask_height`` is the image size.
    """
    runs = F.col("_filled")
    if images is not None:
        holds = holds.join(images.select("image_id", "width", "height"), "image_id")
        runs = geo.clip_runs(runs, F.col("width"), F.col("height"))
        if use_mask:
            fits = (F.col("mask_width") == F.col("width")) & (F.col("mask_height") == F.col("height"))
            runs = F.when(F.col("mask_runs").isNotNull() & fits, F.col("mask_runs")).otherwise(runs)
    filled = with_filled(holds, _filled=F.col("polygon")).withColumn("runs", runs).drop("_filled")
    return filled.withColumn("area", geo.runs_area(F.col("runs")))


def clip_to_images(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Cut existing runs to their image and refresh the area."""
    sized = masks.join(images.select("image_id", "width", "height"), "image_id")
    cut = sized.withColumn("runs", geo.clip_runs(F.col("runs"), F.col("width"), F.col("height")))
    return cut.withColumn("area", geo.runs_area(F.col("runs")))


def with_fallback(masks: DataFrame) -> DataFrame:
    """An empty mask becomes its centroid pixel, clamped to the image."""
    center = geo.centroid(F.col("polygon"))
    x = F.greatest(F.lit(0), F.least(F.col("width") - 1, center["x"])).cast("int")
    y = F.greatest(F.lit(0), F.least(F.col("height") - 1, center["y"])).cast("int")
    pixel = F.array(F.struct(y.alias("y0"), y.alias("y1"), x.alias("x0"), x.alias("x1")))
    filled = masks.withColumn("runs", F.when(F.size("runs") == 0, pixel).otherwise(F.col("runs")))
    return filled.withColumn("area", geo.runs_area(F.col("runs")))


def spans(masks: DataFrame) -> DataFrame:
    """One row per pixel row and run: y, x0, x1."""
    return (
        masks.withColumn("_run", F.explode("runs"))
        .withColumn("y", F.explode(F.sequence(F.col("_run.y0"), F.col("_run.y1"))))
        .withColumns({"x0": F.col("_run.x0"), "x1": F.col("_run.x1")})
        .drop("_run", "runs")
    )


def tile_runs(masks: DataFrame, top: str, bottom: str, left: str, right: str, tile: int = TILE) -> DataFrame:
    """One row per mask and tile that it touches: ty, tx and the ``runs`` cut at the tile's borders.

    The four columns are the bounds of the mask.
    """
    cell = lambda v: F.floor(v / tile).cast("int")

    def cut(runs, low: str, high: str, at: str):
        first = F.col(at) * tile
        inside = F.filter(runs, lambda r: (r[high] >= first) & (r[low] < first + tile))
        ends = {low: lambda r: F.greatest(r[low], first), high: lambda r: F.least(r[high], first + tile - 1)}
        return F.transform(inside, lambda r: F.struct(*[ends.get(k, lambda r, k=k: r[k])(r).cast("int").alias(k) for k in ("y0", "y1", "x0", "x1")]))

    return (
        masks.withColumn("ty", F.explode(F.sequence(cell(F.col(top)), cell(F.col(bottom)))))
        .withColumn("runs", cut(F.col("runs"), "y0", "y1", "ty"))
        .withColumn("tx", F.explode(F.sequence(cell(F.col(left)), cell(F.col(right)))))
        .withColumn("runs", cut(F.col("runs"), "x0", "x1", "tx"))
        .filter(F.size("runs") > 0)
    )


def run_lengths(masks: DataFrame) -> DataFrame:
    """Column-major run lengths ``counts``, starting with the number of leading zeros."""
    return masks.withColumn("counts", arrow_udf(column_counts, "array<int>")(F.col("runs"), F.col("width"), F.col("height")))


def patch_coverage(masks: DataFrame, size: int = 1280, patch: int = 16) -> DataFrame:
    """Share of each ``patch`` cell covered after nearest-neighbour scaling to ``size`` x ``size``.

    Needs width and height; returns image_id, hold_index, patch_id, weight for touched cells.  The cells
    of a mask are counted on its row, so nothing is shuffled.
    """
    shares = arrow_udf(patch_shares(size, patch), "array<struct<patch_id:int,weight:double>>")
    cells = shares(F.col("runs"), F.col("width"), F.col("height"))
    return masks.select("image_id", "hold_index", F.inline(cells).alias("patch_id", "weight"))
