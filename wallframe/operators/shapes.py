"""Geometry columns on holds, boxes and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..skew import salted_join
from .validate import _split, finite

TILE = 64


def with_centroid(holds: DataFrame) -> DataFrame:
    return holds.withColumn("centroid", geo.centroid(F.col("polygon")))


def with_bbox(holds: DataFrame) -> DataFrame:
    return holds.withColumn("bbox", geo.bbox(F.col("polygon")))


def _span(size: str):
    return F.greatest(F.col(size) - 1, F.lit(1))


def to_normalized(holds: DataFrame, images: DataFrame) -> DataFrame:
    """Pixel polygon to ``[0, 1]`` coordinates in ``normalized``."""
    sized = holds.join(images.select("image_id", "width", "height"), "image_id")
    return sized.withColumn(
        "normalized",
        F.transform(
            "polygon",
            lambda p: F.struct((p["x"] / _span("width")).alias("x"), (p["y"] / _span("height")).alias("y")),
        ),
    )


def to_pixel(holds: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``normalized`` back to a pixel polygon; shapes that collapse are rejected."""
    sized = holds.join(images.select("image_id", "width", "height"), "image_id")
    pixels = sized.withColumn(
        "polygon",
        F.transform(
            "normalized",
            lambda p: F.struct(
                geo.half_even(p["x"] * _span("width")).alias("x"),
                geo.half_even(p["y"] * _span("height")).alias("y"),
            ),
        ),
    )
    return _split(pixels, [("degenerate", F.size(F.array_distinct("polygon")) >= 3)])


def boxes_to_polygons(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Float boxes (x1, y1, x2, y2) to clamped four-corner polygons; empty boxes vanish."""
    sized = detections.join(images.select("image_id", "width", "height"), "image_id")

    def clamp(value: str, size: str):
        return F.greatest(F.lit(0), F.least(F.col(size) - 1, geo.half_even(F.col(value)))).cast("int")

    boxed = sized.withColumns(
        {
            "left": clamp("x1", "width"),
            "top": clamp("y1", "height"),
            "right": clamp("x2", "width"),
            "bottom": clamp("y2", "height"),
        }
    ).filter((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))
    return boxed.withColumn(
        "polygon", geo.box_polygon(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"))
    )


def tiled(df: DataFrame, box: str = "bbox", tile: int = TILE) -> DataFrame:
    """One row per tile that a bounding box touches: the key of all spatial joins."""
    b = F.col(box)
    cell = lambda v: F.floor(v / tile).cast("int")
    return df.withColumn("ty", F.explode(F.sequence(cell(b["top"]), cell(b["bottom"] - 1)))).withColumn(
        "tx", F.explode(F.sequence(cell(b["left"]), cell(b["right"] - 1)))
    )


def bbox_join(left: DataFrame, right: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of holds of one image whose boxes overlap.

    Both inputs need ``image_id``, ``hold_index`` and ``bbox``.  A pair that meets in several
    tiles is reported only by the tile of its intersection's top left corner.
    """
    a = tiled(left.select("image_id", F.col("hold_index").alias("left_index"), F.col("bbox").alias("_a")), "_a", tile)
    b = tiled(right.select("image_id", F.col("hold_index").alias("right_index"), F.col("bbox").alias("_b")), "_b", tile)
    first = lambda side: F.greatest(F.col("_a")[side], F.col("_b")[side])
    return (
        a.join(b, ["image_id", "ty", "tx"])
        .filter(geo.boxes_overlap(F.col("_a"), F.col("_b")))
        .filter(
            (F.floor(first("top") / tile) == F.col("ty")) & (F.floor(first("left") / tile) == F.col("tx"))
        )
        .select("image_id", "left_index", "right_index")
    )


def hit_test(clicks: DataFrame, holds: DataFrame, tile: int = TILE) -> DataFrame:
    """Topmost hold (largest ``hold_index``) under each click; null if the click misses.

    ``clicks``: image_id, click_id, x, y in pixels.
    """
    areas = tiled(holds.select("image_id", "hold_index", "polygon", geo.bbox(F.col("polygon")).alias("bbox")), tile=tile)
    placed = clicks.withColumns(
        {"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")}
    )
    hits = (
        salted_join(placed, areas, ["image_id", "ty", "tx"], ["click_id"])
        .filter(
            (F.col("x") >= F.col("bbox.left"))
            & (F.col("x") < F.col("bbox.right"))
            & (F.col("y") >= F.col("bbox.top"))
            & (F.col("y") < F.col("bbox.bottom"))
        )
        .filter(geo.contains(F.col("polygon"), F.col("x"), F.col("y")))
        .groupBy("image_id", "click_id")
        .agg(F.max("hold_index").alias("hold_index"))
    )
    return clicks.join(hits, ["image_id", "click_id"], "left")


def scale_clicks(clicks: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised clicks to pixels; non-finite or outside points are rejected."""
    inside = lambda c: finite(F.col(c)) & F.col(c).between(0.0, 1.0)
    ok, rejected = _split(clicks, [("x", inside("x")), ("y", inside("y"))])
    sized = ok.join(images.select("image_id", "width", "height"), "image_id")
    return (
        sized.withColumns({"x": F.col("x") * (F.col("width") - 1), "y": F.col("y") * (F.col("height") - 1)}),
        rejected,
    )
