"""Polygon expressions.  A polygon is ``array<struct<x:int,y:int>>``, a run ``struct<y0,y1,x0,x1>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .raster import RUNS, polygon_runs  # noqa: F401

POINT = "struct<x:int,y:int>"
POLYGON = f"array<{POINT}>"


def xs(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: p["x"])


def ys(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: p["y"])


def half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def points_from(x_array: Column, y_array: Column) -> Column:
    """Zip two numeric arrays into a polygon, rounding half-even."""
    return F.zip_with(
        x_array, y_array, lambda x, y: F.struct(half_even(x).alias("x"), half_even(y).alias("y"))
    )


def box_polygon(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Four corners, clockwise from the top left."""
    corner = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    return F.array(corner(left, top), corner(right, top), corner(right, bottom), corner(left, bottom))


def is_valid_polygon(polygon: Column) -> Column:
    """All coordinates present and non-negative, at least three distinct points."""
    inside = F.forall(
        polygon,
        lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (p["x"] >= 0) & (p["y"] >= 0),
    )
    return F.coalesce(inside & (F.size(F.array_distinct(polygon)) >= 3), F.lit(False))


def bbox(polygon: Column) -> Column:
    """Bounds with exclusive right and bottom, as used for crops."""
    return F.struct(
        F.array_min(xs(polygon)).alias("left"),
        F.array_min(ys(polygon)).alias("top"),
        (F.array_max(xs(polygon)) + 1).alias("right"),
        (F.array_max(ys(polygon)) + 1).alias("bottom"),
    )


def edges(polygon: Column) -> Column:
    """Closed ring of ``struct<ax,ay,bx,by>`` edges."""
    n = F.size(polygon)
    return F.transform(
        polygon,
        lambda p, i: F.struct(
            p["x"].alias("ax"),
            p["y"].alias("ay"),
            F.get(polygon, (i + 1) % n)["x"].alias("bx"),
            F.get(polygon, (i + 1) % n)["y"].alias("by"),
        ),
    )


def let(value: Column, use) -> Column:
    """Bind ``value`` to a lambda variable, so that ``use`` may mention it often and it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v) / F.size(values)


def centroid(polygon: Column) -> Column:
    """Area centroid, half-even rounded; the point mean if the ring encloses no area."""
    zero = F.struct(*[F.lit(0).cast("bigint").alias(name) for name in ("area2", "cx", "cy")])

    def add(acc: Column, e: Column) -> Column:
        cross = e["ax"].cast("bigint") * e["by"] - e["bx"].cast("bigint") * e["ay"]
        return F.struct(
            (acc["area2"] + cross).alias("area2"),
            (acc["cx"] + (e["ax"] + e["bx"]) * cross).alias("cx"),
            (acc["cy"] + (e["ay"] + e["by"]) * cross).alias("cy"),
        )

    def point(m: Column) -> Column:
        flat = m["area2"] == 0
        return F.struct(
            half_even(F.when(flat, _mean(xs(polygon))).otherwise(m["cx"] / (m["area2"] * 3))).alias("x"),
            half_even(F.when(flat, _mean(ys(polygon))).otherwise(m["cy"] / (m["area2"] * 3))).alias("y"),
        )

    return let(F.aggregate(edges(polygon), zero, add), point)


def contains(polygon: Column, px: Column, py: Column) -> Column:
    """Even-odd ray cast."""
    crossed = F.filter(
        edges(polygon),
        lambda e: ((e["ay"] > py) != (e["by"] > py))
        & (px < (e["ax"] - e["bx"]) * (py - e["by"]) / (e["ay"] - e["by"]) + e["bx"]),
    )
    return F.size(crossed) % 2 == 1


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed-interval overlap of two ``bbox`` structs with exclusive right and bottom."""
    return (
        (a["left"] < b["right"])
        & (b["left"] < a["right"])
        & (a["top"] < b["bottom"])
        & (b["top"] < a["bottom"])
    )


def clip_runs(runs: Column, width: Column, height: Column) -> Column:
    """Cut runs to the image; parts outside vanish."""
    cut = F.transform(
        runs,
        lambda r: F.struct(
            F.greatest(r["y0"], F.lit(0)).alias("y0"),
            F.least(r["y1"], height - 1).cast("int").alias("y1"),
            F.greatest(r["x0"], F.lit(0)).alias("x0"),
            F.least(r["x1"], width - 1).cast("int").alias("x1"),
        ),
    )
    return F.filter(cut, lambda r: (r["y0"] <= r["y1"]) & (r["x0"] <= r["x1"]))


def runs_area(runs: Column) -> Column:
    return F.aggregate(
        runs,
        F.lit(0).cast("bigint"),
        lambda acc, r: acc + (r["y1"] - r["y0"] + 1).cast("bigint") * (r["x1"] - r["x0"] + 1),
    )
