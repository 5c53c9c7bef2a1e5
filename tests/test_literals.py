"""Known values of single operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wallframe.functions import vectors as vec
from wallframe.functions.color import hls_to_rgb, rgb_to_hls
from wallframe.functions.numeric import delta_e
from wallframe.functions.raster import fill
from wallframe.operators import augment as au
from wallframe.operators import color_features as cf
from wallframe.operators.grouping import finalize_groups
from wallframe.operators.masks import with_runs
from wallframe.operators.overlap import span_iou
from wallframe.operators.scanlines import color_counts, pack_pixels, unpack_pixels
from wallframe.operators.shapes import boxes_to_polygons, scale_clicks, to_pixel, with_bbox, with_centroid
from wallframe.operators.validate import validate_colors, validate_holds
from wallframe.registry import get_grouper, slug

HOLD = "image_id int, hold_index int, polygon array<struct<x:int,y:int>>"


def box(l, t, r, b):
    return [(l, t), (r, t), (r, b), (l, b)]


def test_triangle(spark):
    df = spark.createDataFrame([(1, 0, [(1, 1), (5, 1), (1, 5)])], HOLD)
    row = with_bbox(with_centroid(df)).first()
    assert tuple(row.centroid) == (2, 2) and tuple(row.bbox) == (1, 1, 6, 6)


def test_collinear_centroid(spark):
    df = spark.createDataFrame([(1, 0, [(0, 0), (2, 2), (5, 5)])], HOLD)
    assert tuple(with_centroid(df).first().centroid) == (2, 2)


def test_invalid_rows(spark):
    rows = [(1, 0, [(-1, 0), (1, 1), (2, 2)]), (1, 1, [(0, 0), (0, 0), (1, 1)]), (1, 2, box(0, 0, 1, 1)), (1, 3, None)]
    ok, rejected = validate_holds(spark.createDataFrame(rows, HOLD))
    assert [r.hold_index for r in ok.collect()] == [2] and rejected.count() == 3
    assert validate_colors(spark.createDataFrame([(256, 0, 0)], "r int, g int, b int"))[1].first().reason == "r"


def test_iou_set(spark):
    images = spark.createDataFrame([(1, 32, 24)], "image_id int, width int, height int")
    preds = [(1, 2, 10, 12), (12, 3, 24, 18)]
    truths = [(4, 5, 14, 15), (20, 10, 29, 20)]
    make = lambda boxes: with_runs(spark.createDataFrame([(1, k, box(*b)) for k, b in enumerate(boxes)], HOLD), images)
    grid = lambda b: np.array([[b[0] <= x <= b[2] and b[1] <= y <= b[3] for x in range(32)] for y in range(24)])
    found = {(r.pred_idx, r.ann_idx): r.iou for r in span_iou(make(preds), make(truths), tile=8).collect()}
    for i, p in enumerate(preds):
        for j, t in enumerate(truths):
            a, b = grid(p), grid(t)
            assert abs(found.get((i, j), 0.0) - (a & b).sum() / (a | b).sum()) < 1e-12


def test_stored_mask_wins(spark):
    images = spark.createDataFrame([(1, 32, 24)], "image_id int, width int, height int")
    schema = HOLD + ", mask_runs array<struct<y0:int,y1:int,x0:int,x1:int>>, mask_width int, mask_height int"
    pred = spark.createDataFrame([(1, 0, box(20, 15, 25, 20), [(0, 7, 0, 7)], 32, 24)], schema)
    truth = with_runs(spark.createDataFrame([(1, 0, box(0, 0, 7, 7))], HOLD), images)
    assert span_iou(with_runs(pred, images, use_mask=True), truth).first().iou == 1.0
    other = spark.createDataFrame([(1, 0, box(20, 15, 25, 20), [(0, 7, 0, 7)], 31, 24)], schema)
    assert span_iou(with_runs(other, images, use_mask=True), truth).count() == 0


def test_fill_shapes():
    def pixels(points):
        kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
        runs = fill(pa.array([None, [{"x": x, "y": y} for x, y in points]], kind))
        assert runs[0].as_py() == []
        cells = [(x, y) for r in runs[1].as_py() for y in range(r["y0"], r["y1"] + 1) for x in range(r["x0"], r["x1"] + 1)]
        assert len(cells) == len(set(cells))
        return set(cells)

    step = pixels([(0, 0), (6, 0), (6, 3), (3, 3), (3, 6), (0, 6)])
    assert step == {(x, y) for x in range(7) for y in range(7) if y <= 3 or x <= 3}
    hourglass = pixels([(0, 0), (4, 0), (0, 4), (4, 4)])
    assert (2, 2) in hourglass and (0, 2) not in hourglass and (4, 4) in hourglass
    valley = pixels([(0, 0), (4, 4), (8, 0), (8, 8), (0, 8)])
    assert (4, 3) not in valley and (4, 4) in valley and (0, 0) in valley and (8, 0) in valley
    assert pixels([(3, 2), (3, 2), (3, 5)]) == {(3, y) for y in range(2, 6)}


def test_cosine(spark):
    row = spark.sql("SELECT array(1D, 0D) a, array(0D, 1D) b, array(1D, 1D) c").select(
        vec.cosine_distance(F.col("a"), F.col("b")).alias("ab"), vec.cosine_distance(F.col("a"), F.col("c")).alias("ac"), vec.cosine_distance(F.col("c"), F.col("c")).alias("cc")
    ).first()
    assert row.ab == 1 and abs(row.ac - (1 - 0.5**0.5)) < 1e-12 and abs(row.cc) < 1e-12


def test_color_difference():
    lab = np.array([(50.0, 0, 0), (50.0, 0, 0), (50.0, 80, 70)])
    d = delta_e(lab[:, None], lab[None])
    assert d[0, 1] == 0 and np.allclose(d, d.T) and (0 <= d).all() and (d <= 1).all()
    # Published reference pairs of the formula.
    pairs = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082)]
    for a, b, expected in pairs:
        assert abs(delta_e(np.array(a, float), np.array(b, float)) * 100 - expected) < 1e-4


def test_blend(spark):
    assert abs(spark.range(1).select(vec.blend(F.lit(0.2), F.lit(0.8), 3).alias("v")).first().v - 0.65) < 1e-12


def test_noise_becomes_single_groups(spark):
    df = spark.createDataFrame([(1, 0, -1), (1, 1, -1), (1, 2, 0)], "image_id int, hold_index int, label int")
    assert {r.hold_index: r.route_id for r in finalize_groups(df).collect()} == {2: 0, 0: 1, 1: 2}


def test_detector_box(spark):
    images = spark.createDataFrame([(1, 16, 12)], "image_id int, width int, height int")
    d = spark.createDataFrame([(1, 4.0, 3.0, 12.0, 9.0), (1, 20.0, 3.0, 30.0, 9.0)], "image_id int, x1 double, y1 double, x2 double, y2 double")
    rows = with_centroid(boxes_to_polygons(d, images)).collect()
    assert len(rows) == 1 and rows[0].centroid.x == 8


def test_clicks_and_normalised_polygon(spark):
    images = spark.createDataFrame([(1, 11, 21)], "image_id int, width int, height int")
    clicks = spark.createDataFrame([(1, 0, 0.0, 0.5), (1, 1, 1.0, 1.0), (1, 2, 1.5, 0.0)], "image_id int, click_id int, x double, y double")
    ok, rejected = scale_clicks(clicks, images)
    assert {(r.x, r.y) for r in ok.collect()} == {(0.0, 10.0), (10.0, 20.0)} and rejected.first().reason == "x"
    small = spark.createDataFrame([(1, 3, 3)], "image_id int, width int, height int")
    flat = spark.createDataFrame([(1, 0, [(0.0, 0.0), (0.1, 0.1), (1.0, 1.0)])], "image_id int, hold_index int, normalized array<struct<x:double,y:double>>")
    assert to_pixel(flat, small)[1].count() == 1


@pytest.mark.parametrize(("strength", "expected"), [(-1.0, (0, 0, 0)), (0.0, (10, 20, 30)), (1.0, (20, 40, 60))])
def test_lighting(spark, strength, expected):
    pixel = spark.createDataFrame([(1, 0, 0, 10, 20, 30)], "image_id int, y int, x int, r int, g int, b int")
    row = unpack_pixels(au.lighting(pack_pixels(pixel), strength)).first()
    assert (row.r, row.g, row.b) == expected


def grey(spark, side, level):
    return spark.range(side * side).selectExpr("1 AS image_id", f"CAST(id / {side} AS INT) AS y", f"CAST(id % {side} AS INT) AS x", f"{level} AS r", f"{level} AS g", f"{level} AS b")


def test_recolor(spark):
    target = with_runs(spark.createDataFrame([(1, 0, box(1, 1, 5, 5))], HOLD)).selectExpr("*", "20 AS tr", "100 AS tg", "220 AS tb")
    rows = {(r.x, r.y): (r.r, r.g, r.b) for r in unpack_pixels(au.recolor(pack_pixels(grey(spark, 8, 240)), target)).collect()}
    assert rows[2, 2] == (20, 100, 220) and rows[7, 7] == (240, 240, 240)


def test_recolor_applies_overlapping_targets_in_order(spark):
    holds = spark.createDataFrame([(1, 0, box(0, 0, 5, 5)), (1, 1, box(3, 3, 7, 7))], HOLD)
    target = with_runs(holds).selectExpr("*", "IF(hold_index = 0, 20, 200) AS tr", "100 AS tg", "IF(hold_index = 0, 220, 30) AS tb")
    rows = {(r.x, r.y): (r.r, r.g, r.b) for r in unpack_pixels(au.recolor(pack_pixels(grey(spark, 8, 240)), target)).collect()}
    assert rows[1, 1] == (20, 100, 220)
    assert max(abs(a - b) for a, b in zip(rows[7, 7], (200, 100, 30), strict=True)) <= 3
    # The second target sees the first one's lightness of 120: 120 - 240 + 115 is cut to black.
    assert rows[4, 4] == (0, 0, 0)


def test_images_without_a_target_are_passed_on(spark):
    image = grey(spark, 8, 241)
    both = pack_pixels(image.unionByName(image.withColumn("image_id", F.lit(2)).withColumn("r", F.lit(13))))
    target = with_runs(spark.createDataFrame([(1, 0, box(1, 1, 5, 5))], HOLD)).selectExpr("*", "20 AS tr", "100 AS tg", "220 AS tb")
    rows = unpack_pixels(au.recolor(both, target)).filter("image_id = 2").collect()
    assert len(rows) == 64 and {(r.r, r.g, r.b) for r in rows} == {(13, 241, 241)}
    assert unpack_pixels(au.recolor(both, target.limit(0))).count() == 128


def test_pixels_stay_in_lines(spark):
    """No pixel is a row: the plans of colours and distortions have no expansion of x."""
    lines = pack_pixels(grey(spark, 8, 240))
    masks = with_runs(spark.createDataFrame([(1, 0, box(1, 1, 5, 5)), (1, 1, box(30, 2, 40, 3))], HOLD))
    found = {r.hold_index: (r.c0, r.c1, r.c2) for r in cf.mean_color(lines, masks).collect()}
    assert found == {0: (240.0,) * 3, 1: (0.0,) * 3}
    assert {r.hold_index: r.r for r in cf.median_rgb(lines, masks).collect()} == {0: 240, 1: None}
    counts = color_counts(lines, masks)
    assert [(r.code, r.n) for r in counts.orderBy("code").collect()] == [(240, 25), (496, 25), (752, 25)]


def test_chalk(spark):
    holds = with_runs(spark.createDataFrame([(1, 0, box(0, 0, 95, 95))], HOLD))
    targets = holds.selectExpr("*", "96 AS width", "96 AS height", "1.0D AS strength")
    image = grey(spark, 96, 120).withColumns({c: F.when((F.col("x") == 5) & (F.col("y") == 5), 0).otherwise(F.col(c)) for c in "rgb"})
    rows = unpack_pixels(au.chalk(pack_pixels(image), targets, seed=0)).collect()
    level = np.zeros((96, 96))
    for r in rows:
        level[r.y, r.x] = r.r
    assert level[5, 5] == 0
    level[5, 5] = level[5, 6]
    assert level.std() > 1 and level.max() > 120 and np.abs(np.diff(level, axis=1)).mean() < 4
    again = {(r.x, r.y): r.r for r in unpack_pixels(au.chalk(pack_pixels(image), targets, seed=0)).collect()}
    assert all(again[r.x, r.y] == r.r for r in rows)


def test_hls_round_trip(spark):
    df = spark.createDataFrame([(20, 100, 220), (240, 240, 240), (0, 0, 0)], "r int, g int, b int")
    h, l, s = rgb_to_hls(F.col("r"), F.col("g"), F.col("b"))
    back = df.select(h.alias("h"), l.alias("l"), s.alias("s")).select(*[c.alias(n) for c, n in zip(hls_to_rgb(F.col("h"), F.col("l"), F.col("s")), "rgb", strict=True)])
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]


def test_unknown_grouper_lists_choices():
    with pytest.raises(ValueError, match="color_kmeans"):
        get_grouper("nothing")
    assert slug("Color Only", {"n_clusters": 6, "weight": 0.5}) == "color_only-n_clusters-6-weight-0_5"
