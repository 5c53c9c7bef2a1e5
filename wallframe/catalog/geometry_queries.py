"""Queries on filters, geometry, masks and overlap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import masks as m
from ..operators import overlap as ov
from ..operators import shapes as s
from ..operators import validate as v
from . import views as w
from .views import HOLDS_SQL, IOU_SQL, r6

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# ---- filters ---------------------------------------------------------------------------------
@query("flt_geometry", f"""WITH {HOLDS_SQL} SELECT
  CASE WHEN hold_index % 5 = 0 OR hold_index % 7 = 0 THEN 'polygon' ELSE 'ok' END AS verdict, count(*) AS n
  FROM h GROUP BY 1""")
def _(spark, sf):
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    l, t = F.col("l"), F.col("t")
    negative = F.array(point(-l - 1, t), point(l, t), point(l, t + 3))
    flat = F.array(point(l, t), point(l + 1, t), point(l, t))
    shaped = w.holds(spark, sf).withColumn(
        "polygon",
        F.when(F.col("hold_index") % 5 == 0, negative).when(F.col("hold_index") % 7 == 0, flat).otherwise(F.col("polygon")),
    )
    ok, rejected = v.validate_holds(shaped)
    both = ok.select(F.lit("ok").alias("verdict")).unionByName(rejected.select(F.col("reason").alias("verdict")))
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("flt_colors", """SELECT CASE WHEN r NOT BETWEEN 0 AND 255 THEN 'r' WHEN g NOT BETWEEN 0 AND 255 THEN 'g'
  WHEN b NOT BETWEEN 0 AND 255 THEN 'b' ELSE 'ok' END AS verdict, count(*) AS n FROM (SELECT l_orderkey % 300 AS r,
  l_partkey % 270 AS g, l_suppkey % 260 - 1 AS b FROM lineitem) GROUP BY 1""")
def _(spark, sf):
    colors = w.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 300 AS r", "l_partkey % 270 AS g", "l_suppkey % 260 - 1 AS b"
    )
    ok, rejected = v.validate_colors(colors)
    both = ok.select(F.lit("ok").alias("verdict")).unionByName(rejected.select(F.col("reason").alias("verdict")))
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("flt_volumes", f"WITH {HOLDS_SQL} SELECT image_id, hold_index FROM h WHERE hold_type IS NULL OR hold_type <> 'volume'")
def _(spark, sf):
    return v.drop_volumes(w.holds(spark, sf)).select("image_id", "hold_index")


@query("flt_route_eligible", f"WITH {HOLDS_SQL} SELECT image_id, hold_index, route_id FROM h WHERE hold_type IS NULL AND route_id IS NOT NULL")
def _(spark, sf):
    return v.route_eligible(w.holds(spark, sf)).select("image_id", "hold_index", "route_id")


@query("flt_route_label", f"WITH {HOLDS_SQL} SELECT route_label, route_id, count(*) AS n FROM h GROUP BY 1, 2")
def _(spark, sf):
    return w.holds(spark, sf).groupBy("route_label", "route_id").agg(F.count(F.lit(1)).alias("n"))


@query("flt_confidence", f"""WITH {HOLDS_SQL} SELECT image_id, sum(CASE WHEN confidence IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS from_attribute,
  sum(CASE WHEN confidence IS NULL THEN 1 ELSE 0 END)::BIGINT AS from_fallback, round(avg(conf), 6) AS mean_confidence FROM h GROUP BY 1""")
def _(spark, sf):
    known = v.with_confidence(w.holds(spark, sf))
    return known.groupBy("image_id").agg(
        F.count_if(F.col("confidence_source") == "attribute").alias("from_attribute"),
        F.count_if(F.col("confidence_source") == "fallback").alias("from_fallback"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


@query("flt_score", f"WITH {HOLDS_SQL} SELECT image_id, hold_index FROM p WHERE confidence >= 0.4 AND k % 3 IN (0, 1)")
def _(spark, sf):
    scored = w.predictions(spark, sf).withColumn("class_id", F.col("k") % 3)
    return v.score_filter(scored, 0.4, (0, 1)).select("image_id", "hold_index")


@query("flt_score_sigmoid", """SELECT event_id, round(CASE WHEN s BETWEEN 0 AND 1 THEN s ELSE 1 / (1 + exp(-s)) END, 6) AS score
  FROM (SELECT event_id, value / 50 - 1 AS s FROM events WHERE event_id % 11 <> 0)""")
def _(spark, sf):
    events = w.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 50 - 1).alias("score"),
    )
    return v.normalize_scores(events)[0].select("event_id", r6("score"))


@query("flt_images", """SELECT CASE WHEN length(trim(lang)) = 0 THEN 'image_id' WHEN doc_id % 9 = 0 THEN 'split'
  WHEN doc_id % 8 = 0 THEN 'condition' ELSE coalesce(CASE WHEN doc_id % 4 > 0 THEN source END, CAST(doc_id AS VARCHAR)) END AS outcome,
  count(*) AS n FROM documents GROUP BY 1""")
def _(spark, sf):
    docs = w.table(spark, sf, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS image_id",
        "CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 2 = 0 THEN 'test' END AS split",
        "CASE WHEN doc_id % 4 > 0 THEN source END AS source_id",
        "CAST(NULL AS STRING) AS parent_image_id",
        "CASE WHEN doc_id % 8 = 0 THEN 'blurred' ELSE 'clean' END AS condition",
    )
    ok, rejected = v.validate_images(docs)
    both = ok.select(F.col("source_id").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("flt_recipes", """SELECT CASE WHEN k = 3 THEN 'kind' WHEN k < 2 AND event_id % 5 = 0 THEN 'alignment'
  WHEN k = 0 AND value / 400 > 1 THEN 'range' WHEN k = 1 AND CAST(floor(value) AS BIGINT) > 255 THEN 'range'
  WHEN k = 2 AND value / 200 - 1 > 1 THEN 'range' ELSE 'ok' END AS verdict, count(*) AS n
  FROM (SELECT *, event_id % 4 AS k FROM events) GROUP BY 1""")
def _(spark, sf):
    recipes = w.table(spark, sf, "events").selectExpr(
        "CASE event_id % 4 WHEN 0 THEN 'chalk' WHEN 1 THEN 'color' WHEN 2 THEN 'lighting' ELSE 'blur' END AS kind",
        "CASE WHEN event_id % 5 = 0 THEN array(1, 2) ELSE array(1) END AS targets",
        "array(value / 400) AS strengths",
        "array(named_struct('r', CAST(floor(value) AS INT), 'g', 0, 'b', 0)) AS colors",
        "value / 200 - 1 AS strength",
    )
    ok, rejected = v.validate_recipes(recipes)
    both = ok.select(F.lit("ok").alias("verdict")).unionByName(rejected.select(F.col("reason").alias("verdict")))
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("flt_orphans", """WITH a AS (SELECT DISTINCT c_custkey * 3 AS key FROM customer), b AS (SELECT DISTINCT o_custkey * 2 AS key FROM orders)
  SELECT key, 'left' AS side FROM a WHERE key NOT IN (SELECT key FROM b)
  UNION ALL SELECT key, 'right' FROM b WHERE key NOT IN (SELECT key FROM a)""")
def _(spark, sf):
    left = w.table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("key"))
    return v.orphans(left, w.table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("key")), ["key"])


# ---- geometry --------------------------------------------------------------------------------
@query("geo_centroid", f"""WITH {HOLDS_SQL}, tri AS (SELECT *, l AS x1, t AS y1, r AS x2, t AS y2, l AS x3, b AS y3 FROM h)
  SELECT hold_index, CAST(round_even((x1 + x2 + x3) / 3.0, 0) AS INTEGER) AS cx,
  CAST(round_even((y1 + y2 + y3) / 3.0, 0) AS INTEGER) AS cy FROM tri""")
def _(spark, sf):
    point = lambda x, y: F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"))
    corner = w.holds(spark, sf).withColumn("polygon", F.array(point("l", "t"), point("r", "t"), point("l", "b")))
    return s.with_centroid(corner).select("hold_index", F.col("centroid.x").alias("cx"), F.col("centroid.y").alias("cy"))


@query("geo_bbox", f"WITH {HOLDS_SQL} SELECT hold_index, l AS box_left, t AS box_top, r + 1 AS box_right, b + 1 AS box_bottom FROM h")
def _(spark, sf):
    box = s.with_bbox(w.holds(spark, sf))
    return box.select("hold_index", *[F.col(f"bbox.{c}").cast("bigint").alias(f"box_{c}") for c in ("left", "top", "right", "bottom")])


@query("geo_normalize", f"""WITH {HOLDS_SQL} SELECT hold_index, round(l / 127.0::DOUBLE, 6) AS nx, round(t / 127.0::DOUBLE, 6) AS ny,
  l AS x, t AS y FROM h""")
def _(spark, sf):
    images = w.images(spark, sf)
    scaled = s.to_normalized(w.holds(spark, sf), images).drop("width", "height")
    back, _ = s.to_pixel(scaled, images)
    return back.select(
        "hold_index",
        F.round(F.col("normalized")[0]["x"], 6).alias("nx"),
        F.round(F.col("normalized")[0]["y"], 6).alias("ny"),
        F.col("polygon")[0]["x"].cast("bigint").alias("x"),
        F.col("polygon")[0]["y"].cast("bigint").alias("y"),
    )


@query("geo_box_polygon", f"""WITH {HOLDS_SQL}, c AS (SELECT hold_index,
  greatest(0, least(127, CAST(round_even(l * 1.5 - 10, 0) AS BIGINT))) AS box_left, greatest(0, least(127, CAST(round_even(t * 1.5 - 10, 0) AS BIGINT))) AS box_top,
  greatest(0, least(127, CAST(round_even(r * 1.5 - 10, 0) AS BIGINT))) AS box_right, greatest(0, least(127, CAST(round_even(b * 1.5 - 10, 0) AS BIGINT))) AS box_bottom FROM p)
  SELECT * FROM c WHERE box_right > box_left AND box_bottom > box_top""")
def _(spark, sf):
    stretched = w.predictions(spark, sf).select(
        "image_id",
        "hold_index",
        *[(F.col(c) * 1.5 - 10).alias(n) for c, n in (("l", "x1"), ("t", "y1"), ("r", "x2"), ("b", "y2"))],
    )
    boxes = s.boxes_to_polygons(stretched, w.images(spark, sf))
    return boxes.select(
        "hold_index",
        F.col("polygon")[0]["x"].cast("bigint").alias("box_left"),
        F.col("polygon")[0]["y"].cast("bigint").alias("box_top"),
        F.col("polygon")[2]["x"].cast("bigint").alias("box_right"),
        F.col("polygon")[2]["y"].cast("bigint").alias("box_bottom"),
    )


@query("geo_bbox_overlap", f"WITH {HOLDS_SQL}, {IOU_SQL} SELECT image_id, pred_idx AS left_index, ann_idx AS right_index FROM ov")
def _(spark, sf):
    return s.bbox_join(s.with_bbox(w.predictions(spark, sf)), s.with_bbox(w.annotations(spark, sf)))


@query("geo_hit_test", f"""WITH {HOLDS_SQL}, c AS (SELECT image_id, hold_index AS click_id, (hold_index * 29) % 128 + 0.5 AS x, (hold_index * 31) % 128 + 0.5 AS y FROM p)
  SELECT c.image_id, c.click_id, max(a.hold_index) AS hold_index FROM c LEFT JOIN a ON a.image_id = c.image_id
  AND c.x > a.l AND c.x < a.r AND c.y > a.t AND c.y < a.b GROUP BY 1, 2""")
def _(spark, sf):
    clicks = w.predictions(spark, sf).select(
        "image_id",
        F.col("hold_index").alias("click_id"),
        (F.col("hold_index") * 29 % 128 + 0.5).cast("double").alias("x"),
        (F.col("hold_index") * 31 % 128 + 0.5).cast("double").alias("y"),
    )
    return s.hit_test(clicks, w.annotations(spark, sf)).select("image_id", "click_id", "hold_index")


@query("geo_clicks", """SELECT event_id AS click_id, round(value / 500 * 127, 6) AS x, round((event_id % 100) / 100.0::DOUBLE * 127, 6) AS y
  FROM events WHERE value / 500 <= 1 AND event_id % 13 <> 0""")
def _(spark, sf):
    clicks = w.table(spark, sf, "events").select(
        F.col("user_id").alias("image_id"),
        F.col("event_id").alias("click_id"),
        (F.col("value") / 500).alias("x"),
        F.when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("event_id") % 100 / 100.0).alias("y"),
    )
    return s.scale_clicks(clicks, w.images(spark, sf))[0].select("click_id", r6("x"), r6("y"))


# ---- masks -----------------------------------------------------------------------------------
@query("msk_spans", f"WITH {HOLDS_SQL}, {w.DIAMOND_SQL} SELECT hold_index, y, x0, x1 FROM dl")
def _(spark, sf):
    lines = m.spans(m.with_runs(w.diamonds(spark, sf)))
    return lines.select("hold_index", *[F.col(c).cast("bigint").alias(c) for c in ("y", "x0", "x1")])


@query("msk_area", f"""WITH {HOLDS_SQL}, {w.DIAMOND_SQL} SELECT h.hold_index, h.area AS box_area, s.area AS diamond_area FROM h JOIN
  (SELECT hold_index, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area FROM dl GROUP BY 1) s ON s.hold_index = h.hold_index""")
def _(spark, sf):
    boxes = m.with_runs(w.holds(spark, sf)).select("hold_index", F.col("area").alias("box_area"))
    tilted = m.with_runs(w.diamonds(spark, sf)).select("hold_index", F.col("area").alias("diamond_area"))
    return boxes.join(tilted, "hold_index")


@query("msk_clip", f"""WITH {HOLDS_SQL}, {w.DIAMOND_SQL} SELECT hold_index, CAST(sum(least(x1, 99) - x0 + 1) AS BIGINT) AS area,
  count(*) AS line_count FROM dl WHERE y < 90 AND x0 <= 99 GROUP BY 1""")
def _(spark, sf):
    small = w.images(spark, sf).withColumns({"width": F.lit(100), "height": F.lit(90)})
    cut = m.with_runs(w.diamonds(spark, sf), small)
    return cut.filter("area > 0").select("hold_index", "area", F.size("runs").cast("bigint").alias("line_count"))


@query("msk_fallback", f"""WITH {HOLDS_SQL}, b AS (SELECT *, l + 10 AS l2, t + 10 AS t2, least(r + 10, 89) AS r2, least(b + 10, 79) AS b2,
  least(89, CAST(round_even((l + r + 20) / 2.0, 0) AS BIGINT)) AS cx, least(79, CAST(round_even((t + b + 20) / 2.0, 0) AS BIGINT)) AS cy FROM h)
  SELECT hold_index, CASE WHEN l2 <= r2 AND t2 <= b2 THEN l2 ELSE cx END AS x, CASE WHEN l2 <= r2 AND t2 <= b2 THEN t2 ELSE cy END AS y,
  CASE WHEN l2 <= r2 AND t2 <= b2 THEN (r2 - l2 + 1) * (b2 - t2 + 1) ELSE 1 END AS area FROM b""")
def _(spark, sf):
    small = w.images(spark, sf).withColumns({"width": F.lit(90), "height": F.lit(80)})
    moved = w.holds(spark, sf).withColumn(
        "polygon", geo.box_polygon(F.col("l") + 10, F.col("t") + 10, F.col("r") + 10, F.col("b") + 10)
    )
    filled = m.with_fallback(m.with_runs(moved, small))
    run = F.col("runs")[0]
    return filled.select("hold_index", run["x0"].cast("bigint").alias("x"), run["y0"].cast("bigint").alias("y"), "area")


@query("msk_run_lengths", f"""WITH {HOLDS_SQL} SELECT hold_index, concat_ws(',', CAST(l * 128 + t AS VARCHAR), CAST(b - t + 1 AS VARCHAR),
  array_to_string(list_transform(range(r - l), lambda x: concat(CAST(128 - (b - t + 1) AS VARCHAR), ',', CAST(b - t + 1 AS VARCHAR))), ','),
  CAST(128 * 128 - (r * 128 + b) - 1 AS VARCHAR)) AS counts FROM h""")
def _(spark, sf):
    coded = m.run_lengths(m.with_runs(w.holds(spark, sf), w.images(spark, sf)))
    return coded.select("hold_index", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("msk_run_lengths_slanted", f"""WITH {HOLDS_SQL}, {w.DIAMOND_SQL},
  px AS (SELECT hold_index, x * 128 + y AS pos FROM (SELECT hold_index, y, unnest(range(greatest(x0, 0), least(x1, 127) + 1)) AS x FROM dl WHERE y BETWEEN 0 AND 127)),
  g AS (SELECT hold_index, pos, pos - row_number() OVER (PARTITION BY hold_index ORDER BY pos) AS island FROM px),
  r AS (SELECT hold_index, min(pos) AS s, max(pos) AS e FROM g GROUP BY hold_index, island),
  c AS (SELECT hold_index, s, e, s - coalesce(lag(e) OVER (PARTITION BY hold_index ORDER BY s) + 1, 0) AS gap FROM r)
  SELECT hold_index, string_agg(gap || ',' || (e - s + 1), ',' ORDER BY s) || CASE WHEN max(e) < 16383 THEN ',' || (16383 - max(e)) ELSE '' END AS counts FROM c GROUP BY 1""")
def _(spark, sf):
    coded = m.run_lengths(m.with_runs(w.diamonds(spark, sf), w.images(spark, sf)))
    return coded.select("hold_index", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("iou_polygon_slanted", f"""WITH {HOLDS_SQL}, {w.DIAMOND_SQL},
  s AS (SELECT hold_index, sum(x1 - x0 + 1) AS area FROM dl GROUP BY 1),
  c AS (SELECT p.hold_index, sum(greatest(0, least(p.x1, q.x1 + p.hold_index % 5) - greatest(p.x0, q.x0 + p.hold_index % 5) + 1)) AS common
    FROM dl p JOIN dl q ON q.hold_index = p.hold_index AND q.y + p.hold_index % 4 = p.y GROUP BY 1)
  SELECT hold_index, round(coalesce(common, 0) / CAST(2 * area - coalesce(common, 0) AS DOUBLE), 6) AS iou FROM s LEFT JOIN c USING (hold_index)""")
def _(spark, sf):
    shift = lambda p: F.struct((p["x"] + F.col("hold_index") % 5).cast("int").alias("x"), (p["y"] + F.col("hold_index") % 4).cast("int").alias("y"))
    pairs = w.diamonds(spark, sf).select("hold_index", F.col("polygon").alias("first"), F.transform("polygon", shift).alias("second"))
    return ov.polygon_iou(pairs).select("hold_index", r6("iou"))


@query("msk_patch_coverage", f"""WITH {HOLDS_SQL}, q AS (SELECT image_id, hold_index, l * 10 AS x0, (r + 1) * 10 - 1 AS x1, t * 10 AS y0, (b + 1) * 10 - 1 AS y1 FROM a),
  c AS (SELECT *, unnest(range(CAST(floor(y0 / 16) AS BIGINT), CAST(floor(y1 / 16) AS BIGINT) + 1)) AS py FROM q),
  e AS (SELECT *, unnest(range(CAST(floor(x0 / 16) AS BIGINT), CAST(floor(x1 / 16) AS BIGINT) + 1)) AS px FROM c)
  SELECT image_id, hold_index, py * 80 + px AS patch_id, round((least(x1, px * 16 + 15) - greatest(x0, px * 16) + 1) *
  (least(y1, py * 16 + 15) - greatest(y0, py * 16) + 1) / 256.0::DOUBLE, 6) AS weight FROM e""")
def _(spark, sf):
    masks = m.with_runs(w.annotations(spark, sf), w.images(spark, sf))
    return m.patch_coverage(masks).select("image_id", "hold_index", F.col("patch_id").cast("bigint").alias("patch_id"), r6("weight"))


# ---- overlap ---------------------------------------------------------------------------------
def prediction_masks(spark, sf):
    return m.with_runs(w.predictions(spark, sf), w.images(spark, sf))


def annotation_masks(spark, sf):
    return m.with_runs(w.annotations(spark, sf), w.images(spark, sf))


def iou_table(spark, sf, min_iou=0.0):
    """iou with the detector of the prediction."""
    return ov.span_iou(prediction_masks(spark, sf), annotation_masks(spark, sf), min_iou=min_iou, carry=("implementation_id",))


@query("iou_span", f"WITH {HOLDS_SQL}, {IOU_SQL} SELECT image_id, pred_idx, ann_idx, round(iou, 6) AS iou FROM iou")
def _(spark, sf):
    return ov.span_iou(prediction_masks(spark, sf), annotation_masks(spark, sf)).select("image_id", "pred_idx", "ann_idx", r6("iou"))


@query("iou_span_bounded", f"WITH {HOLDS_SQL}, {IOU_SQL} SELECT image_id, pred_idx, ann_idx, round(iou, 6) AS iou FROM iou WHERE iou >= 0.5")
def _(spark, sf):
    return ov.span_iou(prediction_masks(spark, sf), annotation_masks(spark, sf), min_iou=0.5).select(
        "image_id", "pred_idx", "ann_idx", r6("iou")
    )


@query("iou_slanted", f"""WITH {HOLDS_SQL}, {w.DIAMOND_SQL}, ar AS (SELECT hold_index, sum(x1 - x0 + 1) AS area FROM dl GROUP BY 1),
  q AS (SELECT x.image_id, x.hold_index AS i, y.hold_index AS j, sum(least(x.x1, y.x1) - greatest(x.x0, y.x0) + 1) AS common
  FROM dl x JOIN dl y ON x.image_id = y.image_id AND x.y = y.y AND x.hold_index < y.hold_index AND x.x0 <= y.x1 AND y.x0 <= x.x1 GROUP BY 1, 2, 3)
  SELECT q.image_id, q.i AS pred_idx, q.j AS ann_idx, round(common / CAST(a1.area + a2.area - common AS DOUBLE), 6) AS iou FROM q
  JOIN ar a1 ON a1.hold_index = q.i JOIN ar a2 ON a2.hold_index = q.j""")
def _(spark, sf):
    masks = m.with_runs(w.diamonds(spark, sf))
    return ov.span_iou(masks, masks, ordered_pairs=True).select("image_id", "pred_idx", "ann_idx", r6("iou"))


@query("iou_polygon", """WITH q AS (SELECT event_id, event_id % 9 + 6 AS w, event_id % 7 + 5 AS v, event_id % 6 AS dx, event_id % 5 AS dy FROM events)
  SELECT event_id, round(CASE WHEN dx <= w AND dy <= v THEN (w - dx + 1) * (v - dy + 1) / CAST(2 * (w + 1) * (v + 1) - (w - dx + 1) * (v - dy + 1) AS DOUBLE) ELSE 0 END, 6) AS iou FROM q""")
def _(spark, sf):
    e, zero = F.col("event_id"), F.lit(0)
    pairs = w.table(spark, sf, "events").select(
        "event_id",
        geo.box_polygon(zero, zero, e % 9 + 6, e % 7 + 5).alias("first"),
        geo.box_polygon(e % 6, e % 5, e % 6 + e % 9 + 6, e % 5 + e % 7 + 5).alias("second"),
    )
    return ov.polygon_iou(pairs).select("event_id", r6("iou"))


@query("iou_nms", f"""WITH RECURSIVE {HOLDS_SQL},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, hold_index) AS n FROM p),
  q AS (SELECT x.image_id, x.n AS strong, y.n AS weak, x.area + y.area AS s,
    (least(x.r, y.r) - greatest(x.l, y.l) + 1) * (least(x.b, y.b) - greatest(x.t, y.t) + 1) AS i FROM ranked x JOIN ranked y
    ON x.image_id = y.image_id AND x.n < y.n AND x.l <= y.r AND y.l <= x.r AND x.t <= y.b AND y.t <= x.b),
  near AS (SELECT image_id, strong, list(weak) AS weak FROM q WHERE i / CAST(s - i AS DOUBLE) >= 0.6 GROUP BY 1, 2),
  walk AS (SELECT image_id, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS gone, false AS kept FROM (SELECT DISTINCT image_id FROM ranked)
    UNION ALL SELECT w.image_id, w.n + 1, CASE WHEN list_contains(w.gone, w.n + 1) THEN w.gone ELSE list_concat(w.gone, coalesce(near.weak, [])) END,
      NOT list_contains(w.gone, w.n + 1) FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.n = w.n + 1
      LEFT JOIN near ON near.image_id = w.image_id AND near.strong = w.n + 1)
  SELECT r.image_id, r.hold_index FROM walk JOIN ranked r ON r.image_id = walk.image_id AND r.n = walk.n WHERE walk.kept""")
def _(spark, sf):
    masks = v.with_confidence(prediction_masks(spark, sf))
    return ov.nms(masks, 0.6).select("image_id", "hold_index")


@query("iou_merge_runs", f"""WITH {HOLDS_SQL} SELECT image_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS exemplar_run, count(*) AS n FROM p GROUP BY 1, 2""")
def _(spark, sf):
    p = w.predictions(spark, sf)
    merged = ov.merge_runs(p.filter("event_type = 'view'"), p.filter("event_type = 'click'"))
    return merged.groupBy("image_id", "exemplar_run").agg(F.count(F.lit(1)).alias("n"))


@query("iou_nms_runs", f"""WITH RECURSIVE {HOLDS_SQL},
  runs AS (SELECT *, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS exemplar_run, row_number() OVER (PARTITION BY image_id, event_type ORDER BY hold_index) - 1 AS run_index FROM p),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, exemplar_run, run_index) AS n FROM runs),
  q AS (SELECT x.image_id, x.n AS strong, y.n AS weak, x.area + y.area AS s,
    (least(x.r, y.r) - greatest(x.l, y.l) + 1) * (least(x.b, y.b) - greatest(x.t, y.t) + 1) AS i FROM ranked x JOIN ranked y
    ON x.image_id = y.image_id AND x.n < y.n AND x.l <= y.r AND y.l <= x.r AND x.t <= y.b AND y.t <= x.b),
  near AS (SELECT image_id, strong, list(weak) AS weak FROM q WHERE i / CAST(s - i AS DOUBLE) >= 0.6 GROUP BY 1, 2),
  walk AS (SELECT image_id, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS gone, false AS kept FROM (SELECT DISTINCT image_id FROM ranked)
    UNION ALL SELECT w.image_id, w.n + 1, CASE WHEN list_contains(w.gone, w.n + 1) THEN w.gone ELSE list_concat(w.gone, coalesce(near.weak, [])) END,
      NOT list_contains(w.gone, w.n + 1) FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.n = w.n + 1
      LEFT JOIN near ON near.image_id = w.image_id AND near.strong = w.n + 1)
  SELECT r.image_id, r.exemplar_run, r.run_index FROM walk JOIN ranked r ON r.image_id = walk.image_id AND r.n = walk.n WHERE walk.kept""")
def _(spark, sf):
    """Two runs that number their masks from 0 in every image, merged and suppressed together."""
    place = Window.partitionBy("image_id", "event_type").orderBy("hold_index")
    masks = v.with_confidence(prediction_masks(spark, sf)).withColumn("place", (F.row_number().over(place) - 1).cast("bigint"))
    masks = masks.drop("hold_index").withColumnRenamed("place", "hold_index")
    merged = ov.merge_runs(masks.filter("event_type = 'view'"), masks.filter("event_type = 'click'"))
    return ov.nms(merged, 0.6).select("image_id", "exemplar_run", "run_index")
