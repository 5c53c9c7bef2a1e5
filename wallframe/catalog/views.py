"""The input tables seen as images, holds, vectors and pixels, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box_polygon
from ..operators.scanlines import pack_pixels
from ..operators.validate import normalize_route_label

SIDE = 128

HOLD_COLUMNS = """
  user_id AS image_id, event_id AS hold_index, event_type, value, {k} AS k,
  CASE WHEN event_type IN ('view', 'click') THEN 'prediction' ELSE 'annotation' END AS role,
  CASE WHEN event_type = 'error' THEN 'volume' END AS hold_type,
  (event_id * 37) % 90 AS l, (event_id * 37) % 90 + 12 + event_id % 9 AS r,
  (event_id * 53) % 90 AS t, (event_id * 53) % 90 + 12 + event_id % 7 AS b,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE value / 600 END AS confidence,
  CASE WHEN {k} % 10 = 9 THEN 'unknown' ELSE concat('route_', CAST({k} % 6 AS VARCHAR(10))) END AS raw_label
"""
K_SPARK = "CAST(get_json_object(props, '$.k') AS BIGINT)"
K_DUCK = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

IMAGE_COLUMNS = """
  image_id, 128 AS width, 128 AS height,
  CASE WHEN image_id % 2 = 1 THEN 'augmented' ELSE 'clean' END AS condition,
  image_id - image_id % 2 AS source_id,
  CASE WHEN image_id % 5 = 0 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN image_id % 2 = 1 THEN image_id - 1 END AS parent_image_id
"""

# The same views for the SQL side: holds h, images im, predictions p, annotations a.
HOLDS_SQL = f"""
h0 AS (SELECT {HOLD_COLUMNS.format(k=K_DUCK)} FROM events),
h AS (SELECT *, CASE WHEN raw_label = 'unknown' THEN 'Unknown' ELSE raw_label END AS route_label,
  CASE WHEN raw_label <> 'unknown' THEN CAST(substr(raw_label, 7) AS BIGINT) END AS route_id,
  coalesce(confidence, 1.0) AS conf, (r - l + 1) * (b - t + 1) AS area FROM h0),
p AS (SELECT * FROM h WHERE role = 'prediction'),
a AS (SELECT * FROM h WHERE role = 'annotation' AND hold_type IS NULL),
im AS (SELECT {IMAGE_COLUMNS} FROM (SELECT DISTINCT user_id AS image_id FROM events))
"""

IOU_SQL = """
ov AS (SELECT p.image_id, p.event_type AS implementation_id, p.hold_index AS pred_idx, a.hold_index AS ann_idx,
  p.area + a.area AS both_areas, p.conf,
  (least(p.r, a.r) - greatest(p.l, a.l) + 1) * (least(p.b, a.b) - greatest(p.t, a.t) + 1) AS i
  FROM p JOIN a ON p.image_id = a.image_id AND p.l <= a.r AND a.l <= p.r AND p.t <= a.b AND a.t <= p.b),
iou AS (SELECT image_id, implementation_id, pred_idx, ann_idx, conf, i / CAST(both_areas - i AS DOUBLE) AS iou FROM ov)
"""

VECS_SQL = """
vecs AS (SELECT vec_id % 5 AS image_id, vec_id AS hold_index, CAST(embedding AS DOUBLE[]) AS e, label AS truth FROM embeddings),
d AS (SELECT x.image_id, x.hold_index AS i, y.hold_index AS j, x.truth AS ti, y.truth AS tj,
  1 - list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) AS dist
  FROM vecs x JOIN vecs y ON x.image_id = y.image_id AND x.hold_index < y.hold_index)
"""

PIXELS_SQL = """
px AS (SELECT CAST(floor(o_orderkey / 1500) AS BIGINT) AS image_id,
  CAST(floor((o_orderkey % 1500) / 50) AS INTEGER) AS y, CAST(o_orderkey % 50 AS INTEGER) AS x,
  CAST(floor(o_totalprice) AS BIGINT) % 256 AS r, (o_custkey * 7) % 256 AS g, (o_orderkey * 73) % 256 AS b FROM orders),
pm AS (SELECT image_id, g AS hold_index, (image_id * 7 + g * 11) % 40 AS l, (image_id * 5 + g * 3) % 24 AS t,
  least((image_id * 7 + g * 11) % 40 + 5 + g, 49) AS r, least((image_id * 5 + g * 3) % 24 + 4 + g % 3, 29) AS b
  FROM (SELECT DISTINCT image_id FROM px), range(6) AS s(g)),
inside AS (SELECT px.image_id, pm.hold_index, px.x, px.y, px.r, px.g, px.b FROM px JOIN pm
  ON px.image_id = pm.image_id AND px.x BETWEEN pm.l AND pm.r AND px.y BETWEEN pm.t AND pm.b)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def holds(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events").selectExpr(*_columns(HOLD_COLUMNS.format(k=K_SPARK)))
    labelled = normalize_route_label(raw.withColumn("route_label", F.col("raw_label")))
    return labelled.withColumns(
        {
            "route_id": F.col("route_id").cast("bigint"),
            "polygon": box_polygon(F.col("l"), F.col("t"), F.col("r"), F.col("b")),
        }
    )


def _columns(text: str) -> list[str]:
    """Split a select list at top-level commas."""
    parts, depth, start = [], 0, 0
    for pos, char in enumerate(text):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            parts.append(text[start:pos])
            start = pos + 1
    return [p.strip() for p in [*parts, text[start:]]]


def images(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "events").select(F.col("user_id").alias("image_id")).distinct()
    return ids.selectExpr(*_columns(IMAGE_COLUMNS))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return holds(spark, sf).filter(F.col("role") == "prediction").withColumn("implementation_id", F.col("event_type"))


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.validate import drop_volumes

    return drop_volumes(holds(spark, sf).filter(F.col("role") == "annotation"))


def diamonds(spark: SparkSession, sf: str) -> DataFrame:
    """Slanted shapes: one diamond per hold, some reaching over the canvas."""
    h = holds(spark, sf).withColumns(
        {
            "cx": (F.col("l") + 20).cast("int"),
            "cy": (F.col("t") + 16).cast("int"),
            "w": (F.col("hold_index") % 9 + 6).cast("int"),
            "h": (F.col("hold_index") % 7 + 5).cast("int"),
        }
    )
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cx, cy, w, v = (F.col(c) for c in ("cx", "cy", "w", "h"))
    return h.withColumn(
        "polygon", F.array(corner(cx, cy - v), corner(cx + w, cy), corner(cx, cy + v), corner(cx - w, cy))
    )


DIAMOND_SQL = """
dm AS (SELECT *, l + 20 AS cx, t + 16 AS cy, hold_index % 9 + 6 AS w, hold_index % 7 + 5 AS hh FROM h),
dl AS (SELECT image_id, hold_index, cx, cy, w, hh, cy + dy AS y,
  CAST(floor(cx - w * (hh - abs(dy)) / CAST(hh AS DOUBLE) + 0.5) AS BIGINT) AS x0,
  CAST(ceil(cx + w * (hh - abs(dy)) / CAST(hh AS DOUBLE) - 0.5) AS BIGINT) AS x1
  FROM (SELECT *, unnest(range(-hh, hh + 1)) AS dy FROM dm))
"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        (F.col("vec_id") % 5).alias("image_id"),
        F.col("vec_id").alias("hold_index"),
        "embedding",
        F.col("label").cast("bigint").alias("route_id"),
        F.array(
            (F.col("vec_id") * 17 % 90 + 5).cast("double"),
            (F.col("vec_id") * 29 % 120 - 60).cast("double"),
            (F.col("vec_id") * 43 % 110 - 55).cast("double"),
        ).alias("lab"),
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.selectExpr(
        "CAST(floor(o_orderkey / 1500) AS BIGINT) AS image_id",
        "CAST(floor((o_orderkey % 1500) / 50) AS INT) AS y",
        "CAST(o_orderkey % 50 AS INT) AS x",
        "CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INT) AS r",
        "CAST((o_custkey * 7) % 256 AS INT) AS g",
        "CAST((o_orderkey * 73) % 256 AS INT) AS b",
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The pixels as scanlines, as images give them."""
    return pack_pixels(pixels(spark, sf))


def pixel_images(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "orders").selectExpr("CAST(floor(o_orderkey / 1500) AS BIGINT) AS image_id").distinct()
    return ids.selectExpr("image_id", "50 AS width", "30 AS height")


def pixel_holds(spark: SparkSession, sf: str) -> DataFrame:
    """Six overlapping boxes on every 50 x 30 image."""
    g = pixel_images(spark, sf).select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("g"))
    boxes = g.selectExpr(
        "image_id", "width", "height", "CAST(g AS BIGINT) AS hold_index",
        "CAST((image_id * 7 + g * 11) % 40 AS INT) AS l",
        "CAST((image_id * 5 + g * 3) % 24 AS INT) AS t",
        "CAST(least((image_id * 7 + g * 11) % 40 + 5 + g, 49) AS INT) AS r",
        "CAST(least((image_id * 5 + g * 3) % 24 + 4 + g % 3, 29) AS INT) AS b",
    )
    return boxes.withColumn("polygon", box_polygon(F.col("l"), F.col("t"), F.col("r"), F.col("b")))


def r6(name: str):
    """Round to six decimals, as all compared doubles are."""
    return F.round(F.col(name), 6).alias(name)
