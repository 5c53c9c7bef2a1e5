"""Annotation documents: COCO polygons, VIA CSV and VIA project JSON, YOLO label text.

Each reader has two halves: ``read_*`` loads files, ``parse_*`` works on a table of texts
(path, value), so that documents stored in tables take the same route.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import half_even, points_from
from ..operators.validate import normalized_label, route_id_of

COCO = (
    "struct<images:array<struct<id:bigint,file_name:string>>,"
    "annotations:array<struct<image_id:bigint,segmentation:array<array<double>>,"
    "route_label:string,hold_type:string>>>"
)
SHAPE = "struct<name:string,all_points_x:array<double>,all_points_y:array<double>>"
# Point lists stay text here, since a malformed list must be counted, not fail the document.
VIA = (
    "struct<_via_img_metadata:map<string,struct<filename:string,regions:array<struct<"
    "shape_attributes:struct<name:string,all_points_x:string,all_points_y:string>,"
    "region_attributes:struct<hold_type:string,route_id:string>>>>>>"
)


def read_texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Whole files as (path, value)."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_underscored_texts(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """Whole files whose names start with an underscore, as (path, value).

    Spark's readers treat such files as hidden, but annotation exports use such names.  Only their
    paths are listed on the driver; tasks read the contents.
    """
    system, root = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    paths = [(f.path,) for f in found if f.is_file and f.base_name.startswith("_") and f.base_name.endswith(ending)]

    def load(batches):
        source, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with source.open_input_stream(name) as stream:
                    text = stream.read().decode("utf-8")
                yield pa.RecordBatch.from_pydict({"path": [name], "value": [text]})

    listed = spark.createDataFrame(paths, "path string")
    return listed.repartition("path").mapInArrow(load, "path string, value string")


def _ring(flat: Column) -> Column:
    """x, y, x, y, ... to a polygon; null unless the list holds whole pairs."""
    index = F.sequence(F.lit(0), F.greatest(F.size(flat) - 2, F.lit(0)), F.lit(2))
    points = F.transform(
        index,
        lambda k: F.struct(half_even(F.get(flat, k)).alias("x"), half_even(F.get(flat, k + 1)).alias("y")),
    )
    return F.when((F.size(flat) > 0) & (F.size(flat) % 2 == 0), points)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns out of a generator of one row: filters on them stay above it and do not compute them again."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_coco(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, holds) of COCO documents.

    images: path, image_pos, coco_id, file_name, one row even without annotations.
    holds: path, coco_id, hold_index (order within the document), polygon, route_label, route_id, hold_type.
    What is left out is listed by ``coco_rejects``.
    """
    listed = lambda name: _once(documents, entries=F.from_json("value", COCO)[name])
    images = listed("images").select("path", F.posexplode("entries").alias("image_pos", "image")).select(
        "path", "image_pos", F.col("image.id").alias("coco_id"), F.col("image.file_name").alias("file_name")
    )
    notes = listed("annotations").select("path", F.posexplode("entries").alias("hold_index", "note"))
    label = normalized_label(F.col("note.route_label"))
    holds = notes.select(
        "path",
        F.col("note.image_id").alias("coco_id"),
        "hold_index",
        _ring(F.get(F.col("note.segmentation"), F.lit(0))).alias("polygon"),
        label.alias("route_label"),
        route_id_of(label).alias("route_id"),
        F.col("note.hold_type").alias("hold_type"),
    )
    return images, holds.filter(F.col("polygon").isNotNull())


def coco_rejects(documents: DataFrame) -> DataFrame:
    """path, hold_index, reason: documents that do not parse (null index) and annotations without whole coordinate pairs."""
    parsed = documents.select("path", "value", F.from_json("value", COCO).alias("doc"))
    broken = parsed.filter(F.try_parse_json("value").isNull() | (F.col("doc.images").isNull() & F.col("doc.annotations").isNull()))
    notes = parsed.select("path", F.posexplode("doc.annotations").alias("hold_index", "note"))
    ring = F.get(F.col("note.segmentation"), F.lit(0))
    reason = F.when(ring.isNull() | (F.size(ring) == 0), "no ring").when(F.size(ring) % 2 == 1, "odd ring")
    lost = notes.select("path", "hold_index", reason.alias("reason")).filter(F.col("reason").isNotNull())
    return broken.select("path", F.lit(None).cast("int").alias("hold_index"), F.lit("document").alias("reason")).unionByName(lost)


def read_coco(spark: SparkSession, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    return parse_coco(read_texts(spark, path, pattern))


def _csv_shapes(rows: DataFrame) -> DataFrame:
    """row_id, filename, shape and the reason why a region gives no hold though it should."""
    shape = F.from_json("region_shape_attributes", SHAPE)
    shaped = rows.select("row_id", "filename", shape.alias("shape"), F.try_parse_json("region_shape_attributes").isNull().alias("_broken"))
    x, y = F.col("shape.all_points_x"), F.col("shape.all_points_y")
    gap = lambda v: F.exists(v, lambda c: c.isNull())
    reason = (
        F.when(F.col("_broken"), "shape")
        .when(F.col("shape.name").isNull() | (F.col("shape.name") != "polygon"), F.lit(None).cast("string"))
        .when(x.isNull() | y.isNull(), "no points")
        .when(F.size(x) != F.size(y), "unequal lists")
        .when(gap(x) | gap(y), "coordinate")
    )
    return shaped.select("row_id", "filename", "shape", reason.alias("reason"))


def parse_via_csv(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, holds) of region rows: filename, region_shape_attributes (JSON text), row_id (file order).

    Images of regions that ``via_csv_rejects`` lists are kept.
    """
    shaped = _csv_shapes(rows)
    images = shaped.groupBy("filename").agg(F.min("row_id").alias("first_row"))
    holds = shaped.filter((F.col("shape.name") == "polygon") & F.col("reason").isNull()).select(
        "filename",
        F.col("row_id").alias("hold_index"),
        points_from(F.col("shape.all_points_x"), F.col("shape.all_points_y")).alias("polygon"),
        F.lit(None).cast("string").alias("route_label"),
    )
    return images, holds


def via_csv_rejects(rows: DataFrame) -> DataFrame:
    """filename, row_id, reason of regions that are unreadable, or polygons without one y for every x."""
    return _csv_shapes(rows).filter(F.col("reason").isNotNull()).select("filename", "row_id", "reason")


def read_via_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    # Ids grow along each file; only their order is used.
    return parse_via_csv(rows.withColumn("row_id", F.monotonically_increasing_id()))


def parse_via_json(documents: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(holds, skipped) of VIA projects; ``files``: filename column of the images that exist.

    ``skipped`` is one row: images, regions, missing_files, invalid_polygons.
    """
    # Numbers are truncated; anything else in a list makes its polygon invalid.
    number = lambda v: F.when(F.abs(v.try_cast("double")) < float(1 << 31), v.try_cast("double").cast("int"))
    points = lambda text: F.transform(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), number)
    images = (
        documents.select("path", F.explode(F.from_json("value", VIA)["_via_img_metadata"]).alias("key", "meta"))
        .select("path", "key", F.col("meta.filename").alias("filename"), F.col("meta.regions").alias("regions"))
        .join(files.select("filename").distinct().withColumn("present", F.lit(True)), "filename", "left")
        .withColumn("present", F.coalesce("present", F.lit(False)))
    )
    regions = images.filter("present").select(
        "path", "key", "filename", F.posexplode_outer("regions").alias("hold_index", "region")
    )
    hold = F.col("region.region_attributes")
    shape = F.col("region.shape_attributes")
    x, y = points(shape["all_points_x"]), points(shape["all_points_y"])
    usable = (
        (shape["name"] == "polygon")
        & (F.size(x) >= 3)
        & (F.size(x) == F.size(y))
        & F.forall(x, lambda v: v.isNotNull())
        & F.forall(y, lambda v: v.isNotNull())
    )
    judged = regions.withColumn(
        "verdict",
        F.when(F.col("region").isNull(), "none")
        .when(hold["hold_type"].eqNullSafe("volume") | hold["route_id"].isNull(), "region")
        .when(~F.coalesce(usable, F.lit(False)), "polygon")
        .otherwise("hold"),
    )
    holds = judged.filter(F.col("verdict") == "hold").select(
        "path", "filename", "hold_index", points_from(x, y).alias("polygon"), hold["route_id"].alias("route_label")
    )
    per_image = judged.groupBy("path", "key").agg(
        F.count_if(F.col("verdict") == "region").alias("regions"),
        F.count_if(F.col("verdict") == "polygon").alias("invalid_polygons"),
        (F.count_if(F.col("verdict") == "hold") == 0).cast("bigint").alias("images"),
    )
    missing = images.agg(F.count_if(~F.col("present")).alias("missing_files"))
    counted = per_image.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("images", "regions", "invalid_polygons")]
    )
    zero = F.lit(0).cast("bigint")
    skipped = (
        counted.select("images", "regions", zero.alias("missing_files"), "invalid_polygons")
        .unionByName(missing.select(F.col("missing_files").alias("images"), zero.alias("regions"), "missing_files", zero.alias("invalid_polygons")))
        .agg(*[F.sum(c).alias(c) for c in ("images", "regions", "missing_files", "invalid_polygons")])
    )
    return holds, skipped


def read_via_json(spark: SparkSession, path: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parse_via_json(read_texts(spark, path), files)


def parse_yolo(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, bad rows) of label lines: path, line_id, value.

    A label is ``0 xc yc w h`` or ``0 x1 y1 x2 y2 ...``; polygons become their box.
    ``normalized`` is the canonical text with eight decimals.
    """
    fields = F.filter(F.split(F.trim("value"), r"\s+"), lambda v: v != "")
    rows = _once(lines, fields=fields).filter(F.size("fields") > 0)
    numbers = F.transform(F.slice("fields", F.lit(2), F.size("fields")), lambda v: v.try_cast("double"))
    rows = _once(rows, numbers=numbers)
    n = F.col("numbers")
    even = F.filter(n, lambda v, k: k % 2 == 0)
    odd = F.filter(n, lambda v, k: k % 2 == 1)
    box = F.size(n) == 4
    mid = lambda a: (F.array_min(a) + F.array_max(a)) / 2.0
    width = lambda a: F.array_max(a) - F.array_min(a)
    shaped = _once(
        rows,
        xc=F.when(box, F.get(n, F.lit(0))).otherwise(mid(even)),
        yc=F.when(box, F.get(n, F.lit(1))).otherwise(mid(odd)),
        w=F.when(box, F.get(n, F.lit(2))).otherwise(width(even)),
        h=F.when(box, F.get(n, F.lit(3))).otherwise(width(odd)),
    )
    numeric = F.forall(n, lambda v: v.isNotNull())
    inside = F.forall(F.array("xc", "yc", "w", "h"), lambda v: v.between(0.0, 1.0))
    reason = (
        F.when((F.get("fields", F.lit(0)) != "0") | (F.size("fields") < 5) | (F.size(n) % 2 != 0), "format")
        .when(~numeric, "number")
        .when(~F.coalesce(inside, F.lit(False)), "range")
    )
    judged = _once(shaped, reason=reason)
    text = F.format_string("0 %.8f %.8f %.8f %.8f", "xc", "yc", "w", "h")
    labels = judged.filter(F.col("reason").isNull()).select(
        "path", "line_id", F.lit(0).alias("class_id"), "xc", "yc", "w", "h", text.alias("normalized")
    )
    return labels, judged.filter(F.col("reason").isNotNull()).select("path", "line_id", "value", "reason")


def read_yolo_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    return parse_yolo(
        lines.select(
            F.col("_metadata.file_path").alias("path"),
            F.monotonically_increasing_id().alias("line_id"),
            "value",
        )
    )
