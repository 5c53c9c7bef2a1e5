"""File listings, path resolution, images and stored artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import image_size
from ..operators.validate import route_id_of
from ..store import materialize
from .documents import parse_coco, read_texts, read_underscored_texts

ANNOTATION_ENDINGS = ("_annotations.coco.json", "_restructured.json")
DERIVED_FOLDERS = ("distorted", "augmented")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, basename, size, modified of all files below ``root``; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"),
        F.element_at(F.split("path", "/"), -1).alias("basename"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def select_split_files(files: DataFrame, split: str) -> DataFrame:
    """Annotation files of a split: a path part equals it or the stem contains it; all if none does."""
    name = F.element_at(F.split("path", "/"), -1)
    candidates = files.filter(F.greatest(*[name.endswith(e).cast("int") for e in ANNOTATION_ENDINGS]) == 1)
    stem = F.regexp_replace(F.lower(name), r"\.[^.]*$", "")
    chosen = candidates.filter(
        F.array_contains(F.split("path", "/"), split.lower()) | stem.contains(split.lower())
    )
    return candidates if chosen.isEmpty() else chosen


def resolve_image_paths(names: DataFrame, files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved).  names: annotation_path, file_name.  files: path.

    Order: beside the annotation file, below root, in root/images, any file of that basename.
    """
    root = root.rstrip("/")
    base = F.element_at(F.split("file_name", "/"), -1)
    exact = F.array(
        F.concat(F.regexp_replace("annotation_path", "/[^/]*$", ""), F.lit("/"), "file_name"),
        F.concat(F.lit(root + "/"), "file_name"),
        F.concat(F.lit(root + "/images/"), base),
    )
    listing = files.select(F.col("path").alias("image_path")).distinct()
    # Full paths join one to one; per basename only its first path takes part, so a name that many
    # folders share stays one row.
    by_path = (
        names.select(*names.columns, F.posexplode(exact).alias("priority", "image_path"))
        .join(listing, "image_path", "left_semi")
    )
    firsts = listing.groupBy(F.element_at(F.split("image_path", "/"), -1).alias("_base")).agg(
        F.min("image_path").alias("image_path")
    )
    by_name = names.withColumn("_base", base).join(firsts, "_base").select(
        *names.columns, F.lit(3).alias("priority"), "image_path"
    )
    best = (
        by_path.select(*names.columns, "priority", "image_path")
        .unionByName(by_name)
        .groupBy(*names.columns)
        .agg(F.min(F.struct("priority", "image_path")).alias("best"))
        .select(*names.columns, "best.image_path", "best.priority")
    )
    return best, names.join(best, names.columns, "left_anti")


def load_records(spark: SparkSession, root: str, *, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, holds, unresolved) of a benchmark folder: COCO documents joined with their image files."""
    texts = read_texts(spark, root, "*.json").withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    texts = texts.unionByName(read_underscored_texts(spark, root, ".json"))
    chosen = select_split_files(texts, split)
    return records_from(chosen, list_files(spark, root), root, split)


def records_from(documents: DataFrame, files: DataFrame, root: str, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, holds, unresolved): ``unresolved`` lists path and file_name of images without a file."""
    images, holds = parse_coco(documents)
    names = images.select(F.col("path").alias("annotation_path"), "file_name").distinct()
    resolved, lost = resolve_image_paths(names, files, root)
    parts = F.transform(F.split("path", "/"), lambda p: F.lower(p))
    derived = F.arrays_overlap(parts, F.array(*[F.lit(f) for f in DERIVED_FOLDERS]))
    records = (
        images.join(resolved.withColumnRenamed("annotation_path", "path"), ["path", "file_name"])
        .select(
            F.col("file_name").alias("image_id"),
            F.lit(split).alias("split"),
            F.col("file_name").alias("source_id"),
            F.when(derived, "augmented").otherwise("clean").alias("condition"),
            "image_path",
            "path",
            "coco_id",
        )
    )
    keyed = holds.join(records.select("path", "coco_id", "image_id", "condition"), ["path", "coco_id"])
    unresolved = lost.select(F.col("annotation_path").alias("path"), "file_name")
    return records, keyed.withColumn("route_id", route_id_of(F.col("route_label"))).drop("path", "coco_id"), unresolved


def dataset_manifest(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, totals, images without a label) of ``<split>/images`` and ``<split>/labels`` folders below ``root``."""
    return manifest_from(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))


def manifest_from(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, totals, images without a label) of a table of files: path, length, content.

    Every content is read once, into a stored table of digests, header sizes and counts of label
    lines by class (a line's first field); only that table is joined.  Images of a kind that
    ``image_size`` does not know have null sizes.  Totals count images and objects by split and
    class, by split, by class and as a whole; null stands for all.
    """
    pieces = F.split("path", "/")
    is_label = F.element_at(pieces, -2) == "labels"
    lines = F.filter(F.split(F.when(is_label, F.col("content").cast("string")), "\n"), lambda v: F.trim(v) != "")
    classes = F.transform(lines, lambda v: F.get(F.split(F.trim(v), r"\s+"), F.lit(0)))
    counted = F.transform(
        F.array_distinct("classes"),
        lambda c: F.struct(c.alias("class_id"), F.size(F.filter("classes", lambda v: v == c)).cast("bigint").alias("objects")),
    )
    named = files.select(
        F.element_at(pieces, -3).alias("split"),
        F.element_at(pieces, -2).alias("folder"),
        F.element_at(pieces, -1).alias("name"),
        F.col("path"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        image_size(F.when(~is_label, F.col("content"))).alias("size"),
        classes.alias("classes"),
    ).filter((F.col("folder") == "images") | ((F.col("folder") == "labels") & F.col("name").endswith(".txt")))
    read, _ = materialize(
        named.select(
            "split", "folder", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "path", "bytes", "sha256",
            "size.width", "size.height", F.size("classes").alias("objects"), counted.alias("by_class"),
        )
    )
    side = lambda folder, *more: read.filter(F.col("folder") == folder).select(
        "split", "stem", *[F.col(c).alias(f"{folder}_{c}") for c in ("path", "bytes", "sha256")], *more
    )
    images, labels = side("images", "width", "height"), side("labels", "objects", "by_class")
    labelled = images.join(labels, ["split", "stem"])
    rows = labelled.select("split", F.posexplode_outer("by_class").alias("at", "c")).select("split", "at", "c.class_id", "c.objects")
    # An image counts once for each of its classes, and once where classes are summed up.
    seen = F.when(F.grouping("class_id") == 0, F.count("class_id")).otherwise(F.count_if(F.coalesce("at", F.lit(0)) == 0))
    totals = (
        rows.groupingSets([["split", "class_id"], ["split"], ["class_id"], []], "split", "class_id")
        .agg(seen.alias("images"), F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.grouping("class_id").alias("_all"))
        .filter("_all = 1 OR class_id IS NOT NULL")
        .drop("_all")
    )
    return labelled.drop("by_class"), totals, images.join(labels, ["split", "stem"], "left_anti").select("split", "images_path")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, width, height, data (BGR bytes, rows top down)."""
    images = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(path)
    return images.select(
        F.element_at(F.split("image.origin", "/"), -1).alias("image_id"), "image.width", "image.height", "image.data"
    )


def pixel_hashes(images: DataFrame) -> DataFrame:
    """Exact pixel fingerprint; a stored ``source_pixel_hash`` wins."""
    own = F.sha2("data", 256)
    stored = F.col("source_pixel_hash") if "source_pixel_hash" in images.columns else F.lit(None).cast("string")
    return images.withColumn("pixel_hash", F.coalesce(stored, own))


def replay_holds(images: DataFrame, known_images: DataFrame, known_holds: DataFrame) -> DataFrame:
    """Annotated holds of the known image with the same pixels; unknown images keep one row with nulls.

    images: image_id, pixel_hash.  known_images: known_id, pixel_hash.  known_holds: known_id, hold_index, polygon.
    """
    unique = known_images.groupBy("pixel_hash").agg(F.max("known_id").alias("known_id"))
    return images.select("image_id", "pixel_hash").join(unique, "pixel_hash", "left").join(known_holds, "known_id", "left")


def scanlines(images: DataFrame) -> DataFrame:
    """image_id, y, bytes: one row per pixel row, three bytes per pixel."""
    stride = F.col("width") * 3
    rows = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return rows.select("image_id", "y", F.substring("data", F.col("y") * stride + 1, stride).alias("bytes"))


def holds_to_json(holds: DataFrame) -> DataFrame:
    """image_id, json: every column of the hold but its mask."""
    kept = [c for c in holds.columns if c not in {"mask_runs", "mask_width", "mask_height"}]
    return holds.select("image_id", F.to_json(F.struct(*kept)).alias("json"))


def holds_from_json(texts: DataFrame, schema: str) -> DataFrame:
    return texts.select(F.from_json("json", schema).alias("hold")).select("hold.*")


def write_features(features: DataFrame, path: str, keys: Sequence[str] = ("condition", "source", "pooling")) -> None:
    """Feature cache partitioned by its lookup keys, so a reader touches only the folders it asks for."""
    features.write.mode("overwrite").partitionBy(*keys).parquet(path)


def first_occurrences(rows: DataFrame, name: str, position: str) -> DataFrame:
    """Distinct values with the position of their first appearance."""
    return rows.groupBy(name).agg(F.min(position).alias("position"))


def top_images(holds: DataFrame, n: int) -> DataFrame:
    """The n images with most annotations, ties by image id."""
    return (
        holds.groupBy("image_id")
        .agg(F.count(F.lit(1)).alias("annotations"))
        .orderBy(F.desc("annotations"), "image_id")
        .limit(n)
    )


def in_given_order(records: DataFrame, order: DataFrame) -> DataFrame:
    """Records of the ids in ``order`` (image_id, pos), sorted by pos across partitions."""
    return records.join(order, "image_id").orderBy("pos")


def largest_per_key(rows: DataFrame, keys: Sequence[str], score: str, pick: str) -> DataFrame:
    """Row of the largest score per key; the first candidate wins a tie."""
    best = F.max(F.struct(F.col(score), (-F.col(pick)).alias("_n")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b._n")).alias(pick), F.col(f"b.{score}").alias(score))


