"""Queries on annotation documents, file resolution, splits, derived records and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import POLYGON
from ..operators import dataset as ds
from ..operators.shapes import with_bbox
from ..plans import matrix as mx
from ..plans import reports as rep
from ..sources import documents as doc
from ..sources import files as fs
from ..store import materialize
from . import views as w
from .evaluation_queries import DETECTORS, labelled_predictions, truth_rows
from .views import HOLDS_SQL, r6

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# ---- annotation documents --------------------------------------------------------------------
def coco_documents(spark, sf):
    """One COCO document per event; errors are images without annotations."""
    ring = "array(l + 0.5D, t + 0.25D, r + 0.5D, t + 0.25D, r + 0.5D, b + 1.5D, l + 0.5D, b + 1.5D)"
    return w.holds(spark, sf).selectExpr(
        "concat('/data/', CASE WHEN image_id % 4 = 0 THEN 'distorted' ELSE 'plain' END, '/', hold_index, '_annotations.coco.json') AS path",
        "to_json(named_struct('images', array(named_struct('id', hold_index, 'file_name', concat(image_id, '_', hold_index, '.png'))), 'annotations', "
        f"CASE WHEN event_type = 'error' THEN array() ELSE array(named_struct('image_id', hold_index, 'segmentation', array({ring}), 'route_label', upper(raw_label))) END)) AS value",
    )


@query("src_coco_holds", f"""WITH {HOLDS_SQL} SELECT hold_index AS coco_id, CAST(round_even(l + 0.5, 0) AS BIGINT) AS x_min, CAST(round_even(t + 0.25, 0) AS BIGINT) AS y_min,
  CAST(round_even(r + 0.5, 0) AS BIGINT) + 1 AS x_end, CAST(round_even(b + 1.5, 0) AS BIGINT) + 1 AS y_end, CASE WHEN raw_label = 'unknown' THEN 'Unknown' ELSE upper(raw_label) END AS route_label
  FROM h WHERE event_type <> 'error'""")
def _(spark, sf):
    holds = with_bbox(doc.parse_coco(coco_documents(spark, sf))[1])
    edge = lambda c: F.col(f"bbox.{c}").cast("bigint")
    return holds.select("coco_id", edge("left").alias("x_min"), edge("top").alias("y_min"), edge("right").alias("x_end"), edge("bottom").alias("y_end"), "route_label")


@query("src_coco_images", f"WITH {HOLDS_SQL} SELECT concat(image_id, '_', hold_index, '.png') AS file_name, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS holds FROM h")
def _(spark, sf):
    images, holds = doc.parse_coco(coco_documents(spark, sf))
    counts = holds.groupBy("path", "coco_id").agg(F.count(F.lit(1)).alias("holds"))
    return images.join(counts, ["path", "coco_id"], "left").select("file_name", F.coalesce("holds", F.lit(0)).alias("holds"))


@query("src_via_csv", f"""WITH {HOLDS_SQL} SELECT CAST(image_id AS VARCHAR) AS filename, min(hold_index) AS first_row, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS holds,
  CAST(sum(CASE WHEN event_type <> 'error' THEN round_even(l + 0.5, 0) ELSE 0 END) AS BIGINT) AS x_sum FROM h GROUP BY 1""")
def _(spark, sf):
    rows = w.holds(spark, sf).selectExpr(
        "hold_index AS row_id", "CAST(image_id AS STRING) AS filename",
        "to_json(named_struct('name', CASE WHEN event_type = 'error' THEN 'circle' ELSE 'polygon' END, 'all_points_x', array(l + 0.5D, r, r), 'all_points_y', array(t, t, b))) AS region_shape_attributes",
    )
    images, holds = doc.parse_via_csv(rows)
    per_image = holds.groupBy("filename").agg(F.count(F.lit(1)).alias("holds"), F.sum(F.col("polygon")[0]["x"]).alias("x_sum"))
    return images.join(per_image, "filename", "left").fillna(0)


@query("src_via_csv_rejected", """SELECT CAST(user_id AS VARCHAR) AS filename, event_id AS row_id, CASE event_id % 6 WHEN 0 THEN 'unequal lists' WHEN 1 THEN 'no points' WHEN 2 THEN 'shape' ELSE 'coordinate' END AS reason
  FROM events WHERE event_id % 6 < 4""")
def _(spark, sf):
    """Polygons with a list too short, without lists, with a gap, and texts that are no JSON; circles and whole polygons pass."""
    rows = w.table(spark, sf, "events").selectExpr(
        "event_id AS row_id", "CAST(user_id AS STRING) AS filename",
        """CASE event_id % 6 WHEN 0 THEN '{"name":"polygon","all_points_x":[1,2,7],"all_points_y":[3,4]}' WHEN 1 THEN '{"name":"polygon"}' WHEN 2 THEN '{"name":"polygon",'
        WHEN 3 THEN '{"name":"polygon","all_points_x":[1,null,7],"all_points_y":[3,4,5]}' WHEN 4 THEN '{"name":"circle","cx":4}'
        ELSE '{"name":"polygon","all_points_x":[1.5,2,7],"all_points_y":[3,4,9]}' END AS region_shape_attributes""",
    )
    return doc.via_csv_rejects(rows).select("filename", "row_id", "reason")


@query("src_coco_rejected", """SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 5 > 0 THEN 1 END AS hold_index, CASE event_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'odd ring' ELSE 'no ring' END AS reason
  FROM events WHERE event_id % 5 < 3""")
def _(spark, sf):
    """Documents cut short, and second annotations with an odd ring or none."""
    ring = "CASE event_id % 5 WHEN 1 THEN '[[1,2,3]]' WHEN 2 THEN '[]' ELSE '[[4,4,9,4,9,9]]' END"
    whole = f"""concat('{{"images":[{{"id":1,"file_name":"a.png"}}],"annotations":[{{"image_id":1,"segmentation":[[1,1,5,1,5,5]]}},{{"image_id":1,"segmentation":', {ring}, '}}]}}')"""
    texts = w.table(spark, sf, "events").selectExpr("CAST(event_id AS STRING) AS path", f"CASE WHEN event_id % 5 = 0 THEN substring({whole}, 1, 60) ELSE {whole} END AS value")
    return doc.coco_rejects(texts).select("path", F.col("hold_index"), "reason")


def via_documents(spark, sf):
    """One project per event with a single image of two regions; every 5th point list is broken."""
    # Fractions are truncated.
    xs = "CASE WHEN hold_index % 5 = 0 THEN array(l + 0.75D, r) ELSE array(l + 0.75D, r, r) END"
    return w.holds(spark, sf).selectExpr(
        "CAST(hold_index AS STRING) AS path",
        "to_json(named_struct('_via_img_metadata', map(concat('k', hold_index), named_struct('filename', concat(hold_index, '.png'), 'regions', array("
        f"named_struct('shape_attributes', named_struct('name', 'polygon', 'all_points_x', {xs}, 'all_points_y', array(t, t, b)), 'region_attributes', named_struct('hold_type', coalesce(hold_type, 'jug'), 'route_id', CAST(k AS STRING))),"
        "named_struct('shape_attributes', named_struct('name', 'polygon', 'all_points_x', array(l, r, r), 'all_points_y', array(t, t, b)), 'region_attributes', named_struct('hold_type', 'volume', 'route_id', 'x'))))))) AS value",
    )


@query("src_via_json", f"""WITH {HOLDS_SQL}, u AS (SELECT *, hold_index % 9 > 0 AS present FROM h)
  SELECT CAST(sum(CASE WHEN NOT present OR hold_type IS NOT NULL OR hold_index % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS images, CAST(sum(CASE WHEN present THEN CASE WHEN hold_type IS NULL THEN 1 ELSE 2 END ELSE 0 END) AS BIGINT) AS regions,
  CAST(sum(CASE WHEN present THEN 0 ELSE 1 END) AS BIGINT) AS missing_files, CAST(sum(CASE WHEN present AND hold_type IS NULL AND hold_index % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_polygons FROM u""")
def _(spark, sf):
    files = w.holds(spark, sf).filter("hold_index % 9 > 0").select(F.concat("hold_index", F.lit(".png")).alias("filename"))
    return doc.parse_via_json(via_documents(spark, sf), files)[1]


@query("src_via_json_holds", f"WITH {HOLDS_SQL} SELECT concat(hold_index, '.png') AS filename, 0 AS hold_index, l AS x0, t AS y0, CAST(k AS VARCHAR) AS route_label FROM h WHERE hold_index % 9 > 0 AND hold_type IS NULL AND hold_index % 5 > 0")
def _(spark, sf):
    files = w.holds(spark, sf).filter("hold_index % 9 > 0").select(F.concat("hold_index", F.lit(".png")).alias("filename"))
    holds = doc.parse_via_json(via_documents(spark, sf), files)[0]
    return holds.select("filename", "hold_index", F.col("polygon")[0]["x"].cast("bigint").alias("x0"), F.col("polygon")[0]["y"].cast("bigint").alias("y0"), "route_label")


def yolo_lines(spark, sf):
    """Boxes, polygons, and lines that are broken in one of three ways."""
    return w.holds(spark, sf).selectExpr(
        "CAST(image_id AS STRING) AS path", "hold_index AS line_id",
        "CASE hold_index % 6 WHEN 0 THEN concat_ws(' ', '0', (l + r) / 256D, (t + b) / 256D, (r - l) / 128D, (b - t) / 128D)"
        " WHEN 1 THEN concat_ws(' ', '1', '0.5', '0.5', '0.1', '0.1') WHEN 2 THEN '0 0.5 0.5 0.1' WHEN 3 THEN '0 0.5 0.5 1.5 0.25'"
        " ELSE concat_ws('  ', '0', l / 128D, t / 128D, r / 128D, t / 128D, r / 128D, b / 128D) END AS value",
    )


@query("src_yolo", f"""WITH {HOLDS_SQL} SELECT hold_index AS line_id, printf('0 %.8f %.8f %.8f %.8f', (l + r) / 256.0::DOUBLE, (t + b) / 256.0::DOUBLE, (r - l) / 128.0::DOUBLE, (b - t) / 128.0::DOUBLE) AS normalized FROM h WHERE hold_index % 6 IN (0, 4, 5)""")
def _(spark, sf):
    return doc.parse_yolo(yolo_lines(spark, sf))[0].select("line_id", "normalized")


@query("src_yolo_rejected", f"WITH {HOLDS_SQL} SELECT hold_index AS line_id, CASE hold_index % 6 WHEN 3 THEN 'range' ELSE 'format' END AS reason FROM h WHERE hold_index % 6 IN (1, 2, 3)")
def _(spark, sf):
    return doc.parse_yolo(yolo_lines(spark, sf))[1].select("line_id", "reason")


# ---- files -----------------------------------------------------------------------------------
def wanted_names(spark, sf):
    return w.table(spark, sf, "documents").selectExpr("concat('/root/ann/', source, '/a.json') AS annotation_path", "concat('sub/', doc_id, '.png') AS file_name", "doc_id")


def listed_files(spark, sf):
    places = (
        "filter(array(CASE WHEN doc_id % 5 = 0 THEN concat('/root/ann/', source, '/sub/', doc_id, '.png') END, CASE WHEN doc_id % 5 <= 1 THEN concat('/root/sub/', doc_id, '.png') END,"
        " CASE WHEN doc_id % 5 <= 2 THEN concat('/root/images/', doc_id, '.png') END, CASE WHEN doc_id % 5 <= 3 THEN concat('/root/other/', doc_id, '.png') END), p -> p IS NOT NULL)"
    )
    return w.table(spark, sf, "documents").selectExpr(f"explode({places}) AS path")


@query("src_resolve_paths", """SELECT concat('sub/', doc_id, '.png') AS file_name, CASE doc_id % 5 WHEN 0 THEN concat('/root/ann/', source, '/sub/', doc_id, '.png') WHEN 1 THEN concat('/root/sub/', doc_id, '.png')
  WHEN 2 THEN concat('/root/images/', doc_id, '.png') WHEN 3 THEN concat('/root/other/', doc_id, '.png') END AS image_path FROM documents""")
def _(spark, sf):
    found, missing = fs.resolve_image_paths(wanted_names(spark, sf).drop("doc_id"), listed_files(spark, sf), "/root")
    return found.select("file_name", "image_path").unionByName(missing.select("file_name", F.lit(None).cast("string").alias("image_path")))


@query("src_split_files", "SELECT concat('/d/', source, '/', lang, doc_id, '_restructured.json') AS path FROM documents WHERE source = 'src1' OR contains(concat(lang, doc_id), 'src1')")
def _(spark, sf):
    files = w.table(spark, sf, "documents").selectExpr("concat('/d/', source, '/', lang, doc_id, CASE WHEN length(lang) > 0 THEN '_restructured.json' ELSE '.txt' END) AS path")
    return fs.select_split_files(files, "src1")


@query("src_records", f"""WITH {HOLDS_SQL} SELECT concat(image_id, '_', hold_index, '.png') AS image_id, CASE WHEN image_id % 4 = 0 THEN 'augmented' ELSE 'clean' END AS condition,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS holds, CAST(NULL AS BIGINT) AS route_id FROM h WHERE hold_index % 3 > 0""")
def _(spark, sf):
    files = w.holds(spark, sf).filter("hold_index % 3 > 0").select(F.concat(F.lit("/pics/"), "image_id", F.lit("_"), "hold_index", F.lit(".png")).alias("path"))
    images, holds, _ = fs.records_from(coco_documents(spark, sf), files, "/data", "test")
    per_image = holds.groupBy("image_id").agg(F.count(F.lit(1)).alias("holds"), F.max("route_id").cast("bigint").alias("route_id"))
    return images.join(per_image, "image_id", "left").select("image_id", "condition", F.coalesce("holds", F.lit(0)).alias("holds"), "route_id")


@query("src_records_unresolved", f"WITH {HOLDS_SQL} SELECT concat(image_id, '_', hold_index, '.png') AS file_name FROM h WHERE hold_index % 3 = 0")
def _(spark, sf):
    files = w.holds(spark, sf).filter("hold_index % 3 > 0").select(F.concat(F.lit("/pics/"), "image_id", F.lit("_"), "hold_index", F.lit(".png")).alias("path"))
    return fs.records_from(coco_documents(spark, sf), files, "/data", "test")[2].select("file_name")


MANIFEST_SQL = """i AS (SELECT source AS split, doc_id AS stem, unhex(concat('89504E470D0A1A0A0000000D49484452', printf('%08X', doc_id + 1), printf('%08X', n_chars))) || encode(text) AS content FROM documents),
l AS (SELECT source AS split, doc_id AS stem, doc_id % 4 AS zeros, doc_id % 3 AS ones, concat(repeat(concat('0 0.5 0.5 0.1 0.1', chr(10)), doc_id % 4), chr(10), repeat(concat('1 0.2 0.2 0.1 0.1', chr(10)), doc_id % 3)) AS content
  FROM documents WHERE doc_id % 7 > 0)"""


def manifest_files(spark, sf):
    """An image file per document, a PNG header before its text, and label files for six of seven."""
    docs = w.table(spark, sf, "documents")
    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.format_string("%08X%08X", F.col("doc_id") + 1, "n_chars")))
    named = lambda folder, ending: F.concat(F.lit("/set/"), "source", F.lit(f"/{folder}/"), "doc_id", F.lit(ending)).alias("path")
    images = docs.select(named("images", ".png"), F.concat(header, F.encode("text", "UTF-8")).alias("content"))
    lines = F.expr("concat(repeat('0 0.5 0.5 0.1 0.1\\n', int(doc_id % 4)), '\\n', repeat('1 0.2 0.2 0.1 0.1\\n', int(doc_id % 3)))")
    labels = docs.filter("doc_id % 7 > 0").select(named("labels", ".txt"), F.encode(lines, "UTF-8").alias("content"))
    return images.unionByName(labels).withColumn("length", F.length("content").cast("bigint"))


@query("src_manifest", f"""WITH {MANIFEST_SQL} SELECT split, CAST(stem AS VARCHAR) AS stem, stem + 1 AS width, n_chars AS height, octet_length(i.content) AS images_bytes, octet_length(encode(l.content)) AS labels_bytes,
  sha256(i.content) AS images_sha256, sha256(l.content) AS labels_sha256, zeros + ones AS objects FROM i JOIN l USING (split, stem) JOIN documents ON doc_id = stem""")
def _(spark, sf):
    records, _, _ = fs.manifest_from(manifest_files(spark, sf))
    return records.drop("images_path", "labels_path").withColumn("objects", F.col("objects").cast("bigint"))


@query("src_manifest_totals", f"""WITH {MANIFEST_SQL}, c AS (SELECT split, zeros + ones AS objects, NULL AS class_id FROM l UNION ALL SELECT split, zeros, '0' FROM l WHERE zeros > 0 UNION ALL SELECT split, ones, '1' FROM l WHERE ones > 0)
  SELECT split, class_id, count(*) AS images, CAST(sum(objects) AS BIGINT) AS objects FROM c GROUP BY 1, 2 UNION ALL SELECT NULL, class_id, count(*), CAST(sum(objects) AS BIGINT) FROM c GROUP BY class_id""")
def _(spark, sf):
    return fs.manifest_from(manifest_files(spark, sf))[1]


@query("src_manifest_unlabelled", "SELECT source AS split, concat('/set/', source, '/images/', doc_id, '.png') AS images_path FROM documents WHERE doc_id % 7 = 0")
def _(spark, sf):
    return fs.manifest_from(manifest_files(spark, sf))[2]


@query("src_replay_hash", """WITH k AS (SELECT sha256(text) AS hash, max(doc_id) AS known FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
  SELECT d.doc_id AS image_id, k.known AS known_id FROM documents d LEFT JOIN k ON k.hash = sha256(d.text)""")
def _(spark, sf):
    docs = w.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("data"))
    hashed = fs.pixel_hashes(docs)
    known = hashed.filter("image_id % 2 = 0").select(F.col("image_id").alias("known_id"), "pixel_hash")
    holds = known.select("known_id", F.lit(0).alias("hold_index"))
    return fs.replay_holds(hashed, known, holds).select("image_id", "known_id")


@query("snk_hold_roundtrip", f"WITH {HOLDS_SQL} SELECT hold_index, l, b, round(confidence, 6) AS confidence, route_label FROM h")
def _(spark, sf):
    holds = w.holds(spark, sf).select("image_id", "hold_index", "polygon", "confidence", "route_label")
    stored, _ = materialize(fs.holds_to_json(holds))
    back = fs.holds_from_json(stored, f"image_id bigint, hold_index bigint, polygon {POLYGON}, confidence double, route_label string")
    return back.select("hold_index", F.col("polygon")[0]["x"].cast("bigint").alias("l"), F.col("polygon")[2]["y"].cast("bigint").alias("b"), r6("confidence"), "route_label")


# ---- splits and derived records --------------------------------------------------------------
def records(spark, sf):
    return w.table(spark, sf, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS image_id", "CAST(doc_id AS STRING) AS source_id", "'clean' AS condition",
        "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'holdout' END AS split", "CAST(NULL AS STRING) AS parent_image_id",
    )


UNIT = "CAST(CAST('0x' || substr(sha256('7:' || doc_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"


@query("ds_hash_split", f"""SELECT image_id, split, reason FROM (SELECT CAST(doc_id AS VARCHAR) AS image_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'holdout'
  WHEN {UNIT} < 0.8 THEN 'train' WHEN {UNIT} < 0.9::DOUBLE THEN 'val' ELSE 'test' END AS split, CASE WHEN doc_id % 10 = 1 THEN 'split' END AS reason FROM documents)""")
def _(spark, sf):
    ok, rejected = ds.hash_split(records(spark, sf), 7)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).select("image_id", "split", "reason")


@query("ds_ratio_split", """SELECT doc_id AS image_id, CASE WHEN row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) <= greatest(1, round_even((SELECT count(*) FROM documents) * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS split FROM documents""")
def _(spark, sf):
    docs = w.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"))
    return ds.ratio_split(docs, 0.2, 42).select("image_id", "split")


PRINT = "substr(sha256(concat_ws('|', doc_id, 'set1', '7', 'lighting=-0.25;chalk=0.5')), 1, 12)"


@query("ds_derive", f"SELECT concat(doc_id, ':aug:', {PRINT}) AS image_id, CAST(doc_id AS VARCHAR) AS parent_image_id, 'augmented' AS condition, 'lighting,chalk' AS steps FROM documents")
def _(spark, sf):
    made = ds.derive(records(spark, sf), "set1", 7, [("lighting", "-0.25"), ("chalk", "0.5")])
    return made.select("image_id", "parent_image_id", "condition", F.col("augmentation_metadata")["augmentations"].alias("steps"))


@query("ds_iter_split", f"SELECT CAST(doc_id AS VARCHAR) AS image_id, 'clean' AS condition FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT concat(doc_id, ':aug:', {PRINT}), 'augmented' FROM documents WHERE doc_id % 10 = 0")
def _(spark, sf):
    clean = records(spark, sf)
    made = ds.derive(clean, "set1", 7, [("lighting", "-0.25"), ("chalk", "0.5")])
    return ds.iter_split(clean, made, "test", ("train", "val", "test")).select("image_id", "condition")


@query("ds_materialize", "SELECT count(*) AS lazy_rows, count(*) AS stored_rows FROM documents")
def _(spark, sf):
    lazy = ds.derive(records(spark, sf), "set1", 7, [("lighting", "-0.25")])
    stored, _ = materialize(lazy)
    both = lazy.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(stored.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.agg(F.sum("a").alias("lazy_rows"), F.sum("b").alias("stored_rows"))


ARMS = "(VALUES ('dark_025', -0.25::DOUBLE), ('dark_050', -0.5), ('dark_075', -0.75)) AS arms(arm, strength)"


@query("ds_lighting_arms", f"SELECT arm, strength, CAST(doc_id AS VARCHAR) AS source_id, condition FROM documents CROSS JOIN {ARMS} CROSS JOIN (VALUES ('clean'), ('augmented')) AS c(condition)")
def _(spark, sf):
    return ds.lighting_arms(records(spark, sf)).select("arm", "strength", "source_id", "condition")


@query("set_arm_union", "SELECT condition, count(*) AS n FROM documents CROSS JOIN (VALUES ('clean'), ('augmented')) AS c(condition) GROUP BY 1")
def _(spark, sf):
    return ds.one_arm(ds.lighting_arms(records(spark, sf)), "dark_050").groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


@query("evl_dataset_counts", f"SELECT arm, count(*) AS clean_record_count, count(*) AS distorted_record_count, 2 * count(*) AS record_count FROM documents CROSS JOIN {ARMS} GROUP BY 1")
def _(spark, sf):
    return ds.dataset_counts(ds.lighting_arms(records(spark, sf)), ["arm"])


# ---- set operations --------------------------------------------------------------------------
@query("set_missing", "SELECT c_custkey AS item FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def _(spark, sf):
    expected = w.table(spark, sf, "customer").select(F.col("c_custkey").alias("item"))
    done = w.table(spark, sf, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("item"))
    return rep.pending_work(expected, done, ["item"])[0]


@query("set_first_files", "SELECT url AS filename, min(page_id) AS position FROM pages GROUP BY 1")
def _(spark, sf):
    pages = w.table(spark, sf, "pages").select(F.col("url").alias("filename"), "page_id")
    return fs.first_occurrences(pages, "filename", "page_id")


@query("set_merge_blocks", f"""WITH {HOLDS_SQL}, c AS (SELECT im.image_id, CASE WHEN condition = 'clean' THEN 'clean' ELSE 'distorted' END AS condition FROM im),
  n AS (SELECT implementation_id, condition, count(*) AS case_count FROM c CROSS JOIN (VALUES ('view'), ('click')) AS s(implementation_id) GROUP BY 1, 2)
  SELECT *, CAST(sum(case_count) OVER (PARTITION BY implementation_id) AS BIGINT) AS record_count FROM n""")
def _(spark, sf):
    from ..plans.detection import detection_cases

    cases = detection_cases(w.images(spark, sf), labelled_predictions(spark, sf), truth_rows(spark, sf), DETECTORS)
    blocks = cases.groupBy("implementation_id", "condition").agg(F.count(F.lit(1)).alias("case_count"))
    return rep.merge_blocks(blocks, blocks)


@query("set_components", f"""WITH {HOLDS_SQL} SELECT s.detector, g.grouper, CASE WHEN condition = 'clean' THEN 'clean' ELSE 'distorted' END AS condition, count(*) AS images FROM im
  CROSS JOIN (VALUES ('view'), ('click')) AS s(detector) CROSS JOIN (VALUES ('a'), ('b'), ('c')) AS g(grouper) GROUP BY 1, 2, 3""")
def _(spark, sf):
    from ..plans.detection import reported_condition

    images = w.images(spark, sf).select("image_id", reported_condition(F.col("condition")).alias("condition"))
    work = mx.components(DETECTORS, ("a", "b", "c"), spark).join(images, "condition")
    return work.groupBy("detector", "grouper", "condition").agg(F.count(F.lit(1)).alias("images"))
