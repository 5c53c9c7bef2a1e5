"""Readers and writers on real files."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wallframe.functions.headers import image_size
from wallframe.operators.color_features import mean_color, median_rgb
from wallframe.operators.masks import with_runs
from wallframe.operators.scanlines import color_counts
from wallframe.plans.reports import report_json, write_report
from wallframe.sources import documents as doc
from wallframe.sources import files as fs


def write_png(path, pixels: np.ndarray) -> None:
    """8-bit RGB PNG without filters."""
    height, width, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def dataset(tmp_path):
    pixels = np.zeros((12, 16, 3), np.uint8)
    pixels[..., 0], pixels[..., 1], pixels[..., 2] = 10, 20, 30
    pixels[2, 3] = 0
    for split in ("train", "valid"):
        for kind in ("images", "labels"):
            (tmp_path / split / kind).mkdir(parents=True)
    write_png(tmp_path / "train" / "images" / "a.png", pixels)
    write_png(tmp_path / "valid" / "images" / "b.png", pixels + 1)
    write_png(tmp_path / "valid" / "images" / "c.png", pixels + 2)
    (tmp_path / "train" / "labels" / "a.txt").write_text("0 0.5 0.5 0.25 0.25\n\n0 0 0 0.5 0 0.5 0.5\n1 0.5 0.5 0.1 0.1\n")
    (tmp_path / "valid" / "labels" / "b.txt").write_text("0 0.5 0.5 0.25 0.25\n")
    coco = {
        "images": [{"id": 1, "file_name": "a.png"}, {"id": 2, "file_name": "nowhere.png"}, {"id": 3, "file_name": "b.png"}],
        "annotations": [
            {"image_id": 1, "segmentation": [[0.5, 1.5, 6, 1.5, 6, 5]], "route_label": "route_4"},
            {"image_id": 1, "segmentation": [[0, 0, 3, 0, 3, 3]], "route_label": "UNKNOWN"},
        ],
    }
    (tmp_path / "valid" / "_annotations.coco.json").write_text(json.dumps(coco))
    (tmp_path / "train" / "x_annotations.coco.json").write_text(json.dumps({"images": [], "annotations": []}))
    return tmp_path


def test_coco_records(spark, dataset):
    images, holds, _ = fs.load_records(spark, str(dataset), split="valid")
    rows = {r.image_id: r for r in images.collect()}
    assert set(rows) == {"a.png", "b.png"}  # an image without a file is left out
    assert rows["a.png"].image_path.endswith("train/images/a.png") and rows["b.png"].condition == "clean"
    found = {r.hold_index: r for r in holds.collect()}
    assert [tuple(p) for p in found[0].polygon] == [(0, 2), (6, 2), (6, 5)]
    assert (found[0].route_label, found[0].route_id) == ("route_4", 4)
    assert (found[1].route_label, found[1].route_id) == ("Unknown", None)


def test_split_selection_falls_back(spark, dataset):
    files = fs.list_files(spark, str(dataset), "*.json")
    assert fs.select_split_files(files, "train").count() == 1
    assert fs.select_split_files(files, "nosuchsplit").count() == 1


def test_yolo_files(spark, dataset):
    labels, bad = doc.read_yolo_labels(spark, str(dataset))
    texts = sorted(r.normalized for r in labels.collect())
    assert texts == ["0 0.25000000 0.25000000 0.50000000 0.50000000"] + ["0 0.50000000 0.50000000 0.25000000 0.25000000"] * 2
    assert [r.reason for r in bad.collect()] == ["format"]


def test_dataset_manifest(spark, dataset):
    records, totals, unlabelled = fs.dataset_manifest(spark, str(dataset))
    rows = {r.stem: r for r in records.collect()}
    assert (rows["a"].width, rows["a"].height, rows["a"].objects, rows["b"].split) == (16, 12, 3, "valid")
    assert len(rows["a"].images_sha256) == 64 and rows["a"].labels_bytes > 0
    assert {tuple(r) for r in totals.select("split", "class_id", "images", "objects").collect()} == {
        ("train", "0", 1, 2), ("train", "1", 1, 1), ("valid", "0", 1, 1), ("train", None, 1, 3), ("valid", None, 1, 1),
        (None, "0", 2, 3), (None, "1", 1, 1), (None, None, 2, 4),
    }
    assert [r.images_path.rsplit("/", 1)[1] for r in unlabelled.collect()] == ["c.png"]


def test_image_headers(spark):
    """Sizes from headers alone; a JPEG's frame comes after segments of any length."""
    pad = b"\0" * 40
    frame = b"\xff\xc2\0\x11\x08" + (300).to_bytes(2, "big") + (4000).to_bytes(2, "big") + pad
    table = b"\xff\xc4\0\x04\xff\xc0"
    known = {
        b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (70000).to_bytes(4, "big") + (5).to_bytes(4, "big") + pad: (70000, 5),
        b"GIF89a" + (640).to_bytes(2, "little") + (480).to_bytes(2, "little") + pad: (640, 480),
        b"BM" + b"\0" * 16 + (33).to_bytes(4, "little") + (-21).to_bytes(4, "little", signed=True) + pad: (33, 21),
        b"\xff\xd8\xff\xe1\xff\xff" + b"\xff" * 65533 + table + b"\xff" + frame: (4000, 300),
        b"\xff\xd8\xff\xe0\0\x10": None,
        b"\x89PNG\r\n\x1a\n": None,
        b"": None,
        b"RIFF" + pad: None,
        None: None,
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in enumerate(known)], "k int, content binary")
    found = {r.k: r.s and tuple(r.s) for r in df.select("k", image_size(F.col("content")).alias("s")).collect()}
    assert [found[k] for k in range(len(known))] == list(known.values())


def test_via_csv_file(spark, tmp_path):
    path = tmp_path / "via.csv"
    shape = json.dumps({"name": "polygon", "all_points_x": [0, 4.5, 4], "all_points_y": [0, 0, 3]}).replace('"', '""')
    other = json.dumps({"name": "circle", "cx": 1}).replace('"', '""')
    path.write_text(f'filename,region_shape_attributes\nx.png,"{shape}"\ny.png,"{other}"\nx.png,"{shape}"\n')
    images, holds = doc.read_via_csv(spark, str(path))
    assert [r.filename for r in images.orderBy("first_row").collect()] == ["x.png", "y.png"]
    assert [tuple(p) for p in holds.first().polygon] == [(0, 0), (4, 0), (4, 3)] and holds.count() == 2


def test_via_project_file(spark, tmp_path):
    points = {"name": "polygon", "all_points_x": [1, 5, 1], "all_points_y": [1, 1, 5]}
    project = {
        "_via_img_metadata": {
            "k1": {
                "filename": "a.png",
                "regions": [
                    {"shape_attributes": points, "region_attributes": {"hold_type": "jug", "route_id": "3"}},
                    {"shape_attributes": points, "region_attributes": {"hold_type": "volume", "route_id": "3"}},
                    {"shape_attributes": {"name": "rect"}, "region_attributes": {"route_id": "3"}},
                ],
            },
            "k2": {"filename": "gone.png", "regions": []},
            "k3": {"filename": "b.png", "regions": []},
        }
    }
    (tmp_path / "p.json").write_text(json.dumps(project))
    files = spark.createDataFrame([("a.png",), ("b.png",)], "filename string")
    holds, skipped = doc.read_via_json(spark, str(tmp_path / "p.json"), files)
    assert [(r.filename, r.route_label, r.hold_index) for r in holds.collect()] == [("a.png", "3", 0)]
    assert skipped.first().asDict() == {"images": 2, "regions": 1, "missing_files": 1, "invalid_polygons": 1}


def test_pixels_of_masks(spark, dataset):
    images = fs.read_images(spark, str(dataset / "train" / "images"))
    polygon = "array(named_struct('x',1,'y',1),named_struct('x',5,'y',1),named_struct('x',1,'y',5))"
    holds = images.selectExpr("image_id", "width", "height", "0L AS hold_index", f"{polygon} AS polygon")
    masks = with_runs(holds)
    lines = fs.scanlines(images)
    counted = {(r.code // 256, r.code % 256): r.n for r in color_counts(lines, masks).collect()}
    assert counted == {(0, 10): 14, (1, 20): 14, (2, 30): 14, (0, 0): 1, (1, 0): 1, (2, 0): 1}
    colored = median_rgb(lines, masks).first()
    assert (colored.r, colored.g, colored.b) == (10, 20, 30)
    assert abs(mean_color(lines, masks).first().c0 - 14 * 10 / 15) < 1e-9


def test_replay_by_pixels(spark, dataset):
    known = fs.pixel_hashes(fs.read_images(spark, str(dataset))).select(F.col("image_id").alias("known_id"), "pixel_hash")
    asked = fs.pixel_hashes(fs.read_images(spark, str(dataset / "train"))).select("image_id", "pixel_hash")
    asked = asked.unionByName(spark.createDataFrame([("other", "00")], "image_id string, pixel_hash string"))
    holds = spark.createDataFrame([("a.png", 0)], "known_id string, hold_index int")
    assert {(r.image_id, r.hold_index) for r in fs.replay_holds(asked, known, holds).collect()} == {("a.png", 0), ("other", None)}


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("clean", 0.5)], "condition string, value double")
    write_report(df, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).first().value
    assert json.loads(text) == {"condition": "clean", "value": 0.5}
    with pytest.raises(Exception, match="not finite"):
        report_json(df.withColumn("value", F.lit(float("nan")))).collect()


def test_yolo_lines_are_split_once(spark):
    """A filter on what was parsed must not parse the line again."""
    from wallframe.sources.documents import parse_yolo

    lines = spark.range(4).selectExpr("'a' AS path", "id AS line_id", "concat_ws(' ', id % 2, 0.5D, 0.5D, 0.25D, 0.25D * id) AS value")
    labels, bad = parse_yolo(lines)
    assert [r.line_id for r in labels.collect()] == [0, 2] and [r.reason for r in bad.orderBy("line_id").collect()] == ["format"] * 2
    for found in (labels, bad):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_coco_documents_are_parsed_once(spark):
    text = '{"images":[{"id":1,"file_name":"a.png"}],"annotations":[{"image_id":1,"segmentation":[[1,1,5,1,5,5]],"route_label":"route_2"}]}'
    texts = spark.createDataFrame([("p", text), ("q", "{}"), ("r", None)], "path string, value string")
    for rows in doc.parse_coco(texts):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        assert [r["path"] for r in rows.collect()] == ["p"]
