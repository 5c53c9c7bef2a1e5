"""Colour and embedding features of masks.

Pixels come as scanlines (image_id, y, bytes; see ``scanlines``).  Medians and means are taken of counts
of 8-bit values, which is exact and keeps at most 256 counters per channel and mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.color import hex_color
from ..functions.vectors import mean_vector, unit
from .scanlines import KEYS, color_counts, cut_lines, flat, statistics


def _filled(masks: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """One row per mask; masks without pixels get zeros."""
    return masks.select(*KEYS).join(values, KEYS, "left").fillna(0.0, columns)


def median_lab(lines: DataFrame, masks: DataFrame) -> DataFrame:
    """Channel medians of CIELAB per mask, as ``lab`` array.

    All three channels, a and b included, are scaled by 100/255.
    """
    medians = statistics(color_counts(lines, masks, "lab"))
    scaled = medians.select(
        *KEYS,
        (F.col("m0") * 100.0 / 255.0).alias("l"),
        ((F.col("m1") - 128.0) * 100.0 / 255.0).alias("a"),
        ((F.col("m2") - 128.0) * 100.0 / 255.0).alias("b"),
    )
    return _filled(masks, scaled, ["l", "a", "b"]).withColumn("lab", F.array("l", "a", "b"))


def mean_color(lines: DataFrame, masks: DataFrame, space: str = "rgb") -> DataFrame:
    """Mean channels c0, c1, c2 per mask in ``rgb`` or 8-bit ``lab``."""
    names = ["c0", "c1", "c2"]
    return _filled(masks, statistics(color_counts(lines, masks, space)).select(*KEYS, *names), names)


def median_rgb(lines: DataFrame, masks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Half-even rounded channel medians.

    A ``stored`` colour (image_id, hold_index, sr, sg, sb) is used for masks without any pixel,
    that is where no image was given.
    """
    medians = statistics(color_counts(lines, masks)).select(
        *KEYS, *[F.bround(m, 0).cast("int").alias(c) for m, c in (("m0", "r"), ("m1", "g"), ("m2", "b"))]
    )
    table = masks.select(*KEYS).join(medians, KEYS, "left")
    if stored is None:
        return table
    return table.join(stored, KEYS, "left").select(*KEYS, *[F.coalesce(c, f"s{c}").alias(c) for c in ("r", "g", "b")])


def _stride(area: Column, max_samples: int | None) -> Column:
    if max_samples is None:
        return F.lit(1)
    return F.greatest(F.lit(1), F.ceil(F.sqrt(area / float(max_samples)))).cast("int")


def _inside(polygon: np.ndarray, x: np.ndarray, y: int) -> np.ndarray:
    """Even-odd ray cast along one line."""
    ax, ay = polygon.T
    bx, by = np.roll(ax, -1), np.roll(ay, -1)
    crossing = (ay > y) != (by > y)
    at = (ax[crossing] - bx[crossing]) * (y - by[crossing]) / (ay[crossing] - by[crossing]) + bx[crossing]
    return (x[:, None] < at).sum(axis=1) % 2 == 1


def _sampled_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per line of a box: channel sums and number of the pixels on the grid and inside the polygon."""
    for batch in batches:
        sums = np.zeros((batch.num_rows, 4), np.int64)
        pixels, lengths = flat(batch.column("bytes"))
        ends = np.cumsum(lengths)
        rows = batch.select(["y", "x0", "stride", "polygon"]).to_pylist()
        for k, row in enumerate(rows):
            line = pixels[ends[k] - lengths[k] : ends[k]][:: row["stride"]]
            polygon = np.array([(p["x"], p["y"]) for p in row["polygon"]], np.float64)
            taken = line[_inside(polygon, row["x0"] + np.arange(len(line)) * row["stride"], row["y"])]
            sums[k, :3], sums[k, 3] = taken[:, ::-1].sum(axis=0, dtype=np.int64), len(taken)
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in KEYS], *[pa.array(sums[:, k]) for k in range(4)]], names=[*KEYS, "r", "g", "b", "n"])


def sample_hex(lines: DataFrame, holds: DataFrame, clicks: DataFrame, max_samples: int | None = None) -> DataFrame:
    """``#rrggbb`` picked by each click.

    clicks: image_id, click_id, x, y (pixels), hold_index (null for a miss).  A hit averages the
    hold's pixels, or with ``max_samples`` those on a grid whose stride keeps its box near that
    many; a miss reads the clicked pixel.
    """
    box = geo.bbox(F.col("polygon"))
    picked = (
        clicks.filter(F.col("hold_index").isNotNull())
        .select(*KEYS)
        .distinct()
        .join(holds.select(*KEYS, "polygon", box.alias("box")), KEYS)
    )
    b = F.col("box")
    area = (b["right"] - b["left"]).cast("double") * (b["bottom"] - b["top"])
    gridded = picked.withColumn("stride", _stride(area, max_samples)).filter((b["bottom"] > b["top"]) & (b["right"] > b["left"]))
    rows = gridded.select(
        *KEYS,
        "polygon",
        "stride",
        F.explode(F.sequence(b["top"], b["bottom"] - 1, F.col("stride"))).alias("y"),
        b["left"].alias("x0"),
        (b["right"] - 1).alias("x1"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema.fields}
    schema = f"image_id {kinds['image_id']}, hold_index {kinds['hold_index']}, r bigint, g bigint, b bigint, n bigint"
    sums = cut_lines(lines, rows).select(*KEYS, "y", "x0", "stride", "polygon", "bytes").mapInArrow(_sampled_sums, schema)
    sampled = (
        sums.groupBy(*KEYS)
        .agg(*[F.sum(c).alias(c) for c in ("r", "g", "b", "n")])
        .filter("n > 0")
        .select(*KEYS, hex_color(*[F.col(c) / F.col("n") for c in ("r", "g", "b")]).alias("area_color"))
    )
    # Three bytes of the clicked line; misses only.
    missed = clicks.filter(F.col("hold_index").isNull()).select("image_id", "click_id", F.floor("y").cast("int").alias("y"), F.floor("x").cast("int").alias("x0"))
    point = cut_lines(lines, missed.withColumn("x1", F.col("x0")))
    channel = lambda k: F.conv(F.hex(F.substring("bytes", k, 1)), 16, 10).cast("int")
    single = point.select("image_id", "click_id", hex_color(channel(3), channel(2), channel(1)).alias("pixel_color"))
    return (
        clicks.join(sampled, KEYS, "left")
        .join(single, ["image_id", "click_id"], "left")
        .select(*KEYS[:1], "click_id", "hold_index", F.when(F.col("hold_index").isNotNull(), F.col("area_color")).otherwise(F.col("pixel_color")).alias("color"))
    )


def pool_embeddings(tokens: DataFrame, coverage: DataFrame, pooling: str = "weighted") -> DataFrame:
    """Unit-length mean of the patch tokens under each mask.

    tokens: image_id, patch_id, token.  coverage: image_id, hold_index, patch_id, weight.
    ``mean`` counts every touched patch once.
    """
    if pooling not in {"weighted", "mean"}:
        raise ValueError("pooling must be weighted or mean")
    joined = coverage.filter(F.col("weight") > 0).join(tokens, ["image_id", "patch_id"])
    mean = mean_vector("token", "weight" if pooling == "weighted" else None)
    return joined.groupBy("image_id", "hold_index").agg(mean.alias("m")).select(
        "image_id", "hold_index", unit(F.col("m")).alias("embedding")
    )


def stale_features(current: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``current`` (key, signature, ...) whose signature the cache does not hold."""
    return current.join(cache.select("key", "signature"), ["key", "signature"], "left_anti")


def merge_features(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def signature(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)
