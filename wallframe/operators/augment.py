"""Image distortions on scanlines (image_id, y, bytes; see ``scanlines``).

Targets of one image apply in order.  Recolouring needs the median of a target as the targets
before it left it, so targets get a layer: one more than the highest layer of an earlier target they
overlap.  Each layer edits slices of the lines it touches; a line leaves the rounds after its last
layer.  Chalk depends on the pixel alone, so all its targets apply in one pass over a line.
Only images with a target are recoloured or chalked, all others are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.color import rgb_to_hls
from ..functions.color_arrays import cut_byte
from ..store import discard, materialize
from .masks import spans
from .overlap import span_iou
from .scanlines import KEYS, binary, count_values, cut_lines, flat, from_hls, statistics, to_hls

RGB = ["r", "g", "b"]
LINE = ["image_id", "y", "bytes"]
NOISE_CELL = 24
# Fixed value: sharpness of the bicubic kernel.
CUBIC = -0.75
# Luminance weights of the red, green and blue channel.
LUMINANCE = (0.2126, 0.7152, 0.0722)
# A linear congruential step modulo 2^31.
MULTIPLIER, INCREMENT, MASK = 1103515245, 12345, (1 << 31) - 1


def lighting(lines: DataFrame, strength: float | Column) -> DataFrame:
    """Scale all channels by 1 + strength; clip and truncate to bytes."""
    s = F.lit(float(strength)) if isinstance(strength, (int, float)) else strength

    def scale(column: pa.Array, by: pa.Array) -> pa.Array:
        pixels, lengths = flat(column)
        strengths, which = np.unique(np.asarray(by, np.float64), return_inverse=True)
        tables = cut_byte(np.arange(256) * (strengths[:, None] + 1.0))
        ends, out = np.cumsum(lengths), np.empty_like(pixels)
        for k, table in enumerate(which):
            out[ends[k] - lengths[k] : ends[k]] = tables[table][pixels[ends[k] - lengths[k] : ends[k]]]
        return binary(out, lengths)

    return lines.withColumn("bytes", arrow_udf(scale, "binary")(F.col("bytes"), s.cast("double")))


def layers(targets: DataFrame) -> tuple[DataFrame, int]:
    """(targets with ``layer`` from 0, number of layers); hold_index is the order within the image."""
    pending, left = materialize(targets)
    overlaps = span_iou(pending, pending, ordered_pairs=True)
    blocks, _ = materialize(overlaps.select("image_id", F.col("pred_idx").alias("earlier"), F.col("ann_idx").alias("hold_index")))
    done, number = None, 0
    while left:
        waits = blocks.join(pending.select("image_id", F.col("hold_index").alias("earlier")), ["image_id", "earlier"], "left_semi")
        free, _ = materialize(pending.join(waits, KEYS, "left_anti").withColumn("layer", F.lit(number)))
        before = pending
        pending, left = materialize(before.join(free.select(*KEYS), KEYS, "left_anti"))
        discard(before)
        done = free if done is None else done.unionByName(free)
        number += 1
    return (targets.limit(0).withColumn("layer", F.lit(0)) if done is None else done), number


def _with_targets(lines: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of images with a target, all other lines)."""
    # Stored, so that the optimiser knows its size.
    images, _ = materialize(targets.select("image_id").distinct())
    return lines.join(images, "image_id", "left_semi"), lines.join(images, "image_id", "left_anti")


EDITS = "array<struct<x0:int,x1:int,h:int,shift:double,s:int>>"


def _edited(column: pa.Array, edits: pa.Array) -> pa.Array:
    """Hue and saturation set and lightness moved in some slices of each line."""
    pixels, lengths = flat(column)
    out, ends = pixels.copy(), np.cumsum(lengths)
    for k, slices in enumerate(edits.to_pylist()):
        line = out[ends[k] - lengths[k] : ends[k]]
        for e in slices or ():
            part = line[max(e["x0"], 0) : e["x1"] + 1]
            part[:, 1] = cut_byte(part[:, 1] + e["shift"])
            part[:, 2], part[:, 0] = e["h"], e["s"]
    return binary(out, lengths)


def recolor_hls(coded: DataFrame, targets: DataFrame) -> DataFrame:
    """Recolour lines of hue, lightness and saturation.  targets: image_id, hold_index, runs, area, tr, tg, tb."""
    goal = dict(zip(("th", "tl", "ts"), rgb_to_hls(F.col("tr"), F.col("tg"), F.col("tb")), strict=True))
    ordered, number = layers(targets.select(*KEYS, "runs", "area", *goal_columns(goal)))
    placed = spans(ordered.select(*KEYS, "layer", "runs"))
    last = placed.groupBy("image_id", "y").agg(F.max("layer").alias("_last"))
    lines = coded.select(*LINE).join(last, ["image_id", "y"], "left")
    if not number:
        return lines.drop("_last")
    current, _ = materialize(lines)
    finished = current.filter(F.col("_last").isNull())
    for k in range(number):
        work = current.filter(F.col("_last") >= k)
        here = placed.filter(F.col("layer") == k).select(*KEYS, "y", "x0", "x1")
        # Lightness is the middle one of the three values of a pixel.
        middle = statistics(count_values(cut_lines(work, here).select(*KEYS, "bytes"), "stored")).select(*KEYS, "m1")
        aims = ordered.filter(F.col("layer") == k).join(middle, KEYS).select(*KEYS, "th", "ts", (F.col("tl") - F.col("m1")).alias("shift"))
        slices = F.struct("x0", "x1", F.col("th").alias("h"), "shift", F.col("ts").alias("s"))
        edits = here.join(aims, KEYS).groupBy("image_id", "y").agg(F.collect_list(slices).cast(EDITS).alias("_edits"))
        edited = work.join(edits, ["image_id", "y"], "left").withColumn("bytes", arrow_udf(_edited, "binary")(F.col("bytes"), F.col("_edits"))).drop("_edits")
        current, _ = materialize(edited)
        finished = finished.unionByName(current.filter(F.col("_last") == k))
    return finished.drop("_last")


def goal_columns(goal: dict[str, Column]) -> list[Column]:
    return [value.alias(name) for name, value in goal.items()]


def recolor(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Hue and saturation of each target become its colour's; lightness keeps its shading.

    A recoloured image passes through 8-bit HLS as a whole, as untouched pixels do in the original operator.
    """
    active, others = _with_targets(lines.select(*LINE), targets)
    return from_hls(recolor_hls(to_hls(active), targets)).unionByName(others)


def mixed(h: np.ndarray, value: np.ndarray | int) -> np.ndarray:
    """One step of the integer hash: below 2^31 in and out."""
    h = ((h ^ (value & MASK)) * MULTIPLIER + INCREMENT) & MASK
    return h ^ (h >> 15)


def _cubic_weights(t: np.ndarray) -> list[np.ndarray]:
    a = CUBIC

    def outer(d: np.ndarray) -> np.ndarray:
        return ((d * a - 5.0 * a) * d + 8.0 * a) * d - 4.0 * a

    def inner(d: np.ndarray) -> np.ndarray:
        return ((d * (a + 2.0) - (a + 3.0)) * d) * d + 1.0

    return [outer(t + 1.0), inner(t), inner(1.0 - t), outer(2.0 - t)]


def chalk_density(seed: int, image: int, hold: int, y: int, x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Density of one line at ``x``: coarse noise scaled up by a bicubic kernel, clipped and squared.

    The noise of a cell is a hash of seed, image, target and cell.
    """

    def axis(at, size: int):
        cells = max(1, size // NOISE_CELL)
        source = (at + 0.5) * cells / size - 0.5
        base = np.floor(source)
        return base.astype(np.int64), source - base, cells

    (cy, ty, ny), (cx, tx, nx) = axis(np.array([y], np.float64), height), axis(x.astype(np.float64), width)
    key = mixed(mixed(mixed(np.array([0], np.int64), seed), image), hold)
    wx, value = _cubic_weights(tx), np.zeros(len(x))
    for j, wy in enumerate(_cubic_weights(ty)):
        row = mixed(key, int(np.clip(cy + j - 1, 0, ny - 1)[0]))
        noise = mixed(mixed(row, np.arange(nx)), 1) / float(MASK + 1)
        line = np.zeros(len(x))
        for i, w in enumerate(wx):
            line = line + w * noise[np.clip(cx + i - 1, 0, nx - 1)]
        value = value + wy[0] * line
    return np.clip(value, 0.0, 1.0) ** 2


def _chalked(seed: int):
    def run(column: pa.Array, ys: pa.Array, edits: pa.Array) -> pa.Array:
        pixels, lengths = flat(column)
        out, ends = pixels.copy(), np.cumsum(lengths)
        for k, (y, targets) in enumerate(zip(ys.to_pylist(), edits.to_pylist(), strict=True)):
            if not targets:
                continue
            line = out[ends[k] - lengths[k] : ends[k]]
            values = line[:, ::-1].astype(np.float64)
            for e in sorted(targets, key=lambda e: (e["hold_index"], e["x0"])):
                part = values[max(e["x0"], 0) : e["x1"] + 1]
                light = (part[:, 0] * LUMINANCE[0] + part[:, 1] * LUMINANCE[1] + part[:, 2] * LUMINANCE[2]) / 255.0
                visible = np.clip((light - 0.1) / 0.3, 0.0, 1.0)
                x = max(e["x0"], 0) + np.arange(len(part))
                density = chalk_density(seed, e["image"], e["hold_index"], y, x, e["width"], e["height"])
                part += (255.0 - part) * (density * visible * e["strength"])[:, None]
            line[:] = cut_byte(values)[:, ::-1]
        return binary(out, lengths)

    return run


def image_number(image_id: str = "image_id", kind: str = "bigint") -> Column:
    """Whole numbers below 2^31: an id modulo that, or the CRC-32 of a text."""
    if kind in {"tinyint", "smallint", "int", "bigint"}:
        return F.pmod(F.col(image_id).cast("bigint"), F.lit(MASK + 1))
    return F.pmod(F.crc32(F.col(image_id).cast("string").cast("binary")), F.lit(MASK + 1))


def chalk(lines: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Whiten bright target surfaces, leave dark ones alone.

    targets: image_id, hold_index, runs, area, width, height, strength in [0, 1].
    """
    kind = targets.schema["image_id"].dataType.simpleString()
    kept = targets.filter(F.col("strength") > 0).select(*KEYS, "runs", "width", "height", "strength", image_number(kind=kind).alias("image"))
    slices = F.struct(F.col("hold_index").cast("bigint").alias("hold_index"), "x0", "x1", "image", "width", "height", F.col("strength").cast("double").alias("strength"))
    edits = spans(kept).groupBy("image_id", "y").agg(F.collect_list(slices).alias("_edits"))
    return (
        lines.select(*LINE)
        .join(edits, ["image_id", "y"], "left")
        .withColumn("bytes", arrow_udf(_chalked(seed), "binary")(F.col("bytes"), F.col("y"), F.col("_edits")))
        .drop("_edits")
    )


def step_seed(seed: int, step: int) -> int:
    """Independent seed of each step of a plan."""
    return (seed * 1_000_003 + step * 7_919 + 17) % 2_147_483_647


def apply_plan(lines: DataFrame, plan: Sequence[tuple[str, object]], seed: int = 0) -> DataFrame:
    """Apply ("lighting", strength), ("color", targets) and ("chalk", targets) steps in order.

    The plan is configuration, so the loop builds one lazy plan; lineage is cut every four steps.
    """
    for number, (kind, value) in enumerate(plan):
        if kind == "lighting":
            lines = lighting(lines, value)
        elif kind == "color":
            lines = recolor(lines, value)
        elif kind == "chalk":
            lines = chalk(lines, value, step_seed(seed, number))
        else:
            raise ValueError(f"unknown recipe {kind!r}")
        if number % 4 == 3:
            lines, _ = materialize(lines)
    return lines


def bind_recipes(requests: DataFrame, holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bound, orphans): requests joined to their segment; unknown ids are reported."""
    keys = ["image_id", "hold_index"]
    return requests.join(holds, keys), requests.join(holds, keys, "left_anti")


def plan_from_requests(requests: DataFrame, lights: DataFrame) -> DataFrame:
    """Recipe rows in their fixed order: colour, then chalk, then lighting.

    requests: image_id, hold_index, chalk_percent, r, g, b (null colour = unchanged).
    lights: image_id, lighting, source_pixel_hash, pixel_hash; lighting 0 is left out.  The hash of the
    original pixels stays attached.
    """
    null = lambda kind: F.lit(None).cast(kind)
    columns = lambda step, kind, strength, **rgb: [
        F.col("image_id"),
        F.lit(step).alias("step"),
        F.lit(kind).alias("kind"),
        (F.col("hold_index") if kind != "lighting" else null("bigint")).cast("bigint").alias("hold_index"),
        strength.cast("double").alias("strength"),
        *[rgb.get(c, null("int")).cast("int").alias(c) for c in RGB],
    ]
    color = requests.filter(F.col("r").isNotNull()).select(
        *columns(0, "color", null("double"), **{c: F.col(c) for c in RGB})
    )
    chalked = requests.select(*columns(1, "chalk", F.col("chalk_percent") / 100.0))
    light = lights.filter(F.col("lighting") != 0).select(*columns(2, "lighting", F.col("lighting")))
    hashes = lights.select("image_id", F.coalesce("source_pixel_hash", "pixel_hash").alias("source_pixel_hash"))
    return color.unionByName(chalked).unionByName(light).join(hashes, "image_id", "left")
