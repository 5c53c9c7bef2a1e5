"""Pixels as scanlines: image_id, y, bytes, with three bytes (blue, green, red) per pixel.

Spans of masks meet lines on (image, y), so an image is never held by one task and no pixel
becomes a row.  Spans are cut from their line before any byte is decoded; Arrow functions then work on a
million pixels at a time and report counts of channel values, at most 256 per channel and mask.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.color_arrays import hls8, lab8, rgb8
from .masks import spans

CHUNK = 1 << 20
KEYS = ["image_id", "hold_index"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pixels as rows of three bytes, pixels per value) of a binary column without nulls."""
    values = column.to_pylist()
    lengths = np.array([len(v) // 3 for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 3), lengths


def binary(pixels: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Inverse of ``flat``."""
    ends = np.r_[0, np.cumsum(lengths) * 3].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(pixels, np.uint8).tobytes())])


def chunks(batch: pa.RecordBatch, column: str = "bytes") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``CHUNK`` pixels, or one line."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64) // 3
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > CHUNK:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def recoded(lines: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``lines`` with every pixel passed through ``change`` (rows of three bytes)."""

    def run(column: pa.Array) -> pa.Array:
        pixels, lengths = flat(column)
        parts = [change(pixels[k : k + CHUNK]) for k in range(0, len(pixels), CHUNK)]
        return binary(np.concatenate(parts) if parts else pixels, lengths)

    return lines.withColumn("bytes", arrow_udf(run, "binary")(F.col("bytes")))


def pack_pixels(pixels: DataFrame) -> DataFrame:
    """Lines of a table of pixels (image_id, y, x, r, g, b) that has every x from 0 on."""
    hexed = F.concat(*[F.lpad(F.hex(F.col(c).cast("bigint")), 2, "0") for c in ("b", "g", "r")])
    placed = F.array_sort(F.collect_list(F.struct("x", hexed.alias("p"))))
    return pixels.groupBy("image_id", "y").agg(F.unhex(F.array_join(placed["p"], "")).alias("bytes"))


def unpack_pixels(lines: DataFrame, names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """image_id, y, x and three channels: one row per pixel, for output only."""
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in chunks(batch)):
            pixels, lengths = flat(part.column("bytes"))
            owner = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            x = np.arange(len(pixels)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            channels = [pa.array(pixels[:, k].astype(np.int32)) for k in (2, 1, 0)]
            yield pa.RecordBatch.from_arrays(
                [part.column("image_id").take(owner), part.column("y").take(owner), pa.array(x.astype(np.int32)), *channels],
                names=["image_id", "y", "x", *names],
            )

    schema = f"image_id {kinds['image_id']}, y {kinds['y']}, x int, " + ", ".join(f"{n} int" for n in names)
    return lines.select("image_id", "y", "bytes").mapInArrow(decode, schema)


# How the three values that are counted come from a line's bytes.
SPACES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "rgb": lambda bgr: bgr[:, ::-1],
    "lab": lambda bgr: lab8(bgr[:, ::-1]),
    "stored": lambda values: values[:, ::-1],
}


def cut_lines(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` (image_id, y, x0, x1, ...) with the bytes of their pixels; parts beyond the line are cut."""
    first = F.greatest(F.col("x0"), F.lit(0))
    cut = F.substring(F.col("bytes"), first * 3 + 1, (F.col("x1") - first + 1) * 3)
    return parts.filter("x1 >= 0").join(lines.select("image_id", "y", "bytes"), ["image_id", "y"]).withColumn("bytes", cut).filter(F.octet_length("bytes") > 0)


def color_counts(lines: DataFrame, masks: DataFrame, space: str = "rgb") -> DataFrame:
    """image_id, hold_index, code, n: how often each value (256 x channel + value) occurs inside each mask."""
    return count_values(cut_lines(lines, spans(masks.select(*KEYS, "runs"))).select(*KEYS, "bytes"), space)


def count_values(parts: DataFrame, space: str) -> DataFrame:
    if space not in SPACES:
        raise ValueError("space must be rgb or lab")
    convert = SPACES[space]
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in chunks(batch)):
            pixels, lengths = flat(part.column("bytes"))
            image, hold = [part.column(name).dictionary_encode() for name in KEYS]
            both = np.asarray(image.indices.fill_null(-1)).astype(np.int64) * (len(hold.dictionary) + 1) + np.asarray(hold.indices.fill_null(-1))
            _, first, owner = np.unique(both, return_index=True, return_inverse=True)
            codes = convert(pixels).astype(np.int64) + np.arange(3) * 256
            found, n = np.unique(np.repeat(owner, lengths)[:, None] * 768 + codes, return_counts=True)
            rows = pa.array(first[found // 768])
            yield pa.RecordBatch.from_arrays(
                [part.column("image_id").take(rows), part.column("hold_index").take(rows), pa.array((found % 768).astype(np.int32)), pa.array(n.astype(np.int64))],
                names=[*KEYS, "code", "n"],
            )

    schema = f"image_id {kinds['image_id']}, hold_index {kinds['hold_index']}, code int, n bigint"
    partial = parts.select(*KEYS, "bytes").mapInArrow(count, schema)
    return partial.groupBy(*KEYS, "code").agg(F.sum("n").alias("n"))


STATISTICS = "struct<m0:double,m1:double,m2:double,c0:double,c1:double,c2:double>"


def _statistics(codes: pa.Array, counts: pa.Array) -> pa.Array:
    """Median and mean of each channel, from its counts."""
    sizes = np.asarray(pc.list_value_length(codes)).astype(np.int64)
    columns = []
    for start in range(0, len(sizes), 4096):
        size = sizes[start : start + 4096]
        table = np.zeros((len(size), 768), np.int64)
        row = np.repeat(np.arange(len(size)), size)
        table[row, np.asarray(codes.slice(start, 4096).flatten())] = np.asarray(counts.slice(start, 4096).flatten())
        table = table.reshape(-1, 3, 256)
        upto = table.cumsum(axis=2)
        total = upto[:, :, -1:]
        low, high = [(upto <= middle).sum(axis=2) for middle in ((total - 1) // 2, total // 2)]
        columns.append(np.concatenate([(low + high) / 2, (table * np.arange(256)).sum(axis=2) / total[:, :, 0]], axis=1))
    found = np.concatenate(columns) if columns else np.zeros((0, 6))
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(6)], names=["m0", "m1", "m2", "c0", "c1", "c2"])


def statistics(counts: DataFrame) -> DataFrame:
    """image_id, hold_index, medians m0..m2 and means c0..c2 of ``color_counts``."""
    lists = counts.groupBy(*KEYS).agg(F.collect_list(F.struct("code", "n")).alias("all"))
    found = arrow_udf(_statistics, STATISTICS)(F.col("all.code"), F.col("all.n"))
    return lists.select(*KEYS, found.alias("s")).select(*KEYS, "s.*")


def to_hls(lines: DataFrame) -> DataFrame:
    """Lines whose pixels are saturation, lightness and hue: the channels of red, green, blue in that place."""
    return recoded(lines, lambda bgr: hls8(bgr[:, ::-1])[:, ::-1])


def from_hls(lines: DataFrame) -> DataFrame:
    return recoded(lines, lambda slh: rgb8(slh[:, ::-1])[:, ::-1])
